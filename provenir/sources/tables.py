"""Tables of the driver's folder and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes up to which a table of few files is spread: it may be one row group, and so one task.
SPREAD = 64 << 20
#: Tables whose rows are texts, so that work on them outweighs the exchange.
TEXTS = ("documents", "pages", "conversations")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder. Texts in a few small files are dealt to all cores; larger tables have their own splits."""
    path = f"{folder}/{name}.parquet"
    df = spark.read.parquet(path)
    if name not in TEXTS:
        return df
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop)
    cores = spark.sparkContext.defaultParallelism
    if (1 << 20) < found.getLength() <= SPREAD and found.getFileCount() < cores:
        return df.repartition(cores)
    return df


def scratch(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="provenir-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_folders: dict[tuple, str] = {}


def own_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the application ends."""
    key = (spark.sparkContext.applicationId, scratch(spark))
    if key not in _folders:
        _folders[key] = f"{key[1]}/provenir/{key[0]}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders[key])
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return _folders[key]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back: a short plan for what follows, on storage that outlives executors, and the very same rows for all later passes."""
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``keep`` gave and nothing reads any more."""
    for file in df.inputFiles()[:1]:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
