"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.sources.tables import forget, keep, read  # noqa: F401


#: Writes a table under the shared folder and reads it back: cuts the lineage, survives lost executors, and later passes see the very same rows.
materialise = keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, sf_dir, name)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def aside(df: DataFrame, taken: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns of the names ``taken`` renamed, and their old names by the new ones, to give back at the end."""
    used, moved = {c.lower() for c in df.columns} | taken, {}
    for c in df.columns:
        if c.lower() in taken:
            new = c
            while new.lower() in used:
                new += "_"
            used.add(new.lower())
            moved[c] = new
    return df.withColumnsRenamed(moved), {new: c for c, new in moved.items()}


#: Rows of a key from which it is a hot one, and how many hot keys there can be.
HOT, KEYS = 1000, 100_000


def look_up(rows: DataFrame, key: str, values: DataFrame, total: int | None = None) -> DataFrame:
    """``rows`` left joined with ``values`` (one row for each ``key``); ``total``: how many rows there are, where that is known.

    Keys with over ``HOT`` rows and over one in ``KEYS`` of all rows, which are ``KEYS`` at
    most, are joined by broadcast, so that no task receives all rows of a hot key.
    """
    total = rows.count() if total is None else total
    if total <= HOT:
        return rows.join(values, key, "left")
    hot = rows.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > max(HOT, total // KEYS)).select(key)
    known = materialise(values.join(hot, key), "hot")
    if not known.take(1):
        return rows.join(values, key, "left")
    apart = rows.join(F.broadcast(known.select(key)), key, "left_anti").join(values, key, "left")
    return apart.unionByName(rows.join(F.broadcast(known), key))


#: Rows in an Arrow batch: documents are some KB each, and a worker holds a few batches' worth at a time.
BATCH = 4000


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver found it outside PYTHONPATH; keep batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH", "")) if x)


def trimmed(run):
    """``run`` (over Arrow batches), after which the worker gives free memory back: workers are reused by later stages."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:  # another C library
            pass

    return wrapped
