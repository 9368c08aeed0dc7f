"""Versioned model store: commits by atomic creation, latest version by key, soft deletes, buffered run log, graph with keyed merge.

Data are written first, under names of their own, and become visible by one small file that can
be created only once (``create_once``). So writers at the same time never see or overwrite
each other's rows, and what a lost race or a crash leaves behind is in no listing.
"""

from __future__ import annotations

import atexit
import datetime
import hashlib
import json
import os
import uuid
import weakref
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.operators.matching import latest


# Files ----------------------------------------------------------------------------------------------------

class Files:
    """Small files of a folder on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.path().getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def create_once(self, name: str, text: str) -> bool:
        """Create a whole file, unless there is one of that name: of any number of writers exactly one succeeds, and no reader sees a part of it.

        A hidden file is written and then takes its name: by a hard link on local disks, elsewhere by the
        rename of a file system that refuses an existing target (as HDFS does, atomically).
        """
        target = self.path(name)
        self.fs.mkdirs(target.getParent())
        hidden = self.jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
        stream = self.fs.create(hidden, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                plain = lambda p: p.toUri().getPath()
                try:
                    os.link(plain(hidden), plain(target))
                    return True
                except FileExistsError:
                    return False
            return not self.fs.exists(target) and self.fs.rename(hidden, target)
        finally:
            self.fs.delete(hidden, False)


def name_of(text: str) -> str:
    """A file name for any text."""
    return hashlib.sha256(text.encode()).hexdigest()


class Conflict(Exception):
    """The version that a writer started from is no longer the latest."""


# The store ------------------------------------------------------------------------------------------------

class Store:
    """Tables under one folder. A save adds files and rewrites none."""

    HEAD = "id string, version int, name string, domain string, status string, updated_at timestamp, nodes bigint, data string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = Files(spark, self.folder)
        self._log = RunLog(spark, f"{self.folder}/log")

    def _read(self, name: str, schema: str) -> DataFrame:
        there = self.files.exists(name)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def _add(self, rows: DataFrame, name: str) -> None:
        """Further rows of a table that ``_read`` reads, in a folder of their own: jobs that append to one folder at once clear away each other's unfinished files."""
        rows.write.parquet(f"{self.folder}/{name}/{uuid.uuid4().hex}")

    @staticmethod
    def _slot(model_id: str) -> str:
        """A model's folder of commits."""
        return f"commits/{name_of(model_id)}"

    def heads(self) -> DataFrame:
        """A row for each committed version."""
        if not self.files.exists("commits"):
            return self.spark.createDataFrame([], self.HEAD)
        return self.spark.read.schema(self.HEAD).json(f"{self.folder}/commits/*/*.json")

    def versions(self, model_id: str) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(self._slot(model_id)) if n.endswith(".json") and not n.startswith(".")]

    def save(self, model_id: str, name: str, domain: str, nodes: DataFrame, status: str = "draft", expected: int | None = None) -> int:
        """Commit the next version; ``nodes``: kind, id and any further columns. Un-deletes.

        Rows are written once, then the version's file is created; if another writer was first, the next number is
        tried with the same rows. With ``expected`` (0: none yet), the save fails with ``Conflict`` unless that is the latest version.
        """
        data = uuid.uuid4().hex
        own = max(self.versions(model_id), default=0)
        if expected is not None and own != expected:
            raise Conflict(f"{model_id} is at version {own}, not {expected}")
        nodes.write.parquet(f"{self.folder}/nodes/{data}")
        n = self.spark.read.parquet(f"{self.folder}/nodes/{data}").count()
        head = {"id": model_id, "name": name, "domain": domain, "status": status, "nodes": n, "data": data}
        version = own + 1
        while not self.files.create_once(f"{self._slot(model_id)}/{version:010d}.json", json.dumps({**head, "version": version, "updated_at": datetime.datetime.now(datetime.timezone.utc).isoformat()}) + "\n"):
            if expected is not None:
                self.files.delete(f"nodes/{data}")
                raise Conflict(f"{model_id} is beyond version {expected}")
            version += 1
        self._mark(model_id, False)
        return version

    def publish(self, model_id: str, exclude_rejected: bool = False) -> int:
        head = self.get(model_id)
        nodes = self.nodes(model_id, head["version"]).drop("model_id", "version")
        if exclude_rejected and "review" in nodes.columns:
            nodes = nodes.where(~F.col("review").eqNullSafe("rejected"))
        return self.save(model_id, head["name"], head["domain"], nodes, "published")

    def _mark(self, model_id: str, deleted: bool) -> None:
        row = self.spark.range(1).select(F.lit(model_id).alias("id"), F.lit(deleted).alias("deleted"), F.current_timestamp().alias("at"))
        self._add(row, "deleted")

    def delete(self, model_id: str) -> None:
        """Hides the model from ``list``; ``get`` still finds it."""
        self._mark(model_id, True)

    def list(self, domain: str | None = None) -> DataFrame:
        """Latest version of each model that is not deleted, newest first."""
        gone = latest(self._read("deleted", "id string, deleted boolean, at timestamp"), "id", "at").where("deleted")
        rows = latest(self.heads(), "id", "version").join(gone, "id", "left_anti")
        return (rows.where(F.col("domain") == domain) if domain else rows).orderBy(F.desc("updated_at"))

    def get(self, model_id: str, version: int | None = None):
        """A version's head (the latest without a number), or none: one small file is read."""
        known = self.versions(model_id)
        version = version or max(known, default=None)
        if version not in known:
            return None
        return json.loads(self.files.read(f"{self._slot(model_id)}/{version:010d}.json"))

    def nodes(self, model_id: str, version: int) -> DataFrame:
        """One version's nodes; only its files are read."""
        head = self.get(model_id, version)
        if head is None:
            raise KeyError(f"{model_id} has no version {version}")
        return self.spark.read.parquet(f"{self.folder}/nodes/{head['data']}").withColumns({"model_id": F.lit(model_id), "version": F.lit(version)})

    def sweep(self) -> int:
        """Remove rows that no commit names, as a crash between writing and commit leaves them. Not while others save."""
        named = {r["data"] for r in self.heads().select("data").collect()}  # a short name a version
        lost = [n for n in self.files.names("nodes") if n not in named]
        for n in lost:
            self.files.delete(f"nodes/{n}")
        return len(lost)

    STATE = "key string, json string, at timestamp, nth bigint"

    def put_state(self, rows: DataFrame) -> None:
        """Side state (``key``, ``json``) as further rows; earlier ones of a key stay behind it."""
        nth = self._read("state", self.STATE).agg(F.max("nth")).first()[0] or 0
        self._add(rows.select("key", "json", F.current_timestamp().alias("at"), F.lit(nth + 1).cast("bigint").alias("nth")), "state")

    def state(self) -> DataFrame:
        """The last value of each key."""
        return latest(self._read("state", self.STATE), "key", "nth").select("key", "json")

    def log(self, run_id: str, message: str, category: str = "step") -> None:
        self._log.add(run_id, message, category)

    def run_log(self) -> DataFrame:
        return self._log.rows()


# The log --------------------------------------------------------------------------------------------------

class RunLog:
    """Lines of runs, appended in blocks. A block is a folder, and blocks beyond ``MOST`` are merged into one base, of as many files as it fills.

    Lines wait in memory until there are ``LINES`` of them or the oldest is ``SECONDS`` old at the next line, and are written when the log is
    read, flushed or dropped. Logging never stops a run: where the folder can't be written, lines are given up.
    """

    ROW = "run_id string, at timestamp, category string, message string"
    LINES, SECONDS, MOST = 20_000, 30, 8
    #: Bytes of a merged base's files, so that no task reads the whole log.
    FILE = 16 << 20

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.held, self.off = spark, folder, [], False
        self.files = Files(spark, folder)
        me = weakref.ref(self)
        atexit.register(lambda: (log := me()) and log.flush())

    def add(self, run_id: str, message: str, category: str = "step") -> None:
        now = datetime.datetime.now(datetime.timezone.utc)
        self.held.append((run_id, now, category, message))
        if len(self.held) >= self.LINES or (now - self.held[0][1]).total_seconds() >= self.SECONDS:
            self.flush()

    def flush(self) -> None:
        lines, self.held = self.held, []
        if lines:
            self.append(lambda: self.spark.createDataFrame(lines, self.ROW).coalesce(1))

    def append(self, rows) -> None:
        """A block of lines that a job makes (``run_id``, ``at``, ``category``, ``message``), or a function that gives them."""
        if self.off:
            return
        try:
            rows = rows() if callable(rows) else rows
            self._write(rows.select(*[c.split()[0] for c in self.ROW.split(", ")]), f"blocks/{uuid.uuid4().hex}")
            if len(self._blocks()) > self.MOST:
                self.compact()
        except Exception:  # noqa: BLE001  a log that can't be written must not stop what it tells about
            self.off = True

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.parquet(f"{self.folder}/{name}")

    def _base(self) -> dict:
        """The newest base and the blocks it has taken in."""
        names = [n for n in self.files.names("bases") if n.endswith(".json") and not n.startswith(".")]
        return json.loads(self.files.read(f"bases/{names[-1]}")) | {"nth": int(names[-1][:-5])} if names else {"data": None, "taken": [], "nth": 0}

    def _blocks(self) -> list[str]:
        taken = set(self._base()["taken"])
        # A block is there once its job has committed.
        return [n for n in self.files.names("blocks") if n not in taken and self.files.exists(f"blocks/{n}/_SUCCESS")]

    def _parts(self, base: dict, blocks: list[str]) -> list[str]:
        return [f"{self.folder}/{n}" for n in ([f"merged/{base['data']}"] if base["data"] else []) + [f"blocks/{n}" for n in blocks]]

    def _files_for(self, parts: list[str]) -> int:
        size = sum(self.files.fs.getContentSummary(self.files.jvm.org.apache.hadoop.fs.Path(p)).getLength() for p in parts)
        return max(1, -(-size // self.FILE))

    def compact(self) -> bool:
        """Merge all blocks into a new base. Of two that do so at once one wins; readers see each line once throughout."""
        base, blocks = self._base(), self._blocks()
        if not blocks:
            return False
        data = uuid.uuid4().hex
        self._write(self.spark.read.schema(self.ROW).parquet(*(parts := self._parts(base, blocks))).repartition(self._files_for(parts)), f"merged/{data}")
        if not self.files.create_once(f"bases/{base['nth'] + 1:010d}.json", json.dumps({"data": data, "taken": blocks})):
            self.files.delete(f"merged/{data}")
            return False
        for n in blocks:
            self.files.delete(f"blocks/{n}")
        if base["data"]:
            self.files.delete(f"merged/{base['data']}")
        return True

    def rows(self) -> DataFrame:
        self.flush()
        parts = self._parts(self._base(), self._blocks())
        return self.spark.read.schema(self.ROW).parquet(*parts) if parts else self.spark.createDataFrame([], self.ROW)


def stamped(rows: DataFrame) -> DataFrame:
    """Each row as one line of text with its local time."""
    one = F.trim(F.regexp_replace("message", r"[\r\n]+", " "))
    return rows.select("run_id", "at", F.concat(F.lit("["), F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS Z"), F.lit("] ["), "category", F.lit("] "), one).alias("line"))


def call_line(task, provider, model, ok, prompt=None, completion=None, total=None, millis=None, error=None, note=None, module=None):
    """The message of a model call. Arguments are columns; those that are null are left out."""
    part = lambda before, c, after="": F.coalesce(F.concat(F.lit(before), c.cast("string"), F.lit(after)), F.lit("")) if c is not None else F.lit("")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("string") if c is not None else F.lit("0")
    some = F.coalesce(*[c for c in (prompt, completion, total) if c is not None], F.lit(None)).isNotNull()
    tokens = F.when(some, F.concat(F.lit(" tokens(prompt="), number(prompt), F.lit(", completion="), number(completion), F.lit(", total="), number(total), F.lit(")"))).otherwise("")
    said = F.trim(F.regexp_replace(error, r"[\r\n]+", " ")) if error is not None else None
    status = F.when(ok, "ok").otherwise(F.concat(F.lit("ERROR"), part(": ", said)))
    return F.concat(F.lit("task="), task, part(" module=", module), F.lit(" provider="), provider, F.lit(" model="), model, tokens, part(" ", millis, "ms"), F.lit(" "), status, part(" [", note, "]"))


# The graph ------------------------------------------------------------------------------------------------

class Graph:
    """Nodes (``label``, ``id``, JSON ``props``) and edges (``type``, ``source``, ``target``, ``props``) merged by their keys.

    An import adds files to the buckets (by hash of the key) that it touches and rewrites none. Reading takes each key's row
    of the highest ``seq`` (the version the import is of; equal ones by their props), so any number of imports in any order
    give the same graph. ``compact`` rewrites only buckets of more than ``most`` files. An edge is there while both its ends are.
    """

    KEYS = {"nodes": ["label", "id"], "edges": ["type", "source", "target"]}

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.files = Files(spark, self.folder)

    def merge(self, nodes: DataFrame, edges: DataFrame, source: str, seq: int) -> bool:
        """Merge one import; False where ``source`` has been imported at ``seq`` before (then nothing is written). Rows of a null key part are none."""
        mark = f"imports/{name_of(source)}-{seq:010d}.json"
        if self.files.exists(mark):
            return False
        name = uuid.uuid4().hex
        for kind, rows in (("nodes", nodes), ("edges", edges)):
            keys = self.KEYS[kind]
            whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
            own = rows.where(whole).select(*keys, F.coalesce("props", F.lit("{}")).alias("props")).groupBy(*keys).agg(F.max("props").alias("props"))
            own = own.withColumns({"seq": F.lit(seq).cast("bigint"), "bucket": F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")})
            own.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{kind}/{name}")
        # Rows count from here on; a crash before leaves none of them visible.
        return self.files.create_once(mark, json.dumps({"data": name}))

    def _parts(self, kind: str) -> list[str]:
        """Imports of ``kind`` that count: committed ones and what compaction made of them, without what that took in."""
        found = [json.loads(self.files.read(f"imports/{n}")) for n in self.files.names("imports") if n.endswith(".json") and not n.startswith(".")]
        return [x["data"] for x in found if self.files.exists(f"{kind}/{x['data']}")]

    def _rows(self, kind: str) -> DataFrame:
        schema = ", ".join(f"{k} string" for k in self.KEYS[kind]) + ", props string, seq bigint, bucket int"
        parts = self._parts(kind)
        if not parts:
            return self.spark.createDataFrame([], schema)
        # Each import keeps its own root, so that buckets are read as a column.
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.folder}/{kind}/{p}") for p in parts])

    def _merged(self, kind: str) -> DataFrame:
        keys = self.KEYS[kind]
        return self._rows(kind).groupBy("bucket", *keys).agg(F.max(F.struct("seq", "props")).alias("r")).select(*keys, "r.props", "r.seq", "bucket")

    def nodes(self) -> DataFrame:
        return self._merged("nodes").select("label", "id", "props")

    def edges(self) -> DataFrame:
        ends = self._merged("nodes").select("id").distinct()
        held = self._merged("edges").join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(ends.withColumnRenamed("id", "target"), "target", "left_semi")
        return held.select("type", "source", "target", "props")

    def files_of(self, kind: str) -> dict[int, list[str]]:
        """Folders of each bucket."""
        out: dict[int, list[str]] = {}
        for p in self._parts(kind):
            for b in self.files.names(f"{kind}/{p}"):
                if b.startswith("bucket="):
                    out.setdefault(int(b[7:]), []).append(f"{p}/{b}")
        return out

    def compact(self, kind: str, most: int = 4) -> list[int]:
        """Rewrite the buckets of more than ``most`` imports as one each; the others stay as they are. One at a time, and not while others read."""
        full = {b: parts for b, parts in self.files_of(kind).items() if len(parts) > most}
        if not full:
            return []
        name = uuid.uuid4().hex
        self._merged(kind).where(F.col("bucket").isin(list(full))).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{kind}/{name}")
        self.files.create_once(f"imports/{name}.json", json.dumps({"data": name}))
        # Until these are gone, rows are there twice, which merging on read does not mind.
        for parts in full.values():
            for p in parts:
                self.files.delete(f"{kind}/{p}")
        return sorted(full)


def export_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes (label, id, ...) and edges (type, source, target, ...), each once, by label and type."""
    nodes.dropDuplicates(["label", "id"]).write.mode("overwrite").partitionBy("label").parquet(f"{folder}/nodes")
    ends = nodes.select("id").distinct()
    held = edges.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(ends.withColumnRenamed("id", "target"), "target", "left_semi")
    held.dropDuplicates(["type", "source", "target"]).write.mode("overwrite").partitionBy("type").parquet(f"{folder}/edges")
