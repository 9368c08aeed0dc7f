"""Two-pass external shuffle into shards, in DataFrame operations only.

Pass 1 scatters rows uniformly over memory-sized buckets by a seeded hash of their
contents. Pass 2 gathers each bucket, puts it into the order of those hashes, applies
Spark's seeded Fisher-Yates ``shuffle`` and writes it. Each shard is a range of the
whole order, whose prefix sums over bucket counts give shard and slot, so that shard
sizes differ by one row at most (law ``rows``) and a bucket lies in one shard or two.

The result depends on rows, seed and bucket size alone: not on how the input is split
or on the number of shuffle partitions. Rows that are equal in all columns can stand
for one another. Of those that are very many (more than ``COPIES``, and more than one in
``SHARE`` of all rows) the hash takes a number of the copy beside the contents, so they
are spread like all others: they are counted per content before the exchange and taken
apart after it, so that no task holds more than its share.

Null keys and texts, empty texts and repeated rows are rows like all others. An empty
table gives an empty result. Columns named ``shard``, ``slot`` or ``size`` in the input
are replaced; no other names are taken.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenir.llm.common import materialise, table

#: Buckets in one prefix-sum group, so that no window spans all buckets, and in one task of the second pass.
GROUP, IN_TASK = 1024, 8
#: Buckets up to which their starts (16 bytes each) are broadcast; beyond, they are joined by shuffle.
STARTS = 500_000
#: Contents with more copies than both bounds are spread: at most ``SHARE`` of them, so that their hashes (8 bytes each) can be broadcast.
COPIES, SHARE = 1000, 500_000


def shard_rows(df: DataFrame, n_shards: int, key: str, text: str, seed: int = 42, bucket_bytes: int = 2 << 20) -> DataFrame:
    """``df`` with ``size``, ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in its shard)."""
    kept = [c for c in df.columns if c not in ("shard", "slot", "size")]
    # The row travels as one struct, so that no working column can clash with its names.
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long")
    rows = df.select(F.struct(*kept).alias("row"), size.alias("size"), F.xxhash64(F.lit(seed), *kept).alias("hash"))
    total = rows.agg(F.sum(F.col("size") + 64).alias("bytes"), F.count("*").alias("n")).first()
    n_rows, n_buckets = total["n"], max(1, math.ceil((total["bytes"] or 0) / bucket_bytes))
    hot = rows.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > max(COPIES, n_rows // SHARE)).select(F.col("hash").alias("_hot"))
    hot = materialise(hot, "copies")

    # Pass 1. Copies of a hot content are counted before the exchange (in one row a task) and numbered after it.
    one = F.lit(0).cast("long")
    numbered = rows.withColumn("copy", one)
    if hot.take(1):
        is_hot = F.col("hash") == F.col("_hot")
        many = rows.join(F.broadcast(hot), is_hot, "left_semi").groupBy("row", "size", "hash").agg(F.count("*").alias("n"))
        many = many.select("row", "size", "hash", F.explode(F.sequence(one, F.col("n") - 1)).alias("copy"))
        numbered = rows.join(F.broadcast(hot), is_hot, "left_anti").withColumn("copy", one).unionByName(many)
    dealt = numbered.withColumn("bucket", F.pmod(F.xxhash64("hash", "copy", F.lit(seed)), F.lit(n_buckets)))

    # Pass 2: fixed order first, then Fisher-Yates with a fixed seed. The number of partitions depends on the rows alone,
    # and each draws from its own seed in order of its buckets.
    packed = dealt.repartition(max(1, math.ceil(n_buckets / IN_TASK)), "bucket").groupBy("bucket").agg(F.collect_list(F.struct("hash", "copy", "size", "row")).alias("rows"))
    order = lambda x, y, rest: F.when(x < y, -1).when(x > y, 1).otherwise(rest)
    before = lambda a, b: order(a["hash"], b["hash"], order(a["copy"], b["copy"], F.lit(0)))
    fixed = packed.withColumn("rows", F.array_sort("rows", before)).sortWithinPartitions("bucket")
    mixed = fixed.select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("i", "r"))
    written = materialise(mixed.select("bucket", "i", "r.size", "r.row"), "shuffled")

    counts = written.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("group", F.floor(F.col("bucket") / GROUP))
    inner = counts.withColumn("before", F.sum("n").over(Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    groups = counts.groupBy("group").agg(F.sum("n").alias("n"))
    # One row for each GROUP buckets, that is for each 2 GB of text: small enough for one window.
    outer = groups.select("group", F.sum("n").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)).alias("all_before"))
    start = inner.join(outer, "group").select("bucket", (F.coalesce("before", F.lit(0)) + F.coalesce("all_before", F.lit(0))).alias("start"))
    if n_buckets <= STARTS:
        start = F.broadcast(start)

    # The first ``extra`` shards hold one row more.
    least, extra = divmod(n_rows, n_shards)
    place, edge = F.col("start") + F.col("i"), extra * (least + 1)
    rest = place - edge
    shard = F.when(place < edge, F.floor(place / (least + 1))).otherwise(extra + F.floor(rest / max(least, 1)))
    slot = F.when(place < edge, place % (least + 1)).otherwise(rest % max(least, 1))
    return written.join(start, "bucket").select(*[F.col("row")[c].alias(c) for c in kept], "size", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_rows(table(spark, sf_dir, "documents"), 8, "doc_id", "text")
    return out.select("doc_id", "size", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
