"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Words are cut as in ``simhash`` (A-Z in lower case, between ASCII white space). A document's
set holds its distinct shingles of ``words`` words; a text of fewer words is one shingle as a
whole, a text without words (or none) has the empty set and is linked with nothing. Two
documents link if 100 * |intersection| >= ``percent`` * |union|.

Sketch: ``T`` coordinates. In round i < ``T`` each shingle falls into one bin by a hash of
the round and every bin still empty takes the smallest value in it; in rounds from ``T`` on
each shingle falls into bin i - ``T``. So every coordinate is filled after 2 * ``T`` rounds,
in fact after few for sets of some size, and coordinates agree with the similarity as their
chance, concentrated as for independent ones. Bands of coordinates are hashed to keys; by
``layout`` a pair at the threshold shares no key with a chance under one in a million.

Documents of equal sets are one point, so exact copies cost a row each and nothing more.
Points of a key are a bucket. Within a bucket, one bit of each coordinate is compared
(differing bits must stay within five deviations of what the threshold lets expect), and the
sizes of the sets; a bucket hands on the shortest spanning forest of what fits. What such steps connect is
a cluster, so any pair that may link lies in one, and each point's full set travels once, to its cluster.
There all pairs that fit are decided on the full sets, and only links that join what was
apart are handed on: no table of pairs is ever made.

Buckets and clusters over one block go to tasks in blocks of bounded weight. Buckets are compared
by pairs of blocks. Large clusters are first cut into blocks in two ways, which joins most of a dense group, and
then only what is outside a cluster's largest component meets all of its blocks.

Result for each row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable) and
``kept``. Repeated rows are rows of their own; a null id counts as the smallest only where
its component has no other id (and is kept then); other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import look_up, materialise, table, tasks, trimmed
from provenir.llm.simhash import NO_ID, connect, forest

WORDS, PERCENT = 4, 80
#: Coordinates of a sketch; one bit of each makes ``BITS`` words of 64.
T = 192
BITS = T // 64
#: Chance that a pair at the threshold shares no band.
MISS = 1e-6
#: Points of a bucket that are compared at once, and rows in a comparison.
BLOCK, ROWS = 2048, 256
#: Weight of a block of a cluster: its shingles and ``EACH`` for each set.
WEIGHT, EACH = 1 << 20, 256
#: Shingles that are sketched at once, and rows of keys that a task sorts.
AT_ONCE, SORTED = 1 << 17, 1 << 20
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def layout(percent: int) -> tuple[int, int]:
    """Bands and coordinates in each: the longest bands that ``MISS`` allows."""
    for r in range(16, 0, -1):
        if (1 - (percent / 100) ** r) ** (T // r) <= MISS:
            return T // r, r
    raise ValueError(f"similarity of {percent} % is too low for sketches of {T}")


def most_bits(percent: int) -> int:
    """Bits in which sketches of linked sets differ at most: five deviations above the mean at the threshold."""
    q = (1 - percent / 100) / 2
    return math.ceil(T * q + 5 * math.sqrt(T * q * (1 - q)))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    from xxhash import xxh3_64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    starts = [0]
    for p in parts:
        starts.append(starts[-1] + len(p) + 1)
    ends = starts[words:] if len(parts) > words else starts[-1:]
    return np.unique(np.array([xxh3_64_intdigest(joined[a : b - 1]) for a, b in zip(starts, ends)], np.uint64))


def mixed(z: np.ndarray) -> np.ndarray:
    """Draw 64 bits out of each number: shift and multiply."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``T`` coordinates for each set; empty sets keep ``NONE``. A coordinate is its round and the smallest value in its bin."""
    out = np.full((len(sets), T), NONE)
    sizes = np.array([len(s) for s in sets])
    owner, h = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    flat, low = out.reshape(-1), np.uint64(0xFFFFFFFF)
    for i in range(2 * T):
        if not len(h):
            break
        z = mixed(h + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        at = owner * T + (((z >> np.uint64(32)) * np.uint64(T)) >> np.uint64(32)).astype(np.int64) if i < T else owner * T + (i - T)
        empty = flat[at] == NONE
        np.minimum.at(flat, at[empty], np.uint64(i << 32) | (z[empty] & low))
        left = np.zeros(len(sets), bool)
        ids = np.unique(owner)
        left[ids] = (out[ids] == NONE).any(axis=1)
        going = left[owner]
        if not going.all():
            owner, h = owner[going], h[going]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of each row, which names the band too."""
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64))[None, :], (len(sketch), bands)).copy()
    for k in range(rows):
        key = mixed(key * np.uint64(3) ^ mixed(sketch[:, k : bands * rows : rows]))
    return key


def bits_of(sketch: np.ndarray) -> np.ndarray:
    return np.packbits((mixed(sketch) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


W = [f"w{k}" for k in range(BITS)]
PRINTED = "doc_id bigint, text string, id bigint, sig binary, n bigint, keys array<bigint>, bits array<bigint>"


def sketcher(words: int, bands: int, rows: int):
    """Over ``doc_id``, ``text``, ``id``: with the set's name and size, and its band keys and bits."""

    def some(batch):
        from xxhash import xxh3_128_digest

        sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
        s = sketches(sets)
        keys, bits = band_keys(s, bands, rows).view(np.int64), bits_of(s).view(np.int64)
        offsets = lambda m: pa.array(np.arange(0, len(sets) * m + 1, m), pa.int32())
        made = [
            pa.array([xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()),
            pa.array(np.array([len(x) for x in sets], np.int64)),
            pa.ListArray.from_arrays(offsets(bands), pa.array(keys.reshape(-1))),
            pa.ListArray.from_arrays(offsets(BITS), pa.array(bits.reshape(-1))),
        ]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], names=[x.split()[0] for x in PRINTED.split(", ")])

    def run(batches):
        for batch in batches:
            # A shingle ends a word, so there are at most half as many as bytes.
            size = np.cumsum([len(t.as_buffer() or b"") // 2 if t.is_valid else 0 for t in batch.column(1).cast(pa.large_binary())])
            cuts = np.flatnonzero(np.diff(size // AT_ONCE, prepend=0)) if len(size) else []
            for a, b in zip([0, *cuts], [*cuts, len(size)]):
                if b > a:
                    yield some(batch.slice(a, b - a))

    return run


def meet(batches):
    """Over rows ``key``, ``id`` in order of keys: those whose key is a neighbour's, and those of the first and the last key, which may go on in other tasks."""
    first, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, id_ = (c.to_numpy() for c in batch.columns)
        if held is not None:
            key, id_ = np.concatenate([held[0], key]), np.concatenate([held[1], id_])
        else:
            first = key[0]
        same = key[1:] == key[:-1]
        keep = key == first
        keep[1:] |= same
        keep[:-1] |= same
        keep[-1] = False  # comes with the next batch, or at the end
        if held is not None and held[2]:
            keep[0] = True
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(id_[keep])], names=["key", "id"])
        held = (key[-1:], id_[-1:], bool(len(same) and same[-1]))
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["key", "id"])


def near(n: np.ndarray, block: np.ndarray, bits: np.ndarray, tile: tuple[int, int], percent: int, most: int):
    """Arrays ``a``, ``b``, ``d`` (indices and differing bits) of the pairs of a tile that may link: one end in each of its two blocks."""
    first, second = np.flatnonzero(block == tile[0]), np.flatnonzero(block == tile[1])
    for at in range(0, len(first), ROWS):
        own = first[at : at + ROWS]
        other = second[second > own[0]] if tile[0] == tile[1] else second
        d = np.zeros((len(own), len(other)), np.uint16)
        for w in bits:
            d += np.bitwise_count(w[own][:, None] ^ w[other][None, :])
        i, j = np.nonzero(d <= most)
        a, b, d = own[i], other[j], d[i, j].astype(np.int64)
        ok = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
        if tile[0] == tile[1]:
            ok &= a < b
        yield a[ok], b[ok], d[ok]


def ends(ids: np.ndarray, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b]))], names=["a", "b"])


def by_runs(search, keys: int):
    """Over rows in order of their first ``keys`` columns: ``search`` of the batches of each run."""

    def run(batches):
        at, held = None, []
        for got in batches:
            if not got.num_rows:
                continue
            cols = [c.to_numpy() for c in got.columns[:keys]]
            new = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols], axis=0)) + 1
            for x, y in zip([0, *new.tolist()], [*new.tolist(), got.num_rows]):
                own = tuple(int(c[x]) for c in cols)
                if held and own != at:
                    yield from search(held)
                    held = []
                at = own
                held.append(got.slice(x, y - x))
        if held:
            yield from search(held)

    return run


def column(held: list, k: int) -> np.ndarray:
    return np.concatenate([b.column(k).to_numpy() for b in held])


def tree(percent: int):
    """Over the rows of a tile of a bucket: the shortest spanning forest of what may link."""
    most = most_bits(percent)

    def cut(kept):
        a, b, d = (np.concatenate(x) for x in zip(*kept))
        k = forest(a, b, d)
        return [(a[k], b[k], d[k])]

    def search(held):
        _, low, high, block, ids, n, *bits = (column(held, k) for k in range(held[0].num_columns))
        kept, count = [], 0
        for a, b, d in near(n, block, [w.view(np.uint64) for w in bits], (int(low[0]), int(high[0])), percent, most):
            if len(a):
                kept.append((a, b, d))
                count += len(a)
            if count > 1_000_000:
                kept = cut(kept)
                count = len(kept[0][0])
        if kept:
            ((a, b, _),) = cut(kept)
            yield ends(ids, a, b)

    return search


def candidates(members: DataFrame, percent: int, block: int) -> DataFrame:
    """``a``, ``b``: ids that connect what may link, of the rows ``key``, ``size`` (points of the key), ``id``, ``n`` and bits."""
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = members.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    tiles = own.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiles = tiles.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "n", *W)
    dealt = tiles.repartition(tasks(members.sparkSession), "key", "low", "high").sortWithinPartitions("key", "low", "high", "id")
    return dealt.mapInArrow(trimmed(by_runs(tree(percent), 3)), "a bigint, b bigint").distinct()


def decide(percent: int):
    """Over the rows of a tile of a cluster: links, confirmed on the full sets, that join what is apart."""
    most = most_bits(percent)

    def search(held):
        _, low, high, block, ids, n, comp, *bits = (column(held, k) for k in range(7 + BITS))
        bits = [w.view(np.uint64) for w in bits]
        lists = [b.column(7 + BITS) for b in held]
        flat = np.unique(np.concatenate([x.flatten().to_numpy() for x in lists]), return_inverse=True)[1]
        starts = np.concatenate([[0], np.cumsum(n)])
        mark = np.zeros(int(flat.max(initial=0)) + 1, bool)
        label = np.unique(comp, return_inverse=True)[1]
        first, second = np.flatnonzero(block == low[0]), np.flatnonzero(block == high[0])
        a_of, b_of = [], []
        for a in first.tolist():
            other = second[second > a] if low[0] == high[0] else second
            other = other[(label[other] != label[a]) & (100 * np.minimum(n[a], n[other]) >= percent * np.maximum(n[a], n[other]))]
            d = np.zeros(len(other), np.uint16)
            for w in bits:
                d += np.bitwise_count(w[a] ^ w[other])
            other = other[d <= most]
            if not len(other):
                continue
            own = flat[starts[a] : starts[a + 1]]
            mark[own] = True
            size = n[other]
            at = np.cumsum(size) - size
            common = np.add.reduceat(mark[flat[np.repeat(starts[other] - at, size) + np.arange(size.sum())]], at, dtype=np.int64)
            mark[own] = False
            linked = other[100 * common >= percent * (n[a] + size - common)]
            if len(linked):
                found, at = np.unique(label[linked], return_index=True)
                a_of += [a] * len(at)
                b_of += linked[at].tolist()
                label[np.isin(label, found)] = label[a]
        if a_of:
            yield ends(ids, np.array(a_of), np.array(b_of))

    return search


def confirmed(tiles: DataFrame, percent: int, name: str) -> DataFrame:
    """Links within ``tiles``: rows ``cluster``, ``low``, ``high``, ``block``, ``id``, ``n``, ``comp``, bits and ``shingles``."""
    dealt = tiles.select("cluster", "low", "high", "block", "id", "n", "comp", *W, "shingles").repartition(tasks(tiles.sparkSession), "cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "id")
    return materialise(dealt.mapInArrow(trimmed(by_runs(decide(percent), 3)), "a bigint, b bigint"), name)


def set_maker(words: int):
    """Over rows that end with a text: its set in the text's place."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t, words).view(np.int64) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "shingles"])

    return run


def whole_clusters(gathered: DataFrame, nodes: DataFrame, percent: int, weight: int, known: DataFrame | None = None) -> DataFrame:
    """All links that matter within clusters; ``gathered``: rows ``cluster``, ``blocks`` (of its weight), ``id``, ``n``, bits and ``shingles``. ``known``: links found before, with ``comp`` in ``gathered``: their components."""
    one = lambda df, seed: df.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).cast("int")).withColumns({"low": F.col("block"), "high": F.col("block")})
    links = confirmed(one(gathered if known is not None else gathered.withColumn("comp", F.col("id")), 1), percent, "linked")
    joined = lambda: connect(nodes, links if known is None else links.union(known))
    large = gathered.where("blocks > 1")
    if not large.take(1):
        return links
    # The same again by another hash: components of blocks meet.
    found = joined()
    placed = lambda: large.join(found.select(F.col("fp").alias("id"), "top"), "id", "left").withColumn("comp", F.coalesce("top", "id")).drop("top")
    links = links.union(confirmed(one(placed(), 2), percent, "linked2"))
    found = joined()
    rows = materialise(placed(), "large")
    # What is outside the largest component of its cluster meets all blocks; clusters are few beside their rows, which are over a block each.
    sizes = rows.groupBy("cluster", "comp").agg(F.count("*").alias("m"), F.sum(F.col("n") + EACH).alias("w"))
    big = sizes.groupBy("cluster").agg(F.max_by("comp", F.struct("m", "comp")).alias("most"), F.sum("w").alias("all"), F.max_by("w", F.struct("m", "comp")).alias("own"))
    parts = lambda c: F.ceil(c / F.lit(weight)).cast("int")
    big = materialise(big.select("cluster", "most", parts(F.col("own")).alias("inside"), parts(F.col("all") - F.col("own")).alias("outside")).where("outside > 0"), "big")
    rows = look_up(rows, "cluster", big).where("outside IS NOT NULL")
    of = lambda c: F.pmod(F.xxhash64("id", F.lit(3)), F.col(c)).cast("int")
    rows = rows.withColumn("block", F.when(F.col("comp") == F.col("most"), F.col("outside") + of("inside")).otherwise(of("outside")))
    others = F.when(F.col("block") < F.col("outside"), F.sequence(F.lit(0), F.col("outside") + F.col("inside") - 1)).otherwise(F.sequence(F.lit(0), F.col("outside") - 1))
    tiles = rows.withColumn("other", F.explode(others)).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    return links.union(confirmed(tiles, percent, "rest"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, block: int = BLOCK, weight: int = WEIGHT) -> DataFrame:
    """A row for each row of ``df``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``."""
    bands, width = layout(percent)
    named = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("id"))
    rows = materialise(named.mapInArrow(trimmed(sketcher(words, bands, width)), PRINTED), "sketched")
    points = materialise(rows.where("n > 0").groupBy("sig").agg(F.min("id").alias("id"), F.min("doc_id").alias("low")), "points")

    bits = [F.col("bits")[k].alias(w) for k, w in enumerate(W)]
    reps = materialise(rows.select("id", F.col("n").cast("int").alias("n"), "keys", *bits).join(points.select("id"), "id", "left_semi"), "representatives")
    # Sorted by ranges of key and id, so that no task receives all rows of a key, and only rows that share a key go on.
    parts = max(tasks(df.sparkSession), -(-reps.count() * bands // SORTED))
    dealt = reps.select(F.explode("keys").alias("key"), "id").repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")
    shared = materialise(dealt.mapInArrow(trimmed(meet), "key bigint, id bigint"), "shared")
    buckets = materialise(shared.groupBy("key").agg(F.count("*").cast("int").alias("size")).where("size > 1"), "buckets")
    members = look_up(shared, "key", buckets).where("size > 1").select("key", "size", "id").join(reps.drop("keys"), "id")
    maybe = candidates(members, percent, block)

    nodes = points.select(F.col("id").alias("fp"), F.coalesce("low", F.lit(NO_ID)).alias("label"))
    clusters = connect(nodes, maybe).select(F.col("fp").alias("id"), F.col("top").alias("cluster")).join(reps.drop("keys"), "id")
    clusters = materialise(clusters, "clusters")
    sizes = materialise(clusters.groupBy("cluster").agg(F.ceil(F.sum(F.col("n") + EACH) / F.lit(weight)).cast("int").alias("blocks")), "cluster_sizes")
    sized = look_up(clusters, "cluster", sizes)
    gathered = sized.join(rows.select("id", "text"), "id").select("cluster", "blocks", "id", "n", *W, "text")
    schema = "cluster bigint, blocks int, id bigint, n int, " + ", ".join(f"{w} bigint" for w in W) + ", shingles array<bigint>"
    gathered = materialise(gathered.mapInArrow(trimmed(set_maker(words)), schema), "gathered")
    found = connect(nodes, whole_clusters(gathered, nodes, percent, weight))

    label = F.when(F.col("label") != NO_ID, F.col("label"))
    groups = points.join(found.select(F.col("fp").alias("id"), label.alias("reached"), F.lit(True).alias("linked")), "id", "left")
    groups = groups.select("sig", F.when(F.col("linked"), F.col("reached")).otherwise(F.col("low")).alias("component_id"))
    full = rows.where("n > 0").select("sig", "doc_id", "n").join(groups, "sig").select("doc_id", "n", "component_id")
    every = full.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), g AS (
  SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS s
  FROM w
), k AS (
  SELECT r, doc_id, CAST(len(s) AS BIGINT) AS n, min(r) OVER (PARTITION BY list_sort(s)) AS first, s FROM g
), n AS (
  SELECT r, doc_id, n, CASE WHEN n = 0 THEN r ELSE first END AS point FROM k
), e AS (
  SELECT r, n, hash(unnest(s)) AS x FROM k WHERE r = first
), c AS (
  SELECT a.r AS a, b.r AS b, a.n + b.n AS s, count(*) AS c
  FROM e AS a JOIN e AS b ON a.x = b.x AND a.r <> b.r AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY 1, 2, 3
), l AS (
  SELECT a, b FROM c WHERE 100 * c >= 80 * (s - c)
), reach(r, o) AS (
  SELECT point, point FROM n
  UNION
  SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.o
), m AS (
  SELECT reach.r AS point, min(o.doc_id) AS component_id FROM reach JOIN n AS o ON o.point = reach.o GROUP BY 1
)
SELECT doc_id, n AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM n JOIN m USING (point)
"""
