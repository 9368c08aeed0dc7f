"""SimHash near-duplicates with BK-trees.

Fingerprints: A-Z in lower case, words between ASCII white space, shingles of
``words`` words with repeats (a shorter text is one shingle; a text without words
has fingerprint 0), XXH64 with seed 42 of each; a bit is set if it is set in over
half of the hashes. Two fingerprints link at ``radius`` or fewer differing bits.

Only distinct fingerprints are searched, so exact copies cost one row however many
there are. They are cut into shards: the 64 bits are split into ``radius + 2``
blocks (more, as the table grows), and two fingerprints that link agree in all blocks
but ``radius``, so each fingerprint goes to one shard for each choice of so many blocks. Each shard is a BK-tree
(children keyed by the Hamming distance to their parent), and a search follows only
edges within the radius; whole subtrees are searched for all their queries at once
in numpy. Shard trees travel by a shuffle and not by broadcast, since together
they grow with the corpus. A shard gives a star for each of its components, never all pairs.

A shard of more than ``SHARD`` fingerprints, as a huge group of near copies makes,
does not go to one task: its fingerprints are dealt again by every key within half
the radius (two linked fingerprints always share such a midpoint), which is linear
in their number and exact. Components then come from min-label propagation with
pointer jumping over a written table of links.

Null texts count as empty; repeated rows and null ids are rows of their own and
null ids are left out of the smallest id unless a component has no other. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenir.llm.common import aside, look_up, materialise, table, tasks, trimmed

WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints in a shard that one task searches; larger ones are dealt by midpoints.
SHARD = 32_768
#: Points below which a subtree is searched point by point.
LEAF = 48


def fingerprint(text: str | None, words: int = WORDS) -> int:
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxh64_intdigest(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    starts = [0]
    for p in parts:
        starts.append(starts[-1] + len(p) + 1)
    hashes = np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[words:])], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def printer(words: int, column: int):
    """Append each row's fingerprint; ``column``: the text's."""

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, words) for t in batch.column(column).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], names=[*batch.schema.names, "fp"])

    return run


def fingerprints(df: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """``df`` with ``fp``, the fingerprint's 64 bits as a long."""
    df = df.drop("fp")
    return df.mapInArrow(trimmed(printer(words, df.columns.index(text))), T.StructType([*df.schema.fields, T.StructField("fp", T.LongType())]))


def bk_links(points: np.ndarray, radius: int, first: int | None = None):
    """Arrays of indices of linked pairs, by a BK-tree over ``points`` that all of them search at once; with ``first``, a tree of the first so many that the others search."""
    stack = [(np.arange(len(points)), np.arange(len(points)))] if first is None else [(np.arange(first), np.arange(first, len(points)))]
    while stack:
        nodes, queries = stack.pop()
        if len(nodes) <= LEAF:
            near = np.bitwise_count(points[nodes][:, None] ^ points[queries][None, :]) <= radius
            a, b = np.nonzero(near)
            own = nodes[a] < queries[b]
            yield nodes[a][own], queries[b][own]
            continue
        pivot, rest = nodes[0], nodes[1:]
        far = np.bitwise_count(points[queries] ^ points[pivot]).astype(np.int64)
        hit = queries[(far <= radius) & (queries != pivot)]
        yield np.full(len(hit), pivot), hit
        edge = np.bitwise_count(points[rest] ^ points[pivot]).astype(np.int64)
        for e in np.unique(edge):
            asked = queries[np.abs(far - e) <= radius]
            if len(asked):
                stack.append((rest[edge == e], asked))


def components(n: int, links) -> np.ndarray:
    """Smallest index of each point's component."""
    parent = np.arange(n)
    for a, b in links:
        while len(a):
            x, y = parent[a], parent[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(parent, high, low)
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            apart = parent[a] != parent[b]
            a, b = a[apart], b[apart]
    return parent


def forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which of the edges make a shortest spanning forest."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    parent = list(range(len(ends)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for level in np.unique(d):
        own = np.flatnonzero(d == level)
        root = np.array([find(x) for x in range(len(ends))])
        for k in own[root[a[own]] != root[b[own]]].tolist():
            x, y = find(int(a[k])), find(int(b[k]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append(k)
    return np.array(kept, np.int64)


def search(radius: int):
    """Over rows sorted by shard: the star links of each shard."""

    def stars(points: np.ndarray):
        points = np.sort(points)
        if len(points) == 2:
            if int(points[0] ^ points[1]).bit_count() > radius:
                return None
            root = np.zeros(2, np.int64)
        else:
            root = components(len(points), bk_links(points, radius))
        own = root != np.arange(len(points))
        return (points[own], points[root[own]]) if own.any() else None

    def run(batches):
        held_key, held = None, []
        for batch in batches:
            keys, points = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held_key is not None and keys[a] != held_key:
                    done = np.concatenate(held) if len(held) > 1 else held[0]
                    if len(done) > 1 and (got := stars(done)):
                        out.append(got)
                    held = []
                held_key = keys[a]
                held.append(points[a:b])
            if out:
                yield link_batch(out)
        if held:
            done = np.concatenate(held)
            if len(done) > 1 and (got := stars(done)):
                yield link_batch([got])

    return run


def link_batch(got) -> pa.RecordBatch:
    a, b = (np.concatenate(x).view(np.int64) for x in zip(*got))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def block_masks(radius: int, n: int) -> list[int]:
    """Masks of all choices of ``n`` - ``radius`` of ``n`` near-equal blocks of the 64 bits: what differs in ``radius`` bits agrees under one of them."""
    edges = np.linspace(0, 64, n + 1).round().astype(int)
    blocks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges[:-1], edges[1:])]
    return [sum(c) for c in combinations(blocks, n - radius)]


def block_count(radius: int, points: int, shard: int = SHARD) -> int:
    """Blocks that keep shards of evenly spread points far below ``shard``: 6 for a radius of 4 up to some 10 thousand million points."""
    n = radius + 2
    while n < radius + 6 and points >> (64 * (n - radius) // n) > shard // 8:
        n += 1
    return n


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``a``, ``b``: links between distinct fingerprints ``fp`` that connect all that link."""
    if radius % 2:
        raise ValueError("radius must be even, for midpoints of large shards")
    n = tasks(prints.sparkSession)
    masks = block_masks(radius, block_count(radius, prints.count()))
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)])
    dealt = prints.select(F.explode(keys).alias("shard"), "fp")
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("_n")).where(F.col("_n") > shard).select("shard")
    large = materialise(sizes, "large")
    if not large.take(1):
        return dealt.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(search(radius), "a bigint, b bigint")
    # At most prints x blocks / shard rows are large; Spark picks the join by their size.
    small = dealt.join(large, "shard", "left_anti").select("shard", "fp").repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(search(radius), "a bigint, b bigint")
    hot = dealt.join(large, "shard").select("fp").distinct()
    flips = [0] + [sum(1 << i for i in c) for k in range(1, radius // 2 + 1) for c in combinations(range(64), k)]
    # Two fingerprints that link meet halfway, within radius / 2 flips of either.
    middle = hot.select("fp", F.explode(F.array(*[F.lit(signed(x)) for x in flips])).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("mid"))
    # Points that share a midpoint lie within 2 x (radius / 2) bits of each other, so a star to the smallest one only joins what links.
    star = middle.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("_n")).where("_n > 1").select("mid", "b")
    return small.unionByName(middle.join(star, "mid").where("fp != b").select(F.col("fp").alias("a"), "b").distinct())


def connect(nodes: DataFrame, edges: DataFrame, most: int = 60) -> DataFrame:
    """``fp``, ``label`` (smallest start label reachable over ``edges``) and ``top`` (the fingerprint it started at) for ``nodes`` (``fp``, ``label``)."""
    edges = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    ends = edges.select(F.col("a").alias("fp")).distinct()
    # Only fingerprints with a link take part in the rounds; the label is (id, fingerprint), so null ids come last.
    at = materialise(nodes.join(ends, "fp", "left_semi").select("fp", "label", F.col("fp").alias("top")), "labels0")
    total = at.count()
    for k in range(most):
        # Smallest label among the neighbours' tops, then each hangs below the top of that label's fingerprint.
        seen = edges.join(at.select(F.col("fp").alias("b"), "label", "top"), "b").groupBy(F.col("a").alias("fp")).agg(F.min(F.struct("label", "top")).alias("near"))
        best = at.join(seen, "fp").select("fp", F.least(F.struct("label", "top"), "near").alias("own"), F.col("label").alias("was"), F.col("top").alias("was_top"))
        best = materialise(best.withColumn("hub", F.col("own.top")), f"best{k}")
        # In a large component most have the same top.
        new = look_up(best, "hub", best.select(F.col("fp").alias("hub"), F.col("own").alias("up")), total).select("fp", F.least("own", F.coalesce("up", "own")).alias("own"), "was", "was_top")
        at = materialise(new.select("fp", F.col("own.label").alias("label"), F.col("own.top").alias("top"), ((F.col("own.label") != F.col("was")) | (F.col("own.top") != F.col("was_top"))).alias("moved")), f"labels{k + 1}")
        if not at.where("moved").take(1):
            return at.select("fp", "label", "top")
    raise RuntimeError(f"components did not settle in {most} rounds")


NO_ID = (1 << 63) - 1


def groups(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``fp``, ``low`` (smallest id with it), ``component_id`` and ``top`` (a fingerprint that names the component) of each distinct fingerprint of ``prints`` (doc_id, fp)."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    # A null id sorts after all others as a label.
    nodes = distinct.select("fp", F.coalesce("low", F.lit(NO_ID)).alias("label"))
    found = connect(nodes, links(distinct.select("fp"), radius, shard))
    label = F.when(F.col("label") != NO_ID, F.col("label"))
    return distinct.join(found.select("fp", label.alias("reached"), "top"), "fp", "left").select("fp", "low", F.coalesce("reached", "low").alias("component_id"), F.coalesce("top", "fp").alias("top"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """A row for each row of ``df``: ``doc_id``, ``fp`` and ``component_id``, the smallest id that links reach."""
    prints = materialise(fingerprints(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", words).drop("text"), "fingerprints")
    return prints.join(groups(prints, radius, shard).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def first_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """The rows of ``df`` but for all but one of each group of near copies: the one with the smallest id stays."""
    names = df.columns
    df, back = aside(df, {"fp", "_row", "_lost"})
    key, text = ({c: new for new, c in back.items()}.get(c, c) for c in (key, text))
    # Written with a row number, so that later passes know the rows again even if they are read in other splits.
    rows = materialise(fingerprints(df.withColumn("_row", F.monotonically_increasing_id()), text, words), "printed")
    prints = rows.select(F.col(key).cast("long").alias("doc_id"), "fp", "_row")
    named = groups(prints.select("doc_id", "fp"), radius, shard).select("fp", "top")
    return keep_first(rows, prints, named).select(*df.columns).withColumnsRenamed(back).select(*names)


def keep_first(rows: DataFrame, prints: DataFrame, named: DataFrame) -> DataFrame:
    """The rows (by ``_row``) that are the smallest of their group: ``prints`` has ``doc_id``, ``fp`` and ``_row``, ``named`` the group ``top`` of each ``fp``."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    per_print = prints.groupBy("fp").agg(first.alias("first")).join(named, "fp")
    winner = per_print.groupBy("top").agg(F.min("first").alias("win"))
    wins = materialise(look_up(materialise(named, "named"), "top", materialise(winner, "winner")).select("fp", F.col("win._row").alias("_win")), "winners")
    losers = materialise(prints.join(wins, "fp").where("_row != _win").select(F.col("_row").alias("_lost")), "losers")
    return rows.join(losers, F.col("_row") == F.col("_lost"), "left_anti")


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
