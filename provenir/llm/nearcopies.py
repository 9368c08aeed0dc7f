"""Near copies by 5-word Jaccard similarity: SimHash and BK-trees find most, first shingles the rest, shingle sets decide.

Texts are cut into words as in ``simhash``; texts of the same words are one point. Two
points are near copies if the sets of their shingles of ``WORDS`` words (a shorter text is
one shingle) have a Jaccard similarity of at least ``LEAST``, which is computed from the
sets.

Candidates come from SimHashes of ``PARTS`` x 64 bits in a number of tables. A table orders
all points by one of the 64-bit parts, read from a bit of its own on, and cuts that order
into shards of ``SHARD`` points; each shard is one BK-tree, searched at ``RADIUS`` bits. So a
point is in one shard of each table, and work is linear in points and tables, whatever
groups there are. Two texts of similarity ``LEAST`` differ in some 15 % of the bits; the
number of tables follows from that, so that a pair shares a shard with a chance of
``RECALL`` at every size of the corpus.

Candidates differ in at most ``ALL`` of all bits. A shard hands on a shortest spanning
forest of them, not all pairs: what the forest leaves out is connected by shorter steps,
and each point's nearest one is in it. Distances are those of all parts, so shards of different
tables tend to choose the same pairs. A large
group may be held together by one text that all others are copies of, and be spread over
many shards. So there are up to ``ROUNDS`` rounds: the later ones are over one text of each
group found (the one with most links) and all points whose candidates came to nothing.

These rounds find nearly all, by chance and by candidates that were not yet judged. What they leave is found exactly (``rest``): in
any one order of all shingles, two sets of similarity ``LEAST`` share k of their first
``n - ceil(LEAST n) + k``. Shingles that many texts hold come last in that order. Points of
different groups go on if they share as many (``need``) and their sizes allow the similarity. Of a shingle that over ``FEW``
points have among their first, pairs are not counted but compared by bitmaps: these
hold the parity of the set's shingles at each of as many places, so those of two sets differ in
no more places than the sets (a longer one is folded to the shorter). Pairs that were counted meet the same test. Groups that such points connect are a cluster, in
which all pairs of different groups are decided on full sets, as in ``minhash``.

Texts without words are one point that is similar to nothing else. Null ids and
repeated rows are treated as in ``simhash``. Columns of any name come out as they went in.
"""

from __future__ import annotations

import gc
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenir.llm import minhash, simhash
from provenir.llm.common import aside, forget, look_up, materialise, tasks, trimmed

WORDS, LEAST = 5, 0.8
#: 64-bit parts of a SimHash; bits in which a part may differ, and all of them (four deviations beyond what is expected at ``LEAST``).
PARTS, RADIUS, ALL = 6, 18, 86
#: Points in a shard, and the chance that a pair of similarity ``LEAST`` shares one.
SHARD, RECALL = 1024, 0.995
#: Share of bits in which texts of similarity ``LEAST`` differ: the angle whose cosine is 2 LEAST / (1 + LEAST).
DIFFER = math.acos(2 * LEAST / (1 + LEAST)) / math.pi
#: Candidates of a shard that are held before they are cut to a forest, and rounds at most.
HELD, ROUNDS = 1_000_000, 3
#: ``LEAST`` in percent.
PERCENT = round(100 * LEAST)
#: Points on which common shingles are counted, and their least share of them. Only speed depends on these: any order of shingles finds the same.
COUNTED, COMMON = 16_384, 1 / 1000
#: Points of a key whose pairs are counted; those of larger ones are compared by bitmaps.
FEW = 32
#: Row numbers that are broadcast, to pick texts without a shuffle of them.
SENT = 2_000_000
#: Names that a task remembers, so as to send the keys of exact copies once; sorted keys of a task; shingles gathered at once.
SEEN, SORTED, AT_ONCE = 1 << 19, 1 << 20, 1 << 19
COLUMNS = [f"w{k}" for k in range(PARTS)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(parts: list[bytes]) -> np.ndarray:
    """128-bit hashes of the shingles in turn, as two columns."""
    from xxhash import xxh3_128_digest

    joined = b" ".join(parts)
    starts = [0]
    for p in parts:
        starts.append(starts[-1] + len(p) + 1)
    ends = starts[WORDS:] if len(parts) > WORDS else starts[-1:]
    return np.frombuffer(b"".join([xxh3_128_digest(joined[a : b - 1]) for a, b in zip(starts, ends)]), np.uint64).reshape(-1, 2)


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th 64 bits that a shingle's hash is drawn out to: multiply and shift."""
    z = hashes[:, 0] + hashes[:, 1] * np.uint64(2 * k + 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def name_of(parts: list[bytes]) -> int:
    from xxhash import xxh64_intdigest

    return simhash.signed(xxh64_intdigest(b" ".join(parts), 7)) if parts else 0


def set_of(parts: list[bytes]) -> np.ndarray:
    """The set of shingles as sorted numbers."""
    return np.unique(shingle_hashes(parts)[:, 0])


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the set's shingles at each of 64 places or, as the least power of 2, one for each shingle."""
    places = max(64, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def allowed(n, m):
    """Places in which bitmaps may differ: sets of similarity 0.8 share 4/9 of the sum of their sizes, so they differ in a ninth of it at most."""
    return (100 - PERCENT) * (n + m) // (100 + PERCENT)


def point_of(text: str | None) -> tuple[list[int], bytes]:
    """``sig`` (names the sequence of words), the parts of the SimHash and the size of the shingle set; and its bitmap."""
    parts = words_of(text)
    if not parts:
        return [0] * (PARTS + 2), bytes(8)
    hashes = shingle_hashes(parts)
    out = []
    for k in range(PARTS):
        z, counts = mixed(hashes, k), np.zeros(64, np.int64)
        for at in range(0, len(z), 4096):
            counts += np.unpackbits(z[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(z), bitorder="little").view(np.int64)[0]))
    own = np.unique(hashes[:, 0])
    return [name_of(parts), *out, len(own)], bitmap(own)


def printer(column: int):
    def run(batches):
        for batch in batches:
            points = [point_of(t) for t in batch.column(column).to_pylist()]
            made = np.array([x for x, _ in points], np.int64).reshape(-1, PARTS + 2)
            columns = [*(pa.array(made[:, k]) for k in range(PARTS + 2)), pa.array([x for _, x in points], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *ADDED, "_map"])

    return run


#: Working columns beside the input's.
ADDED = ["_sig", *(f"_{c}" for c in COLUMNS), "_n"]


def set_maker(batches):
    for batch in batches:
        sets = [set_of(words_of(t)).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["sig", "shingles"])


def shard_pairs(key: np.ndarray, parts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates among the points of a shard: their shortest spanning forest. ``parts``: a row for each of the ``PARTS``."""
    held: list = []
    count = 0

    def cut():
        a, b, d = (np.concatenate(x) for x in zip(*held))
        k = simhash.forest(a, b, d)
        return [(a[k], b[k], d[k])]

    for a, b in simhash.bk_links(key, RADIUS):
        fits = np.minimum(n[a], n[b]) >= LEAST * np.maximum(n[a], n[b]) - 1e-9
        a, b = a[fits], b[fits]
        d = np.zeros(len(a), np.int64)
        for part in parts:
            d += np.bitwise_count(part[a] ^ part[b])
        ok = d <= ALL
        if ok.any():
            held.append((a[ok], b[ok], d[ok]))
            count += int(ok.sum())
        if count > HELD:
            held = cut()
            count = len(held[0][0])
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ((a, b, _),) = cut()
    return a, b


def searcher(shard: int):
    """Over rows in order of table and key: the candidates of each run of ``shard`` rows of a table."""

    def search(rows):
        key, sig, n, *parts = (np.concatenate(x) for x in zip(*rows))
        a, b = shard_pairs(key.view(np.uint64), [p.view(np.uint64) for p in parts], n)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sig[a], sig[b])), pa.array(np.maximum(sig[a], sig[b]))], names=["a", "b"])

    def run(batches):
        at, held, count = None, [], 0
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            x, size = 0, len(cols[0])
            while x < size:
                if held and (cols[0][x] != at or count == shard):
                    yield from search(held)
                    held, count = [], 0
                at = cols[0][x]
                y = min(size, x + shard - count, int(np.searchsorted(cols[0], at, side="right")))
                held.append([c[x:y] for c in cols[1:]])
                count += y - x
                x = y
        if held:
            yield from search(held)

    return run


def rotated(c: Column, bits: int) -> Column:
    return c if not bits else F.shiftleft(c, bits).bitwiseOR(F.shiftrightunsigned(c, 64 - bits))


def table_count(points: int, shard: int = SHARD) -> int:
    """Tables so that a pair of similarity ``LEAST`` shares a shard in one of them with a chance of ``RECALL``: the bits that tell shards apart must agree."""
    bits = max(0.0, math.log2(max(points, 1) / shard)) + 1
    return math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - DIFFER) ** bits))


def candidates(points: DataFrame, start: int, shard: int) -> DataFrame:
    """``a``, ``b``: candidates among ``points`` (sig, parts, n); ``start``: the first bit that a table reads."""
    spark = points.sparkSession
    n = table_count(points.count(), shard)
    # Each part serves in turn, from bits 8 apart on, then from those between them.
    turns = [(k % PARTS, (start + 8 * (k // PARTS) + k // PARTS // 8) % 64) for k in range(n)]
    row = lambda k, part, bit: F.struct(F.lit(k).alias("t"), rotated(F.col(COLUMNS[part]), bit).alias("key"))
    dealt = points.select(F.explode(F.array(*[row(k, *x) for k, x in enumerate(turns)])).alias("r"), "sig", "n", *COLUMNS).select("r.t", "r.key", "sig", F.col("n").cast("int").alias("n"), *COLUMNS)
    # By range, and to the last by ``sig``: no key is so common that it would fill a partition.
    ordered = dealt.repartitionByRange(tasks(spark), "t", "key", "sig").sortWithinPartitions("t", "key", "sig")
    return ordered.mapInArrow(trimmed(searcher(shard)), "a bigint, b bigint").distinct()


def sets_of(sigs: DataFrame, rows: DataFrame, points: DataFrame, text: str, name: str) -> DataFrame:
    """``sig``, ``shingles`` of the points ``sigs``."""
    reps = materialise(points.join(sigs, "sig", "left_semi").select(F.col("rep").alias("_row")), f"{name}_rows")
    # Few numbers go to the texts; beyond that both meet by a shuffle.
    reps = F.broadcast(reps) if reps.count() <= SENT else reps
    return materialise(rows.join(reps, "_row", "left_semi").select("_sig", F.col(text).cast("string")).mapInArrow(trimmed(set_maker), "sig bigint, shingles array<bigint>"), name)


def similar(pairs: DataFrame, rows: DataFrame, points: DataFrame, text: str, name: str) -> DataFrame:
    """``pairs`` with ``good``: whether their shingle sets have the similarity."""
    pairs = materialise(pairs, f"{name}_candidates")
    ends = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()
    sets = sets_of(ends, rows, points, text, f"{name}_sets")
    own = lambda c: sets.select(F.col("sig").alias(c), F.col("shingles").alias(f"_{c}"))
    both = pairs.join(own("a"), "a").join(own("b"), "b")
    common = F.size(F.array_intersect("_a", "_b"))
    good = common >= LEAST * (F.size("_a") + F.size("_b") - common) - 1e-9
    judged = materialise(both.select("a", "b", good.alias("good")), name)
    forget(sets)
    return judged


def need(n):
    """How many shingles two sets of similarity ``LEAST`` share at least among their first ones, by the size of the smaller."""
    return 1 + n // 50


def first_shingles(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first ``n - ceil(LEAST n) + need(n)`` of a sorted set: common ones last, by their counts."""
    most = len(shingles) + (-PERCENT * len(shingles)) // 100 + need(len(shingles))
    if not len(common):
        return shingles[:most]
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    rank = np.where(common[at] == shingles, counts[at], 0)
    return shingles[np.argsort(rank, kind="stable")[:most]]


def keyer(common: np.ndarray, counts: np.ndarray):
    """Over ``sig``, ``text``: the first shingles of each point; of exact copies in a task those of one."""

    def run(batches):
        seen: set = set()
        keys, sigs, count = [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sigs))], names=["key", "id"])

        for batch in batches:
            for sig, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if sig in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(sig)
                parts = words_of(t.as_py())
                if not parts:
                    continue
                first = first_shingles(set_of(parts), common, counts)
                keys.append(first)
                sigs.append(np.full(len(first), sig, np.int64))
                count += len(first)
                if count > AT_ONCE:
                    yield out()
                    keys, sigs, count = [], [], 0
        if count:
            yield out()

    return run


def once(batches):
    """Rows ``key``, ``id`` in order, without repeated ones."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, id_ = (c.to_numpy() for c in batch.columns)
        new = np.ones(len(key), bool)
        new[1:] = (np.diff(key) != 0) | (np.diff(id_) != 0)
        new[0] = last != (key[0], id_[0])
        last = (key[-1], id_[-1])
        if new.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(id_[new])], names=["key", "id"])


def shared_keys(batches):
    """Over rows ``key``, ``id`` in order: those whose key several ids have."""
    return minhash.meet(once(batches))


def may_be(n, m):
    """Whether sizes allow the similarity."""
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def met(few: int):
    """Over rows ``key``, ``id``, ``n``, ``top`` in order of keys: of a key of up to ``few`` points the pairs of different groups (``a``, ``b``, and the ``need`` of their sizes as ``n``), of others the rows (``id`` as ``a``, ``top`` as ``b``)."""

    def pairs(key, id_, n, top):
        for off in range(1, few):
            at = np.flatnonzero(key[off:] == key[:-off])
            if not len(at):
                return
            at = at[(top[at] != top[at + off]) & may_be(n[at], n[at + off])]
            if len(at):
                yield id_[at], id_[at + off], need(np.minimum(n[at], n[at + off]))

    def rows(key, id_, n, top):
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        sizes = np.diff(starts, append=len(key))
        apart = np.minimum.reduceat(top, starts) != np.maximum.reduceat(top, starts)
        small, large = (np.repeat(apart & x, sizes) for x in (sizes <= few, sizes > few))
        made = list(pairs(key[small], id_[small], n[small], top[small])) if small.any() else []
        if made:
            a, b, least = (np.concatenate(x) for x in zip(*made))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b), pa.array(least.astype(np.int32))], names=["key", "a", "b", "n"])
        if large.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[large]), pa.array(id_[large]), pa.array(top[large]), pa.array(n[large])], names=["key", "a", "b", "n"])

    def run(batches):
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            # The last key may go on in the next batch.
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut or (held and held[-1][0][-1] != cols[0][0]):
                done = [*held, [c[:cut] for c in cols]]
                yield from rows(*(np.concatenate(x) for x in zip(*done)))
                held = []
            held.append([c[cut:] for c in cols])
        if held:
            yield from rows(*(np.concatenate(x) for x in zip(*held)))

    return run


def words(maps: list[bytes], places: int) -> np.ndarray:
    """Bitmaps of one length as rows of 64-bit words, folded to ``places`` (half of theirs, or all)."""
    m = np.frombuffer(b"".join(maps), np.uint64).reshape(len(maps), -1)
    half = places // 64
    return m if m.shape[1] == half else m[:, :half] ^ m[:, half:]


def crossing(held: list):
    """Over the rows of a tile of a key: the shortest spanning forest of its groups whose points may be similar, as far as sizes and bitmaps tell."""
    low, high = int(held[0].column(1)[0].as_py()), int(held[0].column(2)[0].as_py())
    block, n, top = (minhash.column(held, k) for k in (3, 5, 6))
    label = np.unique(top, return_inverse=True)[1]
    maps = [x for b in held for x in b.column(7).to_pylist()]
    places = np.array([8 * len(x) for x in maps])
    kept: list = []
    count = 0

    def cut():
        a, b, d = (np.concatenate(x) for x in zip(*kept))
        k = simhash.forest(label[a], label[b], d)
        return [(a[k], b[k], d[k])]

    # Sizes that may be similar have bitmaps of one length, or one of them twice as long.
    for p in np.unique(places).tolist():
        for q in (p // 2, p, 2 * p):
            first, second = np.flatnonzero((block == low) & (places == p)), np.flatnonzero((block == high) & (places == q))
            if not len(first) or not len(second):
                continue
            x, y = (words([maps[k] for k in w], min(p, q)) for w in (first, second))
            for at in range(0, len(first), minhash.ROWS):
                own = first[at : at + minhash.ROWS]
                d = np.zeros((len(own), len(second)), np.int32)
                for k in range(x.shape[1]):
                    d += np.bitwise_count(x[at : at + minhash.ROWS, k][:, None] ^ y[:, k][None, :])
                size, other = n[own][:, None].astype(np.int64), n[second][None, :].astype(np.int64)
                i, j = np.nonzero((d <= allowed(size, other)) & (label[own][:, None] != label[second][None, :]) & may_be(size, other))
                if len(i):
                    kept.append((own[i], second[j], d[i, j]))
                    count += len(i)
                if count > HELD:
                    kept = cut()
                    count = len(kept[0][0])
    if kept:
        ((a, b, _),) = cut()
        yield minhash.ends(top, a, b)


def differ(a: bytes, b: bytes) -> int:
    """Places in which two bitmaps differ, as the shorter one has them."""
    if len(a) > len(b):
        a, b = b, a
    x, y, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(b)
    while bits > 8 * len(a):
        bits //= 2
        y = (y >> bits) ^ (y & ((1 << bits) - 1))
    return (x ^ y).bit_count()


def by_maps(batches):
    """Over rows ``a``, ``b`` (groups), ``n``, ``m`` (sizes of points of them) and two bitmaps: the groups of those that these allow."""
    for batch in batches:
        a, b, n, m = (batch.column(k).to_numpy() for k in range(4))
        d = np.array([differ(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.int64)
        ok = d <= allowed(n, m)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok])], names=["a", "b"])


def common_shingles(asked: DataFrame, rows: DataFrame, points: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of every so many points hold, in order, and their counts: at most the mean size of a set by 1 / ``COMMON``."""
    every = -(-points.count() // COUNTED)
    sets = sets_of(asked.where(F.pmod(F.xxhash64("sig"), F.lit(max(every, 1))) == 0).select("sig"), rows, points, text, "counted")
    least = max(16, math.ceil(COMMON * sets.count()))
    got = sets.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") >= least).toPandas()
    forget(sets)
    shingles, counts = got["s"].to_numpy(np.int64).view(np.uint64), got["c"].to_numpy(np.int64)
    order = np.argsort(shingles)
    return shingles[order], counts[order]


def of_large(rows: DataFrame, points: DataFrame, block: int) -> DataFrame:
    """``a``, ``b``: groups that may be similar by points that share a key; ``rows``: ``key``, ``id``, ``top`` and ``n``."""
    # What is outside a key's largest group meets all of its points.
    groups = rows.groupBy("key", "top").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "top")).alias("most"), F.sum("m").alias("all"))
    blocks = lambda c: F.ceil(c / F.lit(block)).cast("int")
    apart = groups.select("key", F.col("most.top").alias("most"), blocks(F.col("most.m")).alias("inside"), blocks(F.col("all") - F.col("most.m")).alias("outside"))
    of = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    rows = look_up(rows, "key", materialise(apart, "apart")).withColumn("block", F.when(F.col("top") == F.col("most"), F.col("outside") + of("inside")).otherwise(of("outside")))
    others = F.when(F.col("block") < F.col("outside"), F.sequence(F.lit(0), F.col("outside") + F.col("inside") - 1)).otherwise(F.sequence(F.lit(0), F.col("outside") - 1))
    tiles = rows.join(points.select(F.col("sig").alias("id"), "map"), "id").withColumn("other", F.explode(others))
    tiles = tiles.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "n", "top", "map")
    dealt = tiles.repartition(tasks(rows.sparkSession), "key", "low", "high").sortWithinPartitions("key", "low", "high", "id")
    return dealt.mapInArrow(trimmed(minhash.by_runs(crossing, 3)), "a bigint, b bigint").distinct()


def rest(rows: DataFrame, points: DataFrame, asked: DataFrame, nodes: DataFrame, found: DataFrame, near: DataFrame, text: str, few: int = FEW, block: int = minhash.BLOCK, weight: int = minhash.WEIGHT) -> DataFrame | None:
    """``a``, ``b``: links that connect all similar points which ``found`` (the components by the links ``near``) holds apart; None if no two can be similar."""
    spark = rows.sparkSession
    # A set's first shingles are a quarter of it and one, at most.
    parts = max(tasks(spark), -(-(asked.agg(F.sum("n")).first()[0] or 0) // (4 * SORTED)))
    keys = rows.where("_n > 0").select("_sig", F.col(text).cast("string")).mapInArrow(trimmed(keyer(*common_shingles(asked, rows, points, text))), "key bigint, id bigint")
    # Rows of a key are 16 bytes each, and one for each point at most.
    shared = keys.repartition(parts, "key").sortWithinPartitions("key", "id").mapInArrow(trimmed(shared_keys), "key bigint, id bigint")
    grouped = materialise(points.select("sig", "n", "map").join(found.select(F.col("fp").alias("sig"), "top"), "sig", "left").select("sig", F.col("n").cast("int").alias("n"), F.coalesce("top", "sig").alias("top"), "map"), "grouped")
    dealt = shared.join(grouped.select(F.col("sig").alias("id"), "n", "top"), "id").select("key", "id", "n", "top").repartition(tasks(spark), "key").sortWithinPartitions("key")
    pairs = materialise(dealt.mapInArrow(trimmed(met(few)), "key bigint, a bigint, b bigint, n int"), "met")

    # Pairs that share as many of their first shingles as they must, and whose bitmaps allow the similarity.
    end = lambda c, n: grouped.select(F.col("sig").alias(c), F.col("top").alias(f"_{c}"), F.col("n").alias(n), F.col("map").alias(f"_{n}"))
    maybe = pairs.where("key IS NULL").groupBy("a", "b").agg(F.count("*").alias("c"), F.max("n").alias("least")).where("c >= least").select("a", "b")
    maybe = maybe.join(end("a", "n"), "a").join(end("b", "m"), "b").select("_a", "_b", "n", "m", "_n", "_m")
    maybe = materialise(maybe.mapInArrow(trimmed(by_maps), "a bigint, b bigint").distinct(), "maybe")
    large = pairs.where("key IS NOT NULL")
    if large.take(1):
        maybe = maybe.union(materialise(of_large(large.select("key", F.col("a").alias("id"), F.col("b").alias("top"), "n"), points, block), "of_large"))
    forget(pairs)
    if not maybe.take(1):
        return None

    # Clusters of groups, with all of their points.
    clusters = simhash.connect(nodes, maybe).select(F.col("fp").alias("comp"), F.col("top").alias("cluster"))
    wide = materialise(look_up(grouped.select("sig", "n", F.col("top").alias("comp")), "comp", clusters).where("cluster IS NOT NULL"), "wide")
    sizes = materialise(wide.groupBy("cluster").agg(F.ceil(F.sum(F.col("n") + minhash.EACH) / F.lit(weight)).cast("int").alias("blocks")), "cluster_sizes")
    sets = sets_of(wide.select("sig"), rows, points, text, "cluster_sets")
    gathered = look_up(wide, "cluster", sizes).join(sets, "sig")
    # Without sketches: every pair of different groups is decided by its sets.
    gathered = gathered.select("cluster", "blocks", F.col("sig").alias("id"), F.size("shingles").alias("n"), "comp", *[F.lit(0).cast("long").alias(w) for w in minhash.W], "shingles")
    gathered = materialise(gathered, "gathered")
    forget(sets)
    return minhash.whole_clusters(gathered, nodes, PERCENT, weight, near)


def first_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """The rows of ``df`` but for all but one of each group of near copies: the one with the smallest id stays."""
    names = df.columns
    df, back = aside(df, {"_row", "_lost", "_map", *ADDED})
    key, text = ({c: new for new, c in back.items()}.get(c, c) for c in (key, text))
    schema = T.StructType([*df.schema.fields, T.StructField("_row", T.LongType(), False), *(T.StructField(c, T.LongType()) for c in ADDED), T.StructField("_map", T.BinaryType())])
    rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(trimmed(printer(df.columns.index(text))), schema), "printed")
    prints = rows.select(F.col(key).cast("long").alias("doc_id"), F.col("_sig").alias("fp"), "_row")
    own = rows.select(*[F.col(c).alias(c[1:]) for c in (*ADDED, "_map")], "_row", F.col(key).cast("long").alias("low"))
    points = materialise(own.groupBy("sig").agg(*[F.min(c).alias(c) for c in (*COLUMNS, "n")], F.first("map").alias("map"), F.min("_row").alias("rep"), F.min("low").alias("low")), "points")
    nodes = points.select(F.col("sig").alias("fp"), F.coalesce("low", F.lit(simhash.NO_ID)).alias("label"))
    asked = points.where("n > 0").select("sig", *COLUMNS, "n")

    judged = similar(candidates(asked, 0, shard), rows, points, text, "near")
    near = judged.where("good").select("a", "b")
    found = simhash.connect(nodes, near)
    # Further rounds: of each group the point with most links, and the points that are in none though they had candidates.
    ends = lambda df: df.select(F.col("a").alias("sig")).union(df.select(F.col("b").alias("sig")))
    open_ = ends(judged).distinct()
    for k in range(1, ROUNDS):
        links = ends(near).groupBy("sig").agg(F.count("*").alias("links"))
        alone = materialise(open_.join(links, "sig", "left_anti"), f"alone{k}")
        if not alone.take(1):
            break
        hubs = found.select(F.col("fp").alias("sig"), "top").join(links, "sig").groupBy("top").agg(F.max_by("sig", F.struct("links", "sig")).alias("sig"))
        again = materialise(hubs.select("sig").unionByName(alone), f"again{k}")
        more = similar(candidates(asked.join(again, "sig", "left_semi"), 3 * k, shard), rows, points, text, f"more{k}").where("good").select("a", "b")
        if not more.take(1):
            break
        near = near.union(more)
        found = simhash.connect(nodes, near)
    # Shuffle files of these rounds go with their frames, before the exact pass writes its own.
    gc.collect()
    rows.sparkSession.sparkContext._jvm.System.gc()
    more = rest(rows, points, asked, nodes, found, near, text)
    if more is not None:
        found = simhash.connect(nodes, near.union(more))
    named = points.select(F.col("sig").alias("fp")).join(found.select("fp", "top"), "fp", "left").select("fp", F.coalesce("top", "fp").alias("top"))
    return simhash.keep_first(rows, prints, named).select(*df.columns).withColumnsRenamed(back).select(*names)
