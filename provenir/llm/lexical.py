"""Ranked lexical search: sort-based accumulation of integer impacts.

Terms are the maximal runs of ASCII letters and digits and of all characters beyond ASCII in
the whole text, with A-Z in lower case. A document with term counts tf and n terms in all
scores, for each term of an item (repeats included), w * ((1000000000 * tf) div (1000 * tf + 12 * m))
with w = floor(1000 * ln((2 N + 2) / (2 df + 1))) and m = 75 + ((25 * n * N) div L); N documents
have a term, L is the number of all their terms. All but w is 64-bit integer.

Two passes over the documents, neither of which shuffles a text. The first counts N, L and the
df of the items' terms: each task hands on one row a term. In the second each task is a range of the documents:
postings of matched terms are concatenated as (item, document, impact), packed keys
are sorted by radix, equal ones summed by ``reduceat``, and a heap an item keeps the best ``k``.
As a document is in one task, keys of two tasks never meet, and only each task's best rows are
shuffled, for the last ranking.

Items travel to the tasks in blocks of about ``BLOCK`` bytes of text; more items mean more passes, not larger ones.

A null text has no term; an item or document without terms has no rows. Repeated documents
are documents of their own, a null id comes after all others. Repeated rows of items (equal id and text) are
one item, equal ids with different texts are items of their own. Empty tables give no rows;
other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenir.llm.common import table, trimmed

K = 20
#: Bytes of item texts in a block, postings that are accumulated at once, and documents that a packed key can tell apart.
BLOCK, AT_ONCE, DOCS = 8 << 20, 1 << 21, 1 << 16
#: ASCII: what is no term becomes a space, A-Z become a-z.
TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


class Items:
    """The items of a block: vocabulary, and for each term its items with how often they hold it."""

    def __init__(self, rows: list[tuple]):
        self.ids = [i for i, _ in rows]
        self.vocabulary: list[bytes] = []
        known: dict[bytes, int] = {}
        at, own = [], []
        for k, (_, text) in enumerate(rows):
            for t in terms(text):
                at.append(known.setdefault(t, len(known)))
                own.append(k)
        self.vocabulary = list(known)
        packed, times = np.unique(np.array(at, np.int64) << 32 | np.array(own, np.int64), return_counts=True)
        self.item, self.times = packed & 0xFFFFFFFF, times.astype(np.int64)
        self.starts = np.searchsorted(packed >> 32, np.arange(len(known) + 1))


def postings(texts: list, known: dict[bytes, int]):
    """Number of terms of each text, and arrays of (text, term, occurrences) of the known ones."""
    n, owner, found = [], [], []
    for k, text in enumerate(texts):
        words = terms(text)
        n.append(len(words))
        own = [x for x in map(known.get, words) if x is not None]
        found.append(np.array(own, np.int64))
        owner.append(np.full(len(own), k, np.int64))
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    packed, tf = np.unique(np.concatenate(owner) << 32 | np.concatenate(found), return_counts=True)
    return np.array(n, np.int64), packed >> 32, packed & 0xFFFFFFFF, tf.astype(np.int64)


def counter(vocabulary: list[bytes]):
    """Over texts: ``term``, ``n``: documents that hold it; term -1: documents with a term, -2: all their terms."""

    def run(batches):
        known = {t: k for k, t in enumerate(vocabulary)}
        held, docs, total = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            n, _, term, _ = postings(batch.column(0).to_pylist(), known)
            held += np.bincount(term, minlength=len(vocabulary))
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
        own = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own, [-1, -2]])), pa.array(np.concatenate([held[own], [docs, total]]))], names=["term", "n"])

    return run


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Order of non-negative keys, by 16 bits at a time from the lowest (numpy sorts these by radix), as far as the largest goes."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    top, shift = int(keys.max(initial=0)), 16
    while top >> shift:
        order = order[np.argsort((keys[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def accumulate(items: Items, weight: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
    """``item``, ``doc``, ``score`` of all pairs that share a term; ``doc`` ascending numbers under ``DOCS``."""
    first, size = items.starts[term], items.starts[term + 1] - items.starts[term]
    at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    keys = items.item[at] << 16 | np.repeat(doc, size)
    values = np.repeat(weight[term] * impact, size) * items.times[at]
    order = radix_order(keys)
    keys = keys[order]
    cuts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[cuts] >> 16, keys[cuts] & 0xFFFF, np.add.reduceat(values[order], cuts)


def ranker(items: Items, weight: np.ndarray, docs: int, total: int, k: int):
    """Over ids and texts: ``at`` (number of an item), ``doc_id``, ``score`` of the task's best ``k`` documents of each item."""

    def run(batches):
        known = {t: n for n, t in enumerate(items.vocabulary)}
        heaps: dict[int, list] = {}
        least = np.ones(len(items.ids), np.int64)  # what a document must reach: 1, or the worst of a full heap
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), DOCS):
                n, doc, term, tf = postings(batch.column(1).slice(at, DOCS).to_pylist(), known)
                m = 75 + 25 * n * docs // max(total, 1)
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
                # Slices end with a document, so its postings are summed together.
                work = np.cumsum(items.starts[term + 1] - items.starts[term])
                new = np.flatnonzero(np.diff(doc, prepend=-1))
                block = work[new] // AT_ONCE if len(new) else np.zeros(0, np.int64)
                edges = [*new[np.flatnonzero(np.diff(block, prepend=-1))], len(doc)]
                for x, y in zip(edges, edges[1:]):
                    item, own, score = accumulate(items, weight, doc[x:y], term[x:y], impact[x:y])
                    good = np.flatnonzero(score >= least[item])
                    item, own, score = item[good], own[good], score[good]
                    order = np.lexsort((-score, item))
                    for e in order.tolist():
                        i, s = int(item[e]), int(score[e])
                        if s < least[i]:
                            continue
                        d = ids[at + int(own[e])]
                        heap = heaps.setdefault(i, [])
                        # The worst comes first: low score, null id, large id.
                        entry = (s, d is not None, -(d or 0))
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        else:
                            heapq.heappushpop(heap, entry)
                        if len(heap) == k:
                            least[i] = heap[0][0]
        rows = [(i, -d if some else None, s) for i, heap in heaps.items() for s, some, d in heap]
        at, doc_id, score = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], names=["at", "doc_id", "score"])

    return run


def search_block(docs: DataFrame, rows: list[tuple], k: int) -> DataFrame:
    """Results of the items ``rows`` (id, text)."""
    spark = docs.sparkSession
    items = Items(rows)
    counts = docs.select("text").mapInArrow(trimmed(counter(items.vocabulary)), "term bigint, n bigint")
    # A row for each term of the block and two more.
    seen = {r["term"]: r["n"] for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, total = seen.get(-1, 0), seen.get(-2, 0)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * seen.get(t, 0) + 1))) for t in range(len(items.vocabulary))], np.int64)
    best = docs.select("doc_id", "text").mapInArrow(trimmed(ranker(items, weight, n, total, k)), "at bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("at").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(items.ids)), "at bigint, item_id bigint")
    return ranked.join(F.broadcast(names), "at").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text", block: int = BLOCK) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score`` of each item's ``k`` best documents."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item).cast("long").alias("item_id"), F.col(query).cast("string").alias("text")).where("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // block)
    out = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else asked
        rows = [tuple(r) for r in own.orderBy("item_id", "text").collect()]
        if rows:
            found = search_block(docs, rows, k)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0
), p AS (
  SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM d) GROUP BY ALL
), w AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * s.n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY t, s.n
), i AS (
  SELECT row_number() OVER () AS q, item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), it AS (
  SELECT q, item_id, t, count(*) AS times FROM (SELECT q, item_id, unnest(ts) AS t FROM i) GROUP BY ALL
), x AS (
  SELECT it.q, it.item_id, p.r, p.doc_id, CAST(sum(it.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * s.n) // s.l)))) AS BIGINT) AS score
  FROM it JOIN p USING (t) JOIN w USING (t), s GROUP BY ALL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS n FROM x WHERE score > 0
)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM o WHERE n <= 20
"""
