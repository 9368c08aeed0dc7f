"""Vector code compression: product codes whose nearest entries are found by VA-file filtering.

Each component x becomes the integer floor(``scale`` * x); a vector is cut into ``PARTS`` equal
parts, and each part position has a codebook of at most ``ENTRIES`` entries, which starts as that
part of the vectors with the smallest ids. Each round assigns every part to its nearest entry (squared Euclidean
distance, ties to the lower index) and replaces an entry by the componentwise floor of the mean of its
parts; an entry without parts stays.

Assignment: each coordinate of the entries is quantised to ``2 ** CELL_BITS`` cells (with the
least and largest coordinate in each). For each part of a vector, look-up tables
give the least and largest squared distance of its coordinate to each cell; their sums bound the distance to
every entry from below and above. Only entries whose lower bound does not exceed the smallest upper bound are
refined with integer distances, so the result is exact.

Codebooks are bounded (``ENTRIES`` vectors) and travel to the tasks; a round hands on one row of sums a task, entry and component, combined before the shuffle.

Left out are vectors that are null or hold null or non-finite components. All others have a
code: shorter ones are filled up with zeros to the longest, and that to a multiple of ``PARTS``. Components are held within
``limit``, far beyond real ones, so that all sums stay in 64 bits. Null ids are null in the result and come last as
first entries; equal ids go by their vectors; repeated rows are rows of their own. Null labels are one label. With fewer than
``ENTRIES`` vectors the codebooks are smaller; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import look_up, materialise, table, trimmed

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
CELL_BITS = 4
#: Parts of vectors that are bounded at once.
AT_ONCE = 4096


def limit(size: int) -> int:
    """Largest integer component of vectors of ``size``: the squared distance of two vectors stays under 2^62."""
    return math.isqrt((1 << 62) // max(size, 1)) // 2


def integers(column: pa.Array, size: int, scale: float) -> np.ndarray:
    """Integer components, a row for each vector of at most ``size`` components."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    out = np.zeros((len(lengths), size), np.int64)
    most = limit(size)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, at] = np.clip(np.floor(scale * values), -most, most).astype(np.int64)
    return out


class Cells:
    """The codebook of one part position with its coordinates quantised into cells."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        self.entries = entries
        n, width = entries.shape
        count = min(1 << bits, n)
        self.cell = np.zeros((n, width), np.int64)
        self.low, self.high = np.zeros((width, count), np.int64), np.zeros((width, count), np.int64)
        for d in range(width):
            order = np.argsort(entries[:, d], kind="stable")
            for c, own in enumerate(np.array_split(order, count)):
                self.cell[own, d] = c
                self.low[d, c], self.high[d, c] = entries[own, d].min(), entries[own, d].max()

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of each part's nearest entry, its squared distance, and how many distances were computed."""
        below, above = self.low[None] - parts[:, :, None], self.high[None] - parts[:, :, None]
        inside = (below <= 0) & (above >= 0)
        below, above = below * below, above * above
        least = np.where(inside, 0, np.minimum(below, above))
        most = np.maximum(below, above)
        lower = np.zeros((len(parts), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for d in range(parts.shape[1]):
            lower += least[:, d, self.cell[:, d]]
            upper += most[:, d, self.cell[:, d]]
        row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        gap = parts[row] - self.entries[entry]
        exact = (gap * gap).sum(axis=1)
        order = np.lexsort((entry, exact, row))
        first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        return entry[first], exact[first], len(row)


def assigned(cells: list[Cells], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, a row for each vector and a column for each part."""
    n, size = vectors.shape
    width = size // PARTS
    codes, gaps = np.zeros((n, PARTS), np.int64), np.zeros((n, PARTS), np.int64)
    for at in range(0, n, AT_ONCE):
        for p in range(PARTS):
            codes[at : at + AT_ONCE, p], gaps[at : at + AT_ONCE, p], _ = cells[p].nearest(vectors[at : at + AT_ONCE, p * width : (p + 1) * width])
    return codes, gaps


def means(books: np.ndarray, scale: float):
    """Over vectors: the number and the componentwise sums of the parts of each entry, in one row for each component."""
    _, entries, width = books.shape

    def run(batches):
        cells = [Cells(b) for b in books]
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((PARTS, entries), np.int64)
        for batch in batches:
            v = integers(batch.column(0), PARTS * width, scale)
            codes, _ = assigned(cells, v)
            for p in range(PARTS):
                np.add.at(sums[p], codes[:, p], v[:, p * width : (p + 1) * width])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        used = np.argwhere(np.repeat(counts[:, :, None], width, axis=2) > 0)
        part, entry, at = used.T
        arrays = [part, entry, at, sums[part, entry, at], counts[part, entry]]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["part", "entry", "at", "s", "n"])

    return run


def coder(books: np.ndarray, scale: float):
    def run(batches):
        cells = [Cells(b) for b in books]
        for batch in batches:
            codes, gaps = assigned(cells, integers(batch.column(2), books.shape[0] * books.shape[2], scale))
            names = pa.array([bytes(r).hex() for r in codes.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names, pa.array(gaps.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return run


def usable(v: Column) -> Column:
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def fit(rows: DataFrame, scale: float = SCALE, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) for ``rows`` (vec_id, v of usable vectors); empty where there are none."""
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return np.zeros((PARTS, 0, 1), np.int64)
    width = max(1, -(-longest // PARTS))
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    first = integers(pa.array([r["v"] for r in start], pa.list_(pa.float64())), PARTS * width, scale)
    books = np.ascontiguousarray(first.reshape(-1, PARTS, width).transpose(1, 0, 2))
    for _ in range(rounds):
        parts = rows.select("v").mapInArrow(trimmed(means(books, scale)), "part bigint, entry bigint, at bigint, s bigint, n bigint")
        books = books.copy()
        for r in parts.groupBy("part", "entry", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
            books[r["part"], r["entry"], r["at"]] = r["s"] // r["n"]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = SCALE, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id``, ``label``, ``code``, ``error``, ``label_error``, ``codebooks_sha256`` of each usable row."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for each part: 1 to 256 entries")
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")))
    books = fit(rows.select("vec_id", "v"), scale, entries, rounds)
    coded = materialise(rows.mapInArrow(trimmed(coder(books, scale)), "vec_id bigint, label string, code string, error bigint").withColumn("_key", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))), "coded")
    # Labels with many rows are looked up by broadcast, so that no task receives all of theirs.
    sums = materialise(coded.groupBy("_key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s")).select("_key", F.least("s", F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error")), "label_errors")
    return look_up(coded, "_key", sums).select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return codes(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _round(assigned: str, books: str) -> str:
    """Assignment of all parts to the entries of a table of codebooks."""
    return f"""{assigned} AS (
  SELECT vec_id, label, part, q, arg_min(entry, gap * 256 + entry) AS entry, min(gap) AS gap FROM (
    SELECT p.r, p.vec_id, p.label, p.part, p.q, b.entry, CAST(list_sum(list_transform(list_zip(p.q, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS gap
    FROM p JOIN {books} AS b USING (part)
  ) GROUP BY r, vec_id, label, part, q
)"""


def _means(books: str, assigned: str, old: str) -> str:
    """The codebooks after the means of an assignment."""
    return f"""{books} AS (
  SELECT o.part, o.entry, coalesce(m.c, o.c) AS c FROM {old} AS o LEFT JOIN (
    SELECT part, entry, list(c ORDER BY pos) AS c FROM (
      SELECT part, entry, pos, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS c
      FROM (SELECT part, entry, unnest(q) AS x, unnest(range(len(q))) AS pos FROM {assigned}) GROUP BY 1, 2, 3
    ) GROUP BY 1, 2
  ) AS m USING (part, entry)
)"""


SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT r, vec_id, label, part, q[part * (len(q) // 16) + 1 : (part + 1) * (len(q) // 16)] AS q FROM v, range(16) AS t(part)
), first AS (
  SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS entry FROM v ORDER BY vec_id NULLS LAST LIMIT 64
), b0 AS (
  SELECT part, entry, q AS c FROM p JOIN first USING (r)
), {_round("a0", "b0")}, {_means("b1", "a0", "b0")}, {_round("a1", "b1")}, {_means("b2", "a1", "b1")}, {_round("a2", "b2")}, c AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(gap) AS BIGINT) AS error
  FROM (SELECT a2.*, row_number() OVER (PARTITION BY vec_id, part) AS copy FROM a2) GROUP BY vec_id, label, copy
), h AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS h FROM (SELECT part, entry, unnest(c) AS x, unnest(range(len(c))) AS pos FROM b2)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM c, h
"""
