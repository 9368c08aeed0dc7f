"""Exact top-k by inner product: a Voronoi kNN join.

1. Vectors are quantised to integers. Of each distinct vector the ``k + 1`` rows with
   the smallest ids stay (no other can be among anyone's best ``k``), so copies of one
   vector, however many, are a few rows. Pivots are a bounded sample whose number grows
   with the square root of the table; each row belongs to the cell of its nearest pivot.
2. First round: a query's k-th best score among a bounded part of its own cell is a
   lower bound of its k-th best of all. Cell summaries give the bound where a cell
   holds too few rows.
3. Query cells are put into groups of near cells. For a row x, a query cell with pivot c
   and queries within r of it, no score passes c.x + r |x|. A row is replicated only to
   groups in which some cell's least bound is reached.
4. A group's rows are dealt to chunks by a hash, and each (group, chunk) is solved on
   its own. There the bound is taken once more for each query and data cell: a score
   against a cell with pivot p and rows within s of it is at most q.p + |q| s; only the
   cells that reach the query's own bound are multiplied out. Ties go to the smaller id.

How much is pruned depends on the data: tight clusters leave a few cells for a query,
while independent directions in many dimensions leave all of them, and the join is
then the product of queries and rows in blocks.

Vectors that are null, empty or hold null or non-finite components take no part;
vectors of another length than the query's are no candidates for it. Lengths without a
pivot are groups of their own. A query's own row is no candidate; other rows with the
same id are. Rows with a null id are candidates (after all ids in ties) and never
queries. Scores are exact at any size of components and are ranked exactly; one beyond
a long is returned as the nearest long. An empty table, or one without queries, gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenir.llm.common import materialise, table

#: Pivots: the square root of the rows within these. They steer pruning, never results.
LEAST_PIVOTS, MOST_PIVOTS = 16, 4096
#: Queries in a group, rows in a chunk, and chunks at least (so that small tables still spread over a cluster).
GROUP, CHUNK, LEAST_CHUNKS = 8192, 16_384, 16
#: Rows of a query's own cell that the first round looks at.
OWN = 1024
ROW = "uid bigint, vec_id bigint, v binary, dim int, cell int, far double, norm double"
NAMES = [x.split()[0] for x in ROW.split(", ")]
FOUND = "query_id bigint, query_uid bigint, vec_id bigint, uid bigint, score decimal(38,0)"
LONG = 2**63 - 1


def quantised(lists: pa.Array, scale: float) -> list[np.ndarray | None]:
    """floor(scale * x) of each usable vector; integers of any size are whole doubles."""
    out: list[np.ndarray | None] = []
    flat, null = lists.flatten(), lists.is_null().to_numpy(False)
    given = flat.cast(pa.float64()).to_numpy(False)  # nulls become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * given)
    # Only components within a factor of ``scale`` of the largest double can overflow; they stay the largest one.
    x = np.where(np.isfinite(given), np.clip(x, -np.finfo(float).max, np.finfo(float).max), np.nan)
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
    for i, gone in enumerate(null):
        own = x[ends[i] : ends[i + 1]]
        out.append(None if gone or not len(own) or not np.isfinite(own).all() else own)
    return out


def encoded(v: np.ndarray) -> bytes:
    """Four bytes a component where that is exact."""
    small = v.astype(np.float32) if np.abs(v).max() < 2.0**24 else v
    return (small + 0.0).tobytes()  # no negative zeros: equal vectors have equal bytes


def decoded(column: pa.Array, dim: int) -> np.ndarray:
    parts = column.to_pylist()
    if all(len(p) == 4 * dim for p in parts):
        return np.frombuffer(b"".join(parts), np.float32).reshape(-1, dim)
    return np.array([np.frombuffer(p, np.float32 if len(p) == 4 * dim else np.float64).astype(np.float64) for p in parts])


def points_of(pivots: list[list[float]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Numbers and coordinates of the pivots of each length."""
    by: dict[int, list[int]] = {}
    for i, p in enumerate(pivots):
        by.setdefault(len(p), []).append(i)
    return {d: (np.array(i), np.array([pivots[k] for k in i], np.float64)) for d, i in by.items()}


def celler(pivots: list[list[float]], scale: float):
    def run(batches):
        points = points_of(pivots)
        for batch in batches:
            every = quantised(batch.column(2), scale)
            ids = [c.to_pylist() for c in (batch.column(0), batch.column(1))]
            by: dict[int, list[int]] = {}
            for i, v in enumerate(every):
                if v is not None:
                    by.setdefault(len(v), []).append(i)
            for dim, at in by.items():
                x = np.array([every[i] for i in at])
                with np.errstate(over="ignore", invalid="ignore"):
                    norm = np.sqrt((x * x).sum(1))
                    cell, far = np.full(len(at), -1 - dim), norm
                    if dim in points:
                        number, p = points[dim]
                        near = np.argmin(np.nan_to_num((p * p).sum(1)[None, :] - 2 * (x @ p.T), nan=np.inf), axis=1)
                        cell, far = number[near], np.sqrt(((x - p[near]) ** 2).sum(1))
                cols = [pa.array([c[i] for i in at], pa.int64()) for c in ids] + [pa.array([encoded(v) for v in x], pa.binary())]
                cols += [pa.array(np.full(len(at), dim), pa.int32()), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(norm)]
                yield pa.RecordBatch.from_arrays(cols, names=NAMES)

    return run


def product(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, bool]:
    """Exact inner products, and whether they are plain numbers (else Python integers)."""
    most = float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1]
    if most < 2.0**24:
        return q.astype(np.float32) @ x.astype(np.float32).T, True
    if most < 2.0**53:
        return q.astype(np.float64) @ x.astype(np.float64).T, True
    whole = lambda a: np.array([[int(t) for t in r] for r in a.tolist()], object)
    return whole(q) @ whole(x).T, False


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's ``k`` best scores, ties to the earlier column; -inf is no score."""
    if scores.dtype == object:
        rows = [[j for j in sorted(range(len(r)), key=lambda j: (-r[j], j)) if r[j] != -math.inf][:k] for r in scores]
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([j for r in rows for j in r], np.int64)
    least = np.partition(scores, -k, axis=1)[:, -k][:, None] if scores.shape[1] > k else -np.inf
    i, j = np.nonzero((scores >= least) & (scores > -np.inf))
    order = np.lexsort((j, -scores[i, j], i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, i)
    own = np.arange(len(i)) - first < k
    return i[own], j[own]


def nearest_rows(q: np.ndarray, q_uid: np.ndarray, least: np.ndarray, x: np.ndarray, uid: np.ndarray, cell: np.ndarray, far: np.ndarray, points: np.ndarray | None, k: int):
    """(query, row, score) of each query's ``k`` best of ``x`` that reach its bound ``least``, and how many pairs were scored.

    ``x`` is in order of ids; ``points`` has a pivot for each cell number in it, or is None.
    """
    out, scored = [], 0
    cells, of = np.unique(cell, return_inverse=True)
    s = np.zeros(len(cells))
    np.maximum.at(s, of, far)
    size = np.bincount(of)
    for at in range(0, len(q), 256):
        part, bound = q[at : at + 256], least[at : at + 256]
        if points is None or not np.isfinite(bound).any():
            need = np.ones((len(part), len(cells)), bool)
        else:
            wide = part.astype(np.float64)
            norm = np.sqrt((wide * wide).sum(1))
            # Rounding of these sums stays far below the slack.
            need = (wide @ points[cells].T + norm[:, None] * s[None, :]) * 1.0 + 1e-9 * norm[:, None] * (s + np.sqrt((points[cells] ** 2).sum(1)))[None, :] + 1e-6 >= bound[:, None]
        # Queries that need the same cells are multiplied out together.
        kinds, kind = np.unique(need, axis=0, return_inverse=True)
        for n, wanted in enumerate(kinds):
            asked, rows = np.flatnonzero(kind.ravel() == n), np.flatnonzero(wanted[of])
            if not len(rows):
                continue
            scored += len(asked) * int(size[wanted].sum())
            scores, plain = product(part[asked], x[rows])
            if not plain:
                scores = scores.copy()
            own = q_uid[at + asked][:, None] == uid[rows][None, :]
            scores[own] = -np.inf if plain else -math.inf
            i, j = best_of(scores, k)
            out += [(at + asked[a], rows[b], scores[a, b]) for a, b in zip(i, j)] if not plain else [np.stack([at + asked[i], rows[j], scores[i, j].astype(np.int64)], axis=1)] if len(i) else []
    if out and isinstance(out[0], np.ndarray) and all(isinstance(o, np.ndarray) for o in out):
        return np.concatenate(out), scored
    return [(int(a), int(b), int(c)) for o in out for a, b, c in (o if isinstance(o, np.ndarray) else [o])], scored


def own_bounds(k: int):
    """First round: queries of a cell with their bound ``least`` from rows of the cell."""

    def run(key, queries: pa.Table, data: pa.Table) -> pa.Table:
        least = np.full(queries.num_rows, -np.inf)
        if queries.num_rows and data.num_rows:
            dim = queries.column("dim")[0].as_py()
            q, x = (decoded(t.column("v").combine_chunks(), dim) for t in (queries, data))
            uid = data.column("uid").to_numpy()
            for at in range(0, len(q), 256):
                scores, plain = product(q[at : at + 256], x)
                if not plain:
                    continue  # too large for bounds in doubles
                scores[queries.column("uid").to_numpy()[at : at + 256][:, None] == uid[None, :]] = -np.inf
                if len(uid) >= k:
                    least[at : at + 256] = np.partition(scores, -k, axis=1)[:, -k]
        return pa.table([*[queries.column(n) for n in NAMES], pa.array(least)], names=[*NAMES, "least"])

    return run


def spans(c: np.ndarray, r: float, points: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible scores between queries within ``r`` of ``c`` and the rows within ``far`` of each pivot."""
    mid = points @ c
    width = (np.linalg.norm(c) * far + r * np.sqrt((points**2).sum(1)) + r * far) * (1 + 1e-9) + 1e-6
    return mid - width, mid + width


def group_cells(asked: list, found: list, pivots: list[list[float]], k: int) -> dict[int, dict]:
    """Per query cell: its group, radius and least bound. ``asked``: cell, n, far, least; ``found``: cell, n, far of the data."""
    points = points_of(pivots)
    row_of = {int(c): (dim, i) for dim, (number, _) in points.items() for i, c in enumerate(number)}
    held: dict[int, list] = {}
    for r in found:
        held.setdefault(row_of[r["cell"]][0], []).append(r)
    out: dict[int, dict] = {}
    group = -1
    for dim in sorted({row_of[r["cell"]][0] for r in asked}):
        own = [r for r in asked if row_of[r["cell"]][0] == dim]
        at = np.array([points[dim][1][row_of[r["cell"]][1]] for r in own])
        # A chain of near cells, cut where a group is full.
        left, chain, here = np.ones(len(own), bool), [], 0
        while left.any():
            left[here] = False
            chain.append(here)
            if left.any():
                here = int(np.argmin(np.where(left, ((at - at[here]) ** 2).sum(1), np.inf)))
        data = held.get(dim, [])
        places = np.array([points[dim][1][row_of[r["cell"]][1]] for r in data]).reshape(-1, dim)
        far, n = np.array([r["far"] for r in data]), np.array([r["n"] for r in data])
        full = GROUP + 1
        for i in chain:
            r = own[i]
            least = r["least"]
            if not math.isfinite(least) and len(data):
                low, _ = spans(at[i], r["far"], places, far)
                order = np.argsort(-low)
                enough = np.flatnonzero(np.cumsum(n[order]) > k)  # the query itself may be among them
                least = float(low[order][enough[0]]) if len(enough) else -math.inf
                least = least if math.isfinite(least) else -math.inf
            if full + r["n"] > GROUP:
                group, full = group + 1, 0
            full += r["n"]
            out[r["cell"]] = {"group": group, "far": r["far"], "least": least, "n": r["n"]}
    return out


def router(pivots: list[list[float]], cells: dict[int, dict]):
    """Copies of each row, one for each group whose bound it reaches."""

    def run(batches):
        points = points_of(pivots)
        sides = {}
        for dim, (number, p) in points.items():
            own = [i for i, c in enumerate(number) if int(c) in cells]
            if own:
                info = [cells[int(number[i])] for i in own]
                order = np.argsort([x["group"] for x in info], kind="stable")
                group = np.array([x["group"] for x in info])[order]
                starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                sides[dim] = (p[own][order], np.array([x["far"] for x in info])[order], np.array([x["least"] for x in info])[order], group[starts], starts)
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in sides:
                    continue
                p, r, least, groups, starts = sides[dim]
                own = batch.filter(pa.array(dims == dim))
                x, norm = decoded(own.column(2), dim).astype(np.float64), own.column(6).to_numpy()
                with np.errstate(over="ignore", invalid="ignore"):
                    high = x @ p.T + norm[:, None] * r[None, :] + 1e-9 * norm[:, None] * (r + np.sqrt((p * p).sum(1)))[None, :] + 1e-6
                    reached = np.logical_or.reduceat(~(high < least[None, :]), starts, axis=1)
                for n, g in enumerate(groups.tolist()):
                    if reached[:, n].any():
                        t = own.filter(pa.array(reached[:, n]))
                        yield pa.RecordBatch.from_arrays([*t.columns, pa.array(np.full(t.num_rows, g), pa.int64())], names=[*NAMES, "g"])

    return run


def solver(k: int, pivots: list[list[float]]):
    places = points_of(pivots)

    def run(key, queries: pa.Table, data: pa.Table) -> pa.Table:
        got: list = []
        if queries.num_rows and data.num_rows:
            dim = queries.column("dim")[0].as_py()
            data = data.take(pa.array(np.lexsort((data.column("uid").to_numpy(), data.column("vec_id").fill_null(LONG).to_numpy(), data.column("vec_id").is_null().to_numpy()))))
            q, x = (decoded(t.column("v").combine_chunks(), dim) for t in (queries, data))
            points, cell = None, data.column("cell").to_numpy()
            if dim in places and cell[0] >= 0:
                number, p = places[dim]
                points, cell = p, np.searchsorted(number, cell)
            got, _ = nearest_rows(q, queries.column("uid").to_numpy(), queries.column("least").to_numpy(), x, data.column("uid").to_numpy(), cell, data.column("far").to_numpy(), points, k)
        a, b, c = (list(z) for z in zip(*(got.tolist() if isinstance(got, np.ndarray) else got))) if len(got) else ([], [], [])
        a, b = pa.array(a, pa.int64()), pa.array(b, pa.int64())
        return pa.table(
            [queries.column("vec_id").take(a), queries.column("uid").take(a), data.column("vec_id").take(b), data.column("uid").take(b), pa.array([max(-(10**38) + 1, min(10**38 - 1, s)) for s in c], pa.decimal128(38, 0))],
            names=[x.split()[0] for x in FOUND.split(", ")],
        )

    return run


def top_k(df: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, pivots: int | None = None) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's ``k`` best rows; ``is_query``: a condition on ``vec_id``."""
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    usable = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    n = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(df.count())))
    points = [[float(math.floor(scale * x)) if abs(x) < 1e300 else x for x in r["v"]] for r in usable.orderBy(F.xxhash64("vec_id"), "uid").select("v").limit(n).collect()]
    points = list(map(list, dict.fromkeys(map(tuple, points))))

    celled = rows.mapInArrow(celler(points, scale), ROW)
    celled = materialise(celled, "cells")
    asks = F.coalesce(is_query(F.col("vec_id")), F.lit(False))
    copies = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last(), "uid")
    data = materialise(celled.withColumn("_k", F.row_number().over(copies)).where(F.col("_k") <= k + 1).drop("_k"), "distinct")
    # Summaries: at most a row for each pivot, and one for all lengths without any.
    summary = lambda t, *more: [r.asDict() for r in t.groupBy(F.greatest("cell", F.lit(-1)).alias("cell")).agg(F.count("*").alias("n"), F.max("far").alias("far"), *more).collect()]
    found = summary(data)
    chunks = max(LEAST_CHUNKS, -(-sum(r["n"] for r in found) // CHUNK))

    # First round, within cells that have a pivot.
    queries = celled.where(asks)
    counted = {r["cell"]: r["n"] for r in summary(queries) if r["cell"] >= 0}
    as_map = lambda d, kind: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("cell")] if d else F.lit(None).cast(kind)
    parts = F.coalesce(as_map({c: -(-m // GROUP) for c, m in counted.items()}, "int"), F.lit(1))
    some = Window.partitionBy("cell").orderBy(F.xxhash64("uid", F.lit(3)), "uid")
    sample = data.where(F.col("cell").isin(list(counted)) if len(counted) <= 100 else F.col("cell") >= 0).withColumn("_k", F.row_number().over(some)).where(F.col("_k") <= OWN)
    sample = sample.select(*NAMES, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = queries.where("cell >= 0").withColumn("part", F.pmod(F.xxhash64("uid", F.lit(1)), parts).cast("int"))
    bound = dealt.groupBy("cell", "part").cogroup(sample.groupBy("cell", "part")).applyInArrow(own_bounds(k), ROW + ", least double")
    odd = queries.where("cell < 0").withColumn("least", F.lit(float("-inf")))
    asked = materialise(bound.unionByName(odd), "asked")

    with_pivot = lambda rows: [r for r in rows if r["cell"] >= 0]
    cells = group_cells(with_pivot(summary(asked, F.min("least").alias("least"))), with_pivot(found), points, k)
    sizes: dict[int, int] = {}
    for x in cells.values():
        sizes[x["group"]] = sizes.get(x["group"], 0) + x["n"]
    shares = {g: -(-m // GROUP) for g, m in sizes.items()}
    of = lambda d: F.coalesce(F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("g")], F.lit(1)) if d else F.lit(1)

    # Lengths without a pivot are groups by their length, which needs no list of them.
    needed = data.where("cell >= 0").mapInArrow(router(points, cells), ROW + ", g bigint").unionByName(data.where("cell < 0").withColumn("g", F.col("cell").cast("bigint")))
    needed = needed.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(chunks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), of(shares) - 1)))
    own = asked.withColumn("g", F.coalesce(as_map({c: x["group"] for c, x in cells.items()}, "int"), F.col("cell")).cast("bigint"))
    own = own.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(1)), of(shares)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    near = own.groupBy("g", "chunk", "part").cogroup(needed.groupBy("g", "chunk", "part")).applyInArrow(solver(k, points), FOUND)
    order = Window.partitionBy("query_uid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid")
    score = F.greatest(F.least("score", F.lit(LONG).cast("decimal(38,0)")), F.lit(-LONG - 1).cast("decimal(38,0)")).cast("long")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def op7_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
