"""Triples, walks and path checks. A triple is (s, p, o, literal)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The closed vocabulary of predicates beside relationship verbs.
PREDICATES = (
    "kind label has_attribute has_type references cardinality applies_to severity rule_kind triggered_by "
    "consumes produces guarded_by emits performed_by calls produced_by consumed_by has_step precedes involves"
).split()


def triples(rows: DataFrame, s, p, o, literal: bool = False) -> DataFrame:
    """One branch of a projection; rows without subject or object give none."""
    out = rows.select(s.cast("string").alias("s"), (F.lit(p) if isinstance(p, str) else p).alias("p"), o.cast("string").alias("o"), F.lit(literal).alias("literal"))
    return out.where(F.col("s").isNotNull() & F.col("o").isNotNull())


def every(parts: list[DataFrame]) -> DataFrame:
    """The triples of all branches, for what takes repeated ones as one: all rows meet in ``project`` only to drop these."""
    return reduce(DataFrame.unionByName, parts)


def project(parts: list[DataFrame]) -> DataFrame:
    """The distinct triples of all branches."""
    return every(parts).dropDuplicates(["s", "p", "o"])


def predicate_counts(t: DataFrame) -> DataFrame:
    """A1."""
    return t.groupBy("p").agg(F.count("*").alias("n"))


def adjacency(t: DataFrame) -> DataFrame:
    """Edges both ways; a literal or self reference only from its subject."""
    there = t.select(F.col("s").alias("node"), F.col("o").alias("other"), "s", "p", "o", "literal")
    back = t.where(~F.col("literal") & (F.col("s") != F.col("o"))).select(F.col("o").alias("node"), F.col("s").alias("other"), "s", "p", "o", "literal")
    return there.unionByName(back)


def frontier_batch(t: DataFrame, frontier: DataFrame, sent: DataFrame, cap: int = 150) -> DataFrame:
    """Unsent edges at the frontier first, then names and kinds of what they reach, then the frontier's literals. Triples may be repeated."""
    adj = adjacency(t)
    left = adj.join(sent.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
    at = left.join(frontier.select("node").distinct(), "node", "left_semi")
    edges = at.where(~F.col("literal")).select("s", "p", "o", F.lit(0).alias("prio"), "other")
    reached = edges.select(F.col("other").alias("node")).distinct().join(frontier.select("node"), "node", "left_anti")
    names = left.where(F.col("literal") & F.col("p").isin("label", "kind")).join(reached, "node", "left_semi").select("s", "p", "o", F.lit(1).alias("prio"))
    own = at.where("literal").select("s", "p", "o", F.lit(2).alias("prio"))
    every = edges.drop("other").unionByName(names).unionByName(own).groupBy("s", "p", "o").agg(F.min("prio").alias("prio"))
    return every.orderBy("prio", "s", "p", "o").limit(cap)


def frontier_rounds(t: DataFrame, seeds: DataFrame, keep, most: int = 4, cap: int = 150, width: int = 12) -> DataFrame:
    """The batches of a walk without a guide: each round sends its frontier's best ``cap`` unsent triples, and the first ``width`` new ends of their edges are the next frontier.

    ``keep`` writes each round, which has at most ``cap`` rows.
    """
    frontier = keep(seeds.select("node").distinct(), "frontier0")
    visited, sent = frontier, None
    for k in range(1, most + 1):
        known = t.limit(0).select("s", "p", "o") if sent is None else sent.select("s", "p", "o")
        batch = keep(frontier_batch(t, frontier, known, cap).withColumn("round", F.lit(k)), f"round{k}")
        if batch.isEmpty():
            break
        sent = batch if sent is None else sent.unionByName(batch)
        at = F.struct("s", "p", "o")
        ends = batch.where("prio = 0").select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("s").alias("node")), F.struct(F.lit(1).alias("side"), F.col("o").alias("node")))).alias("e"), at.alias("at")).select("e.node", F.struct("at", "e.side").alias("at"))
        fresh = ends.groupBy("node").agg(F.min("at").alias("at")).join(visited, "node", "left_anti")
        frontier = keep(fresh.orderBy("at").limit(width).select("node"), f"frontier{k}")
        visited = visited.unionByName(frontier)
    return sent if sent is not None else t.limit(0).select("s", "p", "o", F.lit(0).alias("prio"), F.lit(0).alias("round"))


def hops(t: DataFrame, seeds: DataFrame, most: int, keep) -> DataFrame:
    """Least number of hops of every node that edges reach from ``seeds`` (``node``) within ``most``.

    A round joins the frontier with the edges and drops what is known; ``keep``
    (a function of DataFrame and name) writes each round, so plans stay short.
    """
    adj = keep(adjacency(t.where(~F.col("literal"))).select("node", "other").distinct(), "adjacency")
    seen = frontier = keep(seeds.select("node").distinct().withColumn("hop", F.lit(0)), "hop0")
    for k in range(1, most + 1):
        near = frontier.select("node").join(adj, "node").select(F.col("other").alias("node")).distinct()
        frontier = keep(near.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(k)), f"hop{k}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def check_paths(t: DataFrame, paths: DataFrame, vocabulary: list[str]) -> DataFrame:
    """For each path (``path_id``, ``path``: node, predicate, node, ...) how many hops hold in either direction, and whether all do. Triples may be repeated.

    Ends go in one order, so an edge is one row for both directions; only predicates and edges that some path may name are looked up.
    """
    n = F.ceil((F.size("path") - 1) / 2).cast("int")
    hop = paths.where(F.size("path") >= 3).select("path_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("path", 2 * i).alias("a"), F.get("path", 2 * i + 1).alias("p"), F.get("path", 2 * i + 2).alias("b")))).alias("k", "x")).select("path_id", "k", "x.*")
    ends = lambda a, b: [F.least(a, b).alias("_x"), F.greatest(a, b).alias("_y")]
    edges = t.where(~F.col("literal") & F.col("s").isNotNull() & F.col("o").isNotNull())
    known = (edges.where(F.col("p").isin(vocabulary)) if vocabulary else edges).select("p", *ends("s", "o")).distinct().withColumn("_ok", F.lit(True))
    # A hop without an end holds not; the least of two ends would be the other.
    asked = hop.select("path_id", "p", *[F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), x).alias(n) for x, n in zip((F.least("a", "b"), F.greatest("a", "b")), ("_x", "_y"))])
    found = asked.join(known, ["p", "_x", "_y"], "left").withColumn("ok", F.coalesce("_ok", F.lit(False)))
    return found.groupBy("path_id").agg(F.count("*").alias("hops"), F.count_if("ok").alias("held"), F.bool_and("ok").alias("valid"))


def directly_follows(log: DataFrame, case: str, time: str, event: str, tie: str) -> DataFrame:
    """How often one event follows another at once within a case, and how many cases show it."""
    from pyspark.sql import Window

    after = F.lead(event).over(Window.partitionBy(case).orderBy(time, tie))
    return log.withColumn("_to", after).where(F.col("_to").isNotNull()).groupBy(F.col(event).alias("source"), F.col("_to").alias("target")).agg(F.count("*").alias("n"), F.countDistinct(case).alias("cases"))
