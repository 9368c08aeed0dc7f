"""Constraint checks as queries: one declaration per reference path, one generator of anti-joins."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ISSUE = ["level", "kind", "owner", "from_id", "field", "missing_id"]


@dataclass(frozen=True)
class Path:
    """A reference of ``owner`` rows (``key``) by ``column`` to ``target``'s ``target_key``; arrays are taken apart."""

    owner: str
    key: str
    column: str
    target: str
    target_key: str
    level: str = "error"
    kind: str = "dangling_reference"


#: The reference paths of a knowledge model: owner table, column, target table.
MODEL_PATHS = [
    Path("object_property", "object_id", "references", "object_type", "id"),
    Path("relationship", "id", "source", "object_type", "id"),
    Path("relationship", "id", "target", "object_type", "id"),
    Path("rule_object", "rule_id", "object_id", "object_type", "id"),
    Path("rule_attribute", "rule_id", "attribute_id", "attribute", "id"),
    Path("rule", "id", "trigger_event_id", "event_type", "id"),
    Path("rule_binding", "rule_id", "object_id", "object_type", "id"),
    Path("rule_group_member", "group_id", "rule_id", "rule", "id", "warn"),
    Path("action_io", "action_id", "object_id", "object_type", "id"),
    Path("action_precondition", "action_id", "rule_id", "rule", "id"),
    Path("action_emit", "action_id", "event_id", "event_type", "id"),
    Path("action_trigger", "action_id", "event_id", "event_type", "id"),
    Path("action_side_effect", "action_id", "object_id", "object_type", "id"),
    Path("action_step", "action_id", "reads", "object_type", "id"),
    Path("action_step", "action_id", "writes", "object_type", "id"),
    Path("action_step", "action_id", "calls_action_id", "action", "id"),
    Path("action_step", "action_id", "guard_rule_id", "rule", "id"),
    Path("action_param", "action_id", "object_id", "object_type", "id"),
    Path("event_field", "event_id", "object_id", "object_type", "id"),
    Path("event_producer", "event_id", "action_id", "action", "id"),
    Path("event_consumer", "event_id", "action_id", "action", "id"),
    Path("process_object", "process_id", "object_id", "object_type", "id"),
    Path("process_step", "process_id", "action_id", "action", "id"),
    Path("process_actor", "process_id", "role", "role", "id", "warn"),
    Path("process_edge", "process_id", "to_step_id", "process_step", "step_id"),
    Path("process_edge", "process_id", "event_id", "event_type", "id"),
    Path("process_trigger", "process_id", "event_id", "event_type", "id"),
    Path("event_consumer", "event_id", "process_id", "process", "id", "warn"),
]


def issue(level, kind, owner, from_id, field, missing):
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return [c.cast("string").alias(n) for c, n in zip(map(lit, (level, kind, owner, from_id, field, missing)), ISSUE)]


def dangling(tables: dict[str, DataFrame], paths: list[Path]) -> DataFrame:
    """Rows of every path whose reference has no target; nulls refer to nothing."""
    parts = []
    for p in paths:
        if p.owner not in tables or p.target not in tables or p.column not in tables[p.owner].columns:
            continue
        own = references(tables, p)
        ids = tables[p.target].select(F.col(p.target_key).alias("_ref")).distinct()
        lost = own.where(F.col("_ref").isNotNull()).join(ids, "_ref", "left_anti")
        parts.append(lost.select(*issue(p.level, p.kind, p.owner, F.col("_from"), p.column, F.col("_ref"))))
    return reduce(DataFrame.unionByName, parts)


def revalidate(old: dict[str, DataFrame], new: dict[str, DataFrame], paths: list[Path], before: DataFrame, touched: set[str] | None = None) -> DataFrame:
    """The issues of ``dangling(new, paths)`` from those ``before`` (of ``old``) and the differences between the two models.

    Only paths are read whose owner or target table is in ``touched`` (all, if not given). Of such a path, owners
    whose references changed are checked again, other owners only against targets that went; issues whose
    target came are dropped. All other issues stand.
    """
    touched = touched if touched is not None else set(old) | set(new)
    out = []
    for p in paths:
        at = (F.col("owner") == p.owner) & (F.col("field") == p.column)
        known = lambda t: p.owner in t and p.target in t and p.column in t[p.owner].columns
        was = before.where(at)
        if not known(new):
            continue
        if not {p.owner, p.target} & touched and known(old):
            out.append(was)
            continue
        if not known(old):
            out.append(dangling(new, [p]))
            continue
        refs, lost_ids, new_ids, again = references(new, p), None, None, None
        if p.owner in touched:
            sides = references(old, p).withColumn("_n", F.lit(-1)).unionByName(refs.withColumn("_n", F.lit(1)))
            changed = sides.groupBy("_from", "_ref").agg(F.sum("_n").alias("_n")).where("_n <> 0").select("_from").distinct()
            was = was.join(changed.select(F.col("_from").cast("string").alias("from_id")), "from_id", "left_anti")
            again = refs.join(changed, "_from", "left_semi")
            refs = refs.join(changed, "_from", "left_anti")
        ids = lambda t: t[p.target].select(F.col(p.target_key).alias("_ref")).where("_ref IS NOT NULL").distinct()
        if p.target in touched:
            lost_ids, new_ids = ids(old).join(ids(new), "_ref", "left_anti"), ids(new).join(ids(old), "_ref", "left_anti")
            was = was.join(new_ids.select(F.col("_ref").cast("string").alias("missing_id")), "missing_id", "left_anti")
        row = issue(p.level, p.kind, p.owner, F.col("_from"), p.column, F.col("_ref"))
        out.append(was.select(*ISSUE))
        if again is not None:
            out.append(again.where("_ref IS NOT NULL").join(ids(new), "_ref", "left_anti").select(*row))
        if lost_ids is not None:
            out.append(refs.join(lost_ids, "_ref", "left_semi").select(*row))
    return reduce(DataFrame.unionByName, [x.select(*ISSUE) for x in out]) if out else before.limit(0)


def references(tables: dict[str, DataFrame], p: Path) -> DataFrame:
    """``_from`` and ``_ref`` of a path's owners, arrays taken apart; an owner without references has none."""
    own = tables[p.owner].select(F.col(p.key).alias("_from"), F.col(p.column).alias("_ref"))
    return own.select("_from", F.explode("_ref").alias("_ref")) if own.schema["_ref"].dataType.typeName() == "array" else own


def issues_of_stage(issues: DataFrame, prefixes: list[str]) -> DataFrame:
    """The issues that come from ids of a stage."""
    return issues.where(reduce(lambda a, b: a | b, [F.col("from_id").startswith(x) for x in prefixes]))


def duplicate_ids(nodes: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """V1: every row of an id but the first."""
    w = Window.partitionBy(key).orderBy(order)
    return nodes.withColumn("_k", F.row_number().over(w)).where("_k > 1").select(*issue("error", "duplicate_id", "node", F.col(key), "id", F.col(key)))


def missing_sources(nodes: DataFrame) -> DataFrame:
    """V2: extracted or merged nodes without a citation (error), with an unverified one (warn)."""
    own = nodes.where(F.col("provenance").isin("extracted", "merged"))
    none = own.where("sources = 0").select(*issue("error", "missing_source", F.col("kind"), F.col("id"), "sources", F.lit(None)))
    weak = nodes.where("sources > verified").select(*issue("warn", "unverified_quote", F.col("kind"), F.col("id"), "sources", F.lit(None)))
    return none.unionByName(weak)


def cached_mismatch(owner: DataFrame, key: str, cached, live, kind: str = "cached_mismatch") -> DataFrame:
    """V7: a cached value that is not the live one."""
    return owner.where(~cached.eqNullSafe(live)).select(*issue("warn", kind, "node", F.col(key), "cached", live))


def same_set(a, b):
    """U4."""
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def inverse(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """The distinct pairs of ``right`` and the ``left`` that names it. Pairs, not a list for each: very many may name one."""
    return pairs.where(F.col(right).isNotNull() & F.col(left).isNotNull()).select(right, left).distinct()


def inverse_mismatch(declared: DataFrame, derived: DataFrame, key: str, column: str) -> DataFrame:
    """Keys whose declared pairs are not the derived ones."""
    sides = declared.select(key, column, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(derived.select(key, column, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    odd = sides.groupBy(key, column).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")).where("_a <> _b").select(key).distinct()
    return odd.select(*issue("warn", "inverse_mismatch", "event", F.col(key), column, F.lit(None)))


def rollup(issues: DataFrame) -> DataFrame:
    """Issues by owner and level, with the totals and whether the model may be saved."""
    by = issues.groupBy("owner").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warn").alias("warnings"))
    total = by.agg(F.lit("*").alias("owner"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"))
    return by.unionByName(total).withColumn("can_save", F.col("errors") == 0)
