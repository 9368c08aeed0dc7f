"""Layer documents, manifests, coercions and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions.text import col
from provenir.operators.integrity import issue
from provenir.operators.matching import numbered
from provenir.operators.segment import starts_within


def carry(prev: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The new rows, with the previous values where they say nothing."""
    old = prev.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns])
    out = new.join(old, key, "left")
    return out.select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in new.columns])


def fallback(primary, other) -> Column:
    """An array, or another where it is null or empty."""
    return F.when(F.size(F.coalesce(col(primary), F.array())) > 0, col(primary)).otherwise(col(other))


def manifest(steps: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ordered nodes of each process with their action's name; steps of unknown actions as warnings."""
    named = steps.join(actions.select(F.col("id").alias("action_id"), F.col("name").alias("_n")), "action_id", "left")
    known = named.where(F.col("_n").isNotNull())
    nodes = known.groupBy("process_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct("action_id", F.col("_n").alias("name")).alias("v")))), lambda x: x["v"]).alias("nodes"))
    lost = named.where(F.col("_n").isNull()).select(*issue("warn", "unresolved_step", "process", F.col("process_id"), "action_id", F.col("action_id")))
    return nodes, lost


def layer_issues(rows: DataFrame, key: str, text: str, name: str = "name") -> DataFrame:
    """Syntax errors, items that are no objects, missing and repeated ids of one layer's items. Only items with an id are compared with others."""
    v = F.try_parse_json(text)
    t = F.schema_of_variant(v)
    item = rows.select(F.col(key), F.col(text).alias("_t"), t.alias("_k"), F.try_variant_get(v, f"$.{name}", "string").alias("_id"))
    named = F.col("_id").isNotNull() & (F.trim("_id") != "") & F.coalesce(F.col("_k").startswith("OBJECT"), F.lit(False))
    first = F.row_number().over(Window.partitionBy("_id").orderBy(key))
    item = item.where(named).withColumn("_f", first).unionByName(item.where(~named).withColumn("_f", F.lit(1)))
    kind = (
        F.when(F.col("_t").isNotNull() & F.col("_k").isNull(), "syntax")
        .when(~F.col("_k").startswith("OBJECT"), "not_object")
        .when(F.col("_id").isNull() | (F.trim("_id") == ""), "missing_id")
        .when(F.col("_f") > 1, "duplicate_id")
    )
    return item.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(key, "kind")


def shape_issues(rows: DataFrame, key: str, required: list[str], closed: dict[str, list[str]]) -> DataFrame:
    """Required fields that are empty and values outside a closed vocabulary."""
    checks = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.concat(F.lit("missing:"), F.lit(c))) for c in required]
    checks += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(allowed), F.concat(F.lit("value:"), F.lit(c))) for c, allowed in closed.items()]
    return rows.select(key, F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def per_stage(rows: DataFrame, by: str, order: list[Column], most: int = 40) -> DataFrame:
    """The first ``most`` of each group, with how many were left out. Groups are counted apart, so that ranking stops at ``most`` before the exchange."""
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)
    sizes = rows.groupBy(by).agg(F.count("*").alias("_n"))
    return first.join(sizes, by).withColumn("left_out", F.greatest(F.col("_n") - most, F.lit(0))).drop("_n")


def endpoints(triples: DataFrame, by: str, order: str) -> DataFrame:
    """Distinct ends of a list of triples in order of first mention."""
    ends = triples.select(by, F.col(order).alias("o"), F.explode(F.when(F.col("literal"), F.array("s")).otherwise(F.array("s", "o"))).alias("node"), F.col("s").alias("_s"))
    first = ends.groupBy(by, "node").agg(F.min(F.struct("o", (F.col("node") != F.col("_s")).alias("second"))).alias("k"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "node"))), lambda x: x["node"]).alias("nodes"))


def known_only(values, known) -> Column:
    """Known values of an array, each once, in order."""
    return F.array_distinct(F.filter(col(values), lambda x: F.array_contains(col(known), x)))


def related_entity(c) -> Column:
    """The id in trailing parentheses."""
    return F.nullif(F.regexp_extract(col(c), r"\(([^()]+)\)\s*$", 1), F.lit(""))


def excerpt(rows: DataFrame, by: str, order: str, text: str, most: int, sep: str = "\n\n") -> DataFrame:
    """Texts of a group in order, joined and cut at ``most`` characters.

    Only what can fall within the cut is gathered: running lengths decide before any text moves.
    """
    rows = starts_within(rows, by, order, F.coalesce(F.length(text), F.lit(0)) + len(sep), most)
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("_b", F.coalesce(F.sum(F.length(text) + len(sep)).over(w), F.lit(0))).where(F.col("_b") < most)
    return near.groupBy(by).agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), sep), F.lit(most)).alias("excerpt"))


def unwrap(c) -> Column:
    """The items of a layer document: a bare array, or the first array beside ``metadata``; null where it does not parse."""
    t = F.trim(col(c))
    parts = F.from_json(t, "map<string,string>")
    inner = F.filter(F.map_entries(parts), lambda e: (e["key"] != "metadata") & e["value"].startswith("["))
    return F.when(t.startswith("[") & F.try_parse_json(t).isNotNull(), t).when(t.startswith("{"), F.get(inner, F.lit(0))["value"])


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Later rows of a name get the next number that no earlier row's name has, with a warning flag."""
    return numbered(rows, F.col(name), order, "unique_name", "").withColumn("warned", F.col("unique_name") != F.col(name))
