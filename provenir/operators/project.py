"""Published layers and generated files from model tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions.text import first_clause, pascal_snake, property_type, slugify, upper_snake
from provenir.operators.matching import numbered

#: Published type of each internal one.
PUBLISHED = {"string": "String", "integer": "Integer", "decimal": "Float", "money": "Float", "boolean": "Boolean", "date": "Date", "datetime": "Timestamp", "uuid": "String", "enum": "String", "reference": "String", "json": "String", "array": "List<String>"}
JSON_TYPES = {"String": "string", "Integer": "integer", "Float": "number", "Boolean": "boolean", "Date": "string", "Timestamp": "string"}
#: Prefixes of ids by layer.
LAYERS = {"ruleGroup:": "rule_groups", "rule:": "rules", "objectType:": "objects", "rel:": "relationships", "action:": "actions", "event:": "events", "process:": "processes"}


def lookup(table: dict, c, default=None) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(c) if isinstance(c, str) else c], F.lit(default))


def published_type(c) -> Column:
    """F7."""
    return lookup(PUBLISHED, c, "String")


def json_type(c) -> Column:
    """F8."""
    return F.when(F.col(c).startswith("List<"), "array").otherwise(lookup(JSON_TYPES, c, "string"))


def layer_of(c) -> Column:
    """owning layer of an id."""
    out = F.lit(None).cast("string")
    for prefix, layer in reversed(list(LAYERS.items())):
        out = F.when(F.col(c).startswith(prefix), layer).otherwise(out)
    return out


def bare_id(c) -> Column:
    """an id without the prefix of its kind."""
    return F.regexp_replace(F.col(c), "^[^:]*:", "")


def coerce_id(rows: DataFrame, id_: str, order: str, prefix: str) -> DataFrame:
    """``fixed``: the id with the layer's prefix and a slug of its body; one that another row has already gets the next free number."""
    known = "^(" + "|".join([*LAYERS, "doc:", "ontology:", "inst:", "term:"]) + ")"
    want = F.concat(F.lit(prefix), slugify(F.regexp_replace(F.col(id_), known, "")))
    good = rows.withColumn("_want", want)
    kept = good.where(F.col("_want") == F.col(id_)).withColumn("_first", F.lit(0))
    moved = good.where(~F.col("_want").eqNullSafe(F.col(id_))).withColumn("_first", F.lit(1))
    both = kept.unionByName(moved).withColumn("_at", F.format_string("%d %020d", "_first", F.col(order).cast("bigint")))
    return numbered(both, F.col("_want"), "_at", "fixed", "-").drop("_want", "_first", "_at")


def spec_objects(objects: DataFrame, properties: DataFrame) -> DataFrame:
    """Published objects, properties in order."""
    item = F.struct("ord", F.struct("name", published_type("type").alias("type"), "is_foreign_key", "references").alias("p"))
    props = properties.groupBy("object_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["p"]).alias("properties"))
    return objects.join(props, F.col("id") == F.col("object_id"), "left").select(pascal_snake("name").alias("id"), "name", F.coalesce("description", F.lit("")).alias("description"), "primary_key", F.coalesce("properties", F.array().cast(props.schema["properties"].dataType)).alias("properties"))


def spec_rules(rules: DataFrame) -> DataFrame:
    """Published rules named by title or first clause."""
    return rules.select("id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(first_clause("statement"), F.lit("")), "id").alias("businessLogicRuleName"), F.col("statement").alias("standardizedLogicRule"))


def spec_events(events: DataFrame) -> DataFrame:
    return events.select(upper_snake("name").alias("name"), F.coalesce("description", F.lit("")).alias("description"))


def layer_file(layer: DataFrame, name: str, project: str, version: int, order: str | None = None) -> DataFrame:
    """(``path``, ``part``, ``ord``, ``line``): the lines of one layer's document, wrapped with its metadata.

    A line is a row, so a layer of any size stays spread; ``write_layer`` puts them in order.
    """
    meta = F.to_json(F.struct(F.lit(project).alias("project_name"), F.lit(name).alias("document_type"), F.lit(version).alias("version")))
    row = lambda part, line: layer.sparkSession.range(1).select(F.lit(f"{name}.json").alias("path"), F.lit(part).alias("part"), F.lit("").alias("ord"), line.alias("line"))
    at = F.col(order).cast("string") if order else F.to_json(F.struct(*layer.columns))
    items = layer.select(F.lit(f"{name}.json").alias("path"), F.lit(1).alias("part"), at.alias("ord"), F.to_json(F.struct(*layer.columns)).alias("line"))
    return row(0, F.concat(F.lit('{"metadata":'), meta, F.lit(f',"{name}":['))).unionByName(items).unionByName(row(2, F.lit("]}")))


def write_layer(lines: DataFrame, folder: str) -> None:
    """Text files that, put together in order of their names, are the document: a comma stands before each item but the first. Equal items are one."""
    lines = lines.dropDuplicates(["part", "ord", "line"])
    first = lines.where("part = 1").agg(F.min(F.struct("ord", "line")).alias("f")).select("f.*").first()
    comma = F.when((F.col("part") == 1) & ~((F.col("ord") == F.lit(first["ord"])) & (F.col("line") == F.lit(first["line"]))), ",").otherwise("") if first["ord"] is not None else F.lit("")
    lines.repartitionByRange("part", "ord", "line").sortWithinPartitions("part", "ord", "line").select(F.concat(comma, "line").alias("value")).write.mode("overwrite").text(folder)


def parameter_schema(inputs: DataFrame, by: str) -> DataFrame:
    """JSON-schema parameters of each action from its inputs (name, type, required, many)."""
    prop = F.struct(F.when(F.col("many"), "array").otherwise(json_type("type")).alias("type"), F.col("description"))
    return inputs.groupBy(by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("name"), prop.alias("schema"))))).alias("properties"),
        F.array_sort(F.filter(F.collect_list(F.when(F.col("required"), F.col("name"))), lambda x: x.isNotNull())).alias("required"),
    )


def routine_actions(routines: DataFrame) -> DataFrame:
    """Database routines (``params``: mode, name, type) as actions with inputs, outputs and a function tool; those that return a trigger are none."""
    some = routines.where(~F.lower(F.coalesce("returns", F.lit(""))).contains("trigger"))
    item = lambda p: F.struct(p["name"].alias("name"), property_type(p["type"]).alias("type"))
    mode = lambda p: F.coalesce(p["mode"], F.lit("IN"))
    out = F.transform(F.filter("params", lambda p: mode(p).isin("OUT", "INOUT")), item)
    result = F.array(F.struct(F.lit("result").alias("name"), property_type("returns").alias("type")))
    return some.select("id", "name", F.transform(F.filter("params", lambda p: mode(p) != "OUT"), item).alias("inputs"), F.when((F.col("kind") == "function") & (F.coalesce("returns", F.lit("")) != ""), F.concat(out, result)).otherwise(out).alias("outputs"), F.lit("function").alias("tool"))


def side_effects(routines: DataFrame, tables: DataFrame) -> DataFrame:
    """Distinct (routine, kind, table object) of the statements in routine bodies: inserts write, updates and deletes change state.

    A table is found by its name, and by its schema where the statement names one; of several the first by order.
    """
    name = r'([A-Za-z0-9_."`]+)'
    all_of = lambda p: F.regexp_extract_all("body", F.lit(p), F.lit(1))
    writes, changes = all_of(rf"(?i)\binsert\s+into\s+{name}"), F.concat(all_of(rf"(?i)\bupdate\s+{name}\s+set\b"), all_of(rf"(?i)\bdelete\s+from\s+{name}"))
    rows = routines.select("id", F.explode(F.concat(F.transform(writes, lambda t: F.struct(F.lit("db_write").alias("kind"), t.alias("t"))), F.transform(changes, lambda t: F.struct(F.lit("state_change").alias("kind"), t.alias("t"))))).alias("x"))
    parts = F.split(F.regexp_replace("x.t", '["`]', ""), r"\.")
    named = rows.select("id", F.col("x.kind").alias("kind"), F.element_at(parts, -1).alias("table"), F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2)).alias("_schema")).distinct()
    own = tables.select("table", F.col("schema").alias("_own"), F.col("id").alias("object_id"), "ord")
    hits = named.join(own, "table").where(F.col("_schema").isNull() | (F.col("_schema") == "") | (F.col("_schema") == F.col("_own")))
    return hits.groupBy("id", "kind", "table", "_schema").agg(F.min_by("object_id", "ord").alias("object_id")).select("id", "kind", "object_id").distinct()


def trigger_events(triggers: DataFrame) -> DataFrame:
    """One event for each table and operation of its triggers, named in the past tense, with the mutation it tells."""
    from provenir.operators.model import trigger_parts

    past = {"INSERT": "INSERTED", "UPDATE": "UPDATED", "DELETE": "DELETED"}
    ops = triggers.select("table", F.explode(trigger_parts("definition")[1]).alias("op")).distinct()
    return ops.select(F.concat(F.lit("event:"), slugify(F.concat("table", F.lit("."), F.lower(lookup(past, "op"))))).alias("id"), F.concat_ws("_", upper_snake("table"), lookup(past, "op")).alias("name"), "table", F.col("op").alias("mutation_type"))


def process_steps(steps: DataFrame, actions: DataFrame) -> DataFrame:
    """Steps of known actions, numbered s1, s2, ... in order within their process."""
    known = steps.join(actions.select(F.col("id").alias("action_id")), "action_id", "left_semi")
    k = F.row_number().over(Window.partitionBy("process_id").orderBy("ord"))
    return known.withColumn("step_id", F.concat(F.lit("s"), k))


def process_edges(steps: DataFrame) -> DataFrame:
    """Consecutive steps of a process as ``precedes`` edges between their actions."""
    after = F.lead("action_id").over(Window.partitionBy("process_id").orderBy("ord"))
    return steps.withColumn("to_action", after).where(F.col("to_action").isNotNull()).select("process_id", F.col("action_id").alias("from_action"), "to_action")
