"""Merged briefs, the view graph, published action fields, prompt parts and catalog rows of routines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenir.functions.text import col, json_slice, slugify, strip, upper_snake
from provenir.operators.matching import numbered


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_k = 1").drop("_k")


def ordered(values: Column, name: str = "ord") -> Column:
    """A group's values in order, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(name).alias("o"), values.alias("v")))), lambda x: x["v"])


# Briefs --------------------------------------------------------------------------------------------------

def merge_entries(rows: DataFrame, prefix: str, by_kind: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entries of all fragments (``ord`` over all, ``raw_id``, ``kind``, ``name``) with ids of their own, the first of a name (and kind) staying; and which entry each raw id means."""
    key = F.regexp_replace(F.lower(strip("name")), r"\s+", " ")
    named = rows.where(strip(F.coalesce("name", F.lit(""))) != "").withColumn("key", key)
    keys = ["kind", "key"] if by_kind else ["key"]
    label = F.concat("kind", F.lit("-"), "name") if by_kind else F.col("name")
    kept = numbered(first_of(named, keys, "ord"), F.concat(F.lit(f"{prefix}-"), slugify(label)), "ord", "id", "-")
    meant = named.where(F.coalesce("raw_id", F.lit("")) != "").join(kept.select(*keys, "id"), keys).groupBy("raw_id").agg(F.max_by("id", "ord").alias("id"))
    return kept, meant


def remap_refs(refs: DataFrame, kept: DataFrame, meant: DataFrame) -> DataFrame:
    """References (``owner``, ``ord``, ``ref``) to entries by raw id, else by name; what means nothing goes, each entry once per owner."""
    names = first_of(kept, ["key"], "ord").select(F.col("key").alias("_key"), F.col("id").alias("_named"))
    key = F.regexp_replace(F.lower(strip("ref")), r"\s+", " ")
    both = refs.join(meant.select(F.col("raw_id").alias("ref"), F.col("id").alias("_raw")), "ref", "left").withColumn("_key", key).join(names, "_key", "left")
    found = both.withColumn("id", F.coalesce("_raw", "_named")).where("id IS NOT NULL")
    return found.groupBy("owner", "id").agg(F.min("ord").alias("ord"))


# Graph ------------------------------------------------------------------------------------------------------

def view_graph(nodes: DataFrame, links: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes (``kind``, ``id``, ``label``, ``degree``) with weights, and edges (``from``, ``to``, ``kind``) between nodes that are shown.

    ``links``: kind of edge (rel, rule, io, trigger, emit, proc, step) to its rows (``source_kind``, ``source``, ``target_kind``, ``target``).
    """
    full = lambda k, i: F.concat(k, F.lit(":"), i)
    weight = F.when(F.col("kind").isin("object", "action"), F.coalesce("degree", F.lit(0)) + 1).when(F.col("kind") == "process", 3).otherwise(2)
    shown = nodes.select(full("kind", "id").alias("id"), "kind", F.coalesce(F.nullif("label", F.lit("")), F.regexp_replace("id", "^rule:", "R")).alias("label"), weight.cast("int").alias("weight"))
    rows = reduce(DataFrame.unionByName, [df.select(full("source_kind", "source").alias("from"), full("target_kind", "target").alias("to"), F.lit(k).alias("kind")) for k, df in links.items()])
    ids = shown.select("id").distinct()
    live = rows.where(F.col("from") != F.col("to")).join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi")
    return shown, live.select("from", "to", "kind")


def step_links(steps: DataFrame, nexts: DataFrame) -> DataFrame:
    """Edges between actions whose steps follow each other in a process."""
    at = lambda p: steps.select("process_id", F.col("step_id").alias(f"{p}_step"), F.col("action_id").alias(p))
    both = nexts.select("process_id", "source_step", "target_step").join(at("source"), ["process_id", "source_step"]).join(at("target"), ["process_id", "target_step"])
    return both.select(F.lit("action").alias("source_kind"), "source", F.lit("action").alias("target_kind"), "target")


# Published actions --------------------------------------------------------------------------------------------

def step_name(text, order) -> Column:
    """A step's name from the first six words of its text."""
    spaced = F.regexp_replace(F.coalesce(col(text), F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")
    words = F.slice(F.filter(F.split(spaced, "[^A-Za-z0-9]+"), lambda w: w != ""), 1, 6)
    cap = F.transform(words, lambda w, i: F.when(i == 0, F.lower(w)).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.right(w, F.greatest(F.length(w) - 1, F.lit(0))))))
    return F.when(F.size(words) == 0, F.concat(F.lit("step"), col(order).cast("string"))).otherwise(F.array_join(cap, ""))


def criteria_lines(triggers: DataFrame, gates: DataFrame, rules: DataFrame) -> DataFrame:
    """Chinese lines of what an action waits for: its events (part 0), then the known rules that gate it, with their ids."""
    events = triggers.select("action_id", F.lit(0).alias("part"), "ord", F.concat(F.lit("事件 "), upper_snake(F.regexp_replace("event_id", "^event:", "")), F.lit(" 已送达")).alias("line"), F.lit(None).cast(gates.schema["rule_id"].dataType).alias("rule_id"))
    known = gates.join(rules.select(F.col("id").alias("rule_id"), F.coalesce(F.nullif("title", F.lit("")), F.col("id").cast("string")).alias("shown")), "rule_id")
    held = known.select("action_id", F.lit(1).alias("part"), "ord", F.concat(F.lit("规则「"), "shown", F.lit("」已满足")).alias("line"), "rule_id")
    return events.unionByName(held)


def numbered_lines(lines: Column) -> Column:
    """The text of an action's lines in order."""
    return F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"])), "\n")


def submission_criteria(triggers: DataFrame, gates: DataFrame, rules: DataFrame) -> DataFrame:
    """Numbered Chinese lines of what an action waits for."""
    lines = criteria_lines(triggers, gates, rules).groupBy("action_id").agg(F.sort_array(F.collect_list(F.struct("part", "ord", "line"))).alias("lines"))
    return lines.select("action_id", numbered_lines(F.col("lines")).alias("criteria"))


def data_changes(effects: DataFrame, objects: DataFrame) -> DataFrame:
    """Published changes of data by side effects on known objects."""
    own = effects.where(F.col("kind").isin("db_write", "state_change", "payment")).join(objects.select(F.col("id").alias("object_id")).distinct(), "object_id", "left_semi")
    return own.select("action_id", "object_id", F.when(F.col("kind") == "db_write", "CREATE").otherwise("MODIFY").alias("change"), strip(F.coalesce("description", F.lit(""))).alias("description"))


def tools_of(actions: DataFrame, effects: DataFrame) -> DataFrame:
    """An action's integration and what it calls outside, each once with its first place."""
    own = actions.where(F.coalesce("integration", F.lit("")) != "").select("action_id", F.lit(-1).cast("bigint").alias("ord"), F.col("integration").alias("tool"))
    calls = effects.where((F.col("kind") == "external_call") & (F.coalesce("description", F.lit("")) != "")).select("action_id", F.col("ord").cast("bigint").alias("ord"), strip("description").alias("tool"))
    return own.unionByName(calls).groupBy("action_id", "tool").agg(F.min("ord").alias("ord"))


def tool_use(actions: DataFrame, effects: DataFrame) -> DataFrame:
    """An action's tools in order."""
    return tools_of(actions, effects).groupBy("action_id").agg(ordered(F.col("tool")).alias("tools"))


def reacts_to(triggers: DataFrame, by: str) -> DataFrame:
    """The events that a role's actions wait for, each once, sorted."""
    return triggers.select(by, "event_id").distinct().groupBy(by).agg(F.array_sort(F.collect_list("event_id")).alias("events"))


def tool_heading(tool, name, name_zh, execution, integration) -> Column:
    """The head of a tool's section in a role's prompt."""
    zh = F.when(F.coalesce(col(name_zh), F.lit("")) != "", F.concat(F.lit(" / "), col(name_zh))).otherwise("")
    how = F.concat(F.lit(" — execution: `"), F.coalesce(col(execution), F.lit("function")), F.lit("`"))
    where = F.when(F.coalesce(col(integration), F.lit("")) != "", F.concat(F.lit(" · integration: `"), col(integration), F.lit("`"))).otherwise("")
    return F.concat(F.lit("### `"), F.coalesce(col(tool), col(name)), F.lit("`\n**"), col(name), zh, F.lit("**"), how, where)


def stage_prompt(system, brief, web) -> Column:
    """A system prompt with the seeds that there are."""
    return F.concat_ws("\n\n", col(system), F.nullif(col(brief), F.lit("")), F.nullif(col(web), F.lit("")))


# Enrichment -----------------------------------------------------------------------------------------------------

def enrichments(replies: DataFrame, reply: str) -> DataFrame:
    """The items of ``{"enrichments": [...]}`` in a reply, as JSON; replies without such an object give none."""
    body = F.from_json(json_slice(reply), "enrichments array<map<string,string>>")["enrichments"]
    return replies.select(*[c for c in replies.columns if c != reply], F.posexplode(body).alias("ord", "item"))


def batch_lines(objects: DataFrame, properties: DataFrame) -> DataFrame:
    """What a prompt says of each object: id, table, columns with types, comment."""
    cols = properties.groupBy(F.col("object_id").alias("id")).agg(F.array_join(ordered(F.concat("name", F.lit(" ("), "type", F.lit(")"))), ", ").alias("_c"))
    comment = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("\n  comment: "), "description")).otherwise("")
    return objects.join(cols, "id", "left").select("id", F.concat(F.lit("- id: "), "id", F.lit("\n  table: "), "name", F.lit("\n  columns: "), F.coalesce("_c", F.lit("")), comment).alias("line"))


# Catalog rows -----------------------------------------------------------------------------------------------------

def shape_triggers(rows: DataFrame) -> DataFrame:
    """Trigger rows of a catalog (``name``, ``table``, ``event``, ``timing``, ...) that can be used, with known timings."""
    event = F.upper(F.coalesce("event", F.lit("")))
    ok = rows.where((F.coalesce("name", F.lit("")) != "") & (F.coalesce("table", F.lit("")) != "") & event.isin("INSERT", "UPDATE", "DELETE"))
    return ok.withColumns({"event": event, "timing": F.when(F.upper("timing") == "BEFORE", "BEFORE").otherwise("AFTER")})


def shape_routines(routines: DataFrame, params: DataFrame) -> DataFrame:
    """Routines with their parameters in order; unnamed ones of either go."""
    mode = F.upper(F.coalesce("mode", F.lit("IN")))
    p = F.struct(F.when(mode.isin("OUT", "INOUT"), mode).otherwise("IN").alias("mode"), "name", F.coalesce("sql_type", F.lit("unknown")).alias("type"))
    own = params.where((F.coalesce("specific_name", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != "")).groupBy("specific_name").agg(ordered(p).alias("params"))
    empty = F.array().cast("array<struct<mode:string,name:string,type:string>>")
    named = routines.where(F.coalesce("name", F.lit("")) != "").join(own.withColumnRenamed("specific_name", "name"), "name", "left")
    return named.select("schema", "name", F.when(F.col("kind") == "function", "function").otherwise("procedure").alias("kind"), F.coalesce("params", empty).alias("params"), F.nullif(strip("returns"), F.lit("")).alias("returns"), F.nullif(strip("comment"), F.lit("")).alias("comment"))


def layer_schema(df: DataFrame, id_pattern: str) -> dict:
    """A JSON-schema document of a layer's items, from the types of its columns."""

    def of(t) -> dict:
        if isinstance(t, T.ArrayType):
            return {"type": "array", "items": of(t.elementType)}
        if isinstance(t, T.StructType):
            return {"type": "object", "properties": {f.name: of(f.dataType) for f in t.fields}, "required": [f.name for f in t.fields if not f.nullable]}
        kind = "boolean" if isinstance(t, T.BooleanType) else "integer" if isinstance(t, T.IntegralType) else "number" if isinstance(t, T.NumericType) else "string"
        return {"type": kind}

    item = of(df.schema)
    if "id" in item["properties"]:
        item["properties"]["id"]["pattern"] = id_pattern
    return {"type": "array", "items": item}

