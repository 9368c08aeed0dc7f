"""Typed interfaces of a model's objects and tools of its actions, as rows and as documents of ordered lines.

``objects``: ``id``, ``ord``, ``name``. ``properties``: ``object_id``, ``ord``, ``name``, ``type``, ``references`` (null: no foreign key),
``primary_key`` (boolean). ``actions``: ``id``, ``ord``, ``tool``, ``name``. ``ios``: ``action_id``, ``side`` (input or output), ``ord``, ``name``,
``type``, ``object_id``, ``required``, ``many``. ``gates``: ``action_id``, ``ord``, ``rule_id``, ``severity``.
``ord`` is unique among objects, among actions, and within an owner.

Names are identifiers: without letters or digits they are ``Unnamed`` and ``unnamed``, before a digit stands an underscore, and a
name that an earlier row has gets the first free number. A document is rows of ``file``, ``at`` (its order) and ``line``, so
none is put together in one row or task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions.text import tool_name
from provenir.operators.matching import numbered
from provenir.operators.views import looked_up, pascal
from provenir.sources.tables import keep

#: Types of the generated language by published type; all others are strings.
TYPES = {"Integer": "number", "Float": "number", "Boolean": "boolean", "List<String>": "string[]"}


def identifier(c: Column, empty: str) -> Column:
    # ``c`` stands here once: each further use would make the name anew.
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\A\z", empty), r"\A(?=[0-9])", "_")


def type_name(c) -> Column:
    return identifier(pascal(F.col(c) if isinstance(c, str) else c), "Unnamed")


def field_name(c) -> Column:
    return identifier(tool_name(c), "unnamed")


def given(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def bare(c: str) -> Column:
    return F.regexp_replace(c, "^[^:]*:", "")


def interface_names(objects: DataFrame) -> DataFrame:
    """``object_id``, ``ord``, ``interface``: each object's own name."""
    # Written: each use of a name would else make it anew, many times a row.
    wanted = keep(objects.select("id", "ord", type_name(given(F.col("name"), bare("id"))).alias("_wanted")), "wanted")
    named = numbered(wanted, F.col("_wanted"), "ord", "interface", "")
    return named.select(F.col("id").alias("object_id"), "ord", "interface")


def tool_names(actions: DataFrame) -> DataFrame:
    """``action_id``, ``ord``, ``tool``, ``renamed`` (an earlier action has its name)."""
    base = field_name(given(F.col("tool"), F.col("name"), bare("id")))
    wanted = keep(actions.select("id", "ord", base.alias("_wanted")), "wanted")
    named = numbered(wanted, F.col("_wanted"), "ord", "tool", "_")
    return named.select(F.col("id").alias("action_id"), "ord", "tool", (F.col("tool") != F.col("_wanted")).alias("renamed"))


def language_type(c: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[F.col(c)], F.lit("string"))


def fields(properties: DataFrame, names: DataFrame) -> DataFrame:
    """``object_id``, ``ord``, ``field``, ``type``, ``optional``: a foreign key has its object's interface, or is a string where that is missing; the primary key alone is not optional."""
    rows = looked_up(properties, "references", names.withColumnRenamed("object_id", "references"), "interface")
    kind = F.when(F.col("references").isNotNull(), F.coalesce("interface", F.lit("string"))).otherwise(language_type("type"))
    return rows.select("object_id", "ord", field_name("name").alias("field"), kind.alias("type"), (~F.coalesce("primary_key", F.lit(False))).alias("optional"))


def parameters(ios: DataFrame, names: DataFrame) -> DataFrame:
    """``action_id``, ``side``, ``ord``, ``field``, ``type``, ``optional``: inputs and outputs; ``unknown`` for a missing object or no type."""
    return typed(ios, names).drop("interface")


def typed(ios: DataFrame, names: DataFrame) -> DataFrame:
    """``parameters`` and the ``interface`` that each mentions, if any."""
    rows = looked_up(ios, "object_id", names, "interface")
    one = F.when(F.col("object_id").isNotNull(), F.coalesce("interface", F.lit("unknown"))).when(given(F.col("type")).isNotNull(), language_type("type")).otherwise("unknown")
    kind = F.when(F.coalesce("many", F.lit(False)) & ~F.endswith(one, F.lit("[]")), F.concat(one, F.lit("[]"))).otherwise(one)
    return rows.select("action_id", "side", "ord", field_name("name").alias("field"), kind.alias("type"), (~F.coalesce("required", F.lit(False))).alias("optional"), "interface")


def imported(ios: DataFrame, names: DataFrame) -> DataFrame:
    """``action_id``, ``interface``: each interface that an action's inputs and outputs mention, once."""
    return ios.join(names, "object_id").select("action_id", "interface").distinct()


def results(params: DataFrame, tools: DataFrame) -> DataFrame:
    """``action_id``, ``result``: nothing, the type of the one output, or an interface of its own for several."""
    out = params.where("side = 'output'").groupBy("action_id").agg(F.count("*").alias("n"), F.first("type").alias("type"))
    kind = F.when(F.col("n") == 1, F.col("type")).when(F.col("n") > 1, F.concat(type_name("tool"), F.lit("Output"))).otherwise("void")
    return tools.join(out, "action_id", "left").select("action_id", kind.alias("result"))


def warnings(actions: DataFrame, gates: DataFrame, rules: DataFrame) -> DataFrame:
    """``action_id``, ``kind``, ``detail``: tools that had to be renamed and preconditions without a rule."""
    renamed = tool_names(actions).where("renamed").select("action_id", F.lit("renamed").alias("kind"), F.col("tool").alias("detail"))
    known = rules.select(F.col("id").alias("rule_id")).distinct()
    lost = gates.join(actions.select(F.col("id").alias("action_id")), "action_id", "left_semi").join(known, "rule_id", "left_anti")
    return renamed.unionByName(lost.select("action_id", F.lit("missing rule").alias("kind"), F.col("rule_id").alias("detail")))


def lines(rows: DataFrame, file: Column, of, part: int | Column, line: Column, ord_="ord") -> DataFrame:
    number = lambda c: F.col(c).cast("long") if isinstance(c, str) else F.lit(c).cast("long")
    return rows.select(file.alias("file"), F.struct(number(of).alias("of"), F.lit(part).cast("int").alias("part"), number(ord_).alias("ord")).alias("at"), line.alias("line"))


def field_line() -> Column:
    return F.concat(F.lit("  "), "field", F.when(F.col("optional"), "?").otherwise(""), F.lit(": "), "type", F.lit(";"))


def opening(name: Column) -> Column:
    return F.concat(F.lit("export interface "), name, F.lit(" {"))


def type_lines(objects: DataFrame, properties: DataFrame, file: str = "types.ts") -> DataFrame:
    """An interface for each object, in order; one without properties takes any field."""
    names, at = keep(interface_names(objects), "interfaces"), F.lit(file)
    own = names.select("object_id", F.col("ord").alias("of"), "interface")
    rows = fields(properties, names).join(own.drop("interface"), "object_id")
    none = own.join(properties.select("object_id").distinct(), "object_id", "left_anti")
    return reduce(DataFrame.unionByName, [
        lines(own, at, "of", 0, opening(F.col("interface")), 0), lines(rows, at, "of", 1, field_line()),
        lines(none, at, "of", 1, F.lit("  [key: string]: unknown;"), 0), lines(own, at, "of", 2, F.lit("}"), 0),
    ])


def tool_lines(actions: DataFrame, objects: DataFrame, ios: DataFrame, gates: DataFrame) -> DataFrame:
    """A document for each tool: what it imports, its parameters, outputs if several, signature, and preconditions in order."""
    names, tools = interface_names(objects), tool_names(actions).drop("ord", "renamed")
    params = keep(typed(ios, names), "parameters")
    out = F.col("side") == "output"
    own = params.groupBy("action_id").agg(F.count_if(out).alias("n"), F.first(F.when(out, F.col("type")), ignorenulls=True).alias("one"), F.max(F.col("side") == "input").alias("takes"), F.array_join(F.array_sort(F.collect_set("interface")), ", ").alias("names"))
    # What each tool needs, once: its own lines come from this row, and those of its parameters and rules by its id.
    each = keep(tools.join(own, "action_id", "left").withColumn("name", type_name("tool")), "tools")
    file, name = F.concat(F.lit("tools/"), "tool", F.lit(".ts")), F.col("name")
    result = F.when(F.col("n") == 1, F.col("one")).when(F.col("n") > 1, F.concat(name, F.lit("Output"))).otherwise("void")
    signature = F.concat(F.lit("export async function "), "tool", F.lit("("), F.when(F.col("takes"), F.concat(F.lit("input: "), name, F.lit("Input"))).otherwise(""), F.lit("): Promise<"), result, F.lit("> {"))
    several = F.col("n") > 1
    own_lines = [
        (0, F.when(F.col("names") != "", F.concat(F.lit("import type { "), "names", F.lit(" } from '../types.js';")))),
        (1, opening(F.concat(name, F.lit("Input")))), (3, F.lit("}")), (4, F.when(several, opening(F.concat(name, F.lit("Output"))))), (6, F.when(several, F.lit("}"))),
        (7, signature), (9, F.concat(F.lit("  throw new Error('Not implemented: "), "tool", F.lit("');"))), (10, F.lit("}")),
    ]
    text = each.select(file.alias("file"), F.explode(F.array(*[F.struct(F.lit(part).alias("part"), line.alias("line")) for part, line in own_lines])).alias("l")).where("l.line IS NOT NULL")
    inside = params.drop("interface").join(each.select("action_id", "tool", "n"), "action_id")
    quoted = F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace("rule_id", r"([\\'])", r"\\$1"), r"\r?\n", " "), F.lit("'"))
    checks = gates.join(each.select("action_id", "tool"), "action_id")
    return reduce(DataFrame.unionByName, [
        lines(text, F.col("file"), 0, F.col("l.part"), F.col("l.line"), 0),
        lines(inside.where((F.col("side") == "input") | (out & several)), file, 0, F.when(out, 5).otherwise(2), field_line()),
        lines(checks, file, 0, 8, F.concat(F.lit("  assertPrecondition("), quoted, F.lit(", '"), F.coalesce("severity", F.lit("info")), F.lit("', true);"))),
    ])


def registry_lines(actions: DataFrame, file: str = "tools/index.ts") -> DataFrame:
    """The document that names every tool, in order of the actions."""
    tools, at = tool_names(actions), F.lit(file)
    edge = actions.sparkSession.createDataFrame([(1, "export const tools = {"), (3, "} as const;"), (4, "export type ToolName = keyof typeof tools;")], "part int, line string")
    edges = edge.select(at.alias("file"), F.struct(F.lit(0).cast("long").alias("of"), "part", F.lit(0).cast("long").alias("ord")).alias("at"), "line")
    said = [(0, F.concat(F.lit("import { "), "tool", F.lit(" } from './"), "tool", F.lit(".js';"))), (2, F.concat(F.lit("  "), "tool", F.lit(",")))]
    uses = tools.select("ord", F.explode(F.array(*[F.struct(F.lit(part).alias("part"), line.alias("line")) for part, line in said])).alias("l"))
    return lines(uses, at, 0, F.col("l.part"), F.col("l.line")).unionByName(edges)
