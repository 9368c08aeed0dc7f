"""Queries of views of a model, and of interfaces of its tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.operators import interfaces as I
from provenir.operators import views as V
from provenir.plans.catalogue import query, read
from provenir.sources import tables


def text(*parts):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def view(spark, d, keep=None) -> dict[str, DataFrame]:
    """Customers as objects with their orders as attributes, and as processes with these as steps; documents as rules. ``keep`` writes the customers with their lists, which a model reads several times."""
    c, o, k = read(spark, d, "customer"), read(spark, d, "orders"), F.col("o_custkey")
    kinds = [F.lit("Money"), F.lit("Enum<a|b>"), text("Reference<C", k + 1, ">"), text("C", k * 7), F.lit("date")]
    kind = F.element_at(F.array(*kinds), (F.col("o_orderkey") % 5 + 1).cast("int"))
    attr = F.struct(text("order_", F.col("o_orderkey")).alias("name"), kind.alias("type"), F.lit("fk").alias("role"))
    step = F.struct(text("handle ", F.col("o_orderkey")).alias("en"), F.col("o_orderstatus").alias("zh"), text("C", k * 3).alias("obj"))
    lists = o.groupBy(k.alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", attr.alias("a"), step.alias("s")))).alias("l"))
    attrs = F.transform(F.col("l"), lambda x, i: x["a"].withField("role", F.when(i == 0, "pk").when(x["o_orderkey"] % 2 == 0, "fk")))
    all_ = c.join(lists, "c_custkey", "left").withColumn("k", F.col("c_custkey"))
    all_ = keep(all_, "customers") if keep else all_
    relation = F.array(text("buys after → C", F.col("k") + 1, " (next), C", F.col("k") - 1), F.lit("nothing"))
    return {
        "objects": all_.select(F.col("k").alias("ord"), text("C", F.col("k")).alias("name"), F.col("c_mktsegment").alias("zh"), F.lit(0.5).alias("confidence"), attrs.alias("attrs"), relation.alias("relations")),
        "rules": read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("en"), F.lit("").alias("zh"), F.col("text").alias("formal"), ((F.col("doc_id") % 100) / 100).alias("confidence"), F.col("source").alias("document"), F.lit("").alias("excerpt"), F.lit(1).alias("page"), F.array(text("C", F.col("doc_id"))).alias("objects")),
        "processes": all_.select(F.col("k").alias("id"), F.col("c_mktsegment").alias("name"), F.lit("").alias("zh"), F.array(F.lit("clerk")).alias("actors"), F.array(text("C", F.col("k"))).alias("objects"), F.transform("l", lambda x: x["s"]).alias("steps")),
    }


@query("""WITH o AS (SELECT *, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS first, CASE o_orderkey % 5 WHEN 0 THEN 'Float' WHEN 1 THEN 'List<String>' WHEN 2 THEN 'Reference<C' || (o_custkey + 1) || '>' WHEN 4 THEN 'Date' ELSE CASE WHEN o_custkey * 7 IN (SELECT c_custkey FROM customer) THEN 'Reference<C' || o_custkey * 7 || '>' ELSE 'String' END END AS type FROM orders)
  SELECT 'c' || c_custkey AS id, 'C' || c_custkey AS name, c_mktsegment AS zh, coalesce((SELECT string_agg('buys after → C' || n.c_custkey, ';' ORDER BY n.c_custkey DESC) FROM customer AS n WHERE abs(n.c_custkey - c.c_custkey) = 1), '') AS relations, 'order_' || o_orderkey AS attr, type, CASE WHEN first THEN 'pk' WHEN type LIKE 'Ref%' THEN 'fk' END AS role
  FROM customer AS c LEFT JOIN o ON o_custkey = c_custkey""")
def p13_view_objects(spark, d):
    v = V.to_view(V.from_view(view(spark, d, tables.keep)))["objects"]
    return v.select("id", "name", "zh", F.array_join("relations", ";").alias("relations"), F.explode_outer("attrs").alias("a")).select("id", "name", "zh", "relations", F.col("a.name").alias("attr"), "a.type", "a.role")


@query("""WITH s AS (SELECT c_custkey AS k, c_mktsegment, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS i FROM customer JOIN orders ON o_custkey = c_custkey)
  SELECT 'process:' || k || '-' || lower(c_mktsegment) AS process_id, CAST(i AS INTEGER) AS ord, 'action:' || k || '-' || i || '-handle-' || o_orderkey AS action_id, o_orderstatus AS zh, CASE WHEN 3 * k IN (SELECT c_custkey FROM customer) THEN 'objectType:c' || 3 * k END AS object_id,
    'event:' || k || '.' || i || '.c' || 3 * k || '.done' AS event_id, k || '_' || i || '_C' || 3 * k || '_DONE' AS event, CASE WHEN i > 0 THEN 'event:' || k || '.' || (i - 1) || '.c' || 3 * k || '.done' END AS trigger_id FROM s""")
def p13_view_actions(spark, d):
    m = V.from_view(view(spark, d), tables.keep)
    act = m["action"].select(F.col("id").alias("action_id"), "zh", "object_id")
    event = m["event"].select(F.col("id").alias("event_id"), F.col("name").alias("event"))
    return m["step"].join(act, "action_id").join(m["emit"], "action_id").join(event, "event_id").join(m["trigger"].withColumnRenamed("event_id", "trigger_id"), "action_id", "left").select("process_id", "ord", "action_id", "zh", "object_id", "event_id", "event", "trigger_id")


@query("""SELECT left(text, 48) AS title, md5(text) AS en_md5, source AS document, CASE WHEN contains(t, ':=') THEN 'state_transition' WHEN contains(t, 'block') OR contains(t, '∃') THEN 'authorization' WHEN contains(t, '≤') OR contains(t, '30d') OR contains(t, '60d') OR contains(t, 'today') THEN 'temporal' WHEN contains(t, '=') AND contains(t, 'σ') THEN 'derivation' ELSE 'validation' END AS kind,
    CASE WHEN doc_id % 100 >= 95 THEN 'block' WHEN doc_id % 100 >= 88 THEN 'warn' ELSE 'info' END AS severity FROM (SELECT *, coalesce(lower(text), '') AS t FROM documents)""")
def p13_view_rules(spark, d):
    return V.from_view(view(spark, d))["rule"].select("title", F.md5(F.col("en").cast("binary")).alias("en_md5"), "document", "kind", "severity")


# Interfaces ----------------------------------------------------------------------------------------------

def tool_model(spark, d) -> dict[str, DataFrame]:
    """Customers as objects with their orders as properties, orders as actions over the parts and suppliers of their lines."""
    c, o, li = (read(spark, d, t) for t in ("customer", "orders", "lineitem"))
    key = lambda name: text("objectType:", F.col(name))
    own = F.col("l_partkey") % 4 != 0
    return {
        "objects": c.select(key("c_custkey").alias("id"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("name")),
        "properties": o.select(key("o_custkey").alias("object_id"), F.col("o_orderkey").alias("ord"), text("order", F.col("o_orderkey")).alias("name"), F.lit("Float").alias("type"), F.when(F.col("o_orderkey") % 3 == 0, text("objectType:", F.col("o_custkey") * 5)).alias("references"), (F.col("o_orderkey") % 2 == 0).alias("primary_key")),
        "actions": o.select(text("action:", F.col("o_orderkey")).alias("id"), F.col("o_orderkey").alias("ord"), F.lit(None).cast("string").alias("tool"), text("Handle ", F.col("o_orderkey")).alias("name")),
        "ios": li.select(text("action:", F.col("l_orderkey")).alias("action_id"), F.when(F.col("l_linenumber") % 3 == 0, "output").otherwise("input").alias("side"), F.col("l_linenumber").alias("ord"), text("part ", F.col("l_partkey")).alias("name"), F.lit("Integer").alias("type"), F.when(own, key("l_partkey")).alias("object_id"), (F.col("l_linenumber") % 2 == 0).alias("required"), (F.col("l_quantity") > 25).alias("many")),
        "gates": li.select(text("action:", F.col("l_orderkey")).alias("action_id"), F.col("l_linenumber").alias("ord"), text("rule:", F.col("l_suppkey")).alias("rule_id"), F.when(F.col("l_returnflag") == "R", "block").alias("severity")),
    }


INTERFACES = """n AS (SELECT c_custkey AS k, c_mktsegment || CASE WHEN r = 1 THEN '' ELSE CAST(r AS VARCHAR) END AS interface FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer))"""
TOOLS = f"""{INTERFACES}, p AS (
  SELECT l_orderkey AS k, l_linenumber AS ord, l_linenumber % 3 = 0 AS outward, CASE WHEN l_partkey % 4 = 0 THEN 'number' ELSE coalesce(interface, 'unknown') END || CASE WHEN l_quantity > 25 THEN '[]' ELSE '' END AS type, 'part_' || l_partkey || CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE '?' END AS field FROM lineitem LEFT JOIN n ON n.k = l_partkey
), t AS (
  SELECT o_orderkey AS k, count(*) FILTER (outward) AS outs, max(type) FILTER (outward) AS one, coalesce(bool_or(NOT outward), false) AS takes FROM orders LEFT JOIN p ON p.k = o_orderkey GROUP BY 1
)"""


@query(f"WITH {INTERFACES} SELECT DISTINCT 'action:' || l_orderkey AS action_id, interface FROM lineitem JOIN n ON k = l_partkey WHERE l_partkey % 4 <> 0")
def x24_imported_interfaces(spark, d):
    m = tool_model(spark, d)
    return I.imported(m["ios"], I.interface_names(m["objects"]))


@query(f"""WITH {INTERFACES}, o AS (SELECT c_custkey AS k, o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'number' ELSE coalesce(interface, 'string') END AS type FROM customer JOIN orders ON o_custkey = c_custkey LEFT JOIN n ON n.k = 5 * c_custkey)
  SELECT k AS of, 0 AS part, 0 AS ord, 'export interface ' || interface || ' {{' AS line FROM n UNION ALL SELECT k, 2, 0, '}}' FROM n
  UNION ALL SELECT k, 1, o_orderkey, '  order' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ': ' ELSE '?: ' END || type || ';' FROM o
  UNION ALL SELECT k, 1, 0, '  [key: string]: unknown;' FROM n WHERE k NOT IN (SELECT o_custkey FROM orders)""")
def x24_type_document(spark, d):
    m = tool_model(spark, d)
    return I.type_lines(m["objects"], m["properties"]).select("at.of", "at.part", "at.ord", "line")


@query(f"""WITH {TOOLS}, l AS (
  SELECT k, 0 AS part, 0 AS ord, 'import type {{ ' || string_agg(DISTINCT interface, ', ' ORDER BY interface) || ' }} from ''../types.js'';' AS line FROM (SELECT l_orderkey AS k, interface FROM lineitem JOIN n ON n.k = l_partkey WHERE l_partkey % 4 <> 0) GROUP BY k
  UNION ALL SELECT k, 1, 0, 'export interface Handle' || k || 'Input {{' FROM t UNION ALL SELECT k, 2, ord, '  ' || field || ': ' || type || ';' FROM p WHERE NOT outward UNION ALL SELECT k, 3, 0, '}}' FROM t
  UNION ALL SELECT k, 4, 0, 'export interface Handle' || k || 'Output {{' FROM t WHERE outs > 1 UNION ALL SELECT k, 5, ord, '  ' || field || ': ' || type || ';' FROM p JOIN t USING (k) WHERE outward AND outs > 1 UNION ALL SELECT k, 6, 0, '}}' FROM t WHERE outs > 1
  UNION ALL SELECT k, 7, 0, 'export async function handle_' || k || '(' || CASE WHEN takes THEN 'input: Handle' || k || 'Input' ELSE '' END || '): Promise<' || CASE outs WHEN 0 THEN 'void' WHEN 1 THEN one ELSE 'Handle' || k || 'Output' END || '> {{' FROM t
  UNION ALL SELECT l_orderkey, 8, l_linenumber, '  assertPrecondition(''rule:' || l_suppkey || ''', ''' || CASE WHEN l_returnflag = 'R' THEN 'block' ELSE 'info' END || ''', true);' FROM lineitem
  UNION ALL SELECT k, 9, 0, '  throw new Error(''Not implemented: handle_' || k || ''');' FROM t UNION ALL SELECT k, 10, 0, '}}' FROM t
) SELECT 'tools/handle_' || k || '.ts' AS file, part, CAST(ord AS BIGINT) AS ord, line FROM l WHERE k IN (SELECT o_orderkey FROM orders)""")
def x24_tool_documents(spark, d):
    m = tool_model(spark, d)
    return I.tool_lines(m["actions"], m["objects"], m["ios"], m["gates"]).select("file", "at.part", "at.ord", "line")


@query("""SELECT CAST(0 AS BIGINT) AS of, 1 AS part, 'export const tools = {' AS line UNION ALL SELECT 0, 3, '} as const;' UNION ALL SELECT 0, 4, 'export type ToolName = keyof typeof tools;'
  UNION ALL SELECT 0, 0, 'import { handle_' || o_orderkey || ' } from ''./handle_' || o_orderkey || '.js'';' FROM orders UNION ALL SELECT 0, 2, '  handle_' || o_orderkey || ',' FROM orders""")
def x24_registry(spark, d):
    return I.registry_lines(tool_model(spark, d)["actions"]).select("at.of", "at.part", "line")
