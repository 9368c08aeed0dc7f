"""Queries of catalogs, evidence and the store."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenir.operators import bundle as BU
from provenir.operators import integrity as V
from provenir.operators import schema_seed as S
from provenir.operators import stages
from provenir.plans.catalogue import query, read
from provenir.sources import catalogs as C
from provenir.sources import store, tables

#: Orders as relations and their lines as columns; an order refers to the customer's order before it, by lines of either in an order of their own.
CATALOG = """rel AS (
  SELECT o_orderkey AS relid, 's' || o_custkey % 5 AS table_schema, 'order_' || o_orderkey AS table_name, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders
), att AS (
  SELECT relid, num, 'item_' || p || '_' || num AS column_name, q, x FROM (
    SELECT l_orderkey AS relid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INTEGER) AS num, l_partkey AS p, l_quantity AS q, l_extendedprice AS x FROM lineitem)
), own AS (
  SELECT relid, list(num ORDER BY x DESC, num) AS conkey, list(num ORDER BY q, num) AS confkey FROM att GROUP BY 1
), far AS (
  SELECT a.relid, a.prev AS ref_relid, unnest(range(1, least(len(k.conkey), len(f.confkey)) + 1)) AS i, k.conkey, f.confkey
  FROM rel AS a JOIN own AS k USING (relid) JOIN own AS f ON f.relid = a.prev
)"""


def catalog_tables(spark, d):
    """Relations, attributes and constraints of a catalog with positional arrays, from orders and their lines."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem").withColumn("num", place)
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    number = lambda c: F.col(c).cast("string")
    relations = o.select(F.col("o_orderkey").alias("relid"), text("s", (F.col("o_custkey") % 5).cast("string")).alias("table_schema"), text("order_", number("o_orderkey")).alias("table_name"))
    attributes = li.select(F.col("l_orderkey").alias("relid"), "num", text("item_", number("l_partkey"), "_", number("num")).alias("column_name"))
    order = lambda *keys: F.transform(F.array_sort(F.collect_list(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col("num").alias("n")))), lambda x: x["n"])
    own = li.groupBy(F.col("l_orderkey").alias("relid")).agg(order(-F.col("l_extendedprice")).alias("conkey"), order(F.col("l_quantity")).alias("confkey"))
    prev = o.select(F.col("o_orderkey").alias("relid"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("ref_relid"))
    action = F.element_at(F.array(*map(F.lit, "acrnd")), (F.col("relid") % 5 + 1).cast("int"))
    fk = prev.join(own.select("relid", "conkey"), "relid").join(own.select(F.col("relid").alias("ref_relid"), "confkey"), "ref_relid")
    fk = fk.select(text("fk_", number("relid")).alias("constraint_name"), F.lit("f").alias("kind"), "relid", "ref_relid", "conkey", "confkey", action.alias("on_delete"), F.lit("a").alias("on_update"))
    pk = own.select(text("pk_", number("relid")).alias("constraint_name"), F.lit("p").alias("kind"), "relid", F.lit(None).cast("bigint").alias("ref_relid"), "conkey", F.lit(None).cast("array<int>").alias("confkey"), F.lit(" ").alias("on_delete"), F.lit(" ").alias("on_update"))
    return relations, attributes, fk.unionByName(pk)


ACTION = "CASE relid % 5 WHEN 1 THEN 'CASCADE' WHEN 2 THEN 'RESTRICT' WHEN 3 THEN 'SET NULL' WHEN 4 THEN 'SET DEFAULT' ELSE {} END"


@query(f"""WITH {CATALOG} SELECT r.table_schema, r.table_name, 'fk_' || f.relid AS constraint_name, 'foreign_key' AS kind, CAST(f.i AS INTEGER) AS ordinal_position, a.column_name, p.table_schema AS ref_schema, p.table_name AS ref_table, b.column_name AS ref_column,
    {ACTION.format("'NO ACTION'").replace("relid", "f.relid")} AS on_delete, 'NO ACTION' AS on_update
  FROM far AS f JOIN rel AS r ON r.relid = f.relid JOIN rel AS p ON p.relid = f.ref_relid JOIN att AS a ON a.relid = f.relid AND a.num = f.conkey[f.i] JOIN att AS b ON b.relid = f.ref_relid AND b.num = f.confkey[f.i]
  UNION ALL SELECT r.table_schema, r.table_name, 'pk_' || a.relid, 'primary_key', CAST(row_number() OVER (PARTITION BY a.relid ORDER BY x DESC, num) AS INTEGER), column_name, NULL, NULL, NULL, NULL, NULL FROM att AS a JOIN rel AS r ON r.relid = a.relid""")
def j19_key_columns(spark, d):
    relations, attributes, constraints = catalog_tables(spark, d)
    return C.keys_by_position(constraints, attributes, relations)


@query(f"""WITH {CATALOG}, k AS (
    SELECT f.relid, f.ref_relid, string_agg(a.column_name, ',' ORDER BY f.i) AS columns, string_agg(b.column_name, ',' ORDER BY f.i) AS ref_columns
    FROM far AS f JOIN att AS a ON a.relid = f.relid AND a.num = f.conkey[f.i] JOIN att AS b ON b.relid = f.ref_relid AND b.num = f.confkey[f.i] GROUP BY 1, 2
  ) SELECT r.table_schema, r.table_name, 'foreign_key' AS kind, k.columns, p.table_schema AS ref_schema, p.table_name AS ref_table, k.ref_columns, {ACTION.format("NULL").replace("relid", "k.relid")} AS on_delete
  FROM k JOIN rel AS r ON r.relid = k.relid JOIN rel AS p ON p.relid = k.ref_relid
  UNION ALL SELECT r.table_schema, r.table_name, 'primary_key', string_agg(column_name, ',' ORDER BY x DESC, num), NULL, NULL, NULL, NULL FROM att AS a JOIN rel AS r ON r.relid = a.relid GROUP BY 1, 2""")
def s11_key_facts(spark, d):
    relations, attributes, constraints = catalog_tables(spark, d)
    facts = C.key_facts(C.keys_by_position(constraints, attributes, relations))
    return facts.select(F.col("schema").alias("table_schema"), F.col("table").alias("table_name"), "kind", F.array_join("columns", ",").alias("columns"), "ref_schema", "ref_table", F.array_join("ref_columns", ",").alias("ref_columns"), "on_delete")


def standard_views(spark, d):
    """Views of an information schema over the same data, without ``rules`` and ``routines``: customers are tables, their orders columns."""
    o = read(spark, d, "orders").select(F.concat(F.lit("s"), (F.col("o_custkey") % 5).cast("string")).alias("table_schema"), F.concat(F.lit("Customer_"), F.col("o_custkey").cast("string")).alias("table_name"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("column_name"), "o_orderkey", "o_orderstatus", "o_totalprice")
    place = F.row_number().over(Window.partitionBy("table_schema", "table_name").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    columns = o.withColumn("ORDINAL_POSITION", place)
    kind = F.when(F.col("o_orderstatus") == "F", "enum('a','it''s')").when(F.col("o_orderstatus") == "O", "varchar(20)")
    found = {
        "columns": columns.select("table_schema", "TABLE_NAME", "column_name", kind.alias("sql_type"), F.when(F.col("o_orderkey") % 2 == 0, "NO").otherwise("yes").alias("is_nullable"), F.lit(" ").alias("column_default"), "ORDINAL_POSITION", F.lit(None).cast("string").alias("comment")),
        "checks": columns.where("ORDINAL_POSITION = 1").select(F.col("table_schema").alias("constraint_schema"), F.concat(F.lit("ck_"), "column_name").alias("constraint_name"), F.concat(F.lit("CHECK (( "), F.col("column_name"), F.lit("::text = ANY (ARRAY['a', 'b']::text[])))")).alias("definition")),
        "constraints": columns.where("ORDINAL_POSITION = 1").select(F.col("table_schema").alias("constraint_schema"), F.concat(F.lit("ck_"), "column_name").alias("constraint_name"), "table_schema", "table_name", F.lit("CHECK").alias("kind")),
    }
    by_select = {view.select: name for name, view in C.STANDARD.items()}

    def reader(view):
        name = by_select[view.select]
        if name in ("rules", "routines", "parameters"):
            raise ValueError(f"no view {name}")
        return found.get(name, spark.createDataFrame([], view.columns))

    return reader


@query("""WITH c AS (SELECT 's' || o_custkey % 5 AS schema, 'Customer_' || o_custkey AS t, 'o' || o_orderkey AS name, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
  SELECT 'column' AS kind, schema AS table_schema, t AS table_name, CAST(n AS INTEGER) AS ord, name, CASE o_orderstatus WHEN 'F' THEN 'enum(''a'',''it''''s'')' WHEN 'O' THEN 'varchar(20)' ELSE 'unknown' END AS sql_type, o_orderkey % 2 <> 0 AS nullable, CASE o_orderstatus WHEN 'F' THEN 'a|it''s' END AS enum_values, NULL AS expression, NULL AS columns FROM c
  UNION ALL SELECT DISTINCT 'table', schema, t, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM c
  UNION ALL SELECT 'check', schema, t, NULL, 'ck_' || name, NULL, NULL, NULL, name || ' IN (''a'',''b'')', name FROM c WHERE n = 1""")
def s12_catalog_facts(spark, d):
    facts = C.scan(spark, standard_views(spark, d), "standard").facts
    return facts.select("kind", F.col("schema").alias("table_schema"), F.col("table").alias("table_name"), "ord", "name", "sql_type", "nullable", F.array_join("enum_values", "|").alias("enum_values"), "expression", F.array_join("columns", "|").alias("columns"))


def order_facts(spark, d):
    """Orders as tables of a schema in ten files, their lines as columns, with a key, a unique pair and a check."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    file = lambda c: (F.col(c) % 10).cast("string")
    name = lambda c: F.concat(F.lit("order_"), F.col(c).cast("string"))
    column = lambda c: F.concat(F.lit("item_"), F.col(c).cast("string"))
    tables = C.fact(o, file=file("o_orderkey"), kind=F.lit("table"), schema=F.lit("s"), table=name("o_orderkey"))
    columns = C.fact(li, file=file("l_orderkey"), kind=F.lit("column"), schema=F.lit("s"), table=name("l_orderkey"), ord="l_linenumber", name=column("l_linenumber"), sql_type=F.concat(F.lit("t"), (F.col("l_partkey") % 7).cast("string")), nullable=F.col("l_linenumber") != 1)
    first = C.fact(o, file=file("o_orderkey"), kind=F.lit("primary_key"), schema=F.lit("s"), table=name("o_orderkey"), columns=F.array(F.lit("item_1")))
    checks = C.fact(o, file=file("o_orderkey"), kind=F.lit("check"), schema=F.lit("s"), table=name("o_orderkey"), expression=F.concat(F.lit("item_1 = '"), "o_orderstatus", F.lit("'")))
    return tables.unionByName(columns).unionByName(first).unionByName(checks)


@query("""WITH f AS (
    SELECT o_orderkey AS k, 1 AS r, 0 AS o, 'TABLE s.order_' || o_orderkey AS t, 'object' AS kind FROM orders
    UNION ALL SELECT l_orderkey, 3, l_linenumber, '  item_' || l_linenumber || ' t' || l_partkey % 7 || CASE WHEN l_linenumber = 1 THEN ' NOT NULL' ELSE '' END, 'property' FROM lineitem
    UNION ALL SELECT o_orderkey, 4, 0, '  PRIMARY KEY item_1', 'key' FROM orders
    UNION ALL SELECT o_orderkey, 7, 0, '  CHECK item_1 = ''' || o_orderstatus || '''', 'rule' FROM orders
  ), p AS (
    SELECT *, k % 10 AS file, row_number() OVER w AS line, sum(length(t) + 1) OVER w - length(t) - 1 AS s FROM f WINDOW w AS (PARTITION BY k % 10 ORDER BY 'order_' || k, r, o, t ROWS UNBOUNDED PRECEDING)
  )
  SELECT CAST(file AS VARCHAR) AS file, kind AS node_kind, CAST(line AS BIGINT) AS line, CAST(s + length(t) - length(ltrim(t)) AS BIGINT) AS char_start, CAST(s + length(t) AS BIGINT) AS char_end, CASE WHEN k % 97 = 0 THEN ltrim(t) || '?' ELSE ltrim(t) END AS snippet, k % 97 <> 0 AS verified
  FROM p WHERE kind <> 'key'""")
def v16_grounding_survival(spark, d):
    # What is cited and where it is looked up are the same rows, made once.
    index = tables.keep(S.evidence_index(order_facts(spark, d)), "evidence")
    cites = S.citations(index)
    # Planted: what no line says.
    false = F.regexp_extract("node_id", r"order-(\d+)", 1).cast("bigint") % 97 == 0
    planted = cites.withColumn("snippet", F.when(false, F.concat("snippet", F.lit("?"))).otherwise(F.col("snippet")))
    return S.survival(planted, index).drop("node_id")


# Store ----------------------------------------------------------------------------------------------------

def folder(spark) -> str:
    return f"{tables.own_folder(spark)}/{uuid.uuid4().hex}"


@query("SELECT CAST(v AS INTEGER) AS version, c_nationkey % 3 AS part, count(*) AS n FROM customer, range(1, 4) AS t(v) GROUP BY ALL")
def s18_concurrent_versions(spark, d):
    s = store.Store(spark, folder(spark))
    rows = read(spark, d, "customer").select(F.lit("object").alias("kind"), F.col("c_custkey").cast("string").alias("id"), (F.col("c_nationkey") % 3).alias("part"))
    with ThreadPoolExecutor(3) as pool:
        versions = list(pool.map(lambda _: s.save("m", "Model", "retail", rows), range(3)))
    saved = reduce(DataFrame.unionByName, [s.nodes("m", v) for v in versions])
    return saved.groupBy("version", "part").agg(F.count("*").alias("n"))


def graph_parts(spark, d, seq: int):
    """Customers and nations as a graph: in the second import a third of the customers are missing and the names are new."""
    c = read(spark, d, "customer").where((F.lit(seq) == 1) | (F.col("c_custkey") % 3 != 0))
    text = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    nodes = c.select(F.lit("Customer").alias("label"), text("c", "c_custkey").alias("id"), F.to_json(F.struct(F.concat("c_name", F.lit(f" {seq}")).alias("name"))).alias("props"))
    nations = read(spark, d, "nation").where("n_nationkey < 20").select(F.lit("Nation").alias("label"), text("n", "n_nationkey").alias("id"), F.lit("{}").alias("props"))
    edges = c.select(F.lit("IN").alias("type"), text("c", "c_custkey").alias("source"), text("n", "c_nationkey").alias("target"), F.lit(f'{{"seq":{seq}}}').alias("props"))
    # Rows come more than once, and some edges have no end.
    return nodes.unionByName(nations).unionByName(nodes), edges.unionByName(edges)


@query("""SELECT k AS run, 'Customer' AS label, 'c' || c_custkey AS id, '{"name":"' || c_name || CASE WHEN c_custkey % 3 <> 0 THEN ' 2"}' ELSE ' 1"}' END AS props, CASE WHEN c_nationkey < 20 THEN 'n' || c_nationkey END AS target, CASE WHEN c_nationkey < 20 THEN '{"seq":' || CASE WHEN c_custkey % 3 <> 0 THEN 2 ELSE 1 END || '}' END AS edge
  FROM customer, range(2) AS t(k) UNION ALL SELECT k, 'Nation', 'n' || n_nationkey, '{}', NULL, NULL FROM nation, range(2) AS t(k) WHERE n_nationkey < 20""")
def s19_graph_merge(spark, d):
    out = []
    for run, order in enumerate(([1, 2, 1], [2, 1])):
        g = store.Graph(spark, folder(spark), buckets=8)
        for seq in order:
            g.merge(*graph_parts(spark, d, seq), "model", seq)
        if run:
            g.compact("nodes", 1)
        edges = g.edges().select(F.col("source").alias("id"), "target", F.col("props").alias("edge"))
        out.append(g.nodes().join(edges, "id", "left").select(F.lit(run).cast("bigint").alias("run"), "label", "id", "props", "target", "edge"))
    return out[0].unionByName(out[1])


@query("SELECT 'run' || o_custkey % 5 AS run_id, '[' || strftime(TIMESTAMP '2024-01-01' + to_milliseconds(o_orderkey), '%Y-%m-%d %H:%M:%S.%g') || ' +0000] [llm] task=t' || o_orderkey || ' provider=p model=m' || CASE WHEN o_orderkey % 2 = 0 THEN ' tokens(prompt=' || o_custkey || ', completion=0, total=' || o_orderkey || ')' ELSE '' END || ' ' || o_custkey || 'ms ' || CASE WHEN o_orderstatus = 'F' THEN 'ERROR: no reply' ELSE 'ok' END || CASE WHEN o_orderkey % 3 = 0 THEN ' [retry]' ELSE '' END AS line FROM orders")
def s20_run_log(spark, d):
    log = store.RunLog(spark, folder(spark))
    o = read(spark, d, "orders")
    even = lambda c: F.when(F.col("o_orderkey") % 2 == 0, F.col(c))
    message = store.call_line(
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string")), F.lit("p"), F.lit("m"), F.col("o_orderstatus") != "F", prompt=even("o_custkey"), total=even("o_orderkey"), millis=F.col("o_custkey"),
        error=F.lit("no\nreply "), note=F.when(F.col("o_orderkey") % 3 == 0, "retry"),
    )
    lines = o.select(F.concat(F.lit("run"), (F.col("o_custkey") % 5).cast("string")).alias("run_id"), F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("o_orderkey")).alias("at"), F.lit("llm").alias("category"), message.alias("message"), (F.col("o_orderkey") % 3).alias("block"))
    for k in range(3):
        log.append(lines.where(F.col("block") == k))
    log.compact()
    return store.stamped(log.rows()).select("run_id", "line")


@query("SELECT c_custkey, c_nationkey + 2 AS value, 3 AS cursor FROM customer WHERE c_custkey % 2 = 0")
def t1_client_paced_run(spark, d):
    c = read(spark, d, "customer")
    steps = [
        ("read", lambda got: c.select("c_custkey", F.col("c_nationkey").cast("int").alias("value"))),
        ("filter", lambda got: got["read"].where("c_custkey % 2 = 0")),
        ("add", lambda got: got["filter"].withColumn("value", F.col("value") + 2)),
    ]
    place = folder(spark)
    clients = [stages.Cursor(spark, place, "run", steps) for _ in range(2)]
    told = {"cursor": 0, "status": "running"}
    for k in range(12):  # two clients in turn; what comes late or twice changes nothing
        if told["status"] == "complete":
            break
        told = clients[k % 2].advance(told["cursor"])
    return clients[0].results()["add"].withColumn("cursor", F.lit(told["cursor"]))


@query("""WITH c AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 7 <> 0 UNION SELECT c_custkey + 1000000 FROM customer WHERE c_custkey % 11 = 0), e AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS source, o_custkey % 13 AS target FROM orders)
  SELECT 'relationship' AS owner, CAST(id AS VARCHAR) AS from_id, 'source' AS field, CAST(source AS VARCHAR) AS missing_id FROM e WHERE source NOT IN (SELECT id FROM c)
  UNION ALL SELECT 'relationship', CAST(id AS VARCHAR), 'target', CAST(target AS VARCHAR) FROM e WHERE target NOT IN (SELECT id FROM c)""")
def x37_issues_of_a_rerun(spark, d):
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    edges = lambda far: o.select(F.col("o_orderkey").alias("id"), F.when((F.col("o_orderkey") % 5 == 0) & far, F.col("o_custkey") + 1_000_000).otherwise(F.col("o_custkey")).alias("source"), (F.col("o_custkey") % 13).alias("target"))
    old = {"object_type": c.select(F.col("c_custkey").alias("id")), "relationship": edges(F.lit(False))}
    more = c.where("c_custkey % 11 = 0").select((F.col("c_custkey") + 1_000_000).alias("id"))
    new = {"object_type": old["object_type"].where("id % 7 <> 0").unionByName(more), "relationship": edges(F.lit(True))}
    before = tables.keep(V.dangling(old, V.MODEL_PATHS), "issues")
    return V.revalidate(old, new, V.MODEL_PATHS, before).select("owner", "from_id", "field", "missing_id")


# Bundle ---------------------------------------------------------------------------------------------------

def bundle_model(spark, d) -> dict[str, DataFrame]:
    """Brands as objects, suppliers as rules, orders as actions, priorities as events, customers as processes over their orders."""
    p, o, li, c = (read(spark, d, t) for t in ("part", "orders", "lineitem", "customer"))
    key = lambda prefix, name: F.concat(F.lit(prefix), F.col(name).cast("string"))
    level = F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)))
    none = F.lit(None).cast("string")
    first = li.groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("p_partkey")).join(p.select("p_partkey", "p_brand"), "p_partkey")
    return {
        "object": p.select(key("objectType:", "p_brand").alias("id"), F.col("p_brand").alias("name"), none.alias("description"), F.lit("p_partkey").alias("primary_key")).distinct(),
        "property": p.select(key("objectType:", "p_brand").alias("object_id"), F.col("p_partkey").alias("ord"), key("p", "p_partkey").alias("name"), F.lit("integer").alias("type"), F.lit(False).alias("is_foreign_key"), none.alias("references")),
        "rule": read(spark, d, "supplier").select(key("rule:", "s_suppkey").alias("id"), F.col("s_name").alias("title"), F.lit("x").alias("statement")),
        "gate": li.select(key("action:", "l_orderkey").alias("action_id"), key("rule:", "l_suppkey").alias("rule_id"), F.col("l_linenumber").alias("ord")),
        "action": o.select(key("action:", "o_orderkey").alias("id"), F.concat(F.lit("ship "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderstatus").alias("description"), F.when(F.col("o_orderkey") % 3 == 0, "human").alias("actor_kind"), F.when(F.col("o_orderkey") % 5 == 0, "erp").alias("integration")),
        "trigger": o.select(key("action:", "o_orderkey").alias("action_id"), F.concat(F.lit("event:"), level).alias("event_id"), F.lit(1).alias("ord")),
        "effect": first.select(key("action:", "l_orderkey").alias("action_id"), F.lit(1).alias("ord"), F.when(F.col("l_orderkey") % 2 == 0, "db_write").otherwise("state_change").alias("kind"), key("objectType:", "p_brand").alias("object_id"), F.lit(" made ").alias("description")),
        "emit": o.select(key("action:", "o_orderkey").alias("action_id"), F.lit(1).alias("ord"), F.concat(F.lit("event:"), F.when(F.col("o_orderkey") % 7 == 0, "unknown").otherwise(level)).alias("event_id")),
        "event": o.select(F.concat(F.lit("event:"), level).alias("id"), level.alias("name"), none.alias("description")).distinct(),
        "process": c.select(key("process:", "c_custkey").alias("id"), none.alias("name"), F.col("c_name").alias("description")),
        "step": o.select(key("process:", "o_custkey").alias("process_id"), F.col("o_orderkey").alias("ord"), key("action:", "o_orderkey").alias("action_id"), F.when(F.col("o_orderkey") % 2 == 0, " if ").alias("condition")),
        "process_trigger": c.select(key("process:", "c_custkey").alias("process_id"), F.lit(1).alias("ord"), F.when(F.col("c_custkey") % 2 == 0, "schedule").otherwise("event").alias("kind"), F.when(F.col("c_custkey") % 3 == 0, "event:nothing").otherwise("event:1").alias("event_id")),
        "actor": c.where("c_custkey % 4 = 0").select(key("process:", "c_custkey").alias("process_id"), F.lit(1).alias("ord"), F.col("c_mktsegment").alias("role")),
    }


@query(r"""WITH o AS (SELECT *, lower(split_part(o_orderpriority, '-', 1)) AS level FROM orders), e AS (SELECT DISTINCT level FROM o), f AS (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS p_partkey FROM lineitem GROUP BY 1),
  g AS (SELECT l_orderkey, string_agg((n + 1) || '. 规则「' || s_name || '」已满足', chr(10) ORDER BY n) AS held FROM (SELECT l_orderkey, s_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, s_name) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) GROUP BY 1),
  brand AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1),
  ev AS (SELECT o_custkey, level, min(o_orderkey) AS k FROM o WHERE o_orderkey % 7 <> 0 GROUP BY ALL)
  SELECT 'objects' AS layer, array_to_string(list_transform(string_split(p_brand, '#'), lambda x: upper(x[1]) || lower(x[2:])), '_') AS id, p_brand AS name, CAST(n AS VARCHAR) AS detail FROM brand
  UNION ALL SELECT 'rules', CAST(s_suppkey AS VARCHAR), s_name, '' FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey % 3 = 0 AND l_orderkey IN (SELECT o_orderkey FROM orders))
  UNION ALL SELECT 'rules', CAST(s_suppkey AS VARCHAR), s_name, 'human' FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey % 3 = 0 AND l_orderkey IN (SELECT o_orderkey FROM orders))
  UNION ALL SELECT 'events', NULL, upper(level), '' FROM e
  UNION ALL SELECT 'actions', CAST(o_orderkey AS VARCHAR), 'ship' || o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'human' ELSE 'agent' END || '|1. 事件 ' || upper(level) || ' 已送达' || coalesce(chr(10) || held, '') || '|' || coalesce(p_brand || ':' || CASE WHEN o_orderkey % 2 = 0 THEN 'CREATE' ELSE 'MODIFY' END || ':made', '') || '|' || CASE WHEN o_orderkey % 5 = 0 THEN 'erp' ELSE '' END || '|' || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE upper(level) END
    FROM o LEFT JOIN g ON g.l_orderkey = o_orderkey LEFT JOIN f ON f.l_orderkey = o_orderkey LEFT JOIN part USING (p_partkey)
  UNION ALL SELECT 'workflows', CAST(c_custkey AS VARCHAR), CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE 'Agent' END || '|' || CASE WHEN c_custkey % 2 = 0 THEN 'SCHEDULED_SYNC' WHEN c_custkey % 3 = 0 THEN '' ELSE '1' END || '|'
    || coalesce((SELECT string_agg(o_orderkey || ':ship' || o_orderkey || ':' || o_orderstatus || ':' || CASE WHEN o_orderkey % 3 = 0 THEN 'manual' WHEN o_orderkey % 5 = 0 THEN 'tool' ELSE 'logic' END || ':' || CASE WHEN o_orderkey % 2 = 0 THEN 'if' ELSE '' END, ';' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') || '|'
    || coalesce((SELECT string_agg(upper(level), ';' ORDER BY k, level) FROM ev WHERE o_custkey = c_custkey), '') FROM customer""")
def p1_bundle(spark, d):
    model = bundle_model(spark, d)
    out = BU.bundle(model)
    flat = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[f] for f in fields])), ";")
    row = lambda layer, id_, name, *detail: out[layer].select(F.lit(layer).alias("layer"), id_.cast("string").alias("id"), F.col(name).alias("name"), F.concat_ws("|", *detail).alias("detail"))
    parts = [
        row("objects", F.col("id"), "name", F.size("properties").cast("string")),
        row("rules", F.col("id"), "businessLogicRuleName", F.col("executor")),
        row("events", F.lit(None), "name", F.lit("")),
        row("actions", F.col("id"), "name", F.col("actor"), F.col("submission_criteria"), flat("data_changes", "object", "change", "description"), F.array_join("tool_use", ";"), F.array_join("triggered_event", ";")),
        row("workflows", F.col("id"), "name", F.array_join("actor", ";"), F.array_join("trigger", ";"), flat("actions", "order", "name", "description", "type", "condition"), F.array_join("triggered_event", ";")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("""SELECT p_partkey, CAST(v.ord AS INTEGER) AS ord, v.en || p_name AS term_en, '名' || p_partkey AS term_zh, CASE WHEN p_partkey % 3 = 0 THEN 'metric' ELSE 'other' END AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'money' END AS data_type, CASE WHEN p_partkey % 5 <> 0 THEN p_type || '|b' END AS aliases
  FROM part, (VALUES (0, ''), (2, 'the ')) AS v(ord, en) WHERE p_partkey % 7 <> 0""")
def x13_coerce_terms(spark, d):
    k, p = F.col("p_partkey"), read(spark, d, "part")
    term = lambda en: F.struct(
        F.struct(F.concat(F.lit(en), "p_name").alias("en"), F.concat(F.lit("名"), k.cast("string")).alias("zh")).alias("term"), F.when(k % 3 == 0, " metric ").otherwise("thing").alias("kind"),
        F.when(k % 2 == 0, "money").otherwise("gold").alias("dataTypeHint"), F.when(k % 5 == 0, F.array(F.lit(" "))).otherwise(F.array(F.col("p_type"), F.lit(" b "), F.lit("b"))).alias("aliases"),
    )
    alone = F.to_json(F.struct(F.struct(F.col("p_name").alias("en")).alias("term")))
    body = F.concat(F.lit('Here: {"terms":['), F.to_json(term(" ")), F.lit(","), alone, F.lit(","), F.to_json(term("the ")), F.lit("]} done"))
    replies = p.select("p_partkey", F.when(k % 7 == 0, F.lit('{"terms": 5}')).otherwise(body).alias("reply"))
    return stages.coerce_terms(replies, "reply").select("p_partkey", "ord", "term_en", "term_zh", "kind", "data_type", F.array_join("aliases", "|").alias("aliases"))
