"""Queries of sources, type forms, schema facts, references of a knowledge model, graph pieces, grounding tiers and the store."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from provenir.engine import Engine
from provenir.functions import jsonfix
from provenir.functions import text as T
from provenir.operators import enrich, schema_seed
from provenir.operators import graph as G
from provenir.operators import grounding as J
from provenir.operators import integrity as V
from provenir.operators import layers as L
from provenir.operators import matching as M
from provenir.operators import model as O
from provenir.operators import project as P
from provenir.operators import published as B
from provenir.operators import segment as D
from provenir.plans.catalogue import EXACT, PARTS, TRIPLES, query, read, star_triples
from provenir.plans.stage_queries import pick, values
from provenir.sources import ddl, documents, store, tables


def text_key(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


# Sources ------------------------------------------------------------------------------------------------

@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(160), ' '), '[\x{FEFF}\x{200B}-\x{200D}\x{2060}]', '', 'g'), '[ \t\f\v]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS t FROM documents)
  SELECT doc_id || '.txt' AS name, 'text' AS format, 'parsed_' || left(sha256(t), 16) AS ref, 'sha256:' || sha256(t) AS content_hash FROM t""")
def s2_parse_documents(spark, d):
    raw = read(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.lit("text/plain").alias("mime"), F.encode("text", "UTF-8").alias("content"))
    return documents.parse(raw).select("name", "format", "ref", "content_hash")


@F.pandas_udf(BinaryType())
def packaged(texts: pd.Series) -> pd.Series:
    """A word-processor package of a text's lines."""

    def one(text: str) -> bytes:
        out = io.BytesIO()
        body = "".join(f"<w:p><w:r><w:t>{x.replace('&', '&amp;').replace('<', '&lt;')}</w:t></w:r></w:p>" for x in text.split("\n"))
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f"<w:document><w:body>{body}</w:body></w:document>")
        return out.getvalue()

    return texts.map(one)


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' & <co>' || chr(10) || c_mktsegment || chr(10) ELSE 'plain ' || c_name END AS text FROM customer")
def s5_package_text(spark, d):
    said = F.concat("c_name", F.lit(" & <co>\n"), "c_mktsegment")
    content = F.when(F.col("c_custkey") % 2 == 0, packaged(said)).otherwise(F.encode(F.concat(F.lit("plain "), "c_name"), "UTF-8"))
    return read(spark, d, "customer").select("c_custkey", documents.package_text(content).alias("text"))


@query("SELECT p_partkey, 'b' || p_size AS schema, p_brand AS table_name, p_type AS sql_type, p_size % 2 = 0 AS nullable FROM part")
def s10_catalog_rows(spark, d):
    rows = read(spark, d, "part").select(F.concat(F.lit("b"), "p_size").alias("TABLE_SCHEMA"), F.col("p_brand").alias("Table_Name"), F.col("p_partkey").cast("string").alias("column_name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("COLUMN_TYPE"), F.col("p_type").alias("data_type"), F.when(F.col("p_size") % 2 == 0, " yes").otherwise("No ").alias("IS_NULLABLE"))
    return ddl.from_catalog(rows).select(F.col("name").cast("bigint").alias("p_partkey"), "schema", F.col("table").alias("table_name"), "sql_type", "nullable")


@query("SELECT c_custkey, 'mysql://root:***@h/' || c_custkey || ' password=***' AS message FROM customer")
def s14_redact(spark, d):
    said = F.concat(F.lit("mysql://root:se"), "c_custkey", F.lit("cret@h/"), "c_custkey", F.lit(" password = hush"), "c_custkey")
    return read(spark, d, "customer").select("c_custkey", documents.redact(said).alias("message"))


#: A dump of each part: comments, quoted names, keys in all forms.
def dumps(spark, d):
    n = F.col("n_nationkey")
    sql = F.format_string(
        """-- a ; comment
USE `s%d`; CREATE TABLE "T one" (id int PRIMARY KEY, "odd;name" varchar(%d) NOT NULL DEFAULT 'it''s; so', kind enum('a','b') COMMENT 'c', r int, UNIQUE (id, r), KEY k (r), CHECK ((kind IN ('a', 'b'))));
/* gone; */ ALTER TABLE "T one" ADD CONSTRAINT f FOREIGN KEY (r) REFERENCES other.x (y) ON DELETE SET NULL; # end
COMMENT ON COLUMN "T one".r IS 'ref'; CREATE VIEW v AS SELECT id FROM "T one";""",
        n, n + 1,
    )
    return ddl.parse_ddl(read(spark, d, "nation").select(n.cast("string").alias("file"), sql.alias("sql")))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS file, kind, n FROM nation, (VALUES ('table', 1), ('column', 4), ('primary_key', 1), ('unique', 1), ('check', 1), ('foreign_key', 1), ('view', 1), ('column_comment', 1)) AS v(kind, n)")
def d4_facts(spark, d):
    return dumps(spark, d).groupBy("file", "kind").agg(F.count("*").cast("int").alias("n"))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS file, 's' || n_nationkey AS schema, v.name, replace(v.t, '#', CAST(n_nationkey + 1 AS VARCHAR)) AS sql_type, v.nullable, v.e AS enum_values, v.c AS comment FROM nation,
  (VALUES ('id', 'int', false, NULL, NULL), ('odd;name', 'varchar(#)', false, NULL, NULL), ('kind', 'enum(''a'', ''b'')', true, 'a|b', 'c'), ('r', 'int', true, NULL, 'ref')) AS v(name, t, nullable, e, c)""")
def d3_columns(spark, d):
    return dumps(spark, d).where("kind = 'column'").select("file", "schema", "name", "sql_type", "nullable", F.array_join("enum_values", "|").alias("enum_values"), "comment")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS file, 'r' AS columns, 'other' AS ref_schema, 'x' AS ref_table, 'y' AS ref_columns, 'SET NULL' AS on_delete FROM nation")
def d5_foreign_keys(spark, d):
    return dumps(spark, d).where("kind = 'foreign_key'").select("file", F.array_join("columns", ",").alias("columns"), "ref_schema", "ref_table", F.array_join("ref_columns", ",").alias("ref_columns"), "on_delete")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS file, k AS rule_kind FROM nation, (VALUES ('validation'), ('constraint')) AS v(k)")
def p6_seed_rules(spark, d):
    return schema_seed.rules(dumps(spark, d)).select("file", "rule_kind")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS file, 1 AS n_table, 1 AS n_view, 4 AS n_column, 1 AS n_primary_key, 1 AS n_foreign_key, 1 AS n_unique, 1 AS n_check, 0 AS n_error FROM nation")
def p4_schema_profile(spark, d):
    out = Engine(spark).preview(dumps(spark, d).where("kind <> 'column_comment'"))
    return out.select("file", *[F.col(c).cast("int").alias(f"n_{c}") for c in out.columns if c != "file"])


@query("SELECT n_nationkey AS k, 'objectType:s' || n_nationkey || '-t-one' AS id, 'id' AS primary_key FROM nation")
def x22_table_ids(spark, d):
    return schema_seed.objects(dumps(spark, d)).where("kind = 'table'").select(F.col("file").cast("int").alias("k"), "id", "primary_key")


@query("SELECT n_nationkey AS k, v.t AS name, replace(v.p, '#', CAST(n_nationkey AS VARCHAR)) AS primary_key FROM nation, (VALUES ('a#', 'a#_id'), ('b', 'z_id'), ('c', 'c_id')) AS v(t, p)".replace("v.t AS name", "replace(v.t, '#', CAST(n_nationkey AS VARCHAR)) AS name"))
def x5_guess_keys(spark, d):
    n = F.col("n_nationkey")
    sql = F.format_string("CREATE TABLE a%d (z_id int, a%d_id int); CREATE TABLE b (q int, z_id int, y_id int); CREATE TABLE c (q int);", n, n)
    out = schema_seed.objects(ddl.parse_ddl(read(spark, d, "nation").select(n.cast("string").alias("file"), sql.alias("sql"))))
    return out.select(F.col("file").cast("int").alias("k"), "name", "primary_key")


# Forms --------------------------------------------------------------------------------------------------

@query("SELECT c_custkey, 'cafe-' || c_custkey || '-fi.x' AS slug FROM customer")
def f3_slug_marks(spark, d):
    return read(spark, d, "customer").select("c_custkey", T.slugify(T.fold_marks()(F.concat(F.lit("--Café "), "c_custkey", F.lit(" ﬁ..x!")))).alias("slug"))


TYPES = [("decimal", "Float", "number"), ("enum", "String", "string"), ("array", "List<String>", "array"), ("datetime", "Timestamp", "string"), ("odd", "String", "string"), ("integer", "Integer", "integer"), ("boolean", "Boolean", "boolean")]


@query(f"SELECT p_partkey, v.p AS published, v.j AS json FROM part JOIN {values([(k, p, j) for k, (_, p, j) in enumerate(TYPES)], 'k, p, j')} ON v.k = p_partkey % {len(TYPES)}")
def f7_published_types(spark, d):
    p = read(spark, d, "part").select("p_partkey", P.published_type(pick([t for t, _, _ in TYPES], "p_partkey")).alias("published"))
    return p.select("p_partkey", "published", P.json_type("published").alias("json"))


LISTS = [("String", 1), ("List<Integer>", 1), ("List<List<Date>>", 1), ("List<Integer", 0), ("Integer>", 0), ("List<Text>", 0), ("", 0)]


@query(f"SELECT p_partkey, v.ok = 1 AS ok FROM part JOIN {values([(k, ok) for k, (_, ok) in enumerate(LISTS)], 'k, ok')} ON v.k = p_partkey % {len(LISTS)}")
def f10_list_types(spark, d):
    return read(spark, d, "part").select("p_partkey", T.is_list_type(pick([t for t, _ in LISTS], "p_partkey")).alias("ok"))


OWNERS = [("objectType:a", "objects", "a"), ("ruleGroup:b.c", "rule_groups", "b.c"), ("rule:d:e", "rules", "d:e"), ("rel:f", "relationships", "f"), ("other:g", None, "g"), ("h", None, "h")]


@query(f"SELECT o_orderkey, v.o AS layer, v.b AS bare FROM orders JOIN {values([(k, o, b) for k, (_, o, b) in enumerate(OWNERS)], 'k, o, b')} ON v.k = o_orderkey % {len(OWNERS)}")
def f12_owner_layers(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", pick([i for i, _, _ in OWNERS], "o_orderkey").alias("id"))
    return o.select("o_orderkey", P.layer_of("id").alias("layer"), P.bare_id("id").alias("bare"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1) THEN 0.0 WHEN c_acctbal < 0 THEN 0.0 WHEN c_acctbal > 1000 THEN 1.0 ELSE c_acctbal / 1000 END AS x FROM customer")
def f17_clamp(spark, d):
    raw = F.when(F.col("c_custkey") % 5 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 5 == 1, F.lit(float("inf"))).otherwise(F.col("c_acctbal") / 1000)
    return read(spark, d, "customer").select("c_custkey", T.clamp01(raw).alias("x"))


@query("SELECT n_nationkey, 'a > ' || n_nationkey || ' AND (b < 1)' AS expression FROM nation")
def f19_bare_checks(spark, d):
    sql = F.format_string("CREATE TABLE t (a int, b int, CHECK (((a > %d AND (b < 1)))));", "n_nationkey")
    out = ddl.parse_ddl(read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("file"), sql.alias("sql")))
    return out.where("kind = 'check'").select(F.col("file").cast("int").alias("n_nationkey"), "expression")


@query(r"SELECT p_partkey, regexp_matches(' ' || p_name || '_x ' || p_type || ' ', '[^A-Za-z0-9_]' || split_part(p_type, ' ', 1) || '[^A-Za-z0-9_]') AS whole, false AS part FROM part")
def f21_whole_words(spark, d):
    text = F.concat_ws(" ", F.concat("p_name", F.lit("_x")), "p_type")
    return read(spark, d, "part").select("p_partkey", T.has_word(text, F.split("p_type", " ")[0]).alias("whole"), T.has_word(text, F.lit("x")).alias("part"))


@query(r"SELECT doc_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(t, ' ')) AS h FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9\x{4E00}-\x{9FFF}]+'), lambda w: length(w) >= 2) AS t FROM documents)")
def f28_tokens(spark, d):
    t = read(spark, d, "documents").select("doc_id", T.search_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("h"))


@query("SELECT l_orderkey, string_agg('p' || l_linenumber || ':' || CASE WHEN l_linenumber % 2 = 0 THEN 'array' ELSE 'number' END, ',' ORDER BY 'p' || l_linenumber) AS properties, coalesce(string_agg('p' || l_linenumber, ',' ORDER BY 'p' || l_linenumber) FILTER (l_linenumber < 3), '') AS required FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1")
def f33_parameter_schema(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    inputs = rows.select("l_orderkey", F.concat(F.lit("p"), "l_linenumber").alias("name"), F.lit("Float").alias("type"), F.lit("").alias("description"), (F.col("l_linenumber") < 3).alias("required"), (F.col("l_linenumber") % 2 == 0).alias("many"))
    out = P.parameter_schema(inputs, "l_orderkey")
    return out.select("l_orderkey", F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat_ws(":", e["key"], e["value"]["type"])), ",").alias("properties"), F.array_join("required", ",").alias("required"))


# Routines and triggers ------------------------------------------------------------------------------------

def routines(spark, d):
    k = F.col("n_nationkey")
    body = F.format_string("BEGIN INSERT INTO sales.\"orders\" VALUES (1); UPDATE parts SET a = %d; DELETE FROM nowhere; update parts set b = 2; delete from other.orders; END", k)
    arg = lambda m, n, t: F.struct(F.lit(m).alias("mode"), F.lit(n).alias("name"), F.lit(t).alias("type"))
    params = F.array(arg("IN", "a", "int"), arg("OUT", "b", "text"), arg("INOUT", "c", "numeric(3)"))
    return read(spark, d, "nation").select(text_key("action:", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(k % 2 == 0, "function").otherwise("procedure").alias("kind"), params.alias("params"), F.when(k % 4 == 0, "boolean").when(k % 4 == 2, "TRIGGER").alias("returns"), body.alias("body"))


@query("SELECT 'action:' || n_nationkey AS id, 'a Integer,c Float' AS inputs, 'b String,c Float' || CASE WHEN n_nationkey % 4 = 0 THEN ',result Boolean' ELSE '' END AS outputs FROM nation WHERE n_nationkey % 4 <> 2")
def p7_routine_actions(spark, d):
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x["name"], x["type"])), ",")
    return P.routine_actions(routines(spark, d)).select("id", shown("inputs").alias("inputs"), shown("outputs").alias("outputs"))


@query("SELECT 'action:' || n_nationkey AS id, v.k AS kind, v.o AS object_id FROM nation, (VALUES ('db_write', 'o1'), ('state_change', 'p1'), ('state_change', 'o2')) AS v(k, o)")
def a20_side_effects(spark, d):
    t = spark.createDataFrame([("sales", "orders", "o1", 1), ("other", "orders", "o2", 2), ("public", "parts", "p1", 3), ("old", "parts", "p2", 4)], "schema string, table string, id string, ord int")
    return P.side_effects(routines(spark, d), t)


@query("SELECT 'event:t' || n_nationkey || '.inserted' AS id, 'T' || n_nationkey || '_INSERTED' AS name, 'INSERT' AS mutation_type FROM nation UNION ALL SELECT 'event:t' || n_nationkey || '.deleted', 'T' || n_nationkey || '_DELETED', 'DELETE' FROM nation WHERE n_nationkey % 2 = 0")
def p8_trigger_events(spark, d):
    n = F.col("n_nationkey")
    one = read(spark, d, "nation").select(text_key("t", "n_nationkey").alias("table"), F.when(n % 2 == 0, "CREATE TRIGGER x AFTER INSERT OR DELETE ON t EXECUTE update_it()").otherwise("create trigger x before insert on t").alias("definition"))
    return P.trigger_events(one.unionByName(one)).select("id", "name", "mutation_type")


# References of a model -----------------------------------------------------------------------------------------

def model_tables(spark, d):
    """A knowledge model of the star schema: parts are objects, suppliers rules, orders actions, users events, customers processes."""
    k = lambda c: F.col(c).cast("string")
    part, orders, line = read(spark, d, "part"), read(spark, d, "orders"), read(spark, d, "lineitem")
    return {
        "object_type": part.where("p_partkey % 7 <> 0").select(k("p_partkey").alias("id")),
        "rule": read(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(k("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, text_key("E", "s_nationkey")).alias("trigger_event_id")),
        "event_type": read(spark, d, "nation").where("n_nationkey % 5 <> 0").select(text_key("E", "n_nationkey").alias("id")),
        "action": orders.where("o_orderkey % 4 <> 0").select(k("o_orderkey").alias("id")),
        "relationship": line.select(k("l_orderkey").alias("id"), k("l_partkey").alias("source"), k("l_suppkey").alias("target")),
        "rule_object": line.groupBy(k("l_suppkey").alias("rule_id")).agg(F.collect_set(k("l_partkey")).alias("object_id")),
        "action_precondition": line.select(k("l_orderkey").alias("action_id"), k("l_suppkey").alias("rule_id")),
        "event_producer": orders.select(k("o_custkey").alias("event_id"), k("o_orderkey").alias("action_id")),
        "process_step": orders.select(k("o_custkey").alias("process_id"), k("o_orderkey").alias("action_id")),
        "rule_group_member": line.select(k("l_orderkey").alias("group_id"), k("l_suppkey").alias("rule_id")),
    }


LOST = {
    "v4_relationship_ends": ("relationship", "SELECT 'error' AS level, 'relationship' AS owner, CAST(l_orderkey AS VARCHAR) AS from_id, 'source' AS field, CAST(l_partkey AS VARCHAR) AS missing_id FROM lineitem WHERE l_partkey % 7 = 0 UNION ALL SELECT 'error', 'relationship', CAST(l_orderkey AS VARCHAR), 'target', CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_suppkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0)"),
    "v5_rule_references": ("rule", "SELECT 'error' AS level, 'rule_object' AS owner, CAST(l_suppkey AS VARCHAR) AS from_id, 'object_id' AS field, CAST(l_partkey AS VARCHAR) AS missing_id FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_partkey % 7 = 0) UNION ALL SELECT 'error', 'rule', CAST(s_suppkey AS VARCHAR), 'trigger_event_id', 'E' || s_nationkey FROM supplier WHERE s_suppkey % 6 IN (2, 4) AND s_nationkey % 5 = 0 UNION ALL SELECT 'warn', 'rule_group_member', CAST(l_orderkey AS VARCHAR), 'rule_id', CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_suppkey % 3 = 0"),
    "v6_action_references": ("action", "SELECT 'error' AS level, 'action_precondition' AS owner, CAST(l_orderkey AS VARCHAR) AS from_id, 'rule_id' AS field, CAST(l_suppkey AS VARCHAR) AS missing_id FROM lineitem WHERE l_suppkey % 3 = 0"),
    "v8_event_references": ("event", "SELECT 'error' AS level, 'event_producer' AS owner, CAST(o_custkey AS VARCHAR) AS from_id, 'action_id' AS field, CAST(o_orderkey AS VARCHAR) AS missing_id FROM orders WHERE o_orderkey % 4 = 0"),
    "v9_process_references": ("process", "SELECT 'error' AS level, 'process_step' AS owner, CAST(o_custkey AS VARCHAR) AS from_id, 'action_id' AS field, CAST(o_orderkey AS VARCHAR) AS missing_id FROM orders WHERE o_orderkey % 4 = 0"),
}


def _lost(name: str, owner: str, sql: str) -> None:
    def run(spark, d):
        paths = [p for p in V.MODEL_PATHS if p.owner.split("_")[0] == owner]
        return V.dangling(model_tables(spark, d), paths).select("level", "owner", "from_id", "field", "missing_id")

    run.__name__ = name
    query(sql)(run)


for _name, (_owner, _sql) in LOST.items():
    _lost(_name, _owner, _sql)


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'id' WHEN c_custkey % 3 = 1 THEN 'name' ELSE 'raw' END AS via, CASE WHEN c_custkey % 3 < 2 THEN 'n' || c_nationkey ELSE '?' || c_custkey END AS ends, c_custkey FROM customer")
def j2_endpoint_resolution(spark, d):
    n = read(spark, d, "nation").select(text_key("n", "n_nationkey").alias("id"), text_key("raw", "n_nationkey").alias("raw"), F.lower("n_name").alias("low"), F.col("n_nationkey").alias("c_nationkey"))
    k = F.col("c_custkey") % 3
    rows = read(spark, d, "customer").join(n.select("c_nationkey", "low"), "c_nationkey").select("c_custkey", F.when(k == 0, text_key("raw", "c_nationkey")).when(k == 1, F.upper("low")).otherwise(text_key("?", "c_custkey")).alias("ref"))
    out = M.resolve_first(rows, "ref", n, [(F.col("ref"), "raw"), (F.lower("ref"), "low")])
    return out.select("c_custkey", F.when(F.col("ref").startswith("raw"), "id").when(F.col("resolved").isNotNull(), "name").otherwise("raw").alias("via"), F.coalesce("resolved", "ref").alias("ends"))


@query("SELECT l_orderkey AS id, l_partkey AS source, l_suppkey AS target FROM lineitem WHERE l_partkey % 2 = 0 AND l_suppkey % 2 = 0 AND l_partkey <> l_suppkey AND l_suppkey IN (SELECT p_partkey FROM part)")
def j4_prune_relationships(spark, d):
    edges = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))
    return O.live_edges(edges, read(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"))).select("id", "source", "target")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS file, 'objectType:public-child' AS source, 'objectType:public-parent' AS target, 'p' AS via FROM nation")
def j5_parent_objects(spark, d):
    sql = F.lit("CREATE TABLE parent (id int PRIMARY KEY); CREATE TABLE child (p int, q int, FOREIGN KEY (p) REFERENCES parent (id), FOREIGN KEY (q) REFERENCES outside (id));")
    facts = ddl.parse_ddl(read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("file"), sql.alias("sql")))
    return schema_seed.relationships(facts).select("file", "source", "target", "via")


@query("""WITH t AS (SELECT DISTINCT lower(p_type) AS term FROM part), n AS (SELECT DISTINCT p_brand AS node, lower(left(p_type, 3 + length(p_brand) % 2)) AS name FROM part)
  SELECT term, arg_min(node, (node)) AS node FROM t JOIN n ON contains(term, name) OR contains(name, term) WHERE term = name OR least(length(term), length(name)) >= 3 GROUP BY term""")
def j11_expected_entities(spark, d):
    p = read(spark, d, "part")
    terms = p.select(F.lower("p_type").alias("term_id")).distinct().select("term_id", F.array("term_id").alias("keys"))
    nodes = p.select(F.col("p_brand").alias("node_id"), F.col("p_brand").alias("ord"), F.lower(F.left("p_type", 3 + F.length("p_brand") % 2)).alias("name")).distinct()
    return M.match_names(terms, nodes).select(F.col("term_id").alias("term"), F.col("node_id").alias("node"))


@query("SELECT process_id, from_action, to_action FROM (SELECT l_orderkey AS process_id, l_partkey AS from_action, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS to_action FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL)) WHERE to_action IS NOT NULL")
def j14_step_edges(spark, d):
    steps = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("action_id"))
    return P.process_edges(steps.select(F.col("l_orderkey").alias("process_id"), "action_id", F.col("l_linenumber").alias("ord")))


@query("SELECT p_brand AS view, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_size, p_partkey) AS columns FROM part GROUP BY 1")
def a17_view_columns(spark, d):
    rows = read(spark, d, "part").select(F.col("p_brand").alias("view"), F.struct("p_size", "p_partkey").alias("at"), F.col("p_partkey").cast("string").alias("name"))
    return M.ordered_keys(rows, ["view"], "at", "name").select("view", F.array_join("columns", ",").alias("columns"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'c' || o_custkey || ',x' ELSE 'c' || o_custkey || ',o' || o_orderkey END AS targets FROM orders")
def a23_target_objects(spark, d):
    c, own = text_key("c", "o_custkey"), text_key("o", "o_orderkey")
    even = F.col("o_orderkey") % 2 == 0
    rows = read(spark, d, "orders").select("o_orderkey", F.array(c).alias("io"), F.when(even, F.array(F.lit("x"), c)).alias("steps"), F.when(~even, F.array(own, F.lit(None))).alias("effects"))
    return rows.select("o_orderkey", F.array_join(O.target_objects("io", "steps", "effects"), ",").alias("targets"))


@query("SELECT p_partkey AS id FROM part WHERE p_size < 3 ORDER BY round(p_retailprice, 2), p_partkey LIMIT 40")
def l6_weakest_nodes(spark, d):
    nodes = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") < 3, "inferred").otherwise("human").alias("provenance"), F.round("p_retailprice", 2).alias("confidence"))
    return O.weak_nodes(nodes, below=-1.0).select("id")


# Graph ----------------------------------------------------------------------------------------------------

@query(f"WITH {TRIPLES} SELECT node, count(*) AS degree FROM (SELECT s AS node FROM t UNION ALL SELECT o FROM t WHERE NOT literal AND s <> o) GROUP BY node")
def g2_adjacency(spark, d):
    return G.adjacency(star_triples(spark, d)).groupBy("node").agg(F.count("*").alias("degree"))


@query(f"WITH {TRIPLES} SELECT p, count(DISTINCT s) AS subjects, count(*) AS n FROM t GROUP BY p")
def u2_distinct_triples(spark, d):
    t = star_triples(spark, d)
    return G.project([t, t]).groupBy("p").agg(F.countDistinct("s").alias("subjects"), F.count("*").alias("n"))


@query("SELECT 'customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'lives_in', count(*) FROM customer")
def g7_graph_export(spark, d):
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    nodes = c.select(F.lit("customer").alias("label"), text_key("c", "c_custkey").alias("id")).unionByName(n.select(F.lit("nation").alias("label"), text_key("n", "n_nationkey").alias("id")))
    edges = c.select(F.lit("lives_in").alias("type"), text_key("c", "c_custkey").alias("source"), text_key("n", "c_nationkey").alias("target"))
    lost = c.select(F.lit("lives_in").alias("type"), text_key("c", "c_custkey").alias("source"), F.lit("nowhere").alias("target"))
    folder = f"{tables.scratch(spark)}/provenir/{uuid.uuid4().hex}/graph"
    store.export_graph(nodes.unionByName(nodes), edges.unionByName(edges).unionByName(lost), folder)
    count = lambda name, by: spark.read.parquet(f"{folder}/{name}").groupBy(F.col(by).alias("label")).agg(F.count("*").alias("n"))
    return count("nodes", "label").unionByName(count("edges", "type"))


# Grounding -------------------------------------------------------------------------------------------------

@query(f"SELECT doc_id, item_id, 'exact' AS tier, true AS verified FROM ({EXACT})")
def c1_grounding_tiers(spark, d):
    out = Engine(spark).ground(read(spark, d, "benchmark"), read(spark, d, "documents"))
    return out.where("tier = 'exact'").select("doc_id", "item_id", "tier", "verified")


@query(rf"""WITH s AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, s FROM (SELECT doc_id, {PARTS} AS s FROM documents)), t AS (SELECT doc_id, i - 1 AS idx, trim(s[i]) AS text FROM s)
  SELECT CASE WHEN idx % 5 = 0 THEN 'covered' WHEN text = '' OR regexp_matches(text, '^[\d\s.、第章节()()\-—]+$') OR regexp_matches(text, '^[^\p{{L}}\p{{N}}]+$') OR len(string_split_regex(text, '\s+')) < 3 THEN 'uncoverable' WHEN idx % 5 = 1 THEN 'partial' ELSE 'uncovered' END AS status, count(*) AS n FROM t GROUP BY 1""")
def c3_coverage_tiers(spark, d):
    s = D.sentences(read(spark, d, "documents"))
    covered = s.withColumn("covered_by", F.when(F.col("idx") % 5 == 0, F.array(F.lit(1).cast("bigint"))))
    verdicts = s.where("idx % 5 IN (0, 1, 2)").select("document_id", "idx", F.when(F.col("idx") % 5 == 2, "odd").otherwise("partial").alias("verdict"))
    return J.coverage_status(covered, verdicts).groupBy("status").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS last_line FROM documents")
def k10_line_numbers(spark, d):
    return read(spark, d, "documents").select("doc_id", T.line_number("text", F.length("text")).alias("last_line"))


@query("SELECT l_orderkey AS process_id, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS steps FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY 1")
def k12_ordered_steps(spark, d):
    steps = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("process_id"), F.col("l_partkey").alias("action_id"), F.col("l_linenumber").alias("ord"))
    nodes, _ = L.manifest(steps, read(spark, d, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    return nodes.select("process_id", F.array_join(F.transform("nodes", lambda x: x["action_id"].cast("string")), ",").alias("steps"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS payload FROM orders")
def x9_payload_choice(spark, d):
    own = F.when(F.col("o_orderkey") % 3 == 0, F.array("o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, F.array().cast("array<string>"))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(L.fallback(own, F.array("o_orderstatus")), ",").alias("payload"))


@query("SELECT c_custkey, 'c' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS name FROM customer")
def p12_merge_back(spark, d):
    c = read(spark, d, "customer").select("c_custkey", text_key("c", "c_custkey").alias("id"), F.col("c_name").alias("name"))
    clean = c.where("c_custkey % 2 = 0").select("id", F.lit("new").alias("name"))
    return O.edit_back(c, clean, "id", ["name"]).select("c_custkey", "id", "name")


@query("SELECT DISTINCT 'customer-' || c_mktsegment AS id, 2 AS version, 'published' AS status, 'retail' AS domain FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer)")
def t3_versions(spark, d):
    folder = f"{tables.scratch(spark)}/provenir/{uuid.uuid4().hex}/store"
    s = store.Store(spark, folder)
    first = read(spark, d, "customer").agg(F.min("c_mktsegment")).first()[0]
    nodes = read(spark, d, "customer").select(F.lit("object").alias("kind"), text_key("c", "c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "rejected").alias("review"))
    s.save(f"customer-{first}", "Customers", "retail", nodes)
    s.publish(f"customer-{first}", exclude_rejected=True)
    s.save("gone", "Gone", "retail", nodes)
    s.delete("gone")
    s.save("other", "Other", "banking", nodes)
    return s.list("retail").select("id", "version", "status", "domain")


@query("SELECT c_custkey AS document_id, v.idx, v.kind, replace(v.text, '#', CAST(c_custkey AS VARCHAR)) AS text FROM customer, (VALUES (0, 'obligation', 'Customer # must pay.'), (2, 'prohibition', 'It may not wait.')) AS v(idx, kind, text)")
def m2_obliging_sentences(spark, d):
    text = F.concat(F.lit("Customer "), "c_custkey", F.lit(" must pay. Mustard is no word of that kind. It may not wait."))
    return enrich.rules_stub(read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text"))).select("document_id", "idx", "kind", "text")


# Briefs, view graph, published actions ---------------------------------------------------------------------------

@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY lower(p_type) ORDER BY p_partkey) AS k FROM part), m AS (SELECT lower(p_type) AS key, min(p_partkey) AS first FROM part GROUP BY 1)
  SELECT DISTINCT o_orderkey % 50 AS owner, 'persona-' || regexp_replace(key, '[^a-z0-9.-]+', '-', 'g') AS id FROM orders JOIN part ON p_partkey = o_custkey % 40 + 1 JOIN m ON key = lower(p_type) WHERE o_orderkey % 3 < 2""")
def j16_merge_brief(spark, d):
    p = read(spark, d, "part")
    said = p.select(F.col("p_partkey").alias("ord"), text_key("raw", "p_partkey").alias("raw_id"), F.lit("object").alias("kind"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.concat(F.lit(" "), "p_type")).alias("name"))
    kept, meant = B.merge_entries(said, "persona")
    o = read(spark, d, "orders").withColumn("p_partkey", F.col("o_custkey") % 40 + 1).join(p.select("p_partkey", "p_type"), "p_partkey")
    k = F.col("o_orderkey") % 3
    refs = o.select((F.col("o_orderkey") % 50).alias("owner"), F.col("o_orderkey").alias("ord"), F.when(k == 0, text_key("raw", "p_partkey")).when(k == 1, F.upper("p_type")).otherwise("nobody").alias("ref"))
    return B.remap_refs(refs, kept, meant).select("owner", "id")


@query("""WITH e AS (SELECT 'object:' || p_partkey AS a, 'object:' || p_size AS b, 'rel' AS kind FROM part UNION ALL SELECT 'rule:' || l_suppkey, 'object:' || l_partkey, 'rule' FROM lineitem)
  SELECT kind, count(*) AS n FROM e WHERE a <> b AND a IN (SELECT 'object:' || p_partkey FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT 'rule:' || s_suppkey FROM supplier) AND b IN (SELECT 'object:' || p_partkey FROM part WHERE p_partkey % 5 <> 0) GROUP BY 1""")
def g8_view_edges(spark, d):
    p, line = read(spark, d, "part"), read(spark, d, "lineitem")
    nodes = p.where("p_partkey % 5 <> 0").select(F.lit("object").alias("kind"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("label"), F.col("p_size").alias("degree"))
    nodes = nodes.unionByName(read(spark, d, "supplier").select(F.lit("rule").alias("kind"), F.col("s_suppkey").cast("string").alias("id"), F.lit("").alias("label"), F.lit(0).alias("degree")))
    link = lambda df, sk, s, tk, t: df.select(F.lit(sk).alias("source_kind"), F.col(s).cast("string").alias("source"), F.lit(tk).alias("target_kind"), F.col(t).cast("string").alias("target"))
    _, edges = B.view_graph(nodes, {"rel": link(p, "object", "p_partkey", "object", "p_size"), "rule": link(line, "rule", "l_suppkey", "object", "l_partkey")})
    return edges.groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT 'object:' || p_partkey AS id, p_name AS label, p_size + 1 AS weight FROM part UNION ALL SELECT 'rule:rule:' || s_suppkey, 'R' || s_suppkey, 2 FROM supplier UNION ALL SELECT 'process:' || n_nationkey, n_name, 3 FROM nation")
def g8_view_nodes(spark, d):
    rows = lambda df, kind, i, label, n: df.select(F.lit(kind).alias("kind"), i.alias("id"), label.alias("label"), n.alias("degree"))
    nodes = rows(read(spark, d, "part"), "object", F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_size"))
    nodes = nodes.unionByName(rows(read(spark, d, "supplier"), "rule", text_key("rule:", "s_suppkey"), F.lit(""), F.lit(0))).unionByName(rows(read(spark, d, "nation"), "process", F.col("n_nationkey").cast("string"), F.col("n_name"), F.lit(0)))
    none = nodes.limit(0).select(F.col("kind").alias("source_kind"), F.col("id").alias("source"), F.col("kind").alias("target_kind"), F.col("id").alias("target"))
    return B.view_graph(nodes, {"rel": none})[0].select("id", "label", "weight")


@query("SELECT process_id, source, target FROM (SELECT o_custkey AS process_id, o_orderkey AS source, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS target FROM orders) WHERE target IS NOT NULL AND target % 7 <> 0 AND source % 7 <> 0")
def g8_step_links(spark, d):
    from pyspark.sql import Window

    o = read(spark, d, "orders").select(F.col("o_custkey").alias("process_id"), text_key("s", "o_orderkey").alias("step_id"), F.concat_ws("|", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("action_id"), "o_orderkey")
    follow = o.withColumn("target_step", F.lead("step_id").over(Window.partitionBy("process_id").orderBy("o_orderkey"))).select("process_id", F.col("step_id").alias("source_step"), "target_step")
    out = B.step_links(o.where("o_orderkey % 7 <> 0"), follow)
    part = lambda c, k: F.split_part(c, F.lit("|"), F.lit(k)).cast("bigint")
    return out.select(part("source", 1).alias("process_id"), part("source", 2).alias("source"), part("target", 2).alias("target"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'step' || p_size ELSE 'checkTheOrderLineOf' || p_partkey END AS name FROM part")
def x6_step_names(spark, d):
    text = F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit("Check the orderLine, of "), "p_partkey", F.lit(" and more"))).otherwise("!!")
    return read(spark, d, "part").select("p_partkey", B.step_name(text, "p_size").alias("name"))


@query("""WITH l AS (SELECT l_orderkey AS action_id, 0 AS part, l_linenumber AS ord, l_partkey AS k, '事件 PART_' || l_partkey || ' 已送达' AS line FROM lineitem WHERE l_linenumber < 3 UNION ALL SELECT l_orderkey, 1, l_linenumber, l_suppkey, '规则「' || s_name || '」已满足' FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber > 3 AND s_suppkey % 4 <> 0),
  n AS (SELECT *, row_number() OVER (PARTITION BY action_id ORDER BY part, ord, line) AS i FROM l) SELECT action_id, string_agg(i || '. ' || line, chr(10) ORDER BY i) AS criteria FROM n GROUP BY 1""")
def x6_submission_criteria(spark, d):
    line = read(spark, d, "lineitem")
    triggers = line.where("l_linenumber < 3").select(F.col("l_orderkey").alias("action_id"), text_key("event:part.", "l_partkey").alias("event_id"), F.col("l_linenumber").alias("ord"))
    gates = line.where("l_linenumber > 3").select(F.col("l_orderkey").alias("action_id"), F.col("l_suppkey").alias("rule_id"), F.col("l_linenumber").alias("ord"))
    rules = read(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    return B.submission_criteria(triggers, gates, rules)


@query("SELECT l_orderkey AS action_id, l_partkey AS object_id, CASE WHEN l_linenumber % 4 = 0 THEN 'CREATE' ELSE 'MODIFY' END AS change FROM lineitem WHERE l_linenumber % 4 <> 3 AND l_partkey % 7 <> 0")
def x6_data_changes(spark, d):
    effects = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("action_id"), F.col("l_partkey").alias("object_id"), pick(["db_write", "state_change", "payment", "notification"], "l_linenumber").alias("kind"), F.lit(" x ").alias("description"))
    return B.data_changes(effects, read(spark, d, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id"))).select("action_id", "object_id", "change")


@query("""WITH t AS (SELECT o_orderkey AS action_id, -1 AS ord, 'db.' || o_orderpriority AS tool FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT l_orderkey, l_linenumber, 'call ' || l_suppkey % 3 FROM lineitem WHERE l_linenumber % 2 = 0), u AS (SELECT action_id, tool, min(ord) AS ord FROM t GROUP BY ALL)
  SELECT action_id, string_agg(tool, ',' ORDER BY ord, tool) AS tools FROM u GROUP BY 1""")
def x6_tool_use(spark, d):
    actions = read(spark, d, "orders").select(F.col("o_orderkey").alias("action_id"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("db."), "o_orderpriority")).otherwise("").alias("integration"))
    effects = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("action_id"), F.col("l_linenumber").alias("ord"), pick(["external_call", "payment"], "l_linenumber").alias("kind"), F.concat(F.lit(" call "), F.col("l_suppkey") % 3).alias("description"))
    return B.tool_use(actions, effects).select("action_id", F.array_join("tools", ",").alias("tools"))


@query("SELECT o_orderpriority AS role, string_agg(DISTINCT 'e' || o_custkey % 30, ',' ORDER BY 'e' || o_custkey % 30) AS events FROM orders GROUP BY 1")
def x25_reacts_to(spark, d):
    t = read(spark, d, "orders").select(F.col("o_orderpriority").alias("role"), F.concat(F.lit("e"), F.col("o_custkey") % 30).alias("event_id"))
    return B.reacts_to(t, "role").select("role", F.array_join("events", ",").alias("events"))


@query("""SELECT n_nationkey, '### `' || CASE WHEN n_nationkey % 2 = 0 THEN 't' || n_nationkey ELSE n_name END || '`' || chr(10) || '**' || n_name || CASE WHEN n_nationkey % 3 = 0 THEN ' / 国' ELSE '' END || '** — execution: `function`' || CASE WHEN n_nationkey % 5 = 0 THEN ' · integration: `x`' ELSE '' END AS head FROM nation""")
def x25_tool_headings(spark, d):
    k = F.col("n_nationkey")
    head = B.tool_heading(F.when(k % 2 == 0, F.concat(F.lit("t"), k)), F.col("n_name"), F.when(k % 3 == 0, "国"), F.lit(None).cast("string"), F.when(k % 5 == 0, "x").otherwise(""))
    return read(spark, d, "nation").select("n_nationkey", head.alias("head"))


@query("SELECT c_custkey, 'You are ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || chr(10) || c_mktsegment ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || chr(10) || 'web' ELSE '' END AS prompt FROM customer")
def x17_stage_prompts(spark, d):
    k = F.col("c_custkey")
    return read(spark, d, "customer").select("c_custkey", B.stage_prompt(F.concat(F.lit("You are "), "c_name"), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(""), F.when(k % 3 == 0, "web")).alias("prompt"))


@query("SELECT c_custkey, v.k AS ord, 'o' || v.k AS id, c_mktsegment AS description FROM customer, (VALUES (0), (1)) AS v(k) WHERE c_custkey % 3 = 0")
def x21_enrichments(spark, d):
    good = F.format_string('Here:\n```json\n{"enrichments": [{"id": "o0", "description": "%s"}, {"id": "o1", "description": "%s"}]}\n``` bye', "c_mktsegment", "c_mktsegment")
    reply = F.when(F.col("c_custkey") % 3 == 0, good).when(F.col("c_custkey") % 3 == 1, "no JSON").otherwise('{"enrichments": [oops}')
    out = B.enrichments(read(spark, d, "customer").select("c_custkey", reply.alias("reply")), "reply")
    return out.select("c_custkey", "ord", F.col("item")["id"].alias("id"), F.col("item")["description"].alias("description"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, md5('- id: ' || o_orderkey || chr(10) || '  table: ' || o_orderpriority || chr(10) || '  columns: ' || coalesce(c, '') || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '  comment: ' || o_orderstatus ELSE '' END) AS h FROM orders LEFT JOIN (SELECT l_orderkey, string_agg('p' || l_partkey || ' (Float)', ', ' ORDER BY l_linenumber, 'p' || l_partkey || ' (Float)') AS c FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def x21_batch_lines(spark, d):
    objects = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("description"))
    props = read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("object_id"), F.col("l_linenumber").alias("ord"), text_key("p", "l_partkey").alias("name"), F.lit("Float").alias("type"))
    return B.batch_lines(objects, props).select("id", F.md5("line").alias("h"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'INSERT' ELSE 'DELETE' END AS event, CASE WHEN l_suppkey % 3 = 0 THEN 'BEFORE' ELSE 'AFTER' END AS timing FROM lineitem WHERE l_linenumber <> 3 AND l_partkey % 5 <> 0")
def x19_catalog_triggers(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 5 > 0, "t").alias("name"), F.lit("tab").alias("table"), F.when(F.col("l_linenumber") == 3, "TRUNCATE").when(F.col("l_linenumber") % 2 == 0, "insert").otherwise("Delete").alias("event"), F.when(F.col("l_suppkey") % 3 == 0, "before").otherwise("odd").alias("timing"))
    return B.shape_triggers(rows).select("l_orderkey", "l_linenumber", "event", "timing")


@query("""WITH p AS (SELECT 'r' || l_orderkey AS name, string_agg(CASE WHEN l_linenumber % 3 = 0 THEN 'OUT' ELSE 'IN' END || ' p' || l_linenumber || ' int', ',' ORDER BY l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'OUT' ELSE 'IN' END) AS params FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1)
  SELECT 'r' || o_orderkey AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'function' ELSE 'procedure' END AS kind, coalesce(params, '') AS params, CASE WHEN o_orderkey % 2 = 0 THEN 'int' END AS returns FROM orders LEFT JOIN p ON p.name = 'r' || o_orderkey WHERE o_orderkey % 5 <> 0""")
def x19_catalog_routines(spark, d):
    k, n = F.col("o_orderkey"), F.col("l_linenumber")
    routines_ = read(spark, d, "orders").select(F.lit("s").alias("schema"), F.when(k % 5 > 0, text_key("r", "o_orderkey")).otherwise("").alias("name"), F.when(k % 2 == 0, "function").otherwise("odd").alias("kind"), F.when(k % 2 == 0, " int ").otherwise(" ").alias("returns"), F.lit(None).cast("string").alias("comment"))
    params = read(spark, d, "lineitem").select(text_key("r", "l_orderkey").alias("specific_name"), F.when(n != 2, F.concat(F.lit("p"), n)).alias("name"), F.when(n % 3 == 0, "out").when(n % 3 == 1, "odd").alias("mode"), F.lit("int").alias("sql_type"), n.alias("ord"))
    out = B.shape_routines(routines_, params)
    return out.select("name", "kind", F.array_join(F.transform("params", lambda p: F.concat_ws(" ", p["mode"], p["name"], p["type"])), ",").alias("params"), "returns")


# Uploads, state and JSON ---------------------------------------------------------------------------------------------

@query("SELECT c_custkey, 'doc:' || CASE WHEN c_custkey % 2 = 0 THEN 'file-' || c_custkey || '.txt' ELSE 'same.html' || CASE WHEN c_custkey = 1 THEN '' ELSE '-' || ((c_custkey + 1) / 2)::INT END END AS id, CASE WHEN c_custkey % 2 = 0 THEN 'text' ELSE 'html' END AS format, CASE WHEN c_custkey % 2 = 0 THEN 'a ' || c_name ELSE c_name END AS text, CASE WHEN c_custkey % 2 = 0 THEN length(c_name) + 3 ELSE length(c_name) + 7 END AS size FROM customer")
def s7_upload(spark, d):
    even = F.col("c_custkey") % 2 == 0
    files = read(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.when(even, F.concat(F.lit("File "), "c_custkey", F.lit(".txt"))).otherwise("Same.html").alias("name"), F.lit("").alias("mime"), F.base64(F.encode(F.when(even, F.concat(F.lit("a  "), "c_name")).otherwise(F.concat(F.lit("<p>"), "c_name", F.lit("</p>"))), "UTF-8")).alias("data"))
    sources, texts = documents.upload(files)
    both = sources.join(texts.select(F.col("document_id").alias("id"), "text"), "id")
    return both.select(F.regexp_extract("text", r"(\d+)$", 1).cast("bigint").alias("c_custkey"), "id", "format", "text", "size")


@query("SELECT 'run:' || c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN '{\"cursor\": 2}' ELSE '{\"cursor\": 1}' END AS json FROM customer")
def s23_side_state(spark, d):
    s = store.Store(spark, f"{tables.scratch(spark)}/provenir/{uuid.uuid4().hex}/store")
    c = read(spark, d, "customer")
    s.put_state(c.select(text_key("run:", "c_custkey").alias("key"), F.lit('{"cursor": 1}').alias("json")))
    s.put_state(c.where("c_custkey % 2 = 0").select(text_key("run:", "c_custkey").alias("key"), F.lit('{"cursor": 2}').alias("json")))
    return s.state()


@query("SELECT event_id, '{\"k\": ' || json_extract_string(props, '$.k') || ', \"a\": [null, {\"b\": \"' || event_type || '\"}]}' AS patched FROM events WHERE props LIKE '{\"k\": %'")
def f27_json_patch(spark, d):
    e = read(spark, d, "events").where("props LIKE '{\"k\": %'")
    return e.select("event_id", jsonfix.patch_udf()("props", F.lit('["a", 1, "b"]'), F.concat(F.lit('"'), "event_type", F.lit('"'))).alias("patched"))


@query("SELECT event_id, event_id % 2 = 0 AS ok, CASE WHEN event_id % 2 = 0 THEN props END AS text, '3,6' AS mask FROM events WHERE props LIKE '{\"k\": %'".replace("'3,6'", "'1,4'"))
def x38_repair_and_parse(spark, d):
    e = read(spark, d, "events").where("props LIKE '{\"k\": %'")
    broken = F.when(F.col("event_id") % 2 == 0, F.regexp_replace("props", r"\}$", ",}")).otherwise(F.regexp_replace("props", r"\}$", ""))
    r = e.select("event_id", jsonfix.checked_udf()(broken).alias("r"), jsonfix.mask_udf()("props").alias("m"))
    return r.select("event_id", "r.ok", "r.text", F.array_join(F.transform("m", lambda x: F.array_join(x.cast("array<string>"), ",")), "|").alias("mask"))


@query(f"""WITH {TRIPLES}, a AS (SELECT s AS node, o AS other, s, p, o, literal FROM t UNION ALL SELECT o, s, s, p, o, literal FROM t WHERE NOT literal AND s <> o),
  b1 AS (SELECT s, p, o, min(prio) AS prio FROM (SELECT s, p, o, 0 AS prio FROM a WHERE node = 'region:1' AND NOT literal UNION ALL SELECT s, p, o, 1 FROM a WHERE literal AND p = 'label' AND node IN (SELECT other FROM a WHERE node = 'region:1' AND NOT literal) AND node <> 'region:1' UNION ALL SELECT s, p, o, 2 FROM a WHERE node = 'region:1' AND literal) GROUP BY ALL ORDER BY prio, s, p, o LIMIT 150),
  f AS (SELECT node FROM (SELECT s AS node, s, p, o, 0 AS side FROM b1 WHERE prio = 0 UNION ALL SELECT o, s, p, o, 1 FROM b1 WHERE prio = 0) WHERE node <> 'region:1' GROUP BY node ORDER BY min((s, p, o, side)) LIMIT 12),
  u AS (SELECT * FROM a WHERE (s, p, o) NOT IN (SELECT (s, p, o) FROM b1)),
  b2 AS (SELECT s, p, o, min(prio) AS prio FROM (SELECT s, p, o, 0 AS prio FROM u WHERE node IN (FROM f) AND NOT literal UNION ALL SELECT s, p, o, 1 FROM u WHERE literal AND p = 'label' AND node IN (SELECT other FROM u WHERE node IN (FROM f) AND NOT literal) AND node NOT IN (FROM f) UNION ALL SELECT s, p, o, 2 FROM u WHERE node IN (FROM f) AND literal) GROUP BY ALL ORDER BY prio, s, p, o LIMIT 150)
  SELECT s, p, o, prio, 1 AS round FROM b1 UNION ALL SELECT s, p, o, prio, 2 FROM b2""")
def g3_frontier_rounds(spark, d):
    seeds = spark.createDataFrame([("region:1",)], "node string")
    return G.frontier_rounds(star_triples(spark, d, G.every), seeds, tables.keep, most=2)
