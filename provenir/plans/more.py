"""Queries of schema facts, published layers, repair, routing and remaining operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenir.functions import jsonfix
from provenir.functions import text as T
from provenir.operators import enrich, project, schema_seed
from provenir.operators import grounding as J
from provenir.operators import integrity as V
from provenir.plans.catalogue import query, read
from provenir.sources import ddl, documents

#: Columns of the driver's tables as a dump; keys are those of the star schema.
DUMP = """
CREATE TABLE region (r_regionkey integer NOT NULL, r_name varchar(25) NOT NULL, PRIMARY KEY (r_regionkey));
CREATE TABLE nation (n_nationkey integer PRIMARY KEY, n_name varchar(25), n_regionkey integer, CONSTRAINT fk_n FOREIGN KEY (n_regionkey) REFERENCES region (r_regionkey));
CREATE TABLE customer (c_custkey bigint PRIMARY KEY, c_name text, c_nationkey integer REFERENCES nation (n_nationkey), c_acctbal double precision, c_mktsegment varchar(10), CHECK (c_mktsegment IN ('BUILDING', 'AUTO''S')));
CREATE TABLE profile (c_custkey bigint PRIMARY KEY, note text, FOREIGN KEY (c_custkey) REFERENCES customer (c_custkey));
CREATE TABLE broken (a int, b;
"""


def facts(spark, d):
    return ddl.parse_ddl(spark.createDataFrame([("star.sql", DUMP)], "file string, sql string"))


@query("""SELECT * FROM (VALUES ('check', 1), ('column', 12), ('error', 1), ('foreign_key', 3), ('primary_key', 4), ('table', 4)) AS v(kind, n)""")
def s9_parse_ddl(spark, d):
    return facts(spark, d).groupBy("kind").agg(F.count("*").cast("int").alias("n"))


@query("""SELECT 'customer' AS table_name, 'c_mktsegment' AS name, 'BUILDING|AUTO''S' AS enum_values""")
def d6_check_enums(spark, d):
    return facts(spark, d).where("kind = 'column' AND enum_values IS NOT NULL").select(F.col("table").alias("table_name"), "name", F.array_join("enum_values", "|").alias("enum_values"))


@query("""SELECT * FROM (VALUES ('objectType:public-nation', 'objectType:public-region', 'many_to_one'), ('objectType:public-customer', 'objectType:public-nation', 'many_to_one'), ('objectType:public-profile', 'objectType:public-customer', 'one_to_one')) AS v(source, target, cardinality)""")
def a21_fk_cardinality(spark, d):
    out = schema_seed.relationships(facts(spark, d)).select("source", "target", "cardinality")
    return out.select(*[F.replace(c, F.lit("_"), F.lit("-")).alias(c) if c != "cardinality" else F.col(c) for c in out.columns])


@query("""SELECT * FROM (VALUES ('region', 'r_regionkey', 2), ('nation', 'n_nationkey', 3), ('customer', 'c_custkey', 5), ('profile', 'c_custkey', 2)) AS v(name, primary_key, properties)""")
def p5_schema_seed(spark, d):
    f = facts(spark, d)
    n = schema_seed.properties(f).groupBy("object_id").agg(F.count("*").cast("int").alias("properties"))
    return schema_seed.objects(f).join(n, F.col("id") == F.col("object_id")).select("name", "primary_key", "properties")


@query("SELECT event_id, props AS repaired FROM events")
def d10_json_repair(spark, d):
    broken = F.regexp_replace(F.regexp_replace("props", r"\}$", ",}"), r"^\{", "{ /* note */")
    fixed = read(spark, d, "events").select("event_id", jsonfix.repair_udf()(broken).alias("r"))
    return fixed.select("event_id", F.regexp_replace("r", r"^\{ +", "{").alias("repaired"))


@query("SELECT event_id, CAST(length(props) - 1 AS INTEGER) AS pos, 1 AS line FROM events WHERE props LIKE '{%'")
def d11_json_errors(spark, d):
    e = jsonfix.lint_udf()(F.expr("substr(props, 1, length(props) - 1)"))
    return read(spark, d, "events").where("props LIKE '{%'").select("event_id", e.alias("e")).select("event_id", "e.pos", "e.line")


@query("""SELECT array_to_string(list_transform(string_split(p_brand, '#'), lambda x: upper(x[1]) || lower(x[2:])), '_') AS id, p_brand AS name, count(*) AS properties, min('p' || p_partkey) AS first_property FROM part GROUP BY p_brand""")
def p1_spec_projection(spark, d):
    p = read(spark, d, "part")
    objects = p.select(F.col("p_brand").alias("id"), F.col("p_brand").alias("name"), F.lit(None).cast("string").alias("description"), F.lit("p_partkey").alias("primary_key")).distinct()
    props = p.select(F.col("p_brand").alias("object_id"), F.col("p_partkey").alias("ord"), F.concat(F.lit("p"), F.col("p_partkey")).alias("name"), F.lit("integer").alias("type"), F.lit(False).alias("is_foreign_key"), F.lit(None).cast("string").alias("references"))
    out = project.spec_objects(objects, props)
    return out.select("id", "name", F.size("properties").cast("bigint").alias("properties"), F.array_min(F.transform("properties", lambda x: x["name"])).alias("first_property"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 7 = 0 THEN 'env' WHEN n_nationkey % 5 = 0 THEN 'set' WHEN n_nationkey > 20 THEN 'long' WHEN n_nationkey % 2 = 0 THEN 'small' ELSE 'base' END AS model FROM nation""")
def m17_router(spark, d):
    k = F.col("n_nationkey")
    agents = read(spark, d, "nation").select(
        "n_nationkey", F.when(k % 7 == 0, "env").alias("env_model"), F.when(k % 5 == 0, "set").otherwise("").alias("settings_model"), F.when(k > 20, 400_000).otherwise(10).alias("chars"),
        F.when(k % 2 == 0, "fast").otherwise("plain").alias("purpose"), F.lit("small").alias("fast_model"), F.lit("big").alias("strong_model"), F.lit("long").alias("long_model"), F.lit("base").alias("default_model"),
    )
    return enrich.route(agents).select("n_nationkey", "model")


@query("SELECT url, CASE WHEN lower(split_part(url, '?', 1)) LIKE '%.pdf' THEN 'pdf' ELSE 'html' END AS format FROM pages")
def s1_detect_format(spark, d):
    return read(spark, d, "pages").select("url", T.detect_format(F.split("url", r"\?")[0], F.lit("text/HTML; charset=utf-8")).alias("format"))


@query(r"SELECT doc_id, CAST(1 + length(left(text, CAST(length(text) // 2 AS BIGINT))) - length(replace(left(text, CAST(length(text) // 2 AS BIGINT)), chr(10), '')) AS INTEGER) AS line FROM documents")
def f29_line_number(spark, d):
    return read(spark, d, "documents").select("doc_id", T.line_number("text", F.floor(F.length("text") / 2).cast("int")).alias("line"))


@query("SELECT doc_id, page, CAST(sum(n + 2) OVER (PARTITION BY doc_id ORDER BY page) - n - 2 AS BIGINT) AS page_start FROM (SELECT conv_id AS doc_id, turn AS page, length(trim(regexp_replace(text, '[ ]+', ' ', 'g'))) AS n FROM conversations)")
def k9_page_offsets(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return documents.page_map(c, "doc_id").select("doc_id", "page", F.col("page_start").cast("bigint").alias("page_start"))


@query("""SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN 'VIP ' || c_name WHEN c_custkey % 3 = 1 THEN '  ' END), ''), c_name) AS c_name FROM customer""")
def m7_keep_or_replace(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name")
    said = c.where("c_custkey % 3 < 2").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("VIP "), "c_name")).otherwise("  ").alias("c_name"))
    return enrich.keep_or_replace(c, said, "c_custkey", ["c_name"])


@query("""WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderkey % 5 <> 0)
  SELECT o_custkey AS process_id, o_orderkey AS action_id, 's' || k AS step_id FROM s""")
def p14_process_steps(spark, d):
    o = read(spark, d, "orders")
    steps = o.select(F.col("o_custkey").alias("process_id"), F.col("o_orderkey").alias("action_id"), F.col("o_orderkey").alias("ord"))
    return project.process_steps(steps, o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"))).select("process_id", "action_id", "step_id")


@query("SELECT process_id, from_action, to_action FROM (SELECT o_custkey AS process_id, o_orderkey AS from_action, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS to_action FROM orders) WHERE to_action IS NOT NULL")
def x31_process_edges(spark, d):
    return project.process_edges(read(spark, d, "orders").select(F.col("o_custkey").alias("process_id"), F.col("o_orderkey").alias("action_id"), F.col("o_orderkey").alias("ord")))


@query("SELECT DISTINCT l_orderkey, arg_min(l_partkey, l_linenumber) AS l_partkey FROM lineitem GROUP BY l_orderkey")
def k3_first_wins(spark, d):
    # Lines of one number: the first in the table's files, as in the SQL read by one thread. Lines without a number or a part lose to all others and name no part, as in arg_min.
    part = F.when(F.col("l_linenumber").isNotNull(), F.col("l_partkey")).alias("l_partkey")
    rows = read(spark, d, "lineitem").select("l_orderkey", part, "l_linenumber", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return J.first_by(rows, ["l_orderkey"], [F.col("l_partkey").isNull(), *map(F.col, ("l_linenumber", "file", "at"))]).select("l_orderkey", "l_partkey")


@query("SELECT o_custkey FROM (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS a, list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderkey % 2 = 0))) AS b FROM orders GROUP BY 1) WHERE a IS NOT DISTINCT FROM b")
def u4_set_equality(spark, d):
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("a"), F.collect_list(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))).alias("b"))
    return o.where(V.same_set("a", "b")).select("o_custkey")
