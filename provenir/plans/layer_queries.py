"""Queries of layer documents, manifests and coercions."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenir.operators import layers as L
from provenir.operators import model as O
from provenir.plans.catalogue import query, read, star_triples, TRIPLES


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand END AS name, p_type FROM part WHERE p_partkey % 2 = 0")
def p16_carry_forward(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    new = p.where("p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("name"), "p_type")
    return L.carry(p.select("p_partkey", F.col("p_brand").alias("name")), new, "p_partkey", ["name"])


@query("SELECT o_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (o_orderstatus = 'P'), CAST(min(o_orderkey) AS VARCHAR)) AS payload FROM orders GROUP BY 1")
def p10_payload_fallback(spark, d):
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey")))).alias("a"), F.array(F.min("o_orderkey")).alias("b"))
    return o.select("o_custkey", F.array_join(L.fallback("a", "b").cast("array<string>"), ",").alias("payload"))


@query("SELECT l_orderkey AS process_id, CAST(count(*) FILTER (l_partkey % 7 <> 0) AS INTEGER) AS nodes, arg_min(p_name, (l_linenumber, l_partkey)) AS first_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_partkey % 7 <> 0 GROUP BY 1")
def p15_manifest(spark, d):
    steps = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("process_id"), F.col("l_partkey").alias("action_id"), F.col("l_linenumber").alias("ord"))
    nodes, _ = L.manifest(steps, read(spark, d, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    return nodes.select("process_id", F.size("nodes").alias("nodes"), F.get("nodes", F.lit(0)).getField("name").alias("first_name"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS from_id, CAST(l_partkey AS VARCHAR) AS missing_id, count(*) AS n FROM lineitem WHERE l_partkey % 7 = 0 GROUP BY ALL")
def j18_manifest_warnings(spark, d):
    steps = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("process_id"), F.col("l_partkey").alias("action_id"), F.col("l_linenumber").alias("ord"))
    _, lost = L.manifest(steps, read(spark, d, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    return lost.groupBy("from_id", "missing_id").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT event_id, user_id, event_id % 11 AS m FROM events), x AS (SELECT event_id, CASE WHEN m = 1 THEN 'syntax' WHEN m = 2 THEN 'not_object' WHEN m = 3 THEN 'missing_id' END AS k, user_id FROM r),
  y AS (SELECT event_id, k, row_number() OVER (PARTITION BY k IS NULL, user_id ORDER BY event_id) AS f FROM x) SELECT event_id, coalesce(k, 'duplicate_id') AS kind FROM y WHERE k IS NOT NULL OR f > 1""")
def v14_layer_issues(spark, d):
    m = F.col("event_id") % 11
    text = F.when(m == 1, F.lit("{oops")).when(m == 2, F.lit("[1]")).when(m == 3, F.lit('{"x": 1}')).otherwise(F.format_string('{"name": "u%d"}', "user_id"))
    return L.layer_issues(read(spark, d, "events").select("event_id", text.alias("t")), "event_id", "t")


@query("SELECT p_partkey, 'missing:name' AS problem FROM part WHERE p_size % 5 = 0 UNION ALL SELECT p_partkey, 'value:kind' FROM part WHERE p_size > 45")
def v12_spec_shape(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 > 0, F.col("p_name")).otherwise(" ").alias("name"), F.when(F.col("p_size") > 45, "odd").otherwise("data").alias("kind"))
    return L.shape_issues(p, "p_partkey", ["name", "kind"], {"kind": ["data", "system"]})


@query("""SELECT c_mktsegment, c_custkey, CAST(k AS INTEGER) AS rank, greatest(n - 40, 0) AS left_out FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE k <= 40""")
def l5_gaps_per_stage(spark, d):
    return L.per_stage(read(spark, d, "customer"), "c_mktsegment", [F.desc("c_acctbal"), F.col("c_custkey")]).select("c_mktsegment", "c_custkey", "rank", "left_out")


@query("WITH " + TRIPLES + """, e AS (SELECT s AS g, s AS node, o AS ord, 0 AS w FROM t WHERE p = 'emits' UNION ALL SELECT s, o, o, 1 FROM t WHERE p = 'emits'), f AS (SELECT g, node, min((ord, w)) AS k FROM e GROUP BY ALL)
  SELECT g AS id, string_agg(node, ',' ORDER BY k, node) AS nodes FROM f GROUP BY g""")
def g5_endpoints(spark, d):
    t = star_triples(spark, d).where("p = 'emits'").withColumn("id", F.col("s")).withColumn("ord", F.col("o"))
    return L.endpoints(t, "id", "ord").select("id", F.array_join("nodes", ",").alias("nodes"))


@query("SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY first, l_suppkey) AS known FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first FROM lineitem WHERE l_suppkey <= 50 GROUP BY ALL) GROUP BY 1")
def x10_known_ids(spark, d):
    a = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("v"))
    k = a.select("l_orderkey", L.known_only("v", F.sequence(F.lit(0).cast("bigint"), F.lit(50).cast("bigint"))).alias("k"))
    return k.where(F.size("k") > 0).select("l_orderkey", F.array_join(F.col("k").cast("array<string>"), ",").alias("known"))


@query("SELECT n_nationkey, 'obj-' || n_nationkey AS entity FROM nation")
def x27_related_entity(spark, d):
    return read(spark, d, "nation").select("n_nationkey", L.related_entity(F.format_string("%s (old) (obj-%d) ", "n_name", "n_nationkey")).alias("entity"))


@query("SELECT source, left(string_agg(text, chr(10) || chr(10) ORDER BY doc_id), 12000) AS excerpt FROM documents GROUP BY 1")
def x15_excerpts(spark, d):
    return L.excerpt(read(spark, d, "documents"), "source", "doc_id", "text", 12000)


@query("SELECT event_id, '[' || CASE WHEN event_id % 2 = 0 THEN props ELSE replace(props, ': ', ':') END || ']' AS items FROM events")
def x34_unwrap_layer(spark, d):
    whole = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), F.col("props"), F.lit("]"))).otherwise(F.concat(F.lit('{"metadata": {"version": {"major": [1]}}, "rules": ['), F.col("props"), F.lit("]}")))
    return read(spark, d, "events").select("event_id", L.unwrap(whole).alias("items"))


@query("SELECT p_partkey, CASE WHEN k = 1 THEN p_type ELSE p_type || k END AS unique_name, k > 1 AS warned FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM part)")
def x23_unique_names(spark, d):
    return L.unique_names(read(spark, d, "part").select("p_partkey", "p_type"), "p_type", "p_partkey").select("p_partkey", "unique_name", "warned")


@query("SELECT split_part(url, '?', 1) AS url, min(page_id) AS page_id FROM pages GROUP BY 1")
def s16_unique_urls(spark, d):
    return read(spark, d, "pages").groupBy(F.split_part("url", F.lit("?"), F.lit(1)).alias("url")).agg(F.min("page_id").alias("page_id"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 2 = 0 THEN 'warn' END, 'block') AS severity FROM orders")
def x26_live_severity(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", F.coalesce(F.when(k % 3 == 0, F.col("o_orderpriority")), F.when(k % 2 == 0, "warn"), F.lit("block")).alias("severity"))


@query("SELECT DISTINCT id FROM (SELECT 'p' || p_partkey AS id FROM part UNION ALL SELECT 'c' || c_custkey FROM customer)")
def u7_taken_ids(spark, d):
    ids = lambda t, p, c: read(spark, d, t).select(F.concat(F.lit(p), F.col(c).cast("string")).alias("id"))
    return ids("part", "p", "p_partkey").unionByName(ids("customer", "c", "c_custkey")).distinct()


@query("""SELECT n_nationkey, n_nationkey || '. nation:' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN ' ("' || n_name || '")' ELSE '' END || ' --references--> ' || CASE WHEN n_nationkey % 3 = 0 THEN '"' || r_name || '" [lit]' ELSE 'region:' || r_regionkey || ' ("' || r_name || '")' END AS line FROM nation JOIN region ON r_regionkey = n_regionkey""")
def f31_triple_text(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    s, r = F.concat(F.lit("nation:"), "n_nationkey"), F.concat(F.lit("region:"), "r_regionkey")
    literal = F.col("n_nationkey") % 3 == 0
    label = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).when(F.col("n_nationkey") % 5 == 0, s)
    return n.select("n_nationkey", O.triple_text("n_nationkey", s, F.lit("references"), F.when(literal, F.col("r_name")).otherwise(r), literal, label, "r_name").alias("line"))


@query("""SELECT o_custkey, md5(coalesce(string_agg(CASE WHEN o_orderstatus <> 'P' THEN 'Hop ' || o_orderkey || ' (' || length(o_orderpriority) || ' triples): ' || o_orderpriority END, chr(10) ORDER BY o_orderkey), '(none yet)')) AS hops FROM orders GROUP BY 1""")
def f31_hops_text(spark, d):
    step = F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey"))
    hops = read(spark, d, "orders").select("o_custkey", step.alias("step"), F.length("o_orderpriority").alias("triples"), F.col("o_orderpriority").alias("inference"))
    return O.hops_text(hops, "o_custkey").select("o_custkey", F.md5("hops").alias("hops"))
