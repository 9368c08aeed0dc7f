"""Queries of the operators on model tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenir.operators import matching
from provenir.operators import model as O
from provenir.operators import segment as D
from provenir.operators.suggest import closed_vocabulary
from provenir.plans.catalogue import CITED, PARTS, query, read, scored_parts


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN p_name ELSE p_name END AS en, CASE WHEN p_size % 3 = 1 THEN p_name ELSE p_type END AS zh FROM part")
def f15_bilingual(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.col("p_name")).otherwise(" ").alias("e"), F.when(F.col("p_size") % 3 != 1, F.col("p_type")).alias("z"))
    return p.select("p_partkey", O.bilingual("e", "z").alias("b")).select("p_partkey", "b.en", "b.zh")


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(concat_ws(' ', source, text), '(?i)(system|platform|gateway|portal|\bapi\b|\berp\b|\bcrm\b|\brms\b|engine|middleware|database|系统|平台|网关|中台|引擎)') THEN 'system' ELSE 'data' END AS class FROM documents""")
def f16_object_class(spark, d):
    return read(spark, d, "documents").select("doc_id", O.object_class("source", "text").alias("class"))


@query("SELECT n_nationkey, 'IN p_a numeric(10,2)|OUT p_' || n_nationkey || ' text|IN c int' AS args FROM nation")
def f23_routine_arguments(spark, d):
    sig = F.concat(F.lit("p_a numeric(10,2) DEFAULT 1, OUT p_"), F.col("n_nationkey").cast("string"), F.lit(" text, c int = 4"))
    args = O.routine_arguments(sig)
    return read(spark, d, "nation").select("n_nationkey", F.array_join(F.transform(args, lambda a: F.concat_ws(" ", a["mode"], a["name"], a["type"])), "|").alias("args"))


TRIGGERS = [
    ("CREATE TRIGGER t AFTER INSERT OR DELETE ON r FOR EACH ROW EXECUTE FUNCTION update_it()", "AFTER", "INSERT,DELETE"),
    ("create trigger t instead   of insert on v for each row execute function f()", "INSTEAD OF", "INSERT"),
    ("CREATE TRIGGER t BEFORE UPDATE OF a, b ON r", "BEFORE", "UPDATE"),
    ("CREATE TRIGGER t AFTER TRUNCATE ON r", "AFTER", ""),
    ("TRIGGER t DELETE OR UPDATE", "AFTER", "UPDATE,DELETE"),
]


@query("SELECT r_regionkey, t.timing, t.events FROM region JOIN (VALUES " + ", ".join(f"({k}, '{t}', '{e}')" for k, (_, t, e) in enumerate(TRIGGERS)) + ") AS t(k, timing, events) ON t.k = r_regionkey % 5")
def f22_trigger_parts(spark, d):
    texts = F.array(*[F.lit(t) for t, _, _ in TRIGGERS])
    timing, events = O.trigger_parts(F.get(texts, (F.col("r_regionkey") % 5).cast("int")))
    return read(spark, d, "region").select("r_regionkey", timing.alias("timing"), F.array_join(events, ",").alias("events"))


@query("""SELECT c_custkey, replace(t.target, '#', CAST(c_custkey AS VARCHAR)) AS target, 'owns' AS verb FROM customer JOIN (VALUES (0, 'A'), (0, 'B #'), (1, 'A -> B'), (2, 'C #'), (2, 'D')) AS t(k, target) ON t.k = c_custkey % 5""")
def d12_relations(spark, d):
    n = F.col("c_custkey").cast("string")
    s = F.get(F.array(F.concat(F.lit("owns → A (x), B "), n, F.lit(" (both)")), F.lit(" owns → A -> B"), F.concat(F.lit("owns -> C "), n, F.lit(", (none), D")), F.lit("owns A, B"), F.lit(" → A")), (F.col("c_custkey") % 5).cast("int"))
    return read(spark, d, "customer").select("c_custkey", F.explode(O.relation(s)).alias("r")).select("c_custkey", "r.target", "r.verb")


@query("SELECT 'customer' AS layer, count(*) AS n FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders")
def a2_layer_counts(spark, d):
    return O.layer_counts({t: read(spark, d, t) for t in ("customer", "part", "orders")})


@query("SELECT coalesce(p_brand, '*') AS kind, count(*) AS total, count(CASE WHEN p_size > 25 THEN 1 END) AS matched FROM part GROUP BY ROLLUP (p_brand)")
def a3_term_stats(spark, d):
    return O.term_stats(read(spark, d, "part").select(F.col("p_brand").alias("kind"), F.when(F.col("p_size") > 25, F.col("p_partkey")).alias("matched_id")))


@query("SELECT l_orderkey, count(*) AS total_refs, count(*) FILTER (l_partkey % 7 <> 0) AS resolved_refs FROM lineitem GROUP BY 1")
def a10_reference_counts(spark, d):
    return O.reference_counts(read(spark, d, "lineitem"), read(spark, d, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id")), "l_orderkey", "l_partkey")


@query("""SELECT l_partkey, count(*) AS sources, count(*) FILTER (v) AS verified, count(DISTINCT (l_suppkey, l_returnflag)) AS witnesses, max(c) AS prior FROM
  (SELECT l_partkey, l_suppkey, l_returnflag, l_linenumber, bool_or(l_linestatus = 'F') AS v, max(l_discount) AS c FROM lineitem GROUP BY ALL) GROUP BY 1""".replace("SELECT l_partkey, l_suppkey, l_returnflag, l_linenumber, bool_or(l_linestatus = 'F') AS v, max(l_discount) AS c FROM lineitem GROUP BY ALL", "SELECT l_partkey, l_suppkey, l_returnflag, l_linenumber, bool_or(l_linestatus = 'F') AS v, max(l_discount) AS c FROM lineitem GROUP BY 1, 2, 3, 4"))
def a11_merge_witnesses(spark, d):
    rows = read(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("document_id"), F.col("l_returnflag").alias("snippet"), F.col("l_linenumber").alias("char_start"), (F.col("l_linestatus") == "F").alias("verified"), F.col("l_discount").alias("confidence"))
    return O.merge_witnesses(rows, "l_partkey")


@query("""SELECT c_mktsegment AS role, 'action' AS kind, CAST(c_custkey AS VARCHAR) AS id FROM customer UNION ALL SELECT DISTINCT c_mktsegment, 'process', o_orderpriority FROM customer JOIN orders ON o_custkey = c_custkey""")
def a15_roles(spark, d):
    actions = read(spark, d, "customer").select(F.col("c_custkey").alias("action_id"), F.col("c_mktsegment").alias("role"))
    return O.roles(actions, read(spark, d, "orders").select(F.col("o_custkey").alias("action_id"), F.col("o_orderpriority").alias("process_id")))


@query("""WITH n AS (SELECT 'r' || r_regionkey AS id, r_name AS name, CASE WHEN r_regionkey = 2 THEN 'given' END AS prose FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, ' ' FROM nation),
  e AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, n_nationkey AS ord, CASE WHEN n_nationkey % 2 = 0 THEN 'n_regionkey' ELSE 'lies in' END AS via FROM nation WHERE n_nationkey % 4 <> 0 UNION ALL SELECT 'n' || n_nationkey, 'nowhere', 100, 'x' FROM nation),
  l AS (SELECT source, target, ord, s.name || ' references ' || t.name AS line, via FROM e JOIN n AS s ON s.id = source JOIN n AS t ON t.id = target),
  b AS (SELECT source AS id, ord, line || ' via ' || via || '.' AS line FROM l UNION ALL SELECT target, ord, line || '.' FROM l),
  g AS (SELECT id, string_agg(line, ' ' ORDER BY ord) AS text FROM (SELECT id, line, min(ord) AS ord FROM b GROUP BY ALL) GROUP BY id)
  SELECT n.id, coalesce(nullif(trim(prose), ''), text, name || ' has no foreign-key relationships to other tables.') AS prose FROM n LEFT JOIN g USING (id)""")
def a22_relationship_prose(spark, d):
    r, n = read(spark, d, "region"), read(spark, d, "nation")
    rid = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    given = F.when(F.col("r_regionkey") == 2, "given")
    names = r.select(rid("r", "r_regionkey").alias("id"), F.col("r_name").alias("name"), given.alias("prose")).unionByName(n.select(rid("n", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(" ").alias("prose")))
    via = F.when(F.col("n_nationkey") % 2 == 0, "n_regionkey")
    edges = n.where("n_nationkey % 4 <> 0").select(rid("n", "n_nationkey").alias("source"), rid("r", "n_regionkey").alias("target"), via.alias("via"), F.lit("lies in").alias("name"), F.col("n_nationkey").alias("ord"))
    lost = n.select(rid("n", "n_nationkey").alias("source"), F.lit("nowhere").alias("target"), F.lit("x").alias("via"), F.lit("y").alias("name"), F.lit(100).alias("ord"))
    return O.relationship_prose(edges.unionByName(lost), names)


@query(CITED + " SELECT p_partkey AS id FROM x WHERE p_size = 3 OR score < 0.2 ORDER BY round(score, 4), p_partkey LIMIT 40")
def w3_weak_nodes(spark, d):
    nodes = scored_parts(spark, d).select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") == 3, "inferred").otherwise("extracted").alias("provenance"), F.col("score"))
    close = nodes.where((F.col("provenance") == "inferred") | (F.col("score") < 0.2)).withColumn("confidence", F.round("score", 4))
    return O.weak_nodes(close, below=2.0).select("id")


@query("SELECT o_orderstatus AS was, CASE WHEN o_orderstatus = 'F' THEN 'rejected' ELSE 'accepted' END AS review, count(*) AS n FROM orders GROUP BY ALL")
def w10_accept_all(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderstatus").alias("was"), F.when(F.col("o_orderstatus") == "F", "rejected").when(F.col("o_orderstatus") == "O", "edited").alias("review"))
    return O.accept_all(o).groupBy("was", "review").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN lower(event_type) IN ('click', 'purchase') THEN lower(event_type) ELSE 'other' END AS kind FROM events")
def w11_closed_vocabulary(spark, d):
    return read(spark, d, "events").select("event_id", O.closed(F.concat(F.lit(" "), F.upper("event_type")), ["click", "purchase"], "other").alias("kind"))


@query("SELECT l_partkey AS source, l_suppkey AS target FROM lineitem WHERE l_partkey <> l_suppkey AND l_partkey % 3 = 0 AND l_suppkey % 3 = 0 AND l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey IN (SELECT p_partkey FROM part)")
def w8_live_edges(spark, d):
    edges = read(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))
    return O.live_edges(edges, read(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id")))


@query("SELECT c_custkey AS id, c_mktsegment AS role, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE WHEN c_custkey % 4 = 0 THEN 1 WHEN c_custkey % 4 = 1 THEN 2 WHEN c_custkey % 4 = 2 THEN 3 ELSE 99 END, c_custkey) AS INTEGER) AS rank FROM customer")
def l7_rules_by_severity(spark, d):
    k = F.col("c_custkey") % 4
    return O.by_severity(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("role"), F.when(k == 0, "block").when(k == 1, "warn").when(k == 2, "info").otherwise("odd").alias("severity"))).select("id", "role", "rank")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 5 OR n_nationkey + 3 <= 12 THEN 'complete' WHEN n_nationkey <= 12 THEN 'running' ELSE 'pending' END AS status FROM nation")
def k11_phase_status(spark, d):
    return read(spark, d, "nation").select("n_nationkey", O.phase_status("n_nationkey", F.col("n_nationkey") + 3, F.lit(12), F.col("n_nationkey") % 6 == 5, 29).alias("status"))


@query("""SELECT DISTINCT o_orderpriority AS role, rule_id FROM (SELECT o_orderpriority, l_suppkey AS rule_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1
  UNION ALL SELECT o_orderpriority, p_size + 100000 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)""")
def j21_role_rules(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("role"), F.col("o_orderkey").alias("action_id"))
    line = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("action_id"), F.col("l_partkey").alias("object_id"), F.col("l_suppkey").alias("rule_id"), "l_linenumber")
    applies = read(spark, d, "part").select(F.col("p_partkey").alias("object_id"), (F.col("p_size") + 100000).cast("bigint").alias("rule_id"))
    return O.role_rules(o, line.where("l_linenumber = 1").select("action_id", "rule_id"), line.select("action_id", "object_id"), applies)


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(b.name, a.name) AS name, a.size FROM (SELECT p_partkey AS k, p_name AS name, p_size AS size FROM part WHERE p_partkey % 2 = 0) AS a FULL JOIN (SELECT p_partkey AS k, 'edited' AS name FROM part WHERE p_partkey % 3 = 0) AS b ON a.k = b.k")
def j23_edit_back(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return O.edit_back(p.where("k % 2 = 0"), p.where("k % 3 = 0").select("k", F.lit("edited").alias("name")), "k", ["name"])


@query("SELECT DISTINCT l_partkey AS source, 'from' AS verb, l_suppkey AS target FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM lineitem AS x WHERE x.l_linenumber = 1 AND x.l_partkey = lineitem.l_partkey AND x.l_suppkey = lineitem.l_suppkey)")
def u8_new_links(spark, d):
    line = read(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.lit("from").alias("verb"), F.col("l_suppkey").alias("target"), "l_linenumber")
    return O.new_links(line.drop("l_linenumber"), line.where("l_linenumber = 1"))


@query("""SELECT l_partkey AS event_id, min(l_orderkey) AS first, CAST(count(DISTINCT l_orderkey) FILTER (l_linenumber = 1) AS INTEGER) AS produced_by, CAST(count(DISTINCT l_orderkey) FILTER (l_linenumber > 1) AS INTEGER) AS consumed_by FROM lineitem GROUP BY 1""")
def g10_event_skeleton(spark, d):
    line = read(spark, d, "lineitem").select(F.col("l_partkey").alias("event_id"), F.col("l_orderkey").alias("action_id"), F.col("l_orderkey").alias("ord"), "l_linenumber")
    out = O.event_skeleton(line.where("l_linenumber = 1"), line.where("l_linenumber > 1"))
    return out.select("event_id", "first", F.size("produced_by").alias("produced_by"), F.size("consumed_by").alias("consumed_by"))


@query("SELECT DISTINCT o_custkey AS process_id, l_partkey AS object_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def x8_infer_objects(spark, d):
    steps = read(spark, d, "orders").select(F.col("o_custkey").alias("process_id"), F.col("o_orderkey").alias("action_id"))
    return O.infer_objects(steps, read(spark, d, "lineitem").select(F.col("l_orderkey").alias("action_id"), F.col("l_partkey").alias("object_id")))


@query("SELECT * FROM (VALUES ('c_nationkey', 'obj-nation'), ('customer_id', 'obj-customer'), ('thing_id', NULL), ('name', NULL)) AS v(name, ref)")
def x30_infer_foreign_keys(spark, d):
    columns = spark.createDataFrame([("c_nationkey",), ("customer_id",), ("thing_id",), ("name",)], "name string").withColumn("raw", F.col("name")).withColumn("name", F.regexp_replace("name", "^c_", ""))
    objects = spark.createDataFrame([("Nation", "obj-nation"), ("Customer", "obj-customer")], "name string, id string")
    return O.infer_foreign_keys(columns, objects).select(F.col("raw").alias("name"), F.col("references").alias("ref"))


@query(f"""WITH s AS (SELECT doc_id, {PARTS} AS s FROM documents) SELECT doc_id AS ref_id, CASE WHEN doc_id % 2 = 0 THEN 'given' ELSE array_to_string(list_filter([s[2], s[1]], lambda x: x IS NOT NULL), ' ') END AS snippet FROM s WHERE doc_id % 2 = 0 OR len(s) > 0""")
def x1_joined_quotes(spark, d):
    s = D.sentences(read(spark, d, "documents"))
    refs = read(spark, d, "documents").select(F.col("doc_id").alias("ref_id"), F.col("doc_id").alias("document_id"), F.array(F.lit(1), F.lit(0)).alias("sentence_refs"), F.when(F.col("doc_id") % 2 == 0, "given").otherwise("").alias("snippet"))
    return O.joined_quotes(refs, s).where("snippet IS NOT NULL").select("ref_id", "snippet")


@query("""SELECT 'gap:cov-r2-' || doc_id AS id, 'rule' AS layer, CASE WHEN lang = 'en' THEN 'block' ELSE 'warn' END AS severity,
  md5('Source sentence ' || doc_id || ' is not represented: "' || text || '"' || coalesce(' — missing: ' || nullif(source, ''), '')) AS en, md5('源文第 ' || doc_id || ' 句未被本体覆盖："' || text || '"' || coalesce(' — 缺失：' || nullif(source, ''), '')) AS zh FROM documents""")
def c4_gaps(spark, d):
    f = read(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.when(F.col("lang") == "en", "uncovered").otherwise("partial").alias("status"), "text", F.col("source").alias("missing"))
    return O.gaps(f, "rule", 2).select("id", "layer", "severity", F.md5("en").alias("en"), F.md5("zh").alias("zh"))


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'object | ' || p_name || ' / ' || p_type || ' | attrs: ' || p_brand || ',' || p_type WHEN 1 THEN 'relationship | ' || p_name || ' | ' || p_brand || ' -> ' || p_type
  WHEN 2 THEN 'rule | ' || p_brand || ' | ' || repeat(p_name || '; ', 20) WHEN 3 THEN 'action | ' || p_name || ' | ' || p_type WHEN 4 THEN 'event | ' || p_name || ' | ' || p_type ELSE 'process | ' || p_name || ' | steps: ' || p_size END AS t FROM part)
  SELECT p_partkey AS id, CASE WHEN length(p_partkey || ' | ' || t) > 240 THEN left(p_partkey || ' | ' || t, 239) || '…' ELSE p_partkey || ' | ' || t END AS line FROM n""")
def x12_digest(spark, d):
    kinds = F.array(*map(F.lit, ("object", "relationship", "rule", "action", "event", "process")))
    n = read(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.get(kinds, (F.col("p_partkey") % 6).cast("int")).alias("kind"), F.col("p_name").alias("name"), F.col("p_type").alias("name_zh"), F.array("p_brand", "p_type").alias("attributes"),
        F.col("p_brand").alias("source"), F.col("p_type").alias("target"), F.col("p_brand").alias("title"), F.repeat(F.concat("p_name", F.lit("; ")), F.lit(20)).alias("statement"), F.col("p_type").alias("description"), F.col("p_size").alias("steps"),
    )
    return O.digest(n).select(F.col("id").cast("bigint").alias("id"), "line")


#: Numbers of nodes in their kind, from 0, and the kinds' sizes and places in order.
DRAWN = """WITH b AS (SELECT p_partkey AS id, ['object', 'rule', 'action', 'event', 'process'][CAST(CASE WHEN p_partkey = 7 THEN 4 WHEN p_partkey % 3 = 2 THEN 4 ELSE p_partkey % 3 END AS BIGINT) + 1] AS kind FROM part),
  k AS (SELECT *, list_position(['object', 'rule', 'action', 'event', 'process'], kind) - 1 AS tier, row_number() OVER (PARTITION BY kind ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM b),
  s AS (SELECT *, CASE WHEN n = 1 THEN 0.5 ELSE i / (n - 1) END AS t, dense_rank() OVER (ORDER BY tier) - 1 AS nth FROM k), p AS (SELECT count(DISTINCT kind) AS kinds FROM b)"""


def drawn(spark, d, mode):
    k = F.when(F.col("p_partkey") == 7, 4).when(F.col("p_partkey") % 3 == 2, 4).otherwise(F.col("p_partkey") % 3)
    n = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.get(F.array(*map(F.lit, O.KINDS)), k.cast("int")).alias("kind"), F.col("p_partkey").alias("ord"))
    return O.layout(n, mode).select("id", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"))


@query(DRAWN + """ SELECT id, round(CASE WHEN tier = 0 THEN 550 + 190 * cos(2 * pi() * t) ELSE 550 + 320 * cos(-pi() / 2 + (tier - 1) * pi() / 2 + 0.04 * pi() + 0.42 * pi() * t) END, 3) + 0.0 AS x,
  round(CASE WHEN tier = 0 THEN 350 + 190 * sin(2 * pi() * t) ELSE 350 + 320 * sin(-pi() / 2 + (tier - 1) * pi() / 2 + 0.04 * pi() + 0.42 * pi() * t) END, 3) + 0.0 AS y FROM s""")
def g9_radial_layout(spark, d):
    return drawn(spark, d, "radial")


@query(DRAWN + " SELECT id, round(120 + (tier + 0.5) * 172.0, 3) + 0.0 AS x, round(90 + (i + 0.5) * (520.0 / n), 3) + 0.0 AS y FROM s")
def g9_hierarchical_layout(spark, d):
    return drawn(spark, d, "hierarchical")


@query(DRAWN + """ SELECT id, round(550 + 230 * cos(-pi() / 2 + 2 * pi() * nth / kinds) + least(150, 50 + n * 8) * cos(2 * pi() * t), 3) + 0.0 AS x,
  round(350 + 170 * sin(-pi() / 2 + 2 * pi() * nth / kinds) + least(150, 50 + n * 8) * sin(2 * pi() * t), 3) + 0.0 AS y FROM s, p""")
def g9_clustered_layout(spark, d):
    return drawn(spark, d, "clustered")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END) > (CASE o_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END)")
def v11_forward_references(spark, d):
    layer = lambda c: F.element_at(F.array(*map(F.lit, ("objects", "rules", "actions"))), (F.col(c) % 3 + 1).cast("int"))
    refs = read(spark, d, "orders").select("o_orderkey", "o_custkey", layer("o_custkey").alias("from_layer"), layer("o_orderkey").alias("to_layer"))
    return O.forward_references(refs, ["objects", "rules", "actions"]).select("o_orderkey", "o_custkey")


@query("""SELECT event_id, event_type || 's' AS value, event_type AS fix FROM events""")
def v15_suggestions(spark, d):
    e = read(spark, d, "events")
    words = closed_vocabulary(e, "event_type")
    rows = e.select("event_id", F.concat("event_type", F.lit("s")).alias("value"))
    return O.suggest(rows, words, "value").select("event_id", "value", "fix")


@query("""SELECT lower(p_brand) || '::' || p_size AS key, arg_min(p_type, p_partkey) AS hint, count(*) AS members FROM part GROUP BY 1""")
def a13_term_merge(spark, d):
    p = read(spark, d, "part").withColumnRenamed("p_type", "hint")
    return matching.merge_by_key(p, F.concat_ws("::", F.lower("p_brand"), F.col("p_size").cast("string")), "p_partkey", ["hint"], [], []).select("key", "hint", "members")
