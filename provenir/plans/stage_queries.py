"""Queries of stages, coercions of replies, diagnostics and published forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenir.functions import text as T
from provenir.operators import model as O
from provenir.operators import project as P
from provenir.operators import stages as S
from provenir.plans.catalogue import EXACT, query, read


def pick(options: list, key: str):
    """One of the options by a row's number."""
    return F.get(F.array(*[o if not isinstance(o, (str, type(None))) else F.lit(o) for o in options]), (F.col(key) % len(options)).cast("int"))


def values(rows: list[tuple], names: str) -> str:
    sql = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(sql, r)) + ')' for r in rows)}) AS v({names})"


# Scalars --------------------------------------------------------------------------------------------

@query(r"""SELECT p_partkey, CASE WHEN s = '' THEN 'x' ELSE s END AS slug FROM (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower('--' || p_name || '..' || p_brand || '.'), '[^a-z0-9.-]+', '-', 'g'), '-{2,}', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS s FROM part)""")
def f4_local_slug(spark, d):
    return read(spark, d, "part").select("p_partkey", T.local_slug(F.concat(F.lit("--"), "p_name", F.lit(".."), "p_brand", F.lit("."))).alias("slug"))


@query(r"""SELECT page_id, left(regexp_replace(regexp_replace(lower(url || ' ete'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 64) AS slug FROM pages""")
def f4_file_slug(spark, d):
    return read(spark, d, "pages").select("page_id", T.file_slug(F.concat("url", F.lit(" ete.PDF"))).alias("slug"))


#: A model's words for types and what they are published as.
WORDS = [("String", "String"), (" List<String> ", "List<String>"), ("list<int>", "List<String>"), ("INT", "Integer"), ("money", "Float"), ("Bool", "Boolean"), ("date", "Date"), ("DateTime", "Timestamp"), ("enum", "List<String>"), ("uuid", "String"), ("", "String")]


@query(f"SELECT p_partkey, v.t AS type FROM part JOIN {values([(k, t) for k, (_, t) in enumerate(WORDS)], 'k, t')} ON v.k = p_partkey % {len(WORDS)}")
def f6_model_type(spark, d):
    return read(spark, d, "part").select("p_partkey", T.model_type(pick([w for w, _ in WORDS], "p_partkey")).alias("type"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'rule:customer-' || c_custkey WHEN c_custkey % 3 = 1 THEN 'rule:seg-' || lower(c_mktsegment) || CASE WHEN k = 1 THEN '' ELSE '-' || k END ELSE 'rule:c.' || c_custkey END AS fixed
  FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_custkey % 3, c_mktsegment ORDER BY c_custkey) AS k FROM customer)""")
def f26_coerce_id(spark, d):
    n = F.col("c_custkey")
    raw = F.when(n % 3 == 0, F.concat(F.lit("objectType:Customer "), n)).when(n % 3 == 1, F.concat(F.lit("event:Seg "), "c_mktsegment")).otherwise(F.concat(F.lit("rule:c."), n))
    return P.coerce_id(read(spark, d, "customer").select("c_custkey", raw.alias("id")), "id", "c_custkey", "rule:").select("c_custkey", "fixed")


@query("""WITH RECURSIVE c AS (SELECT p_partkey, p_brand AS s FROM part), h AS (SELECT p_partkey, s, 0 AS i, CAST(5381 AS BIGINT) AS h FROM c UNION ALL
  SELECT p_partkey, s, i + 1, CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END FROM (SELECT p_partkey, s, i, xor(h * 33, ascii(s[i + 1])) & 4294967295 AS x FROM h WHERE i < length(s)))
  SELECT p_partkey, abs(h) AS h FROM h WHERE i = length(s)""")
def f30_spread_hash(spark, d):
    return read(spark, d, "part").select("p_partkey", T.spread_hash("p_brand").alias("h"))


@query(r"""SELECT p_partkey, lower(replace(p_name, ' ', '_')) || '_order_line_x' AS tool, 'a b \| ' || p_name AS cell, p_name || CASE p_partkey % 3 WHEN 0 THEN ' (s' || p_size || ', p.' || p_size || '):' WHEN 1 THEN ' (p.' || p_size || ') [UNVERIFIED QUOTE]: "said"' ELSE ': "said"' END AS cite FROM part""")
def f32_renderers(spark, d):
    k, p = F.col("p_partkey") % 3, F.col("p_size")
    cite = S.citation("p_name", F.when(k == 0, F.concat(F.lit("s"), p)).otherwise(""), F.when(k < 2, p).otherwise(0), F.when(k == 1, False), F.when(k > 0, " said "))
    return read(spark, d, "part").select("p_partkey", T.tool_name(F.concat(F.lit(" "), "p_name", F.lit(" orderLine--X "))).alias("tool"), T.table_cell(F.concat(F.lit(" a\r\nb | "), "p_name")).alias("cell"), cite.alias("cite"))


#: Formal texts and the kinds of rules they make.
FORMAL = [("x := y", "state_transition"), ("BLOCK if a", "authorization"), ("∃ x", "authorization"), ("a ≤ 3", "temporal"), ("within 30D", "temporal"), ("y = σ(x)", "derivation"), ("a > b", "validation"), (None, "validation")]


@query(f"SELECT o_orderkey, v.t AS kind, CASE WHEN o_orderkey % 4 = 0 THEN 'block' WHEN o_orderkey % 4 = 1 THEN 'warn' ELSE 'info' END AS severity FROM orders JOIN {values([(k, t) for k, (_, t) in enumerate(FORMAL)], 'k, t')} ON v.k = o_orderkey % {len(FORMAL)}")
def f18_rule_kind(spark, d):
    c = F.when(F.col("o_orderkey") % 4 == 0, 0.95).when(F.col("o_orderkey") % 4 == 1, 0.88).otherwise(0.8799)
    return read(spark, d, "orders").select("o_orderkey", O.rule_kind(pick([f for f, _ in FORMAL], "o_orderkey")).alias("kind"), O.rule_severity(c).alias("severity"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'enum' WHEN 1 THEN 'reference' WHEN 2 THEN 'decimal' WHEN 3 THEN 'reference' ELSE 'string' END AS type, CASE WHEN c_custkey % 5 = 0 THEN 'Open,' || c_custkey END AS enum_values, CASE c_custkey % 5 WHEN 1 THEN 'Part ' || c_custkey WHEN 3 THEN n_name END AS target FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def f9_attribute_types(spark, d):
    n = F.col("c_custkey").cast("string")
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = c.select("c_custkey", pick([F.concat(F.lit("enum < Open| |"), n, F.lit(" >")), F.concat(F.lit("Reference<Part "), n, F.lit(">")), "Number", F.col("n_name"), "odd thing"], "c_custkey").alias("raw"))
    out = O.attribute_types(rows, F.col("raw"), read(spark, d, "nation").select(F.col("n_name").alias("name")))
    return out.select("c_custkey", "type", F.array_join("enum_values", ",").alias("enum_values"), "target")


# What a stage takes ------------------------------------------------------------------------------------

@query("SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 3 <> 0)")
def w1_drop_ungrounded(spark, d):
    o = read(spark, d, "orders")
    nodes = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "extracted").when(F.col("o_orderstatus") == "O", "human").alias("provenance"), F.when(F.col("o_orderkey") % 3 == 0, F.array("o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, F.array().cast("array<string>")).alias("sources"))
    return S.drop_ungrounded(nodes).select("id")


def some_issues(spark, d):
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    of = lambda key, *names: F.concat(pick(list(names), key), F.col(key).cast("string"))
    return o.select("o_orderkey", F.when(k % 4 == 0, "warn").otherwise("error").alias("level"), F.when(k % 5 == 0, "duplicate_id").otherwise("dangling_reference").alias("kind"), of("o_orderkey", "objectType:", "rel:", "rule:", "action:", "ruleGroup:", "event:").alias("from_id"), F.lit("f").alias("field"), F.when(k % 7 > 0, of("o_custkey", "objectType:", "action:", "rule:", "event:")).alias("missing_id"))


ISSUE_ROWS = """i AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'warn' ELSE 'error' END AS level, CASE WHEN o_orderkey % 5 = 0 THEN 'duplicate_id' ELSE 'dangling_reference' END AS kind, ['objectType:', 'rel:', 'rule:', 'action:', 'ruleGroup:', 'event:'][o_orderkey % 6 + 1] || o_orderkey AS from_id,
  CASE WHEN o_orderkey % 7 > 0 THEN ['objectType:', 'action:', 'rule:', 'event:'][o_custkey % 4 + 1] || o_custkey END AS missing_id, ['objects', 'objects', 'rules', 'actions', 'rules', 'events'][o_orderkey % 6 + 1] AS tab, ['objects', 'actions', 'rules', 'events'][o_custkey % 4 + 1] AS other FROM orders)"""


@query(f"WITH {ISSUE_ROWS} SELECT o_orderkey, from_id FROM i WHERE o_orderkey % 6 IN (0, 1)")
def w4_stage_issues(spark, d):
    return S.stage_issues(some_issues(spark, d), "objects").select("o_orderkey", "from_id")


@query(f"WITH {ISSUE_ROWS} SELECT from_id, 'f' AS field, missing_id FROM i WHERE kind = 'dangling_reference' AND missing_id IS NOT NULL")
def v18_dangling(spark, d):
    return S.dangling_of(some_issues(spark, d))


@query(f"WITH {ISSUE_ROWS} SELECT 'semantic:' || from_id || ':f:' || kind || ':' || coalesce(missing_id, '') AS key, level AS severity, tab AS layer, CASE WHEN missing_id IS NOT NULL AND other <> tab THEN other END AS related_layer FROM i")
def x33_diagnostics(spark, d):
    return S.diagnostics(some_issues(spark, d)).select("key", "severity", "layer", "related_layer")


@query("SELECT o_custkey, count(*) FILTER (o_orderkey % 3 = 0) AS errors, count(*) FILTER (o_orderkey % 3 <> 0) AS warnings, count(*) FILTER (o_orderkey % 6 = 0) = 0 AS saveable FROM orders GROUP BY 1")
def l10_summary(spark, d):
    k = F.col("o_orderkey")
    diags = read(spark, d, "orders").select("o_custkey", F.when(k % 3 == 0, "error").otherwise("warn").alias("severity"), F.when(k % 2 == 0, "semantic").otherwise("schema").alias("source"))
    return S.summary(diags, "o_custkey")


@query("SELECT doc_id AS idx FROM documents WHERE CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN lang = 'en' ELSE true END")
def w5_findings_of_stage(spark, d):
    k = F.col("doc_id")
    kinds = F.when(k % 3 == 0, F.array().cast("array<string>")).when((k % 3 == 1) & (F.col("lang") == "en"), F.array(F.lit("event"), F.lit("rule"))).when(k % 3 == 1, F.array(F.lit("event")))
    f = read(spark, d, "documents").select(k.alias("idx"), kinds.alias("expected_kinds"))
    return S.findings_of_stage(f, "rules").select("idx")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 4 IN (0, 3)")
def w9_gaps_of_layer(spark, d):
    gaps = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", pick(["general", "object", "rule", "event"], "l_linenumber").alias("layer"))
    return S.gaps_of_layer(gaps, "event").select("l_orderkey", "l_linenumber")


@query("""SELECT c_custkey AS run_id, CASE WHEN c_custkey % 3 = 0 THEN 'objects' WHEN c_custkey % 2 = 1 AND c_custkey % 5 = 0 THEN 'actions' END AS missing_stage, NOT (c_custkey % 3 = 0 OR c_custkey % 2 = 1 AND c_custkey % 5 = 0) AS ready FROM customer""")
def v17_stage_order(spark, d):
    k = F.col("c_custkey")
    runs = read(spark, d, "customer").select(k.alias("run_id"), (k % 2 == 0).alias("from_schema"), (k % 3).alias("objects"), (k % 5).alias("actions"))
    return S.stage_ready(runs, "processes")


# Replies -----------------------------------------------------------------------------------------------

@query("""WITH b AS (SELECT l_orderkey, string_agg('v' || l_linenumber || '=' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS bindings FROM lineitem WHERE l_partkey % 7 <> 0 AND l_linenumber <> 2 GROUP BY 1)
  SELECT o_orderkey AS rule_id, coalesce(bindings, '') AS bindings FROM orders LEFT JOIN b ON l_orderkey = o_orderkey WHERE o_orderkey % 3 <> 0""")
def x2_coerce_bindings(spark, d):
    line = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.struct(F.when(x["l_linenumber"] != 2, F.concat(F.lit("v"), x["l_linenumber"].cast("string"))).otherwise("").alias("var"), x["l_partkey"].cast("string").alias("object_id"))).alias("bindings"))
    rules = read(spark, d, "orders").join(line, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.col("o_orderkey").alias("rule_id"), F.when(F.col("o_orderkey") % 3 > 0, "p").otherwise(" ").alias("predicate"), "bindings")
    objects = read(spark, d, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").cast("string").alias("id"))
    return S.coerce_bindings(rules, objects).select("rule_id", F.array_join(F.transform("bindings", lambda b: F.concat_ws("=", b["var"], b["object_id"])), ",").alias("bindings"))


@query("""SELECT p_brand AS group_id, CASE WHEN length(p_brand) % 2 = 0 THEN p_brand ELSE arg_min(p_name, p_partkey) END AS en, coalesce(arg_min(p_type, p_partkey) FILTER (p_size > 45), arg_min(p_type, p_partkey) || '!') AS zh FROM part GROUP BY 1""")
def x3_group_titles(spark, d):
    p = read(spark, d, "part")
    members = p.select(F.col("p_brand").alias("group_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 45, F.col("p_type")).otherwise(" ").alias("title_zh"), F.concat("p_type", F.lit("!")).alias("statement_zh"))
    return S.group_titles(p.select(F.col("p_brand").alias("group_id"), F.when(F.length("p_brand") % 2 == 0, F.col("p_brand")).otherwise("").alias("seed")).distinct(), members)


@query("SELECT l_orderkey, l_linenumber, 'a' || l_partkey AS name, l_linenumber <> 3 AS is_foreign_key, CASE l_linenumber WHEN 1 THEN 'new' WHEN 2 THEN 'old' END AS ref FROM lineitem WHERE l_linenumber <= 5 AND l_partkey % 4 <> 0")
def x4_coerce_properties(spark, d):
    n = F.col("l_linenumber")
    rows = read(spark, d, "lineitem").where("l_linenumber <= 5").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 4 > 0, F.concat(F.lit(" a"), "l_partkey", F.lit(" "))).otherwise(" ").alias("name"), F.when(n == 1, "new").otherwise("").alias("references"),
        F.when(n <= 2, "old").alias("ref_object_id"), F.when(n == 4, True).alias("is_foreign_key"), F.when(n == 5, "fk").alias("key_role"),
    )
    return S.coerce_properties(rows).select("l_orderkey", "l_linenumber", "name", "is_foreign_key", F.col("references").alias("ref"))


@query("""WITH r AS (SELECT l_partkey AS idx, l_orderkey * 10 + l_linenumber AS ord, CASE l_linenumber WHEN 1 THEN 'covered' WHEN 2 THEN 'partial' WHEN 3 THEN 'odd' ELSE 'uncovered' END AS status, l_linenumber AS n FROM lineitem WHERE l_partkey % 3 <> 0),
  v AS (SELECT * FROM r WHERE status <> 'odd' QUALIFY row_number() OVER (PARTITION BY idx ORDER BY ord DESC) = 1)
  SELECT idx, status, CASE WHEN n = 1 THEN 8 WHEN n = 2 THEN 1 END AS receipts, CASE WHEN n >= 4 THEN 'rule' END AS kinds, CASE WHEN n = 2 THEN 'gone' END AS missing FROM v""")
def x11_coerce_verdicts(spark, d):
    n = F.col("l_linenumber")
    none = F.array().cast("array<string>")
    ids = F.when(n == 1, F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: i.cast("string"))).when(n == 2, F.array(F.lit(""), F.lit("a"))).otherwise(none)
    replies = read(spark, d, "lineitem").select(F.col("l_partkey").alias("idx"), (F.col("l_orderkey") * 10 + n).alias("ord"), F.when(n == 1, "covered").when(n == 2, "partial").when(n == 3, "odd").otherwise("uncovered").alias("status"), ids.alias("covered_by"), F.when(n >= 4, F.array(F.lit("rule"), F.lit("thing"), F.lit("rule"))).otherwise(none).alias("expected_kinds"), F.when(n == 2, " gone ").otherwise(" ").alias("missing"))
    out = S.coerce_verdicts(replies, read(spark, d, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("idx")))
    return out.select("idx", "status", F.when(F.col("covered_by").isNotNull(), F.size("covered_by")).alias("receipts"), F.array_join("expected_kinds", ",").alias("kinds"), "missing")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Order To.Cash '[1:9] || 'Cash ' || n_nationkey END AS name FROM nation".replace("'Order To.Cash '[1:9] || 'Cash '", "'Order To Cash '"))
def x14_derive_name(spark, d):
    n = F.col("n_nationkey")
    return read(spark, d, "nation").select(n, S.derive_name(F.when(n % 2 == 0, F.concat(F.lit(" "), "n_name", F.lit(" "))).otherwise("  "), F.concat(F.lit("ontology:order-to.cash-"), n)).alias("name"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN p_type WHEN p_size % 3 = 0 THEN p_brand ELSE 'i' || p_partkey END WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'i' || p_partkey ELSE p_name END ELSE p_name END AS name FROM part""")
def x16_display_name(spark, d):
    s = F.col("p_size")
    kind = pick(["rule", "process", "object"], "p_partkey")
    name = F.when((F.col("p_partkey") % 3 == 1) & (s % 2 == 0), "").otherwise(F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", S.display_name(kind, F.concat(F.lit("i"), "p_partkey"), name, F.when(s % 2 == 0, F.col("p_type")).otherwise(""), F.when(s % 3 == 0, F.col("p_brand"))).alias("name"))


@query("""WITH f AS (SELECT o_custkey AS event_id, 'f' || l_linenumber AS name, o_orderkey AS a, l_partkey AS b, CASE WHEN l_partkey % 5 = 0 THEN 'reference' ELSE 'money' END AS type, CASE WHEN l_partkey % 5 = 0 THEN l_suppkey END AS object_id, l_linenumber = 1 AS required FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey % 5 = 0 OR l_partkey % 5 = 1)
  SELECT event_id, name, type, object_id, required FROM f QUALIFY row_number() OVER (PARTITION BY event_id, name ORDER BY a, b) = 1""")
def p9_infer_payload(spark, d):
    k = F.col("l_partkey") % 5
    emits = read(spark, d, "orders").select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("action_id"), F.col("o_orderkey").alias("emit_ord"))
    outputs = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("action_id"), F.col("l_partkey").alias("out_ord"), F.concat(F.lit("f"), "l_linenumber").alias("name"), F.when(k == 0, F.col("l_suppkey")).alias("object_id"), F.when(k == 1, "money").when(k > 1, "odd").alias("type"), F.when(F.col("l_linenumber") == 1, True).alias("required"))
    return S.infer_payload(emits, outputs, ["money", "date"]).select("event_id", "name", "type", "object_id", "required")


MODELS = [("openrouter/Google/Gemini-2.5-Pro-x", None, "gemini-2.5-pro", "google/gemini-2.5-flash", False), ("gpt-5.1", "OpenAI", "gpt-5", "gpt-5-mini", False), ("anthropic/claude-opus-4", "openai", "claude-opus", "anthropic/claude-sonnet-4.5", True), ("mistral", "openai", None, None, None), ("x/gpt-4.1", "google", "gpt-4.1", "openai/gpt-4.1-mini", False)]


@query(f"SELECT c_custkey, v.family, v.model, v.w AS wrong_vendor FROM customer JOIN {values([(k, f, m, w if w is None else int(w)) for k, (_, _, f, m, w) in enumerate(MODELS)], 'k, family, model, w')} ON v.k = c_custkey % 5".replace("v.w AS", "v.w = 1 AS"))
def x29_fast_sibling(spark, d):
    hit = S.fast_sibling(pick([m[0] for m in MODELS], "c_custkey"), pick([m[1] for m in MODELS], "c_custkey"))
    return read(spark, d, "customer").select("c_custkey", hit.alias("h")).select("c_custkey", "h.family", "h.model", "h.wrong_vendor")


@query("""WITH e AS (SELECT n_nationkey AS source, n_name, unnest([r_name, 'BACK']) AS target_name, n_nationkey AS ord FROM nation JOIN region ON r_regionkey = n_regionkey), t AS (SELECT source, 'R' || r_regionkey AS target, 'rel:' || regexp_replace(lower(n_name), '[^a-z0-9.-]+', '-', 'g') || '-lies-in-' || regexp_replace(lower(r_name), '[^a-z0-9.-]+', '-', 'g') AS base FROM e JOIN region ON r_name = target_name)
  SELECT base AS id, 'lies_in' AS name, 'N' || source AS source, target FROM t UNION ALL SELECT base || '-2', 'lies_in', 'N' || source, target FROM t WHERE source % 2 = 0""")
def x32_verb_relationships(spark, d):
    r, n = read(spark, d, "region"), read(spark, d, "nation")
    said = F.concat(F.lit("lies in → "), "r_name", F.lit(" (x), BACK"))
    own = n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"), F.when(F.col("n_nationkey") % 2 == 0, F.array(said, said, F.lit("nothing"))).otherwise(F.array(said)).alias("relations"))
    ends = r.select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(100).alias("ord"), F.array().cast("array<string>").alias("relations"))
    return S.verb_relationships(own.unionByName(ends)).select("id", "name", "source", "target")


@query("""WITH e AS (SELECT 'n' || n_nationkey AS s, 'r' || n_regionkey AS t, n_name AS sn, r_name AS tn, n_nationkey AS ord, CASE WHEN n_nationkey % 2 = 0 THEN '属于' ELSE 'lies in' END AS verb FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 5 <> 0),
  b AS (SELECT s AS id, ord, '【' || sn || '】' || verb || '【' || tn || '】。' AS line FROM e UNION ALL SELECT t, ord, '【' || sn || '】' || verb || '【' || tn || '】。' FROM e), g AS (SELECT id, string_agg(line, '' ORDER BY ord) AS p FROM b GROUP BY 1)
  SELECT id, coalesce(p, '【' || name || '】暂无与其他对象的关联关系。') AS prose FROM (SELECT 'n' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region) LEFT JOIN g USING (id)""")
def x36_cjk_prose(spark, d):
    r, n = read(spark, d, "region"), read(spark, d, "nation")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    names = n.select(key("n", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(" ").alias("name_zh")).unionByName(r.select(key("r", "r_regionkey").alias("id"), F.lit("x").alias("name"), F.col("r_name").alias("name_zh")))
    edges = n.where("n_nationkey % 5 <> 0").select(key("n", "n_nationkey").alias("source"), key("r", "n_regionkey").alias("target"), F.col("n_nationkey").alias("ord"), F.when(F.col("n_nationkey") % 2 == 0, "属于").alias("name_zh"), F.lit("").alias("description"), F.lit("lies_in").alias("name"))
    return S.cjk_prose(edges, names)


@query("SELECT l_orderkey AS object_id, l_linenumber AS ord, l_partkey % 7 <> 0 AND (l_linenumber = 1 OR l_linenumber = 2) AS is_foreign_key, CASE WHEN l_partkey % 7 <> 0 AND (l_linenumber = 1 OR l_linenumber = 2) THEN l_partkey END AS ref FROM lineitem")
def p11_legacy_properties(spark, d):
    n = F.col("l_linenumber")
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("object_id"), n.alias("ord"), F.lit("a").alias("name"), F.lit(None).cast("string").alias("description"), F.when(n == 1, "fk").alias("key_role"), F.when(n == 2, "reference").otherwise("string").alias("type"), F.col("l_partkey").alias("ref_object_id"))
    out = S.legacy_properties(rows, read(spark, d, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id")))
    return out.select("object_id", "ord", "is_foreign_key", F.col("references").alias("ref"))


@query("SELECT p_partkey, NOT (p_partkey % 7 = 3) AS needed FROM part")
def p11_needs_migration(spark, d):
    k = F.col("p_partkey") % 7
    need = S.needs_migration(k != 0, F.when(k != 1, "data"), F.when(k != 2, "id").otherwise(" "), F.when(k == 4, "plain").otherwise("【甲】属于【乙】。"), F.when(k == 5, "old").otherwise("新"), F.when(k == 6, "新二").otherwise(" 新 "))
    return read(spark, d, "part").select("p_partkey", need.alias("needed"))


# Published forms -----------------------------------------------------------------------------------------

@query("""WITH k AS (SELECT l_suppkey, string_agg(DISTINCT p, ',' ORDER BY p) AS extra FROM (SELECT l_suppkey, split_part(o_orderpriority, '-', 1) AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1)
  SELECT 'object' AS kind, 'objectType:c-' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'c-' || c_custkey END AS shown, CASE WHEN c_custkey % 3 = 0 THEN 'key' ELSE 'c_' || c_custkey || '_id' END AS extra FROM customer
  UNION ALL SELECT 'action', 'action:' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'shipOrder' ELSE CAST(o_orderkey AS VARCHAR) END, NULL FROM orders UNION ALL SELECT 'event', 'event:' || n_nationkey, upper(replace(n_name, ' ', '_')) || '_MADE', NULL FROM nation UNION ALL SELECT 'rule', 'rule:' || l_suppkey, 'rule:' || l_suppkey, extra FROM k""")
def j17_spec_context(spark, d):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    objects = read(spark, d, "customer").select(key("objectType:c-", "c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("").alias("name"), F.when(F.col("c_custkey") % 3 == 0, " key ").otherwise(" ").alias("primary_key"))
    actions = read(spark, d, "orders").select(key("action:", "o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "ship order").otherwise("").alias("name"), F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("actor_kind"))
    events = read(spark, d, "nation").select(key("event:", "n_nationkey").alias("id"), F.concat("n_name", F.lit(".made")).alias("name"))
    gates = read(spark, d, "lineitem").select(key("action:", "l_orderkey").alias("action_id"), key("rule:", "l_suppkey").alias("rule_id"))
    return S.spec_context(objects, actions, events, gates)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'manual' WHEN o_orderkey % 4 = 1 OR o_orderkey % 12 = 2 THEN 'tool' ELSE 'logic' END AS step FROM orders")
def x7_workflow_steps(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", S.workflow_step(F.when(k % 4 == 0, "human"), F.when(k % 4 < 2, "sys"), F.when(k % 12 == 2, True)).alias("step"))


@query("""WITH t AS (SELECT l_orderkey AS process_id, l_linenumber AS ord, CASE l_linenumber % 3 WHEN 0 THEN 'SCHEDULED_SYNC' WHEN 1 THEN 'ORDER_' || l_suppkey || '_MADE' END AS name FROM lineitem), u AS (SELECT process_id, name, min(ord) AS ord FROM t WHERE name IS NOT NULL GROUP BY ALL)
  SELECT process_id, string_agg(name, ',' ORDER BY ord, name) AS triggers FROM u GROUP BY 1""")
def x7_workflow_triggers(spark, d):
    n = F.col("l_linenumber") % 3
    t = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("process_id"), F.col("l_linenumber").alias("ord"), F.when(n == 0, "schedule").when(n == 1, "event").otherwise("manual").alias("kind"), F.concat(F.lit("event:order."), "l_suppkey", F.lit(".made")).alias("event_id"))
    return S.workflow_triggers(t).select("process_id", F.array_join("triggers", ",").alias("triggers"))


@query("""SELECT 'objects[' || o_orderkey || ']: unknown object "c' || o_custkey || '"' AS message FROM orders WHERE o_custkey % 7 = 0 AND o_orderkey % 3 = 0
  UNION ALL SELECT 'workflows[' || o_orderkey || '].trigger: unknown event "E' || o_custkey || '"' FROM orders WHERE o_custkey % 5 = 0 AND o_orderkey % 3 = 1 AND o_orderkey % 4 <> 0""")
def v13_bundle_issues(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    o = read(spark, d, "orders")
    objects = o.where("o_orderkey % 3 = 0").select(F.concat(F.lit("objects["), k, F.lit("]")).alias("place"), F.lit("object").alias("kind"), F.lit(False).alias("trigger"), F.lit(True).alias("optional"), F.concat(F.lit("c"), c, F.when(k % 2 == 0, ".field").otherwise("")).alias("name"))
    events = o.where("o_orderkey % 3 = 1").select(F.concat(F.lit("workflows["), k, F.lit("].trigger")).alias("place"), F.lit("event").alias("kind"), F.lit(True).alias("trigger"), F.lit(False).alias("optional"), F.when(k % 4 == 0, "SCHEDULED_SYNC").otherwise(F.concat(F.lit("E"), c)).alias("name"))
    empty = o.where("o_orderkey % 3 = 2").select(F.lit("actions").alias("place"), F.lit("object").alias("kind"), F.lit(False).alias("trigger"), F.lit(True).alias("optional"), F.lit("").alias("name"))
    known = read(spark, d, "customer")
    names = known.where("c_custkey % 7 <> 0").select(F.lit("object").alias("kind"), F.concat(F.lit("c"), "c_custkey").alias("name")).unionByName(known.where("c_custkey % 5 <> 0").select(F.lit("event").alias("kind"), F.concat(F.lit("E"), "c_custkey").alias("name")))
    return S.bundle_issues(objects.unionByName(events).unionByName(empty), names).select("message")


@query("SELECT o_orderpriority, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey, o_orderstatus, o_orderkey) AS INTEGER) AS rank FROM orders")
def l8_emit_refs(spark, d):
    e = read(spark, d, "orders").select("o_orderpriority", "o_orderkey", F.col("o_custkey").alias("event_id"), F.col("o_orderstatus").alias("tool"), F.col("o_orderkey").alias("on"))
    return S.emit_refs(e, "o_orderpriority").select("o_orderpriority", "o_orderkey", "rank")


@query("SELECT o_custkey, CAST(rank AS INTEGER) AS rank, 'Can you clarify how to address this gap: ' || o_orderkey || '?' AS question_en, '请说明如何补足以下缺口：' || CASE WHEN o_orderkey % 2 = 0 THEN 'z' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END || '？' AS question_zh FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders WHERE o_orderstatus <> 'P') WHERE rank <= 12")
def l12_fallback_questions(spark, d):
    k = F.col("o_orderkey")
    gaps = read(spark, d, "orders").select("o_custkey", k.alias("ord"), F.when(F.col("o_orderstatus") == "P", "info").otherwise("warn").alias("severity"), k.cast("string").alias("en"), F.when(k % 2 == 0, F.concat(F.lit("z"), k)).otherwise("").alias("zh"))
    return S.fallback_questions(gaps, "o_custkey")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 9007199254740991 WHEN l_linenumber % 3 = 1 THEN l_partkey ELSE l_suppkey END AS n FROM lineitem")
def l11_ordinal(spark, d):
    k = F.col("l_linenumber") % 3
    first = F.when(k == 1, F.concat(F.lit(" "), "l_partkey")).when(k == 2, "x").otherwise(" ")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.ordinal(first, F.when(k > 0, F.col("l_suppkey"))).alias("n"))


@query("SELECT c_mktsegment, CAST(rank AS INTEGER) AS rank, c_custkey || ' | ' || c_nationkey || ' | ' || c_name AS line, total FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rank, count(*) OVER (PARTITION BY c_mktsegment) AS total FROM customer) WHERE rank <= 400")
def l3_node_index(spark, d):
    n = read(spark, d, "customer").select("c_mktsegment", F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").cast("string").alias("kind"), F.col("c_name").alias("label"), F.col("c_custkey").alias("ord"))
    return S.node_index(n, "c_mktsegment")


@query("SELECT p_brand, p_partkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank FROM part) WHERE rank <= 5")
def l13_capped(spark, d):
    return S.capped(read(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 5)


@query("SELECT n_regionkey AS layer, n_nationkey AS id FROM nation WHERE n_regionkey NOT IN (1, 3) UNION ALL SELECT n_regionkey, n_nationkey + 100 FROM nation WHERE n_regionkey = 1")
def u6_assemble(spark, d):
    n = read(spark, d, "nation")
    base = n.select(F.col("n_regionkey").alias("layer"), F.col("n_nationkey").alias("id"))
    edited = n.where("n_regionkey IN (1, 2)").select(F.col("n_regionkey").alias("layer"), (F.col("n_nationkey") + 100).alias("id"), (F.col("n_regionkey") == 1).alias("ok"))
    emptied = n.where("n_regionkey = 3").select(F.col("n_regionkey").alias("layer"), F.lit(None).cast("int").alias("id"), F.lit(True).alias("ok")).distinct()
    return S.assemble(base, edited.unionByName(emptied))


# Coverage ------------------------------------------------------------------------------------------------

@query(f"SELECT doc_id AS document_id, item_id AS node_id, char_start, char_end FROM ({EXACT}) UNION ALL SELECT doc_id, -1, 2, 9 FROM documents")
def c2_citation_intervals(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    from provenir.operators import grounding as J

    cited = J.ground_exact(read(spark, d, "benchmark"), read(spark, d, "documents")).select(F.col("doc_id").alias("document_id"), F.col("item_id").alias("node_id"))
    said = cited.join(read(spark, d, "benchmark").select(F.col("item_id").alias("node_id"), F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit("  "))).alias("snippet")), "node_id")
    refs = said.select("document_id", "node_id", F.lit(5).alias("char_start"), F.lit(5).alias("char_end"), "snippet")
    given = docs.select("document_id", F.lit(-1).cast("bigint").alias("node_id"), F.lit(2).alias("char_start"), F.lit(9).alias("char_end"), F.lit(None).cast("string").alias("snippet"))
    return S.citation_intervals(refs.unionByName(given), docs)


@query("SELECT o_custkey AS pass, CAST(CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE count(*) END AS INTEGER) AS findings FROM orders GROUP BY 1")
def c6_coverage_history(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("pass")).agg(F.collect_list("o_orderkey").alias("findings"))
    return S.retire(o.where("pass % 2 = 1"), o.where("pass % 2 = 0")).select("pass", F.size("findings").alias("findings"))
