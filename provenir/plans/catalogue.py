"""Queries over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenir.functions import text as T
from provenir.operators import graph as G
from provenir.operators import grounding as J
from provenir.operators import integrity as V
from provenir.operators import matching as M
from provenir.operators import scoring as A
from provenir.operators import segment as D
from provenir.operators import suggest as W
from provenir.sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark, sf_dir, name):
    return tables.read(spark, sf_dir, name)


# Text ---------------------------------------------------------------------------------------------

@query(r"""SELECT doc_id, md5(t) AS h, CAST(length(t) AS BIGINT) AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(
  regexp_replace(text, '\r\n?', chr(10), 'g'), chr(160), ' '), '[\x{FEFF}\x{200B}-\x{200D}\x{2060}]', '', 'g'), '[ \t\f\v]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents)""")
def f1_normalize_ws(spark, d):
    t = read(spark, d, "documents").select("doc_id", T.normalize_whitespace("text").alias("t"))
    return t.select("doc_id", F.md5("t").alias("h"), F.length("t").cast("bigint").alias("n"))


@query(r"""SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS h FROM documents""")
def f2_search_form(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.normalize_search("text")).alias("h"))


@query(r"""SELECT t AS sql_type, CASE WHEN t LIKE '%[]' OR t LIKE 'enum%' OR t LIKE 'set(%' THEN 'List<String>' WHEN t IN ('tinyint(1)', 'bool', 'boolean') THEN 'Boolean'
  WHEN t LIKE '%varying%' OR t LIKE 'char%' THEN 'String' WHEN t LIKE 'double%' THEN 'Float' WHEN t LIKE 'timestamp%' OR t LIKE 'datetime%' THEN 'Timestamp'
  WHEN regexp_replace(t, '[ (].*', '') IN ('int', 'bigint', 'smallint', 'serial', 'tinyint') THEN 'Integer' WHEN regexp_replace(t, '[ (].*', '') IN ('numeric', 'decimal', 'real', 'money') THEN 'Float'
  WHEN t = 'date' THEN 'Date' ELSE 'String' END AS property_type
  FROM (VALUES ('varchar(20)'), ('numeric(12,2)'), ('timestamptz'), ('enum(''a'',''b'')'), ('tinyint(1)'), ('text[]'), ('int unsigned'), ('double precision'), ('character varying'), ('date'), ('uuid'), ('bigserial'), ('serial'), ('bool'), ('datetime(6)'), ('set(''x'')'), ('money'), ('tinyint(4)')) AS v(t) WHERE t <> 'bigserial'""")
def f5_property_types(spark, d):
    types = "varchar(20)|numeric(12,2)|timestamptz|enum('a','b')|tinyint(1)|text[]|int unsigned|double precision|character varying|date|uuid|serial|bool|datetime(6)|set('x')|money|tinyint(4)".split("|")
    return spark.createDataFrame([(t,) for t in types], "sql_type string").select("sql_type", T.property_type("sql_type").alias("property_type"))


@query(r"""SELECT p_partkey, lower(array_to_string(w, '_')) AS snake, array_to_string(list_transform(w, lambda x: upper(x[1]) || lower(x[2:])), '_') AS pascal, upper(array_to_string(w, '_')) AS upper_form
  FROM (SELECT p_partkey, list_filter(string_split(trim(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM part)""")
def f11_case_forms(spark, d):
    return read(spark, d, "part").select("p_partkey", T.snake("p_name").alias("snake"), T.pascal_snake("p_name").alias("pascal"), T.upper_snake("p_name").alias("upper_form"))


@query(r"""SELECT doc_id, coalesce(nullif(CASE WHEN length(c) > 60 THEN left(c, 57) || '...' ELSE c END, ''), nullif(left(text, 57), ''), 'Rule') AS title
  FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(regexp_extract(coalesce(text, ''), '^[^.!?;:\n]*'), '^\s+|\s+$', '', 'g') AS c FROM documents)""")
def f14_title_seed(spark, d):
    return read(spark, d, "documents").select("doc_id", T.title_seed("text").alias("title"))


@query(r"""SELECT doc_id, regexp_replace(regexp_extract(text, '^[^.;:,]*'), '^\s+|\s+$', '', 'g') AS clause FROM documents""")
def f13_first_clause(spark, d):
    return read(spark, d, "documents").select("doc_id", T.first_clause("text").alias("clause"))


@query("""SELECT user_id, n, 'a,it''s,' || user_id AS items FROM (SELECT DISTINCT user_id, 3 AS n FROM events)""")
def f20_quoted_list(spark, d):
    e = read(spark, d, "events").select("user_id").distinct()
    x = T.quoted_list(F.concat(F.lit("status IN ('a', 'it''s', '"), F.col("user_id").cast("string"), F.lit("')")))
    return e.select("user_id", F.size(x).alias("n"), F.array_join(x, ",").alias("items"))


@query("""SELECT event_id, props AS json FROM events""")
def f24_json_extract(spark, d):
    noisy = F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n``` done"))
    return read(spark, d, "events").select("event_id", T.json_slice(noisy).alias("json"))


@query("""WITH v AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)),
  m AS (SELECT event_type AS t, substr(event_type, 2) || 'x' AS mangled FROM v)
  SELECT mangled, arg_min(v.event_type, {'far': NOT (starts_with(v.event_type, mangled) OR starts_with(mangled, v.event_type)), 'd': CASE WHEN starts_with(v.event_type, mangled) OR starts_with(mangled, v.event_type) THEN 0 ELSE levenshtein(v.event_type, mangled) END, 'k': k}) AS nearest FROM m, v GROUP BY mangled""")
def f25_nearest_enum(spark, d):
    e = read(spark, d, "events").select("event_type").distinct()
    words = W.closed_vocabulary(e, "event_type")
    m = e.select(F.concat(F.expr("substr(event_type, 2)"), F.lit("x")).alias("mangled"))
    return m.select("mangled", W.nearest_word(F.col("mangled"), words).alias("nearest"))


@query(r"""SELECT page_id, CAST(length(t) AS BIGINT) AS n, md5(t) AS h FROM (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', ' ', 'g'), '(?i)</(p|div|li|tr|h[1-6]|section|article|header|footer|table|ul|ol)>|<br\s*/?>', chr(10), 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') AS t FROM pages)""")
def s3_strip_tags(spark, d):
    t = read(spark, d, "pages").select("page_id", T.strip_tags("html").alias("t"))
    return t.select("page_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("h"))


@query("SELECT doc_id, 'parsed_' || substr(sha256(text), 1, 16) AS ref FROM documents")
def s6_content_ref(spark, d):
    return read(spark, d, "documents").select("doc_id", T.content_ref("text").alias("ref"))


@query("""SELECT n_name, string_agg(c_name || ' (' || c_mktsegment || ')', ', ' ORDER BY c_custkey) AS line, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def s15_textualize(spark, d):
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    item = F.struct("c_custkey", F.format_string("%s (%s)", "c_name", "c_mktsegment").alias("x"))
    return c.groupBy("n_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda v: v["x"]), ", ").alias("line"), F.count("*").alias("n"))


# Sentences and chunks -----------------------------------------------------------------------------

PARTS = r"list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(text, '([.!?;])(\s)', '\1' || chr(10) || '\2', 'g'), '([。！？；])', '\1' || chr(10), 'g'), '[\r\n]+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')"


@query(f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(s, '|')) AS h FROM (SELECT doc_id, {PARTS} AS s FROM documents)")
def d8_sentence_split(spark, d):
    t = read(spark, d, "documents").select("doc_id", T.normalize_whitespace("text").alias("_"), D.clause_split("text").alias("s"))
    return t.select("doc_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join("s", "|")).alias("h"))


@query(f"SELECT doc_id AS document_id, CAST(i - 1 AS INTEGER) AS idx, s[i] AS text, true AS slice_exact FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {PARTS} AS s FROM documents))")
def d9_sentence_offsets(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    s = D.sentences(docs)
    back = s.join(docs.withColumnRenamed("text", "whole"), F.col("doc_id") == F.col("document_id"))
    return back.select("document_id", "idx", "text", (F.substring("whole", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("text")).alias("slice_exact"))


@query(None)
def d7_careful_sentences(spark, d):
    return D.sentences(read(spark, d, "documents"), rule=D.careful_spans)


@query(f"SELECT doc_id AS document_id, i AS pos, row_number() OVER (ORDER BY doc_id, i) AS idx FROM (SELECT doc_id, unnest(range(0, len(s))) AS i FROM (SELECT doc_id, {PARTS} AS s FROM documents))")
def k2_global_numbering(spark, d):
    s = D.sentences(read(spark, d, "documents")).select("document_id", F.col("idx").cast("bigint").alias("pos"))
    return D.number_globally(s, "document_id", "pos").select("document_id", "pos", "idx")


@query(None)
def k5_aligned_chunks(spark, d):
    return D.sentences(read(spark, d, "documents"), rule=D.aligned_chunks())


@query("""SELECT doc_id, CAST(i AS INTEGER) AS chunk, substr(text, CAST(i * 23500 + 1 AS BIGINT), 24000) AS text FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(greatest(ceil((length(text) - 500) / 23500.0) - 1, 0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)""")
def k6_fixed_chunks(spark, d):
    return D.fixed_chunks(read(spark, d, "documents"), 24000, 500)


@query("SELECT l_partkey, l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) - 1) // 80 AS batch FROM lineitem")
def k7_batches(spark, d):
    return D.batches(read(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), 80, "l_orderkey", "l_linenumber", by="l_partkey")


@query("""SELECT source, doc_id, CAST(r AS BIGINT) AS running FROM (SELECT source, doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 6000""")
def k8_budget_prefix(spark, d):
    return D.budget_prefix(read(spark, d, "documents").select("source", "doc_id", "text"), 6000, "source", "doc_id", "text").select("source", "doc_id", F.col("running").cast("bigint").alias("running"))


W2 = r"(trim(text) = '' OR regexp_matches(trim(text), '^[\d\s.、第章节()()\-—]+$') OR regexp_matches(trim(text), '^[^\p{L}\p{N}]+$') OR len(string_split_regex(trim(text), '\s+')) < 3)"


@query(f"WITH s AS (SELECT unnest({PARTS}) AS text FROM documents) SELECT {W2} AS boilerplate, count(*) AS n FROM s GROUP BY 1")
def w2_boilerplate(spark, d):
    s = D.sentences(read(spark, d, "documents"))
    return s.groupBy(D.is_boilerplate("text").alias("boilerplate")).agg(F.count("*").alias("n"))


# Grounding and coverage ---------------------------------------------------------------------------

EXACT = "SELECT doc_id, item_id, CAST(instr(d.text, b.text) - 1 AS INTEGER) AS char_start, CAST(instr(d.text, b.text) - 1 + length(b.text) AS INTEGER) AS char_end FROM documents AS d JOIN benchmark AS b ON contains(d.text, b.text)"


@query(f"SELECT h.*, CAST(1 + length(left(text, char_start)) - length(replace(left(text, char_start), chr(10), '')) AS INTEGER) AS line FROM ({EXACT}) AS h JOIN documents USING (doc_id)")
def j9_ground_exact(spark, d):
    return J.ground_exact(read(spark, d, "benchmark"), read(spark, d, "documents"))


@query(r"SELECT doc_id, item_id FROM (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents) AS d JOIN (SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS q FROM benchmark) AS b ON contains(t, q)")
def j9_ground_normalized(spark, d):
    return J.ground_normalized(read(spark, d, "benchmark"), read(spark, d, "documents")).where("char_end > char_start").select("doc_id", "item_id")


#: Each window of as many tokens as the quotation, by its place; offsets from the lengths of tokens and of what is between them.
FUZZY = r"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w, string_split_regex(text, '\S+') AS gaps FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '\S+') AS q FROM benchmark),
  c AS (SELECT doc_id, item_id, w, gaps, list_distinct(q) AS asked, len(q) AS n, list_transform(w, lambda x: lower(x)) AS l FROM d, b WHERE len(q) > 0 AND len(w) BETWEEN 1 AND 4000),
  k AS (SELECT * FROM c WHERE len(list_intersect(asked, l)) >= 0.8 * len(asked)),
  p AS (SELECT *, unnest(range(0, greatest(len(w) - n, 0) + 1)) AS i FROM k),
  s AS (SELECT doc_id, item_id, w, gaps, n, i, list_distinct(l[i + 1 : i + n]) AS held, asked FROM p),
  r AS (SELECT *, len(list_intersect(held, asked)) / (len(held) + len(asked) - len(list_intersect(held, asked))) AS score FROM s),
  m AS (SELECT * FROM r WHERE score >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, i) = 1),
  z AS (SELECT *, CAST(list_sum(list_transform(gaps[1 : i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1 : i], lambda x: length(x))), 0) AS INTEGER) AS char_start FROM m)
  SELECT doc_id, item_id, round(score, 9) AS score, char_start, CAST(char_start + list_sum(list_transform(w[i + 1 : i + n], lambda x: length(x))) + coalesce(list_sum(list_transform(gaps[i + 2 : i + least(n, len(w))], lambda x: length(x))), 0) AS INTEGER) AS char_end FROM z"""


@query(FUZZY)
def j10_ground_fuzzy(spark, d):
    return J.ground_fuzzy(read(spark, d, "benchmark"), read(spark, d, "documents")).withColumn("score", F.round("score", 9))


@query(f"""WITH e AS ({EXACT}), p AS (SELECT doc_id, unnest(range(0, CAST(ceil(length(text) / 2000.0) AS BIGINT))) AS k FROM documents)
  SELECT doc_id, item_id, k + 1 AS page FROM e JOIN p USING (doc_id) WHERE char_start >= k * 2000 AND char_start < (k + 1) * 2000""")
def j8_page_lookup(spark, d):
    docs = read(spark, d, "documents")
    n = F.ceil(F.length("text") / 2000).cast("int")
    pages = docs.where(F.length("text") > 0).select("doc_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("k")).select("doc_id", (F.col("k") + 1).cast("bigint").alias("page"), (F.col("k") * 2000).alias("page_start"), ((F.col("k") + 1) * 2000).alias("page_end"))
    hits = J.ground_exact(read(spark, d, "benchmark"), docs).select("doc_id", "item_id", "char_start", "char_end")
    return J.page_of(hits, pages, "doc_id").select("doc_id", "item_id", "page")


def covered(spark, d):
    docs = read(spark, d, "documents")
    hits = J.ground_exact(read(spark, d, "benchmark"), docs).select(F.col("doc_id").alias("document_id"), F.col("item_id").alias("node_id"), "char_start", "char_end")
    # Used twice; the hits are few, so only cited documents are split for them, and the sentence side is never moved twice.
    hits = tables.keep(hits, "citations")
    cited = docs.join(hits.select(F.col("document_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return J.coverage_status(J.cover(D.sentences(docs), hits, near=D.sentences(cited))), docs


#: Sentences cited by an exact passage hold or lie in it; per document the count suffices for comparison.
COVER = rf"""WITH s AS (SELECT doc_id, lang, unnest(range(1, len(s) + 1)) AS i, s, text AS whole FROM (SELECT doc_id, lang, {PARTS} AS s, text FROM documents)),
  t AS (SELECT doc_id, lang, i, s[i] AS text, whole, CASE WHEN i = 1 THEN '' ELSE array_to_string(s[1 : i - 1], '') END AS before FROM s),
  o AS (SELECT *, length(regexp_replace(before, '\s', '', 'g')) AS a, length(regexp_replace(before || text, '\s', '', 'g')) AS b FROM t),
  e AS ({EXACT}), x AS (SELECT e.doc_id, item_id, length(regexp_replace(left(d.text, char_start), '\s', '', 'g')) AS a, length(regexp_replace(left(d.text, char_end), '\s', '', 'g')) AS b FROM e JOIN documents AS d USING (doc_id)),
  c AS (SELECT o.doc_id, o.lang, o.i, o.text, count(item_id) AS n FROM o LEFT JOIN x ON x.doc_id = o.doc_id AND x.a < o.b AND x.b > o.a GROUP BY ALL),
  z AS (SELECT doc_id, lang, CASE WHEN n > 0 THEN 'covered' WHEN {W2} THEN 'uncoverable' ELSE 'uncovered' END AS status FROM c)"""


@query(COVER + " SELECT doc_id AS document_id, status, count(*) AS n FROM z GROUP BY ALL")
def j7_sentence_coverage(spark, d):
    status, _ = covered(spark, d)
    return status.groupBy("document_id", "status").agg(F.count("*").alias("n"))


@query(COVER + """ SELECT lang, count(*) AS total, count(*) FILTER (status = 'covered') AS covered, count(*) FILTER (status = 'uncovered') AS uncovered, count(*) FILTER (status = 'uncoverable') AS uncoverable,
  round(count(*) FILTER (status = 'covered') / greatest(1, count(*) FILTER (status <> 'uncoverable')), 4) AS ratio FROM z GROUP BY lang""")
def a4_coverage_ratio(spark, d):
    status, docs = covered(spark, d)
    per = J.coverage_ratio(status, "document_id").join(docs.select(F.col("doc_id").alias("document_id"), "lang"), "document_id")
    total = per.groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("total", "covered", "uncovered", "uncoverable")])
    return total.withColumn("ratio", F.round(F.col("covered") / F.greatest(F.lit(1), F.col("total") - F.col("uncoverable")), 4))


# Confidence ---------------------------------------------------------------------------------------

def cited_parts(spark, d):
    line = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("sources"), F.count_if(F.col("l_returnflag") == "N").alias("verified"), F.countDistinct("l_suppkey").alias("witnesses"), F.count_if(F.col("l_linestatus") == "O").alias("resolved"))
    p = read(spark, d, "part").join(line, F.col("p_partkey") == F.col("l_partkey"), "left")
    return p.na.fill(0, ["sources", "verified", "witnesses", "resolved"])


CITED = """WITH c AS (SELECT p_partkey, p_size, p_brand, p_type, p_name, p_retailprice, coalesce(sources, 0) AS n, coalesce(verified, 0) AS v, coalesce(witnesses, 0) AS w, coalesce(resolved, 0) AS r FROM part LEFT JOIN
  (SELECT l_partkey, count(*) AS sources, count(*) FILTER (l_returnflag = 'N') AS verified, count(DISTINCT l_suppkey) AS witnesses, count(*) FILTER (l_linestatus = 'O') AS resolved FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
  f AS (SELECT *, (CAST(p_brand IS NOT NULL AND p_brand <> '' AS INT) + CAST(p_size > 10 AS INT) + CAST(p_type LIKE 'S%' AS INT)) / 3.0 AS filled FROM c),
  x AS (SELECT *, least(1, least(0.8, greatest(0.45, 0.6 + 0.25 * (p_size / 50.0 - 0.6))) * CASE WHEN n = 0 THEN 0.7 WHEN v = 0 THEN 0.4 ELSE 0.4 + 0.6 * v / n END
  * CASE WHEN w = 0 THEN 0.9 WHEN w = 1 AND v > 0 THEN 1 WHEN w = 1 THEN 0.85 WHEN w = 2 THEN 1.05 ELSE 1.1 END * CASE WHEN n = 0 THEN 1 ELSE 0.5 + 0.5 * r / n END * (0.7 + 0.3 * filled)) AS score FROM f)"""


def scored_parts(spark, d):
    c = cited_parts(spark, d).withColumn("filled", A.completeness(F.col("p_brand").isNotNull() & (F.col("p_brand") != ""), F.col("p_size") > 10, F.col("p_type").startswith("S")))
    return c.withColumn("score", A.rubric(F.col("p_size") / 50.0, "sources", "verified", "witnesses", "sources", "resolved", "filled"))


@query(CITED + " SELECT p_partkey, w AS witnesses, n AS sources FROM c")
def a7_witnesses(spark, d):
    return cited_parts(spark, d).select("p_partkey", "witnesses", "sources")


@query(CITED + " SELECT p_partkey, round(score + 1e-9, 4) AS score FROM x")
def a8_confidence_rubric(spark, d):
    return scored_parts(spark, d).select("p_partkey", F.round(F.col("score") + 1e-9, 4).alias("score"))


@query(CITED + " SELECT p_partkey, round(filled, 6) AS filled FROM x")
def a9_completeness(spark, d):
    return scored_parts(spark, d).select("p_partkey", F.round("filled", 6).alias("filled"))


@query(CITED + """, y AS (SELECT p_brand, score, CASE WHEN p_type LIKE 'S%' THEN 1.4 ELSE 1.0 END * CASE WHEN p_size > 40 THEN 1.25 WHEN p_size < 5 THEN 0 ELSE 1 END AS wt FROM x)
  SELECT p_brand, round(coalesce(sum(score * wt) / nullif(sum(wt), 0), 0), 6) AS confidence FROM y GROUP BY 1""")
def a6_weighted_confidence(spark, d):
    kind = F.when(F.col("p_type").startswith("S"), "action").otherwise("object")
    review = F.when(F.col("p_size") > 40, "accepted").when(F.col("p_size") < 5, "rejected").otherwise("open")
    nodes = scored_parts(spark, d).select("p_brand", kind.alias("kind"), review.alias("review"), F.col("score").alias("confidence"))
    return A.model_confidence(nodes, "p_brand").select("p_brand", F.round("confidence", 6).alias("confidence"))


@query("""SELECT coalesce(lang, '*') AS layer, count(*) AS expected, count(*) FILTER (quality = 1) AS matched, round(count(*) FILTER (quality = 1) / count(*), 6) AS recall
  FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), ())""")
def a5_recall(spark, d):
    rows = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return A.recall(rows.select(F.col("lang").alias("layer"), (F.col("quality") == 1).alias("matched")))


# Integrity ----------------------------------------------------------------------------------------

STAR = [
    V.Path("orders", "o_orderkey", "o_custkey", "customer", "c_custkey"),
    V.Path("lineitem", "l_orderkey", "l_partkey", "part", "p_partkey"),
    V.Path("lineitem", "l_orderkey", "l_suppkey", "supplier", "s_suppkey"),
    V.Path("lineitem", "l_orderkey", "l_orderkey", "orders", "o_orderkey"),
    V.Path("customer", "c_custkey", "c_nationkey", "nation", "n_nationkey"),
    V.Path("nation", "n_nationkey", "n_regionkey", "region", "r_regionkey"),
    V.Path("labels", "doc_id", "doc_id", "documents", "doc_id", "warn"),
]


def star(spark, d):
    """The star schema with every seventh part and fifth nation gone, so that references dangle."""
    t = {n: read(spark, d, n) for n in ("orders", "customer", "lineitem", "part", "supplier", "nation", "region", "labels", "documents")}
    return t | {"part": t["part"].where("p_partkey % 7 <> 0"), "nation": t["nation"].where("n_nationkey % 5 <> 0")}


ISSUES = """WITH i AS (SELECT 'error' AS level, 'lineitem' AS owner, l_orderkey AS f, 'l_partkey' AS field, l_partkey AS m FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0)
  UNION ALL SELECT 'error', 'lineitem', l_orderkey, 'l_suppkey', l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
  UNION ALL SELECT 'error', 'lineitem', l_orderkey, 'l_orderkey', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'error', 'orders', o_orderkey, 'o_custkey', o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'error', 'customer', c_custkey, 'c_nationkey', c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 5 <> 0)
  UNION ALL SELECT 'error', 'nation', n_nationkey, 'n_regionkey', n_regionkey FROM nation WHERE n_nationkey % 5 <> 0 AND n_regionkey NOT IN (SELECT r_regionkey FROM region)
  UNION ALL SELECT 'warn', 'labels', doc_id, 'doc_id', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))"""


@query(ISSUES + " SELECT level, 'dangling_reference' AS kind, owner, CAST(f AS VARCHAR) AS from_id, field, CAST(m AS VARCHAR) AS missing_id FROM i")
def v3_dangling_refs(spark, d):
    return V.dangling(star(spark, d), STAR)


@query(ISSUES + """, r AS (SELECT owner, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warn') AS warnings FROM i GROUP BY owner)
  SELECT owner, errors, warnings, errors = 0 AS can_save FROM (SELECT * FROM r UNION ALL SELECT '*', CAST(sum(errors) AS BIGINT), CAST(sum(warnings) AS BIGINT) FROM r)""")
def a18_diagnostics_rollup(spark, d):
    return V.rollup(V.dangling(star(spark, d), STAR))


@query("SELECT CAST(user_id AS VARCHAR) AS from_id, count(*) - 1 AS extra FROM events GROUP BY user_id HAVING count(*) > 1")
def v1_duplicate_ids(spark, d):
    nodes = read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ord"))
    return V.duplicate_ids(nodes).groupBy("from_id").agg(F.count("*").alias("extra"))


@query(CITED + """ SELECT 'error' AS level, 'missing_source' AS kind, count(*) AS n FROM c WHERE n = 0 HAVING count(*) > 0
  UNION ALL SELECT 'warn', 'unverified_quote', count(*) FROM c WHERE n > v HAVING count(*) > 0""")
def v2_missing_sources(spark, d):
    nodes = cited_parts(spark, d).select(F.col("p_partkey").alias("id"), F.lit("part").alias("kind"), F.lit("extracted").alias("provenance"), "sources", "verified")
    return V.missing_sources(nodes).groupBy("level", "kind").agg(F.count("*").alias("n"))


@query("SELECT CAST(doc_id AS VARCHAR) AS from_id, CAST(length(text) AS VARCHAR) AS live FROM documents WHERE n_chars + (doc_id % 3 = 0)::INT IS DISTINCT FROM length(text)")
def v7_cached_mismatch(spark, d):
    cached = F.col("n_chars") + (F.col("doc_id") % 3 == 0).cast("int")
    return V.cached_mismatch(read(spark, d, "documents"), "doc_id", cached, F.length("text").cast("bigint")).select("from_id", F.col("missing_id").alias("live"))


@query("SELECT DISTINCT event_type, user_id FROM events")
def j6_event_inverse(spark, d):
    return V.inverse(read(spark, d, "events"), "user_id", "event_type")


@query("""WITH e AS (SELECT event_type, list_sort(list_distinct(list(user_id))) AS a, list_sort(list_distinct(list(user_id) FILTER (NOT (user_id % 50 = 3 AND event_type < 'm')))) AS b FROM events GROUP BY 1)
  SELECT event_type AS from_id FROM e WHERE a IS DISTINCT FROM coalesce(b, [])""")
def v10_inverse_mismatch(spark, d):
    e = read(spark, d, "events")
    declared = V.inverse(e.where("NOT (user_id % 50 = 3 AND event_type < 'm')"), "user_id", "event_type")
    return V.inverse_mismatch(declared, V.inverse(e, "user_id", "event_type"), "event_type", "user_id").select("from_id")


# Matching and merging -----------------------------------------------------------------------------

SLUG = r"regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9.-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g')"


@query(f"SELECT p_partkey, CASE WHEN k = 1 THEN b ELSE b || '-' || k END AS id FROM (SELECT p_partkey, b, row_number() OVER (PARTITION BY b ORDER BY p_partkey) AS k FROM (SELECT p_partkey, 'objectType:' || {SLUG.replace('p_name', 'p_brand')} AS b FROM part))")
def k1_mint_ids(spark, d):
    parts = read(spark, d, "part").select("p_partkey", F.regexp_replace("p_brand", r"-?\d+$", "").alias("brand_stem"), "p_brand")
    return M.mint_ids(parts.select("p_partkey", "p_brand"), "p_brand", "p_partkey").select("p_partkey", "id")


@query("""SELECT c_custkey, coalesce(n.n_nationkey, l.n_nationkey) AS resolved FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) WHEN c_custkey % 3 = 0 THEN 'nowhere' ELSE (SELECT lower(n_name) FROM nation WHERE n_nationkey = c_nationkey) END AS ref FROM customer) AS c
  LEFT JOIN nation AS n ON c.ref = CAST(n.n_nationkey AS VARCHAR) LEFT JOIN nation AS l ON lower(c.ref) = lower(l.n_name)""")
def j1_prioritized_resolution(spark, d):
    nation = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("string").alias("key"), F.lower("n_name").alias("low"))
    c = read(spark, d, "customer").join(nation.select(F.col("id").alias("c_nationkey"), F.col("low").alias("_low")), "c_nationkey", "left")
    ref = F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).when(F.col("c_custkey") % 3 == 0, "nowhere").otherwise(F.col("_low"))
    rows = c.select("c_custkey", ref.alias("ref"))
    return M.resolve_first(rows, "ref", nation, [(F.col("ref"), "key"), (F.lower("ref"), "low")]).select("c_custkey", "resolved")


@query("""WITH t AS (SELECT DISTINCT lower(p_type) AS term_id, lower(p_type) AS key FROM part), v AS (SELECT DISTINCT lower(split_part(p_type, ' ', 1)) AS name FROM part), o AS (SELECT name, row_number() OVER (ORDER BY name) AS ord FROM v)
  SELECT term_id, arg_min(name, ord) AS node_id FROM t JOIN o ON contains(key, name) OR contains(name, key) WHERE key = name OR least(length(key), length(name)) >= 3 GROUP BY term_id""")
def j12_term_match(spark, d):
    types = read(spark, d, "part").select(F.lower("p_type").alias("t")).distinct()
    terms = types.select(F.col("t").alias("term_id"), F.array("t").alias("keys"))
    names = types.select(F.split("t", " ")[0].alias("name")).distinct()
    nodes = names.select(F.col("name").alias("node_id"), F.col("name").alias("ord"), "name")
    return M.match_names(terms, nodes)


@query(r"""WITH q AS (SELECT conv_id AS q_id, lower(text) AS t, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9\x{4E00}-\x{9FFF}]+'), lambda w: length(w) >= 2)) AS toks FROM conversations WHERE turn = 0),
  n AS (SELECT item_id AS node_id, lower(text) AS label, list_filter(string_split_regex(lower(text) || ' ' || item_id, '[^a-z0-9\x{4E00}-\x{9FFF}]+'), lambda w: length(w) >= 2) AS toks FROM benchmark),
  s AS (SELECT q_id, node_id, len(list_filter(n.toks, lambda w: list_contains(q.toks, w))) + CASE WHEN label <> '' AND contains(q.t, label) THEN 2 ELSE 0 END AS score FROM q, n),
  r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, node_id) AS rank, max(score) OVER (PARTITION BY q_id) AS best FROM s)
  SELECT q_id, node_id, CAST(score AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8 AND (score > 0 OR best = 0)""")
def j13_lexical_seeds(spark, d):
    q = read(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("q_id"), "text")
    n = read(spark, d, "benchmark").select(F.col("item_id").alias("node_id"), F.col("item_id").alias("ord"), F.col("text").alias("label"))
    return M.lexical_seeds(q, n).select("q_id", "node_id", F.col("score").cast("bigint").alias("score"), "rank")


@query("""SELECT lower(p_brand) AS key, arg_min(p_type, p_partkey) AS p_type, max(p_retailprice) AS p_retailprice, count(*) AS members, count(DISTINCT p_size) AS sizes FROM part GROUP BY 1""")
def a12_chunk_merge(spark, d):
    rows = read(spark, d, "part")
    return M.merge_by_key(rows, F.lower("p_brand"), "p_partkey", ["p_type"], ["p_retailprice"], ["p_size"]).select("key", "p_type", "p_retailprice", "members", F.size("p_size").cast("bigint").alias("sizes"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 'g' || p_size % 3 WHEN p_size > 25 THEN p_brand WHEN p_size > 10 THEN least(p_brand, p_type) || CASE WHEN p_brand = p_type THEN '' ELSE '|' || greatest(p_brand, p_type) END ELSE 'General' END AS cluster FROM part""")
def a14_cluster(spark, d):
    p, n = read(spark, d, "part"), F.col("p_size")
    rules = p.select(F.col("p_partkey").alias("id"), F.when(n > 25, F.col("p_brand")).otherwise(" ").alias("hint"), F.when(n > 10, F.array("p_type", "p_brand", "p_type")).alias("objects"))
    one = p.where("p_size > 40").select(F.concat(F.lit("g"), n % 3).alias("group_id"), F.col("p_partkey").alias("rule_id"), F.lit(1).alias("ord"))
    return W.cluster_rules(rules, one.unionByName(one.withColumns({"group_id": F.lit("later"), "ord": F.lit(2)})))


@query("""WITH x AS (SELECT doc_id AS id, max(quality) = 1 AS found FROM labels GROUP BY 1), l AS (SELECT DISTINCT d.doc_id % 40 AS case_id, x.id, found FROM documents AS d JOIN x ON x.id = d.doc_id WHERE d.doc_id % 40 % 3 <> 0)
  SELECT c.case_id, round(coalesce(avg(found::INT), (SELECT avg(found::INT) FROM x)), 9) AS coverage FROM (SELECT DISTINCT doc_id % 40 AS case_id FROM documents) AS c LEFT JOIN l USING (case_id) GROUP BY 1""")
def a5_use_case_coverage(spark, d):
    case = (F.col("doc_id") % 40).alias("case_id")
    expected = read(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg((F.max("quality") == 1).alias("found"))
    docs = read(spark, d, "documents").select(case, F.col("doc_id").alias("entity_id"))
    out = W.use_case_coverage(docs.where("case_id % 3 <> 0").distinct(), docs.select("case_id").distinct(), expected)
    return out.select("case_id", F.round("coverage", 9).alias("coverage"))


@query("""SELECT l_orderkey AS node_id, l_linenumber AS ord, 'quote_unverified' AS issue FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_linenumber, 'missing_source' FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 2 = 0 AND o_orderstatus = 'F' AND l_linenumber % 2 = 0""")
def v2_citation_issues(spark, d):
    n = F.col("l_linenumber")
    cites = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("node_id"), n.alias("ord"), F.when(F.col("l_returnflag") == "R", False).when(F.col("l_returnflag") == "A", True).alias("verified"), F.when(n % 2 == 1, F.array(F.lit(1).cast("bigint"))).otherwise(F.array().cast("array<bigint>")).alias("sentence_refs"))
    nodes = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "rule").otherwise("object").alias("kind"), F.when(F.col("o_orderstatus") == "F", "extracted").otherwise("human").alias("provenance"))
    return W.citation_issues(cites, nodes)


@query("""WITH m AS (SELECT p_partkey AS i, p_partkey % 9 AS k FROM part)
  SELECT i AS index, '#' || i AS node_id, 'item_not_object' AS kind, 'error' AS level, '' AS field, NULL AS fix FROM m WHERE k = 0
  UNION ALL SELECT i, '#' || i, 'missing_field', 'error', 'id', '"objectType:part-' || i || '"' FROM m WHERE k = 1
  UNION ALL SELECT i, 'rule:p' || i, 'bad_id_prefix', 'warn', 'id', '"objectType:p' || i || '"' FROM m WHERE k = 2
  UNION ALL SELECT i, 'objectType:p' || i, 'missing_field', 'warn', f, x FROM m, (VALUES (3, 'confidence', '0.5'), (3, 'sources', '[]'), (4, 'reviewState', '"pending"'), (4, 'provenance', '"human"'), (5, 'nameZh', '"Part"')) AS v(kk, f, x) WHERE k = kk
  UNION ALL SELECT i, 'objectType:p' || i, 'bad_enum', 'error', f, x FROM m, (VALUES (6, 'reviewState', '"accepted"'), (6, 'provenance', '"human"'), (7, 'properties.1.type', '"Integer"')) AS v(kk, f, x) WHERE k = kk
  UNION ALL SELECT i, 'objectType:p' || i, 'reference_without_target', 'error', 'properties.0.references', NULL FROM m WHERE k = 8""")
def v15_suggest_fixes(spark, d):
    k, i = F.col("p_partkey") % 9, F.col("p_partkey").cast("string")
    field = lambda when, text: F.when(when, text)
    parts = F.concat_ws(
        ", ",
        F.when(k == 1, F.concat(F.lit('"name": "Part '), i, F.lit('"'))).otherwise('"name": "Part"'),
        F.when(k == 2, F.concat(F.lit('"id": "rule:p'), i, F.lit('"'))).when(k != 1, F.concat(F.lit('"id": "objectType:p'), i, F.lit('"'))),
        field(k != 3, '"confidence": 1'), field(k != 3, '"sources": []'), field(k != 5, '"nameZh": "件"'),
        F.when(k == 6, '"reviewState": "accept"').when(k != 4, '"reviewState": "pending"'), F.when(k == 6, '"provenance": "Humn"').when(k != 4, '"provenance": "human"'),
        F.when(k == 7, '"properties": [{"type": "List<X>"}, {"type": "Integr"}]').when(k == 8, '"properties": [{"name": "a", "type": "String", "is_foreign_key": true}]'),
    )
    items = read(spark, d, "part").select(F.col("p_partkey").alias("index"), F.when(k == 0, "[1]").otherwise(F.concat(F.lit("{"), parts, F.lit("}"))).alias("item"))
    return W.suggest_fixes(items, "objects")


@query("SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS columns FROM lineitem GROUP BY 1")
def a16_ordered_keys(spark, d):
    k = M.ordered_keys(read(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_partkey")
    return k.select("l_orderkey", F.array_join(F.col("columns").cast("array<string>"), ",").alias("columns"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def k4_latest_version(spark, d):
    return M.latest(read(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("""WITH c AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL), l AS (SELECT *, n - lag(n, 1, 0) OVER (PARTITION BY user_id ORDER BY day) AS x FROM c)
  SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n, greatest(x, 0) AS added, greatest(-x, 0) AS removed FROM l""")
def a19_version_delta(spark, d):
    c = read(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
    return M.version_delta(c, "user_id", "day").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "added", "removed")


@query("""WITH s AS (SELECT p_partkey AS id, lower(p_name) AS key FROM part WHERE p_partkey % 2 = 0), c AS (SELECT p_partkey + (p_partkey % 3) AS id, lower(p_name) AS key, p_partkey AS ord FROM part),
  f AS (SELECT * FROM c WHERE key NOT IN (SELECT key FROM s) AND id NOT IN (SELECT id FROM s)), g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1),
  h AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1) SELECT id, key FROM s UNION ALL SELECT id, key FROM h""")
def u3_merge_preserve(spark, d):
    p = read(spark, d, "part")
    snapshot = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("key"), F.col("p_partkey").alias("ord"))
    current = p.select((F.col("p_partkey") + F.col("p_partkey") % 3).alias("id"), F.lower("p_name").alias("key"), F.col("p_partkey").alias("ord"))
    return M.merge_preserve(snapshot, current, F.col("key")).select("id", "key")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def u5_last_wins(spark, d):
    p = read(spark, d, "part").select("p_partkey")
    return M.last_wins([p.where("p_partkey % 2 = 0").withColumn("v", F.lit("old")), p.where("p_partkey % 3 = 0").withColumn("v", F.lit("new"))], "p_partkey")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 10 = 3 THEN l_partkey - 1 ELSE l_partkey END AS l_partkey FROM lineitem")
def j15_remap(spark, d):
    moved = read(spark, d, "part").where("p_partkey % 10 = 3").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") - 1).alias("new"))
    return M.remap(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_partkey"], moved)


@query("SELECT l_partkey, l_orderkey, l_linenumber, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 8")
def l4_topk_per_group(spark, d):
    return M.top_per_group(read(spark, d, "lineitem"), ["l_partkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 8).select("l_partkey", "l_orderkey", "l_linenumber", "rank")


# Graph --------------------------------------------------------------------------------------------

def key(prefix, c):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def star_triples(spark, d, put=G.project):
    r, n, c, o, s = (read(spark, d, t) for t in ("region", "nation", "customer", "orders", "supplier"))
    return put(
        [
            G.triples(r, key("region:", "r_regionkey"), "label", F.col("r_name"), True),
            G.triples(n, key("nation:", "n_nationkey"), "label", F.col("n_name"), True),
            G.triples(n, key("nation:", "n_nationkey"), "references", key("region:", "n_regionkey")),
            G.triples(c, key("customer:", "c_custkey"), "references", key("nation:", "c_nationkey")),
            G.triples(s, key("supplier:", "s_suppkey"), "references", key("nation:", "s_nationkey")),
            G.triples(o, key("customer:", "o_custkey"), "emits", key("order:", "o_orderkey")),
            G.triples(o, key("order:", "o_orderkey"), "severity", F.col("o_orderpriority"), True),
        ]
    )


TRIPLES = """t AS (SELECT DISTINCT * FROM (SELECT 'region:' || r_regionkey AS s, 'label' AS p, r_name AS o, true AS literal FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'label', n_name, true FROM nation
  UNION ALL SELECT 'nation:' || n_nationkey, 'references', 'region:' || n_regionkey, false FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'references', 'nation:' || c_nationkey, false FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'references', 'nation:' || s_nationkey, false FROM supplier UNION ALL SELECT 'customer:' || o_custkey, 'emits', 'order:' || o_orderkey, false FROM orders
  UNION ALL SELECT 'order:' || o_orderkey, 'severity', o_orderpriority, true FROM orders) WHERE s IS NOT NULL AND o IS NOT NULL)"""


@query("WITH " + TRIPLES + " SELECT s, p, o, literal FROM t")
def g1_triples(spark, d):
    return star_triples(spark, d)


@query("WITH " + TRIPLES + " SELECT p, count(*) AS n FROM t GROUP BY p")
def a1_predicate_counts(spark, d):
    return G.predicate_counts(star_triples(spark, d))


@query("WITH " + TRIPLES + """, a AS (SELECT s AS node, o AS other, s, p, o, literal FROM t UNION ALL SELECT o, s, s, p, o, literal FROM t WHERE NOT literal AND s <> o),
  e AS (SELECT DISTINCT s, p, o, 0 AS prio FROM a WHERE node = 'nation:3' AND NOT literal), x AS (SELECT DISTINCT other AS node FROM a WHERE node = 'nation:3' AND NOT literal AND other <> 'nation:3'),
  n AS (SELECT DISTINCT s, p, o, 1 AS prio FROM a JOIN x USING (node) WHERE literal AND p IN ('label', 'kind')), l AS (SELECT DISTINCT s, p, o, 2 AS prio FROM a WHERE node = 'nation:3' AND literal),
  z AS (SELECT s, p, o, min(prio) AS prio FROM (SELECT * FROM e UNION ALL SELECT * FROM n UNION ALL SELECT * FROM l) GROUP BY ALL) SELECT s, p, o, prio FROM z ORDER BY prio, s, p, o LIMIT 150""")
def l2_priority_topk(spark, d):
    t = star_triples(spark, d, G.every)
    return G.frontier_batch(t, spark.createDataFrame([("nation:3",)], "node string"), t.limit(0))


@query("WITH RECURSIVE " + TRIPLES + """, e AS (SELECT s AS a, o AS b FROM t WHERE NOT literal UNION SELECT o, s FROM t WHERE NOT literal),
  w(node, hop) AS (SELECT 'region:1', 0 UNION SELECT b, hop + 1 FROM w JOIN e ON a = node WHERE hop < 3) SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM w GROUP BY node""")
def g4_multi_hop(spark, d):
    seeds = spark.createDataFrame([("region:1",)], "node string")
    return G.hops(star_triples(spark, d, G.every), seeds, 3, tables.keep)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS path_id, 3 AS hops, CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 2 END AS held, o_orderkey % 2 = 0 AS valid FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def g6_path_verify(spark, d):
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    end = F.when(F.col("o_orderkey") % 2 == 0, key("region:", "n_regionkey")).otherwise("region:none")
    path = F.array(key("order:", "o_orderkey"), F.lit("emits"), key("customer:", "c_custkey"), F.lit("references"), key("nation:", "n_nationkey"), F.lit("references"), end)
    out = G.check_paths(star_triples(spark, d, G.every), o.select(F.col("o_orderkey").cast("string").alias("path_id"), path.alias("path")), G.PREDICATES)
    return out.select("path_id", F.col("hops").cast("int").alias("hops"), F.col("held").cast("int").alias("held"), "valid")


@query("""WITH f AS (SELECT user_id, event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events)
  SELECT source, target, count(*) AS n, count(DISTINCT user_id) AS cases FROM f WHERE target IS NOT NULL GROUP BY ALL""")
def t6_directly_follows(spark, d):
    return G.directly_follows(read(spark, d, "events"), "user_id", "ts", "event_type", "event_id")
