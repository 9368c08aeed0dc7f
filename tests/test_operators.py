"""Small cases of operators that the driver's tables do not show."""

import json
import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provenir.engine import Engine
from provenir.functions import jsonfix
from provenir.functions import text as T
from provenir.operators import enrich, graph, grounding, integrity, layers, matching, project, segment, suggest
from provenir.sources import ddl, documents
from provenir.streaming import follow


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f("c").alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, want",
    [("a\r\nb\rc", "a\nb\nc"), ("﻿a​ b", "a b"), ("a  \tb  \n  c", "a b\nc"), ("a\n\n\n\nb", "a\n\nb"), ("  ", "")],
)
def test_normalize_whitespace(spark, raw, want):
    assert one(spark, raw, T.normalize_whitespace) == want


@pytest.mark.parametrize("raw, want", [("Order Line", "order-line"), ("--A..b--", "a.b"), ("!!!", "x"), (None, "x"), ("a  &  b", "a-b")])
def test_slug(spark, raw, want):
    assert one(spark, raw, T.slugify) == want


def test_marks_fold(spark):
    assert one(spark, "Éclair ﬁn", lambda c: T.slugify(T.fold_marks()(c))) == "eclair-fin"


@pytest.mark.parametrize("t, ok", [("String", True), ("List<List<Integer>>", True), ("List<Integer", False), ("Integer>", False), ("Text", False)])
def test_list_types(spark, t, ok):
    assert one(spark, t, T.is_list_type) is ok


def test_word_and_tags(spark):
    row = spark.sql("SELECT 'status_x = status' AS a, 'status' AS w, 'x' AS v").select(T.has_word("a", "w").alias("p"), T.has_word("a", "v").alias("q")).first()
    assert row["p"] and not row["q"]
    assert one(spark, "<p>a&#65;&amp;b</p><script>x</script>c<br/>d", T.strip_tags).split() == ["aA&b", "c", "d"]


def test_clamp(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-1.0,), (0.3,), (7.0,)], "c double")
    assert [r[0] for r in df.select(T.clamp01("c")).collect()] == [0.0, 0.0, 0.0, 0.0, 0.3, 1.0]


def scan(text):
    """Coverage spans by a character scanner, for comparison."""
    out, start, i = [], 0, 0

    def push(a, b):
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))

    while i < len(text):
        if text[i] in "\r\n":
            push(start, i)
            start = i + 1
        elif text[i] in "。！？；" or text[i] in ".!?;" and i + 1 < len(text) and text[i + 1].isspace():
            push(start, i + 1)
            start = i + 1
        i += 1
    push(start, len(text))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab .!?;\n\r\t。！ 数3"), max_size=40))
def test_spans(text):
    assert list(segment.spans(text)) == scan(text)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Dr. Who paid 3.14. Then he left!", ["Dr. Who paid 3.14.", "Then he left!"]),
        ("One.\n\nTwo\nmore", ["One.", "Two\nmore"]),
        ('He said "stop." Yes. A. Smith came', ['He said "stop."', "Yes.", "A. Smith came"]),
        ("第一句。 第二句！", ["第一句。", "第二句！"]),
    ],
)
def test_careful_spans(text, want):
    assert [text[a:b] for a, b in segment.careful_spans(text)] == want


def test_aligned_chunks_cover():
    text = " ".join(f"Sentence number {i} is here." for i in range(200))
    chunks = list(segment.aligned_chunks(1000, 100)(text))
    assert chunks[0][0] == 0 and chunks[-1][1] == len(text)
    assert all(b[0] <= a[1] + 1 and b[0] > a[0] for a, b in zip(chunks, chunks[1:]))
    assert all(b - a <= 1100 for a, b in chunks)


@pytest.mark.parametrize("text, flag", [("", True), ("3.2 ", True), ("***", True), ("Two words", True), ("Three words here", False), ("数据质量管理规则", False), ("数据", True)])
def test_boilerplate(spark, text, flag):
    assert one(spark, text, segment.is_boilerplate) is flag


def test_mint_ids_with_natural_suffixes(spark):
    names = ["x", "x", "x-2", "X", "y", "x-2", "y"]
    df = spark.createDataFrame(list(enumerate(names)), "k int, n string")
    got = [r["id"] for r in matching.mint_ids(df, "n", "k").orderBy("k").collect()]
    taken, want = set(), []
    for n in names:
        base = f"objectType:{n.lower()}"
        c, k = base, 2
        while c in taken:
            c, k = f"{base}-{k}", k + 1
        taken.add(c)
        want.append(c)
    assert got == want


def test_grounding_tiers(spark):
    docs = spark.createDataFrame([(1, "The Quick\n brown fox jumps over the lazy dog today"), (2, "nothing")], "doc_id bigint, text string")
    quotes = spark.createDataFrame([(1, "brown fox"), (2, "the quick brown"), (3, "quick brown fox jumps over the very lazy dog today"), (4, "absent words only")], "item_id bigint, text string")
    got = {r["item_id"]: r for r in Engine(spark).ground(quotes, docs).collect()}
    text = "The Quick\n brown fox jumps over the lazy dog today"
    assert got[1]["tier"] == "exact" and text[got[1]["char_start"] : got[1]["char_end"]] == "brown fox"
    assert got[2]["tier"] == "normalized" and text[got[2]["char_start"] : got[2]["char_end"]] == "The Quick\n brown"
    assert got[3]["tier"] == "fuzzy" and not got[3]["verified"] and 4 not in got


def test_contains_pairs(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "gamma")], "d bigint, t string")
    quotes = spark.createDataFrame([(1, "pha beta gam"), (2, "gamma"), (3, "zzz")], "q bigint, t string")
    got = {(r["d"], r["q"]) for r in grounding.contains_pairs(quotes, docs, "q", "d", "t", "t").collect()}
    assert got == {(1, 1), (1, 2), (2, 2)}


def test_cover_counts_each_pair_once(spark):
    s = spark.createDataFrame([(1, 0, "a", 0, 600), (1, 1, "b", 601, 700), (2, 0, "c", 0, 10)], "document_id bigint, idx int, text string, char_start int, char_end int")
    i = spark.createDataFrame([(1, 9, 500, 650), (1, 8, 0, 5), (1, 7, 600, 601)], "document_id bigint, node_id bigint, char_start int, char_end int")
    got = {(r["document_id"], r["idx"]): r["covered_by"] for r in grounding.cover(s, i).collect()}
    assert got == {(1, 0): [8, 9], (1, 1): [9], (2, 0): None}


def test_verdicts_fail_closed(spark):
    c = spark.createDataFrame([(1, 0, "some real words here", None), (1, 1, "other real words here", None), (1, 2, "1.2", None), (1, 3, "x", [4])], "document_id bigint, idx int, text string, covered_by array<bigint>")
    v = spark.createDataFrame([(1, 0, "partial"), (1, 1, "made up")], "document_id bigint, idx int, verdict string")
    assert [r["status"] for r in grounding.coverage_status(c, v).orderBy("idx").collect()] == ["partial", "uncovered", "uncoverable", "covered"]


@pytest.mark.parametrize(
    "bad, want",
    [
        ("{'a': 1, b: True,}", {"a": 1, "b": True}),
        ('{"a": [1 2, 3,], /* c */ "b": None; "c": "x" "d": undefined}', {"a": [1, 2, 3], "b": None, "c": "x", "d": None}),
        ("﻿{“k”: ‘it\\’s’} // end", {"k": "it’s"}),
        ('{"u": "http://x/*y*/"}', {"u": "http://x/*y*/"}),
        ('{"a": 1', None),
        ("hello there", None),
    ],
)
def test_json_repair(bad, want):
    got = jsonfix.repair(bad)
    assert (json.loads(got) if got else None) == want


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8))
def test_valid_json_is_untouched(value):
    text = json.dumps(value)
    assert jsonfix.repair(text) == text
    broken = text.replace("]", ",]").replace("}", ",}") if not any(c in json.dumps(value, ensure_ascii=True) for c in ('"',)) else text
    assert json.loads(jsonfix.repair(broken)) == value


def test_ddl_facts(spark):
    sql = """
    -- a comment; with a semicolon
    CREATE TABLE IF NOT EXISTS "Shop"."item" (id bigint NOT NULL, price numeric(10,2) DEFAULT 0 CHECK (price >= 0), kind varchar(9), tags text[], note text DEFAULT 'a;b');
    ALTER TABLE ONLY "Shop".item ADD CONSTRAINT pk PRIMARY KEY (id), ADD CONSTRAINT k CHECK (((kind)::text = ANY (ARRAY['a'::text, 'b'::text])));
    COMMENT ON COLUMN "Shop".item.kind IS 'it''s';
    CREATE VIEW v AS SELECT id FROM item WHERE kind <> 'a';
    USE `other`; CREATE TABLE `t` (`e` enum('x','y') COMMENT 'z', KEY i (`e`), UNIQUE KEY u (`e`)) ENGINE=InnoDB COMMENT='tt';
    CREATE TABLE oops (
    """
    rows = {(r["kind"], r["table"], r["name"]): r for r in ddl.parse_ddl(spark.createDataFrame([("f", sql)], "file string, sql string")).collect()}
    assert rows["column", "item", "id"]["sql_type"] == "bigint" and not rows["column", "item", "id"]["nullable"]
    assert rows["column", "item", "price"]["sql_type"] == "numeric(10,2)" and rows["column", "item", "tags"]["sql_type"] == "text[]"
    assert rows["column", "item", "kind"]["enum_values"] == ["a", "b"] and rows["column", "item", "kind"]["comment"] == "it's"
    assert rows["column", "item", "note"]["default"] == "'a;b'"
    assert rows["primary_key", "item", "pk"]["columns"] == ["id"] and rows["view", "v", None]["expression"].startswith("SELECT id")
    assert rows["column", "t", "e"]["schema"] == "other" and rows["table", "t", None]["comment"] == "tt" and rows["unique", "t", "u"]["columns"] == ["e"]
    assert ("error", None, None) in rows


def test_seed_evidence_holds_its_lines(spark):
    sql = "CREATE TABLE a (a_id int PRIMARY KEY, n text); CREATE TABLE b (b_id int PRIMARY KEY, a_id int REFERENCES a (a_id), UNIQUE (a_id, b_id));"
    e = Engine(spark)
    model = e.seed(e.upload_schema(spark.createDataFrame([("f", sql)], "file string, sql string")))
    text = model["evidence"].first()["text"]
    assert text.splitlines()[0] == "TABLE public.a" and "  FOREIGN KEY a_id -> public.a" in text
    assert model["relationships"].count() == 1 and model["rules"].count() == 1
    assert {r["type"] for r in model["properties"].collect()} == {"Integer", "String"}
    assert e.preview(e.upload_schema(spark.createDataFrame([("f", sql)], "file string, sql string"))).first()["table"] == 2


def test_catalog_rows_of_any_case(spark):
    df = spark.createDataFrame([("s", "t", "c", "int", "NO", 1)], "TABLE_SCHEMA string, Table_Name string, column_name string, DATA_TYPE string, is_nullable string, ORDINAL_POSITION int")
    row = ddl.from_catalog(df).first()
    assert (row["table"], row["sql_type"], row["nullable"], row["ord"]) == ("t", "int", False, 1)


def test_integrity(spark):
    model = {
        "object_type": spark.createDataFrame([("obj-a",)], "id string"),
        "relationship": spark.createDataFrame([("r1", "obj-a", "obj-z"), ("r2", None, "obj-a")], "id string, source string, target string"),
        "process_object": spark.createDataFrame([("p", ["obj-a", "obj-q"])], "process_id string, object_id array<string>"),
    }
    got = {(r["owner"], r["from_id"], r["field"], r["missing_id"]) for r in integrity.dangling(model, integrity.MODEL_PATHS).collect()}
    assert got == {("relationship", "r1", "target", "obj-z"), ("process_object", "p", "object_id", "obj-q")}


def test_versions_and_deletes(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    nodes = spark.createDataFrame([("object", "obj-a", None), ("rule", "rule-b", "rejected")], "kind string, id string, review string")
    assert e.list().count() == 0
    assert e.save("m", "Model", "retail", nodes) == 1 and e.save("m", "Model", "retail", nodes.limit(1)) == 2
    assert e.get("m")["version"] == 2 and e.get("m", 1)["nodes"] == 2
    assert e.store.nodes("m", 1).count() == 2 and [r["version"] for r in e.list("retail").collect()] == [2]
    assert e.publish("m", exclude_rejected=True) == 3 and e.get("m")["status"] == "published"
    e.delete("m")
    assert e.list().count() == 0 and e.get("m")["version"] == 3
    e.save("m", "Model", "retail", nodes)
    assert e.list().count() == 1
    e.store.log("run", "begun")
    assert e.store.run_log().first()["message"] == "begun"


def test_graph_export(spark, tmp_path):
    nodes = spark.createDataFrame([("Object", "a"), ("Object", "a"), ("Rule", "b")], "label string, id string")
    edges = spark.createDataFrame([("applies", "b", "a"), ("applies", "b", "a"), ("applies", "b", "gone")], "type string, source string, target string")
    Engine(spark).import_graph(nodes, edges, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/nodes").count() == 2 and spark.read.parquet(f"{tmp_path}/edges").count() == 1


def test_documents(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>Hello&nbsp;there</p><style>x</style>")
    (tmp_path / "b.txt").write_text("plain\r\n text")
    import zipfile

    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>One</w:t></w:p><w:p><w:t>Two</w:t></w:p>")
    got = {r["name"]: (r["format"], r["text"]) for r in documents.read_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.html": ("html", "Hello there"), "b.txt": ("text", "plain\ntext"), "c.docx": ("docx", "One\nTwo")}
    assert one(spark, "postgres://u:secret@h/db password=abc", documents.redact) == "postgres://u:***@h/db password=***"


class Flaky:
    name = "flaky"

    def complete(self, prompt):
        if prompt == "config":
            raise enrich.ConfigError("no key")
        if prompt == "bad":
            raise RuntimeError("down")
        return f"<{prompt}>"


def test_prompts_degrade(spark):
    df = spark.createDataFrame([("1", "ok"), ("2", "bad"), ("3", "config")], "id string, prompt string")
    got = {r["id"]: (r["reply"], r["error"]) for r in enrich.run_prompts(df, Flaky(), wait=0).collect()}
    assert got == {"1": ("<ok>", None), "2": (None, "down"), "3": (None, "no key")}
    docs = spark.createDataFrame([(1, "Clerks must sign. Goods may not leave. The sky is blue.")], "doc_id bigint, text string")
    assert [r["kind"] for r in enrich.rules_stub(docs).orderBy("idx").collect()] == ["obligation", "prohibition"]


def test_projections(spark, tmp_path):
    ids = spark.createDataFrame([("ruleGroup:a",), ("rule:a",), ("event:x",), ("zzz",)], "id string")
    assert [r[0] for r in ids.select(project.layer_of("id")).collect()] == ["rule_groups", "rules", "events", None]
    inputs = spark.createDataFrame([("act", "n", "Integer", True, False, "d"), ("act", "m", "String", False, True, None)], "a string, name string, type string, required boolean, many boolean, description string")
    row = project.parameter_schema(inputs, "a").first()
    assert row["required"] == ["n"] and row["properties"]["m"]["type"] == "array"
    r = spark.createDataFrame([("r1", "INSERT INTO shop.a VALUES (1); update b set x = 1; DELETE FROM a")], "id string, body string")
    t = spark.createDataFrame([("shop", "a", "obj-a", 2), ("old", "a", "obj-o", 1), ("shop", "b", "obj-b", 3)], "schema string, table string, id string, ord int")
    assert {tuple(x)[1:] for x in project.side_effects(r, t).collect()} == {("db_write", "obj-a"), ("state_change", "obj-b"), ("state_change", "obj-o")}
    rules = spark.createDataFrame([("r", " ", "Pay first. Then ship"), ("q", "Title", "x")], "id string, title string, statement string")
    assert [x[1] for x in project.spec_rules(rules).collect()] == ["Pay first", "Title"]
    folder = tmp_path / "rules"
    project.write_layer(project.layer_file(rules, "rules", "p", 2, "id"), str(folder))
    content = json.loads("".join(p.read_text() for p in sorted(folder.glob("part-*"))))
    assert content["metadata"]["version"] == 2 and [r["id"] for r in content["rules"]] == ["q", "r"]


def test_hops_and_paths(spark):
    t = spark.createDataFrame([("a", "emits", "b", False), ("b", "emits", "c", False), ("c", "label", "C", True), ("d", "emits", "d", False)], "s string, p string, o string, literal boolean")
    assert {(r["node"], r["hop"]) for r in graph.hops(t, spark.createDataFrame([("c",)], "node string"), 5, lambda df, _: df.cache()).collect()} == {("c", 0), ("b", 1), ("a", 2)}
    paths = spark.createDataFrame([("1", ["a", "emits", "b", "emits", "c"]), ("2", ["a", "emits", "c"])], "path_id string, path array<string>")
    assert {r["path_id"]: r["valid"] for r in graph.check_paths(t, paths, graph.PREDICATES).collect()} == {"1": True, "2": False}


def test_streams(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 0, m), e) for m, e in ((1, "a"), (2, "b"), (3, "a"))] + [(2, datetime(2024, 1, 1, 0, 5), "a"), (2, datetime(2024, 1, 1, 1, 5), "b")]
    schema = "user_id bigint, ts timestamp, event_type string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("counts", follow.windowed_counts(stream()), "complete"), ("pairs", follow.follow_pairs(stream()), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(90)
    assert sum(r["n"] for r in spark.table("counts").collect()) == 5
    assert sorted(tuple(r) for r in spark.table("pairs").collect()) == [("a", "b"), ("a", "b"), ("b", "a")]


def test_drained_stream_holds_closed_windows_only(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h, m), "a") for h, m in ((0, 5), (0, 50), (1, 0), (2, 0), (3, 30))]
    spark.createDataFrame(rows, "ts timestamp, event_type string").write.parquet(str(tmp_path / "seen.parquet"))
    got = follow.drained(follow.windowed_counts(follow.arrivals(spark, str(tmp_path), "seen")), "w")
    assert sorted((r["start"].hour, r["n"]) for r in got.collect()) == [(0, 2)]  # the watermark stands at 1:30
    spark.createDataFrame([], "ts timestamp, event_type string").write.parquet(str(tmp_path / "none.parquet"))
    assert follow.drained(follow.windowed_counts(follow.arrivals(spark, str(tmp_path), "none")), "w").count() == 0


def test_merge_and_remap(spark):
    old = spark.createDataFrame([("1", "a", 0), ("2", "", 1)], "id string, name string, ord int")
    new = spark.createDataFrame([("1", "zz", 0), ("3", "a", 1), ("4", "b", 2), ("5", "b", 3), ("2", "", 4), ("6", "", 5)], "id string, name string, ord int")
    got = sorted(r["id"] for r in matching.merge_preserve(old, new, F.col("name")).collect())
    assert got == ["1", "2", "4", "6"]
    moved = spark.createDataFrame([("1", "9")], "old string, new string")
    assert {tuple(r) for r in matching.remap(spark.createDataFrame([("1", "2"), ("2", "1")], "a string, b string"), ["a", "b"], moved).collect()} == {("9", "2"), ("2", "9")}


def brute_numbers(names, mark):
    """The rule itself: the first free one of name, name-2, name-3, ... in order."""
    taken, out = set(), []
    for n in names:
        i, k = n, 1
        while i in taken:
            k += 1
            i = f"{n}{mark}{k}"
        taken.add(i)
        out.append(i)
    return out


@pytest.mark.parametrize("mark", ["-", ""])
def test_numbers_by_the_rule(spark, mark):
    rng = random.Random(7)
    for words in (["x", "x-2", "x-3", "x-2-2", "y"], ["x", "x1", "x2", "x12", "x02", "12", "2"], ["a", "a-2", "a2", "a-10", "a10", "a-010"]):
        names = [rng.choice(words) for _ in range(60)] + [f"{words[0]}{mark}{k}" for k in range(2, 30)] + [words[0]] * 40
        rng.shuffle(names)
        got = matching.numbered(spark.createDataFrame(list(enumerate(names)), "at int, name string").repartition(3), F.col("name"), "at", "id", mark)
        assert [r["id"] for r in got.orderBy("at").collect()] == brute_numbers(names, mark)


def test_names_of_one_stem_are_no_group(spark):
    """Names that only look numbered are counted like all others; a name that numbering can meet is not."""
    rows = spark.range(20_000).select(F.col("id").alias("at"), F.format_string("Customer#%09d", "id").alias("plain"), F.concat(F.lit("item-"), (F.col("id") + 2).cast("string")).alias("dashed"))
    for column, mark in (("plain", ""), ("plain", "-"), ("dashed", "-")):
        bases = rows.groupBy(F.col(column).alias("_base")).agg(F.count("*").alias("_n"))
        assert matching.contested(bases, mark).count() == 0
    more = rows.select(F.col("dashed").alias("_base")).union(spark.createDataFrame([("item",)] * 3, "_base string")).groupBy("_base").agg(F.count("*").alias("_n"))
    # Three rows pass over all names before them, so all can be met; with gaps only those before the third gap.
    assert matching.contested(more, "-").count() == 20_001
    gaps = more.where("_base = 'item' OR CAST(substring(_base, 6) AS INT) % 3 = 0")
    assert sorted(r["_base"] for r in matching.contested(gaps, "-").collect()) == ["item", "item-3"]


def test_budgets_by_lengths_alone(spark):
    rng = random.Random(3)
    rows = [(g, k, "x" * rng.choice([0, 0, 3, 9, 40])) for g in ("a", "b", None) for k in range(150)] + [("c", 1, "x" * 500), ("c", 2, "y"), ("d", 1, None), ("d", 2, "z")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, t string").repartition(4)
    want, cut = set(), {}
    for g in ("a", "b", None, "c", "d"):
        own, total = sorted((k, t) for x, k, t in rows if x == g and t is not None), 0
        for k, t in own:
            total += len(t)
            if total <= 100:
                want.add((g, k, total))
        cut[g] = "|".join(t for _, t in own)[:100]
    got = segment.budget_prefix(df.where("t IS NOT NULL"), 100, "g", "k", "t")
    assert {(r["g"], r["k"], r["running"]) for r in got.collect()} == want
    assert {r["g"]: r["excerpt"] for r in layers.excerpt(df.where("t IS NOT NULL"), "g", "k", "t", 100, "|").collect()} == cut
    near = segment.starts_within(df.where("t IS NOT NULL"), "g", "k", F.length("t"), 100)
    assert near.count() < 150


def test_a_closed_vocabulary_is_small(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "w string")
    assert suggest.closed_vocabulary(rows, "w") == ["a", "b"]
    with pytest.raises(ValueError):
        suggest.closed_vocabulary(rows, "w", 1)


def test_candidates_hold_both_sure_tiers(spark):
    """Words part at ASCII marks alone; one lookup serves the text as it is and the normalised one, final sigma and quotations without an inner word too."""
    said = ["before ΟΔΟΣ'Α ΤΗΣ ΝΕΑΣ after", "x Größe der  Straße, heute y", "one.two..three four", "ΟΔΟΣΑ", "a   b", "none"]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    quotes = spark.createDataFrame([(0, "ΟΔΟΣ'Α ΤΗΣ"), (1, "größe der straße, heute"), (2, ".two..three "), (3, "ΟΔΟΣ"), (4, "   "), (5, "Größe der  Straße, heute")], "item_id long, text string")
    pairs = {tuple(r) for r in grounding.candidates(quotes, docs, "item_id", "doc_id", "text", "text", T.normalize_search, F.col).select("doc_id", "item_id").collect()}
    exact = {(i, k) for k, q in quotes.collect() for i, t in enumerate(said) if q in t}
    assert (3, 3) in exact and exact | {(1, 1)} <= pairs
    found = {(r["doc_id"], r["item_id"]): r["tier"] for r in Engine(spark).ground(quotes, docs).collect()}
    assert {p for p, tier in found.items() if tier == "exact"} == exact and found[1, 1] == "normalized"


def test_plain_sentences_are_no_boilerplate(spark):
    """The quick search agrees with the full rule wherever it finds three words."""
    texts = ["One two three", "one two", "1 2 3", "1. a 2", "- x × y", "Über das Maß hinaus", "第1章 a b", "a b c", "(a) b c", "", "× ÷ ×"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r[0] == r[1] for r in df.select(segment.is_boilerplate("t"), segment.short_of_words("t")).collect())


def test_repeated_triples_make_no_difference(spark):
    """Paths and batches take triples as they come; an edge is one row for both directions, and a missing end is no edge."""
    rows = [("a", "label", "b", False), ("a", "label", "b", False), ("a", "label", "n", True), ("c", "kind", "c", False), (None, "kind", "d", False)]
    t = graph.every([spark.createDataFrame(rows[:2], "s string, p string, o string, literal boolean"), spark.createDataFrame(rows[2:], "s string, p string, o string, literal boolean")])
    paths = spark.createDataFrame([("1", ["b", "label", "a"]), ("2", ["c", "kind", "c"]), ("3", ["d", "kind", "d"]), ("4", [None, "kind", "c"]), ("5", ["a", "label", "n"])], "path_id string, path array<string>")
    out = graph.check_paths(t, paths, ["label", "kind"])
    assert {(r["path_id"], r["held"], r["valid"]) for r in out.collect()} == {("1", 1, True), ("2", 1, True), ("3", 0, False), ("4", 0, False), ("5", 0, False)}
    batch = graph.frontier_batch(t, spark.createDataFrame([("b",)], "node string"), t.limit(0))
    assert [tuple(r) for r in batch.collect()] == [("a", "label", "b", 0), ("a", "label", "n", 1)]


def test_walk_and_paths_do_not_drop_repeated_triples_first(spark):
    from provenir.plans import catalogue

    for name in ("l2_priority_topk", "g6_path_verify"):
        assert "first(literal" not in catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
