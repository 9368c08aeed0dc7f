"""A resumable run, and cases that tell two readings of an operator apart."""

import json

import pytest
from pyspark.sql import functions as F

from provenir.functions import text as T
from provenir.operators import grounding, layers, matching, project, segment, stages
from provenir.operators import model as O


def test_run_goes_on_where_it_stopped(spark, tmp_path):
    broken = [True]

    def rules(before):
        if broken[0]:
            raise RuntimeError("no model")
        return before["objects"].select((F.col("id") + 1).alias("id"))

    steps = {"objects": lambda before: spark.range(3), "rules": rules, "actions": lambda before: before["rules"].where("id > 1")}
    run = lambda: stages.Run(spark, str(tmp_path), "r1", steps)
    assert run().run() == "error" and run().next_stage() == "rules"
    with pytest.raises(ValueError):
        run().step("actions")
    broken[0] = False
    assert run().step() == ("rules", "complete")
    assert run().run() == "complete" and run().step() == (None, "complete")
    assert [r["status"] for r in run().state()] == ["complete", "error", "complete", "complete"]
    assert sorted(r["id"] for r in run().layer("actions").collect()) == [2, 3]
    assert run().step("rules") == ("rules", "complete")  # one stage again


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f("c").alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("Pay now! Then go.", "Pay now"), ("a" * 61 + ".", "a" * 57 + "..."), ("a" * 60, "a" * 60), (".hidden", ".hidden"), ("", "Rule"), (None, "Rule"), ("one, two; three", "one, two")])
def test_title_seed(spark, raw, want):
    assert one(spark, raw, T.title_seed) == want


@pytest.mark.parametrize("raw, want", [("Order System", "system"), ("Subsystem", "system"), ("API docs", "system"), ("rapid", "data"), ("订单平台", "system"), ("server", "data")])
def test_object_class(spark, raw, want):
    assert one(spark, raw, O.object_class) == want


def test_unique_names_are_unique(spark):
    names = ["x", "x", "x2", "x", "y", "y1", "y"]
    df = spark.createDataFrame(list(enumerate(names)), "k int, n string")
    got = [r["unique_name"] for r in layers.unique_names(df, "n", "k").orderBy("k").collect()]
    assert got == ["x", "x2", "x22", "x3", "y", "y1", "y2"] and len(set(got)) == len(got)


def test_camel_of_long_words(spark):
    assert len(one(spark, "ab" * 700_000, T.camel)) == 1_400_000


def test_names_within_words(spark):
    terms = spark.createDataFrame([("t1", ["reorders"]), ("t2", ["xy"]), ("t3", ["zz", "scar tissue"])], "term_id string, keys array<string>")
    nodes = spark.createDataFrame([("n1", 1, "order"), ("n2", 2, "xyz"), ("n3", 3, "car"), ("n4", 4, "xy")], "node_id string, ord int, name string")
    assert {tuple(r) for r in matching.match_names(terms, nodes).collect()} == {("t1", "n1"), ("t2", "n4"), ("t3", "n3")}


def test_seeds_by_definition(spark):
    q = spark.createDataFrame([(1, "Which order orders the order?"), (2, "nothing here"), (3, "reorders it")], "q_id int, text string")
    n = spark.createDataFrame([("a.order", 1, "order order"), ("b", 2, "order"), ("c", 3, "reo")], "node_id string, ord int, label string")
    got = {(r["q_id"], r["node_id"]): r["score"] for r in matching.lexical_seeds(q, n).collect()}
    # The node's tokens count each time; a label that stands in the question, inside a word too, counts 2; a question without any gets the first nodes.
    assert got == {(1, "a.order"): 5, (1, "b"): 3, (3, "b"): 2, (3, "c"): 2, (2, "a.order"): 0, (2, "b"): 0, (2, "c"): 0}


def test_quotations_of_any_size(spark):
    docs = spark.createDataFrame([(1, "Alpha beta gamma delta epsilon, zeta."), (2, "xx alphabet"), (3, "")], "doc_id bigint, text string")
    quotes = spark.createDataFrame([(1, "pha beta gamma delta eps"), (2, "beta gamma"), (3, "alpha"), (4, ","), (5, "beta gamma delta nothing"), (6, ""), (7, "gamma delta epsilon")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["char_start"], r["char_end"]) for r in grounding.ground_exact(quotes, docs).collect()}
    text = "Alpha beta gamma delta epsilon, zeta."
    want = {(1, i): (text.index(q), text.index(q) + len(q)) for i, q in ((1, "pha beta gamma delta eps"), (2, "beta gamma"), (4, ","), (7, "gamma delta epsilon"))}
    assert got == want | {(2, 3): (3, 8)}
    assert grounding.ground_exact(quotes.limit(0), docs).count() == 0


def test_fuzzy_prefix_is_exact(spark):
    words = [f"word{i}" for i in range(10)]
    docs = spark.createDataFrame([(1, "a b " + " ".join(words[:8] + ["x", "y"]) + " c"), (2, " ".join(words[:7])), (3, " ".join(words[::-1]))], "doc_id bigint, text string")
    quotes = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    got = {r["doc_id"]: round(r["score"], 3) for r in grounding.ground_fuzzy(quotes, docs).collect()}
    assert got == {3: 1.0}


def test_numbering_with_wide_ids(spark):
    rows = spark.createDataFrame([(10**12, 0), (5, 1), (5, 0), (7 * 10**9, 0)], "doc bigint, pos int")
    got = {(r["doc"], r["pos"]): r["idx"] for r in segment.number_globally(rows, "doc", "pos").collect()}
    assert got == {(5, 0): 1, (5, 1): 2, (7 * 10**9, 0): 3, (10**12, 0): 4}


def test_ids_that_fix_themselves_do_not_collide(spark):
    df = spark.createDataFrame([(1, "rule:a"), (2, "objectType:A"), (3, "a!"), (4, None)], "k int, id string")
    got = {r["k"]: r["fixed"] for r in project.coerce_id(df, "id", "k", "rule:").collect()}
    assert got == {1: "rule:a", 2: "rule:a-2", 3: "rule:a-3", 4: "rule:x"}


def test_repair_within_its_budget():
    """Some 200 KB of unclosed objects: repaired or given up, and located, within a second and a half."""
    import time

    from provenir.functions import jsonfix

    text = "[" + ",\n".join('{"id": "node-%d", "name": "n"' % k for k in range(8000))
    commas = "[" + "\n".join('{"id": %d, "name": "n"}' % k for k in range(8000)) + "]"
    began = time.perf_counter()
    assert jsonfix.repair(text) is None and jsonfix.locate_error(text)
    assert jsonfix.repair(commas) is not None
    assert time.perf_counter() - began < 1.5


def test_paths_and_masks(spark):
    from provenir.functions import jsonfix

    assert jsonfix.set_path({"a": [1]}, ["a", 2, "b"], 5) == {"a": [1, None, {"b": 5}]}
    assert jsonfix.set_path("x", [], 1) == 1 and jsonfix.set_path(None, ["k"], 1) == {"k": 1}
    text = """{"a\\"b": 'c"d', "open"""
    mask, quote, escaped = [], None, False
    for ch in text:  # by the definition, one character after the other
        if quote:
            mask.append(True)
            escaped, quote = (False, quote) if escaped else (ch == "\\", quote if ch == "\\" or ch != quote else None)
        else:
            mask.append(ch in "\"'")
            quote = ch if ch in "\"'" else None
    spans = spark.createDataFrame([(text,)], "t string").select(jsonfix.mask_udf()("t").alias("m")).first()["m"]
    assert [k for k, m in enumerate(mask) if m] == [k for a, b in spans for k in range(a, b)]


def test_one_more_try_for_json():
    from provenir.operators import enrich

    class Client:
        name = "c"

        def __init__(self, *said):
            self.said = list(said)

        def complete(self, prompt):
            return self.said.pop(0)

    assert enrich.call_json(Client("Sure: {\"a\": 1} ok"), "p") == '{"a": 1}'
    assert enrich.call_json(Client("no", "[1]"), "p") == "[1]"
    assert enrich.call_json(Client("no", "neither"), "p") is None


def test_layer_schema(spark):
    from provenir.operators import published

    df = spark.createDataFrame([], "id string, n bigint, ok boolean, parts array<struct<x: double>>")
    doc = published.layer_schema(df, "^rule:")
    assert doc["items"]["properties"]["id"] == {"type": "string", "pattern": "^rule:"}
    assert doc["items"]["properties"]["parts"]["items"]["properties"]["x"]["type"] == "number"


def test_coverage_target():
    from provenir.operators.suggest import coverage_target

    assert [coverage_target(*a) for a in ((), (0.5,), (7,), (-1,), (None, "0.3"), (None, "x"), (float("nan"),), (0.2, "0.9"))] == [1.0, 0.5, 1.0, 0.0, 0.3, 1.0, 1.0, 0.2]


def test_new_ids_are_free(spark):
    from provenir.operators.suggest import suggest_fixes

    items = [(0, '{"id": "rule:a"}'), (1, '{"id": "a"}'), (2, '{"id": "rule:a-2"}'), (3, '{"name": {"en": "A b"}}'), (4, "oops"), (5, None), (6, '{"id": 5, "name": "B"}')]
    got = {r["index"]: (r["kind"], r["fix"]) for r in suggest_fixes(spark.createDataFrame(items, "index int, item string"), "rules").collect() if r["field"] in ("id", "")}
    assert got == {1: ("bad_id_prefix", '"rule:a-3"'), 3: ("missing_field", '"rule:a-b"'), 4: ("item_not_object", None), 5: ("item_not_object", None), 6: ("missing_field", '"rule:b"')}


def careful(text):
    """Sentences by one character after the other."""
    words = {"mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "inc", "ltd", "co", "corp", "no", "fig", "eg", "ie", "al", "dept", "approx", "min", "max", "sec"}
    ends, closers, out, start, i, n = ".!?。！？", ".!?。！？”’\"')]", [], 0, 0, len(text)

    def give(a, b):
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    while i < n:
        if text[i : i + 2] == "\n\n":
            give(start, i)
            while i < n and text[i] == "\n":
                i += 1
            start = i
            continue
        if text[i] not in ends:
            i += 1
            continue
        if text[i] == ".":
            k = i
            while k > max(0, i - 24) and text[k - 1].isascii() and text[k - 1].isalpha():
                k -= 1
            decimal = i > 0 and text[i - 1].isdigit() and i + 1 < n and text[i + 1].isdigit()
            if decimal or i - k == 1 or text[k:i].lower() in words:
                i += 1
                continue
        j = i + 1
        while j < n and text[j] in closers:
            j += 1
        if j == n or text[j].isspace():
            give(start, j)
            while j < n and text[j].isspace() and text[j] != "\n":
                j += 1
            start = i = j
        else:
            i += 1
    give(start, n)
    return out


def test_careful_sentences_of_all_documents(spark):
    """The queries without SQL against the scanner above."""
    import os

    from provenir.plans import catalogue

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data here")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    texts_ = {i: careful(t) for i, t in texts.items()}
    got = {(r["document_id"], r["idx"]): (r["char_start"], r["char_end"], r["text"]) for r in catalogue.d7_careful_sentences(spark, folder).collect()}
    assert got == {(i, k): (a, b, texts[i][a:b]) for i, own in texts_.items() for k, (a, b) in enumerate(own)}
    chunks = {}
    for i, own in texts_.items():
        first, k = 0, 0
        while first < len(own):
            stop, size = first, 0
            while stop < len(own) and (stop == first or size + own[stop][1] - own[stop][0] <= 6000):
                size += own[stop][1] - own[stop][0]
                stop += 1
            chunks[i, k] = (own[first][0], own[stop - 1][1])
            if stop == len(own):
                break
            k, back, tail = k + 1, stop, 0
            while back - 1 > first and tail + own[back - 1][1] - own[back - 1][0] <= 600:
                back -= 1
                tail += own[back][1] - own[back][0]
            first = back
    assert {(r["document_id"], r["idx"]): (r["char_start"], r["char_end"]) for r in catalogue.k5_aligned_chunks(spark, folder).collect()} == chunks


@pytest.mark.parametrize("quote, text, want", [("b c", "A  b\n C d", (3, 7)), ("i̇x", "a İX b", (2, 4)), ("x", "", None), ("", "a", None), ("a b", "xA b", (1, 4)), ("q", "a", None)])
def test_places_in_the_original(quote, text, want):
    assert grounding.place(quote, text) == want


def test_terms_of_replies(spark):
    """Half-said terms go, wrong kinds and types are none, lists are cleaned; a reply that is no object gives none."""
    said = json.dumps({"terms": [{"term": {"en": " Order ", "zh": "订单"}, "kind": "entity", "dataTypeHint": "uuid", "aliases": ["a", " a", "", None], "enumValuesHint": [], "snippet": " s "}, {"term": {"en": "x"}}, {"term": "x"}, None, {"term": {"en": "y", "zh": "z"}, "kind": 7, "definition": {"en": "d"}}]})
    rows = spark.createDataFrame([(1, "so: " + said), (2, "no"), (3, None), (4, '{"terms": []}'), (5, said[:60])], "k int, reply string")
    got = stages.coerce_terms(rows, "reply").collect()
    assert [(r["k"], r["ord"], r["term_en"], r["term_zh"], r["kind"], r["data_type"], r["aliases"], r["enum_values"], r["definition_en"], r["snippet"]) for r in got] == [
        (1, 0, "Order", "订单", "entity", "uuid", ["a"], None, "", "s"), (1, 4, "y", "z", "other", None, None, None, "d", ""),
    ]


def test_sentences_come_in_bounded_blocks():
    import pyarrow as pa

    from provenir.operators import segment

    texts = ["One two three. " * 40_000, None, "", "a. b. c.", *["Some words here. And more.\n"] * 30_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    for rule in (segment.spans, segment.careful_spans, segment.aligned_chunks()):
        blocks = list(segment.splitter(rule)([batch]))
        # One batch in gave one block out, however long its texts.
        assert max(b.nbytes for b in blocks) < 4 * segment.CHARS
        got = [r for b in blocks for r in zip(*(c.to_pylist() for c in b.columns))]
        assert got == [(i, k, t[a:b], a, b) for i, t in enumerate(texts) if t for k, (a, b) in enumerate(rule(t))]
