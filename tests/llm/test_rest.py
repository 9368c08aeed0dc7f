"""Chat formatting, main text, decontamination, sharding, top-k, quality and language."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provenir.llm import chat, decontam, html, langid, quality, sharding, topk

from .conftest import ROWS

said = st.text(st.sampled_from("a<|\\im_startend>\n é|nl"), max_size=25)


def formatted(turns):
    batch = pa.RecordBatch.from_arrays([pa.array([t[0] for t in turns], pa.int64()), pa.array([t[1] for t in turns], pa.string()), pa.array([t[2] for t in turns], pa.string())], names=["c", "r", "t"])
    return [r for b in chat.formatter([batch.slice(k, 2) for k in range(0, len(turns), 2)]) for r in b.to_pylist()]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2]), st.one_of(st.just("assistant"), said), said), min_size=1, max_size=9), st.sampled_from([10, 40, 1 << 20]))
def test_chat_round_trip(turns, chunk):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0))
    old, chat.CHUNK = chat.CHUNK, chunk
    try:
        rows = formatted(turns)
    finally:
        chat.CHUNK = old
    back, loss, last = [], [], None
    for r in rows:
        assert (r["chunk"] == 0) == (r["conv_id"] != last or last is None and r["chunk"] == 0)
        last = r["conv_id"]
        data = r["formatted"].encode()
        own = chat.read_turns(data)
        assert r["n_turns"] == len(own)
        back += [(r["conv_id"], a.decode(), b.decode()) for a, b in own]
        loss += [chat.unescape(data[a:b]).decode() for a, b in zip(r["loss_start"], r["loss_end"])]
    assert back == turns
    assert loss == [t[2] for t in turns if t[1] == "assistant"]
    if chunk == 1 << 20:
        assert len(rows) == len({t[0] for t in turns})


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, None, None, "x"), (2, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_conversations(df).mapInArrow(chat.digests, chat.DIGEST).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[None]["n_turns"] == 1 and got[2]["loss_chars"] == 0 and len(got) == 3
    assert chat.format_conversations(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>a &lt;b&gt; &amp; c&#33;<br>d  \n e</p>", "a <b> & c! d e"),
        ("<html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a></nav><article><h1>Head</h1><p>One <b>two</b> three.</p><p>x</p></article><footer>&copy;</footer></body></html>", "Head\n\nOne two three.\n\nx"),
        ("<div class='cookie-notice'>We use cookies</div><div id=content><p>" + "word " * 40 + "</p><p>tail</p></div><div class=\"comments\"><p>" + "no " * 90 + "</p></div>", ("word " * 40).strip() + "\n\ntail"),
        ("<article><p>a</p><aside>side</aside><p>b</p><form><input><label>q</label></form><div class=ad>buy</div><p>c</p></article>", "a\n\nb\n\nc"),
        ("<article><p>open<p>next<script>var t='</p>'</script><!-- <p>no</p> --></article", "open\n\nnext"),
    ],
)
def test_main_text(page, text):
    assert html.extract(page) == text


def test_main_text_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "t"), (1, "u", "<p>x</p>", "t"), (None, None, None, None)], "page_id bigint, url string, html string, text string")
    assert Counter(map(tuple, html.extract_main_text(df).collect())) == Counter({(1, "u", "x"): 2, (None, None, ""): 1})
    assert html.extract_main_text(df.limit(0)).count() == 0


ITEM = "Anna Berg buys 12 kg of apples in the market and sells 3 kg to her friend Tom for 7 dollars today"


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (1, ITEM), (4, "the market near it")], "item_id bigint, text string")
    texts = {
        10: f"Some words before. {ITEM}. And some after.",
        11: "Yes: " + ITEM.replace("Tom", "Max").replace("12", "40").replace("7", "9") + ".",
        12: "Nothing of that kind is here, only 12 kg of apples in the market.",
        13: None,
        14: " but ".join(ITEM.replace("12 kg", f"{k} kg").replace("3 kg", f"{k + 7} kg").replace("Tom", name).replace("7", f"{k + 9}") for k, name in ((5, "Max"), (6, "Jim"))),
        15: "we go to the market near it",
        16: "The market, near it",
    }
    some = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id bigint, text string, hash string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontam.found_items(some, bench).collect()}
    # Two variants of an item do not hide each other; a short item is found wherever its words stand.
    assert got == {(10, 1): "exact", (11, 1): "renamed", (14, 1): "renamed", (15, 4): "exact", (16, 4): "exact"}
    left = decontam.clean(some, bench)
    assert left.columns == some.columns and {r["doc_id"] for r in left.collect()} == {12, 13}
    assert decontam.clean(docs, bench).count() == len(ROWS)
    assert decontam.clean(none, bench).count() == 0
    assert decontam.clean(docs, bench.limit(0)).count() == len(ROWS)


@pytest.mark.parametrize("bytes_", [1 << 20, 300])
def test_sharding(docs, none, bytes_):
    out = sharding.shard_rows(docs, 3, "doc_id", "text", bucket_bytes=bytes_)
    rows = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r[0], r[1]) for r in ROWS)
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in rows)
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    assert sharding.shard_rows(none, 3, "doc_id", "text").count() == 0


def test_sharding_mixes(spark):
    out = sharding.shard_rows(spark.range(4000).selectExpr("id as doc_id", "'x' as text"), 4, "doc_id", "text").collect()
    order = [r["doc_id"] for r in sorted(out, key=lambda r: r["slot"] * 4 + r["shard"])]
    assert abs(np.corrcoef(order, range(4000))[0, 1]) < 0.1


def brute_top(rows, k=5):
    vecs = [(i, vid, np.floor(256 * np.array(v, float)).astype(int)) for i, (vid, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q, a in vecs:
        if q is not None and q % 50 == 0:
            near = sorted(((-int(a @ b), vid is None, vid or 0, j) for j, vid, b in vecs if j != i and len(a) == len(b)))[:k]
            out += [(q, n + 1, None if none else vid, -s) for n, (s, none, vid, _) in enumerate(near)]
    return Counter(out)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(200)]
    rows += [(i, rows[3][1]) for i in range(200, 260)]  # copies and ties
    rows += [(300, None), (350, []), (400, [1.0, None] * 4), (450, [float("nan")] * 8), (None, rows[7][1]), (500, [1.0, 2.0]), (501, [3.0, -1.0]), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = Counter(map(tuple, topk.top_k(df, lambda i: i % 50 == 0).select("query_id", "rank", "vec_id", "score").collect()))
    same = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute_top(same)
    assert topk.top_k(df.limit(0), lambda i: i % 50 == 0).count() == 0
    small, topk.GROUP = topk.GROUP, 2
    try:
        assert Counter(map(tuple, topk.top_k(df, lambda i: i % 50 == 0).select("query_id", "rank", "vec_id", "score").collect())) == got
    finally:
        topk.GROUP = small


def test_quality(spark, docs, none):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40)]
        bad, toxic = i % 4 == 0, i % 5 == 0
        if bad:
            words = [f"{w}###" for w in words]
        if toxic:
            words[::7] = ["zounds"] * len(words[::7])
        rows.append((i, " ".join(words), "en", f"site{i % 3}"))
        labels.append((i, int(not bad), int(toxic)))
    some = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in quality.classify(some, marks).collect()}
    assert sum(got[i] == (q == 1 and t == 0) for i, q, t in labels) >= 396
    kept = quality.kept(some, marks)
    assert kept.columns == some.columns and kept.count() == sum(got.values())
    assert quality.classify(docs, marks).count() == len(ROWS)
    assert quality.kept(docs, marks.limit(0)).count() == len(ROWS)  # no labels, no rejections
    assert quality.kept(none, marks).count() == 0


def test_site_posteriors_shrink(spark):
    rows = [("big", "p", 1.0, 0.0)] * 500 + [("bad", "p", 0.0, 0.0)] * 300 + [("tiny", "p", 0.0, 0.0)] * 1 + [(None, None, 1.0, 0.0)] * 5
    site, mean = quality.sites(spark.createDataFrame(rows, "source string, lang string, _quality double, _toxic double"), "source", "lang")
    got = {r["_host"]: r["p_quality"] for r in site.collect()}
    assert got["bad"] < got["tiny"] < mean["_quality"] < got[None] < got["big"]


def test_language(spark, docs, none):
    rng = np.random.default_rng(3)
    parts = {"aa": ["ba", "bo", "ka"], "bb": ["xi", "zu", "qe"]}
    rows = [(i, " ".join("".join(rng.choice(parts[x], 3)) for _ in range(20)), x) for i, x in enumerate(["aa", "bb"] * 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(df.where(~langid.held_out()))
    assert model[0] == ["aa", "bb"]
    got = langid.with_language(df, model).where(langid.held_out()).collect()
    assert len(got) > 10 and all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in got)
    odd = langid.with_language(docs, model)
    assert odd.count() == len(ROWS) and odd.columns.count("score") == 1
    named = {(r["doc_id"], r["text"]): r["lang_pred"] for r in odd.collect()}
    assert named[3, None] == named[4, ""] == named[5, " \n\t "] == named[6, "12 34 !!! ---"] == "und"
    assert named[1, ROWS[0][1]] in ("aa", "bb")
    assert {r["lang_pred"] for r in langid.with_language(spark.createDataFrame([(1, "a"), (2, "日"), (3, "𠀀")], "doc_id bigint, text string"), model).collect()} <= {"aa", "bb"}
    assert langid.with_language(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.with_language(docs, langid.fit(none)).collect()} == {"und"}


def test_language_is_the_cosine(spark):
    """Sums of products equal the cosine of bundles, up to the document's own norm."""
    texts = ["hello world", "guten tag", "zu"]
    g, n = langid.grams_of(texts)
    protos = np.random.default_rng(0).normal(size=(2, langid.DIMS))
    at = 0
    for k in n:
        bundle = langid.vectors(g[at : at + k]).astype(float).sum(0)
        each = langid.vectors(g[at : at + k]).astype(float) @ protos.T
        assert np.allclose(bundle @ protos.T, each.sum(0))
        at += k
