"""The language stage rejects what is in no learned language."""

import numpy as np

import corpus_pipeline


def test_stage_rejects_other_scripts_and_gibberish(spark):
    rng = np.random.default_rng(3)
    parts = {"aa": ["ba", "bo", "ka"], "bb": ["xi", "zu", "qe"]}
    say = lambda syllables, n: " ".join("".join(rng.choice(syllables, 3)) for _ in range(n))
    rows = [(i, say(parts[x], 20), x) for i, x in enumerate(["aa", "bb"] * 60)]
    rows += [(200, say(parts["aa"], 2), None), (201, say(["жи", "ло", "ту"], 20), "aa"), (202, "".join(rng.choice(list("cdfghjlmnprtvw"), 80)), None), (203, "日本語の文章です。" * 10, None), (204, "12 34", "aa"), (205, None, "bb")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = corpus_pipeline.language_id(spark, df, "")
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.collect()} == {*range(120), 200}
    assert corpus_pipeline.language_id(spark, df.limit(0), "").count() == 0


def test_every_row_teaches(spark, monkeypatch):
    from provenir.llm import langid

    rng = np.random.default_rng(5)
    rows = [(k, "".join(rng.choice(list("abcdefgh"), 6)), "xy"[k % 2]) for k in range(10_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    names, protos = langid.fit(df)
    assert names == ["x", "y"]
    for lang, proto in zip(names, protos):
        grams, counts = np.unique(langid.grams_of([t for _, t, x in rows if x == lang])[0], return_counts=True)
        whole = counts @ langid.vectors(grams).astype(np.float64)
        assert np.allclose(proto, whole / np.linalg.norm(whole))
    # The same when counts are folded in between.
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t, _ in rows]), pa.array([x for *_, x in rows])], names=["text", "lang"])
    once = next(langid.bundle([batch])).to_pylist()
    monkeypatch.setattr(langid, "COUNTED", 50)
    assert next(langid.bundle([batch])).to_pylist() == once
