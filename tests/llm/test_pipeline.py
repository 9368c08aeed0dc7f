"""The pipeline against a brute-force version of its decisions on a small corpus."""

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from provenir.llm import simhash  # noqa: E402

LETTERS = {"aa": "bcdfgaeiou", "bb": "lmnrstvxyz"}


def words(rng, lang, n):
    return " ".join("".join(rng.choice(list(LETTERS[lang]), rng.integers(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    bench = [(i, words(rng, "aa", 25)) for i in range(5)]
    docs, labels, fate = [], [], {}
    for i in range(300):
        lang = "aa" if i % 2 else "bb"
        text = words(rng, lang, 60)
        kind = "clean"
        if i % 10 == 3:
            text, kind = " ".join(f"{w}###" for w in text.split()), "junk"
        elif i % 10 == 4:
            text, kind = text.replace(" ", " zounds ", 6), "toxic"
        elif i % 30 == 5:
            text, kind = f"{text}. {bench[i % 5][1]}. {words(rng, lang, 30)}", "leak"
        elif i % 30 == 6:
            text, kind = docs[i - 4][1], "copy"  # of a clean document
        docs.append((i, text, lang, f"s{i % 4}", len(text)))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
        fate[i] = kind
    docs += [(1000, "1234 5678", None, "s1", 9), (1001, None, None, None, None)]
    fate |= {1000: "und", 1001: "und"}
    folder = tmp_path_factory.mktemp("corpus")
    for name, rows, schema in (
        ("documents", docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        ("labels", labels, "doc_id bigint, quality int, toxic int"),
        ("benchmark", bench, "item_id bigint, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder), {d[0]: d[1] for d in docs}, fate


def test_stages(spark, corpus):
    folder, texts, fate = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r["doc_id"] for r in docs.collect()}
    assert {k for k in fate if fate[k] not in ("junk", "toxic", "und")} <= seen["quality_classifier"]
    assert not [k for k in seen["quality_classifier"] if fate[k] in ("junk", "toxic")]
    assert not [k for k in seen["language_id"] if fate[k] == "und"]

    # Near copies by comparing all pairs of fingerprints of what was left.
    left = sorted(seen["language_id"])
    prints = [simhash.fingerprint(texts[k]) for k in left]
    root = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert seen["simhash_near_dedup"] == {left[r] for r in set(root)}
    assert not [k for k in seen["simhash_near_dedup"] if fate[k] == "copy"]
    assert seen["benchmark_decontamination"] == {k for k in seen["simhash_near_dedup"] if fate[k] != "leak"}

    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == seen["benchmark_decontamination"]
    assert sum(r["piece"] == 0 for r in packed) == len(seen["benchmark_decontamination"])


def test_empty_tables(spark, corpus, tmp_path):
    folder = corpus[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
