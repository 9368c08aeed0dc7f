"""Near copies of the pipeline against all pairs of shingle sets."""

import numpy as np

import corpus_pipeline
from provenir.llm import nearcopies, simhash

from .conftest import ROWS


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def edited(rng, text, n):
    w = text.split()
    for k in rng.choice(len(w), n, replace=False):
        w[k] = f"new{rng.integers(1000)}"
    return " ".join(w)


def test_stage_finds_pairs_beyond_four_bits(spark):
    rng = np.random.default_rng(4)
    texts = []
    for n in (60, 150, 400):
        for _ in range(8):
            base = " ".join(f"w{x}" for x in rng.integers(0, 500, n))
            texts += [base, edited(rng, base, n // 55), edited(rng, base, n // 8)]
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    far = 0
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                far += (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 4
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert far > 5 and 24 < len(set(root)) < len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()} == set(root)
    # In shards of a few points, as in a large corpus: found by the number of tables.
    assert {r["doc_id"] for r in nearcopies.first_of_each(df, shard=8).collect()} == set(root)


def test_group_around_one_text(spark):
    """Copies of one text that are no copies of each other, in more than one shard."""
    rng = np.random.default_rng(9)
    base = " ".join(f"w{x}" for x in rng.integers(0, 5000, 150))
    texts = [base, *(edited(rng, base, 3) for _ in range(150)), *(" ".join(f"w{x}" for x in rng.integers(0, 5000, 150)) for _ in range(60))]
    sets = [shingles(t) for t in texts]
    similar = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    assert sum(similar(0, j) for j in range(1, 151)) == 150 and sum(similar(j, j + 1) for j in range(1, 150)) < 75
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"] for r in nearcopies.first_of_each(df, shard=32).collect()}
    assert got >= {0, *range(151, 211)} and len(got) <= 61 + 4


def test_tables_follow_the_corpus():
    counts = [nearcopies.table_count(n) for n in (0, 10, 10**4, 10**6, 10**9)]
    assert counts == sorted(counts) and counts[0] >= 1 and counts[-1] < 400


def test_odd_rows(spark, docs, none):
    out = nearcopies.first_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "6", "7", "8", "None"]
    assert nearcopies.first_of_each(none).count() == 0
    assert len(ROWS) == docs.count()


def firsts(texts):
    """The first text of each group by all pairs of sets."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return set(root)


def test_pairs_that_simhashes_hold_apart(spark):
    # A phrase that is repeated rules a SimHash and is one shingle of the set.
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 120)) for _ in range(6)]
    texts = [*base, *(f"{b} {'la ' * 900}" for b in base), *(f"{'lo ' * 900} {b}" for b in base[:3])]
    assert firsts(texts) == set(range(6))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"] for r in nearcopies.first_of_each(df).collect()} == set(range(6))


def test_whole_without_candidates(spark, monkeypatch):
    """What the tables leave is found, by keys of few and of many points, in sets whose bitmaps have different lengths."""
    rng = np.random.default_rng(2)
    draw = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    texts = ["", "one", "one", "one two", draw(131), draw(700)]
    for n in (5, 12, 60, 131, 700):
        base = draw(n)
        texts += [base, base + " more", edited(rng, base, max(1, n // 60)), edited(rng, base, max(1, n // 30)), " ".join(base.split()[: n - n // 20])]
    base = draw(131)
    texts += [edited(rng, base, 1) + f" {'x' * k}" for k in range(50)] + [draw(40) + " " + base for _ in range(5)]
    kept = firsts(texts)
    assert 15 < len(kept) < len(texts) - 40
    monkeypatch.setattr(nearcopies, "candidates", lambda points, start, shard: points.select(points.sig.alias("a"), points.sig.alias("b")).limit(0))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"] for r in nearcopies.first_of_each(df).collect()} == kept


def test_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 3, 64, 65, 500, 1030):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for m in (0, n // 3, n):
            b = np.unique(np.concatenate([a[m // 2 :], rng.integers(0, 1 << 63, m).astype(np.uint64)]))
            apart = len(np.setxor1d(a, b))
            assert nearcopies.differ(nearcopies.bitmap(a), nearcopies.bitmap(b)) <= apart
    assert nearcopies.allowed(90, 90) == 20
