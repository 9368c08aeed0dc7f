"""MinHash near-duplicates against all pairs, sketches against their guarantees."""

import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from provenir.llm import minhash

from .conftest import DOCS, ROWS

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        known = low.get(find(i))
        low[find(i)] = known if d is None else d if known is None else min(d, known)
    return Counter((d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows))


def group_rows(seed, bases, copies, edits):
    """Texts of 60 to 120 words with copies in which up to ``edits`` words are changed."""
    rng, out = random.Random(seed), []
    for _ in range(bases):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 120))]
        for _ in range(copies):
            own = base[:]
            for _ in range(rng.randrange(edits + 1)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(4000)}"
            out.append((len(out) * 7 % 1009 + 1000 * (len(out) % 3), " ".join(own)))
    rng.shuffle(out)
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return Counter(map(tuple, minhash.near_duplicates(df, **more).select("doc_id", "n_shingles", "component_id", "kept").collect()))


def test_each_coordinate_is_filled_and_agrees_as_often_as_the_sets():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100, 3000):
        common = rng.integers(0, 1 << 63, n).astype(np.uint64)
        sets = [common, np.concatenate([common, rng.integers(0, 1 << 63, max(1, n // 4)).astype(np.uint64)]), rng.integers(0, 1 << 63, n).astype(np.uint64)]
        s = minhash.sketches([np.unique(x) for x in sets])
        assert (s != minhash.NONE).all()
        want = n / (n + max(1, n // 4))
        assert abs((s[0] == s[1]).mean() - want) < 5 * np.sqrt(want * (1 - want) / minhash.T) + 1e-9
        assert (s[0] == s[2]).mean() < 0.02
    assert (minhash.sketches([np.zeros(0, np.uint64)]) == minhash.NONE).all()


def test_sketch_depends_on_the_set_alone():
    a, b = (minhash.shingles(t) for t in ("one two three four five six", "seven eight"))
    together, alone = minhash.sketches([a, b, a]), minhash.sketches([a])
    assert (together[0] == alone[0]).all() and (together[2] == alone[0]).all()


def test_layout_misses_nothing_in_practice():
    for percent in (60, 80, 90):
        bands, rows = minhash.layout(percent)
        assert bands * rows <= minhash.T and (1 - (percent / 100) ** rows) ** bands <= minhash.MISS
    with pytest.raises(ValueError):
        minhash.layout(2)


def test_rows_that_share_a_key_go_on():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    key = np.sort(rng.integers(0, 60, 100))
    for size in (1, 2, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[k : k + size]), pa.array(np.arange(k, min(k + size, 100)))], names=["key", "id"]) for k in range(0, 100, size)]
        got = np.concatenate([b.column(1).to_numpy() for b in minhash.meet(iter(batches))])
        values, counts = np.unique(key, return_counts=True)
        want = [i for i, k in enumerate(key) if counts[values == k][0] > 1 or k in (key[0], key[-1])]
        assert got.tolist() == want


@pytest.mark.parametrize("block, weight", [(minhash.BLOCK, minhash.WEIGHT), (5, 2000)])
def test_components_by_all_pairs(spark, block, weight):
    rows = group_rows(4, 6, 14, 7)
    got = found(spark, rows, block=block, weight=weight)
    assert got == brute(rows)
    assert 6 <= sum(n for (*_, kept), n in got.items() if kept) < len(rows)


def test_group_around_the_threshold(spark):
    """Chains: each text shares just enough with the next, the ends share little."""
    words = [f"t{k}" for k in range(400)]
    rows = [(k, " ".join(words[10 * k : 10 * k + 100])) for k in range(30)]
    assert found(spark, rows, block=4, weight=1500) == brute(rows)


def test_cases(spark, docs, none):
    got = minhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == brute([r[:2] for r in ROWS])
    assert minhash.near_duplicates(none).count() == 0
    nulls = [(None, "a b c d e f"), (None, "a b c d e f"), (None, "x"), (9, "a B c d e f"), (None, None), (4, "A\tb  c\nd e f")]
    assert found(spark, nulls) == brute(nulls)


def test_many_copies_are_one_point(spark):
    rows = [(k, "the same text of a few words again and again") for k in range(3000)] + [(5000 + k, f"another text {k} of few words {k} alone {k}") for k in range(50)]
    assert found(spark, rows) == brute(rows[:5] + rows[3000:]) + Counter((k, 7, 0, False) for k in range(5, 3000))


def test_schema_is_taken_by_name(spark):
    df = spark.createDataFrame([("x", 3, b"k", "one two three four five")], "keys string, doc_id int, sig binary, text string")
    assert [tuple(r) for r in minhash.near_duplicates(df).collect()] == [(3, 2, 3, True)]
    assert set(DOCS.split()) > {"doc_id", "text"}
