import re
import string
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from provenir.llm import simhash

from .conftest import ROWS


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(points, radius=4):
    root = list(range(len(points)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(points)):
        for j in range(i):
            if (int(points[i]) ^ int(points[j])).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def clusters(n, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        center = int(rng.integers(0, 1 << 63)) * 2
        for _ in range(12):
            x = center
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            out.append(x)
    return np.unique(np.array(out, np.uint64))


def test_fingerprints():
    for row in ROWS:
        if row[1] is None or len(row[1]) < 1000:
            assert simhash.fingerprint(row[1]) == brute(row[1])


def test_bk_tree_finds_all_links():
    points = clusters(40)
    got = simhash.components(len(points), simhash.bk_links(points, 4))
    want = brute_groups(points)
    assert got.tolist() == want


@pytest.mark.parametrize("shard", [simhash.SHARD, 5])
def test_links_connect_what_links(spark, shard):
    points = clusters(12, seed=5)
    prints = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp bigint")
    rows = simhash.groups(prints.selectExpr("cast(null as bigint) as doc_id", "fp"), shard=shard).collect()
    top = {np.int64(r["fp"]).view(np.uint64).item(): r["top"] for r in rows}
    want = brute_groups(points)
    seen = Counter((want[i], top[int(x)]) for i, x in enumerate(points))
    assert len(seen) == len(set(want)) == len({t for _, t in seen})


def test_components(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    got = Counter((r["doc_id"], r["component_id"]) for r in rows)
    assert got[1, 1] == 2 and got[2, 1] == 1
    assert got[3, 3] == got[4, 3] == got[5, 3] == 1  # texts without words link
    assert got[None, None] == 1 and got[None, 3] == 1  # a null id is the smallest of none but its own group
    assert simhash.near_duplicates(none).count() == 0


def test_first_of_each(docs, none):
    out = simhash.first_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "6", "7", "8", "None"]
    assert simhash.first_of_each(none).count() == 0


def test_radius_is_even(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp bigint"), radius=3)
