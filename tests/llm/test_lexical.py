"""Ranked search against brute force over Python integers."""

import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from provenir.llm import lexical

from .conftest import ROWS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    own = [(d, Counter(terms(t))) for d, t in docs]
    n = sum(1 for _, c in own if c)
    total = sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for d, c in own:
            m = 75 + (25 * sum(c.values()) * n) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return Counter(out)


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return Counter(map(tuple, lexical.search(d, i, **more).select("item_id", "rank", "doc_id", "score").collect()))


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 300}"
    docs = [(k, " ".join(word() for _ in range(rng.randrange(0, 60)))) for k in range(n)]
    docs += [(n + k, docs[k][1]) for k in range(40)]  # ties
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 12)))) for k in range(30)]
    return docs, items


def test_terms():
    for text in ["Don't STOP-me 3.5% \x00a\x7fb", "ÄÖ Ünï 日本語，x", None, "", " .,! ", "ǅ É é"]:
        assert [t.decode() for t in lexical.terms(text)] == terms(text)


def test_radix_order_sorts():
    rng = np.random.default_rng(0)
    for top in (1, 100, 1 << 16, 1 << 33, 1 << 50):
        keys = rng.integers(0, top, 5000)
        assert (keys[lexical.radix_order(keys)] == np.sort(keys)).all()
    assert len(lexical.radix_order(np.zeros(0, np.int64))) == 0


@pytest.mark.parametrize("block", [lexical.BLOCK, 300])
def test_search_by_brute_force(spark, block):
    docs, items = corpus(2, 300)
    assert found(spark, docs, items, block=block) == brute(docs, items)
    assert found(spark, docs, items, k=3, block=block) == brute(docs, items, 3)


def test_slices_and_batches_change_nothing(spark, monkeypatch):
    docs, items = corpus(5, 200)
    block = lexical.Items(items)
    known = {t: k for k, t in enumerate(block.vocabulary)}
    n, doc, term, tf = lexical.postings([t for _, t in docs], known)
    assert n.tolist() == [len(terms(t)) for _, t in docs]
    weight = np.arange(len(known)) + 1
    got = lexical.accumulate(block, weight, doc, term, tf)
    want = Counter()
    for d, (_, t) in enumerate(docs):
        c = Counter(terms(t))
        for i, (_, q) in enumerate(items):
            for x in terms(q):
                if x in c:
                    want[i, d] += int(weight[known[x.encode()]]) * c[x]
    assert {(int(i), int(d)): int(s) for i, d, s in zip(*got)} == dict(want)
    for size in (1, 40):
        monkeypatch.setattr(lexical, "AT_ONCE", size)
        monkeypatch.setattr(lexical, "DOCS", 64)
        out = list(lexical.ranker(block, np.ones(len(known), np.int64), 200, int(n.sum()), 5)(iter([spark.createDataFrame(docs, "doc_id bigint, text string").toArrow().combine_chunks().to_batches()[0]])))
        if size == 1:
            first = Counter(map(tuple, (r.values() for r in out[0].to_pylist())))
        else:
            assert Counter(map(tuple, (r.values() for r in out[0].to_pylist()))) == first


def test_cases(spark, docs, none):
    rows = [r[:2] for r in ROWS]
    items = [(1, "Quick fox river"), (1, "Quick fox river"), (1, "lorem ipsum"), (2, None), (3, ""), (None, "Fuchs über"), (4, "not there at all xyz"), (5, "12 12 日本語 don't")]
    ask = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id bigint, text string, doc_id string, rank int")
    got = Counter(map(tuple, lexical.search(docs, ask).select("item_id", "rank", "doc_id", "score").collect()))
    assert got == brute(rows, [i for i in items if i[1] is not None])
    assert lexical.search(none, ask).count() == 0
    assert lexical.search(docs, ask.limit(0)).count() == 0
    empty = lexical.search(docs, ask.where("item_id = 2"))
    assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0
