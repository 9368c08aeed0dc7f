"""Vector codes against brute force; the filter against all distances."""

import hashlib
import math
from collections import Counter

import numpy as np

from provenir.llm import codes


def brute(rows, entries=64, rounds=2):
    """(vec_id, code, error, label_error, digest); rows: (vec_id, vector, label)."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = max((len(v) for _, v, _ in kept), default=0)
    size = max(16, -(-size // 16) * 16)
    ints = [[math.floor(256 * x) for x in v] + [0] * (size - len(v)) for _, v, _ in kept]
    w = size // 16
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[ints[k][p * w : p * w + w] for k in order] for p in range(16)]

    def nearest(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for p in range(16):
            own = {}
            for v in ints:
                part = v[p * w : p * w + w]
                own.setdefault(nearest(part, books[p])[1], []).append(part)
            for n, parts in own.items():
                books[p][n] = [sum(x) // len(parts) for x in zip(*parts)]
    h = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[nearest(v[p * w : p * w + w], books[p]) for p in range(16)] for v in ints]
    by_label = Counter()
    for (_, _, lab), near in zip(kept, found):
        by_label[lab] += sum(g for g, _ in near)
    return Counter((i, "".join(f"{n:02x}" for _, n in near), sum(g for g, _ in near), by_label[lab], h) for (i, _, lab), near in zip(kept, found))


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, code string, part int").repartition(3)
    return Counter(map(tuple, codes.codes(df, **more).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))


def clustered(seed, n, size):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    return [(int(k), (centres[rng.integers(12)] + 0.2 * rng.normal(size=size)).round(3).tolist(), None if k % 7 == 0 else int(k % 4)) for k in rng.permutation(n)]


def test_filter_is_exact_and_saves_distances():
    rng = np.random.default_rng(3)
    for width in (1, 2, 4, 8):
        book, parts = rng.integers(-300, 300, (64, width)), rng.integers(-300, 300, (500, width))
        book[10] = book[3]  # ties
        entry, gap, counted = codes.Cells(book).nearest(parts)
        every = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        assert (entry == every.argmin(axis=1)).all() and (gap == every.min(axis=1)).all()
        assert counted < every.size / (4 if width <= 4 else 1.5)


def test_codes_by_brute_force(spark):
    for rows in (clustered(1, 300, 32), clustered(2, 90, 16), clustered(3, 20, 48)):
        assert got(spark, rows) == brute(rows)
    rows = clustered(4, 120, 32)
    assert got(spark, rows, entries=5, rounds=4) == brute(rows, 5, 4)


def test_cases(spark):
    rows = [
        (1, [0.5] * 16, 1), (1, [0.5] * 16, 1), (2, None, 1), (3, [0.1, None] + [0.0] * 14, 2), (4, [float("nan")] * 16, 2), (5, [float("inf")] * 16, None),
        (None, [-0.3] * 16, None), (6, [0.25, -0.75], None), (7, [], 3), (8, [1.0] * 17, 3), (None, [-0.3] * 16, None),
    ]
    assert got(spark, rows) == brute(rows)
    assert got(spark, [(7, [], 3)]) == brute([(7, [], 3)])
    assert got(spark, []) == Counter()
    assert got(spark, rows[2:4]) == Counter()


def test_huge_components_stay_within_64_bits(spark):
    rows = [(k, [(-1.0) ** (k + j) * 1e300 for j in range(64)], 1) for k in range(70)]
    out = got(spark, rows)
    assert sum(out.values()) == 70 and all(e >= 0 for _, _, e, _, _ in out)


def test_array_slices_keep_their_rows():
    import pyarrow as pa

    column = pa.array([[1.0, 2.0], [], [3.0], [0.5, -0.5]], pa.list_(pa.float64()))
    assert codes.integers(column.slice(2), 2, 2.0).tolist() == [[6, 0], [1, -1]]
