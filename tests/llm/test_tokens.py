"""Token counts and packing against the tokenizer library."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")
from provenir.llm import packing, tokencount  # noqa: E402

from .conftest import ROWS  # noqa: E402

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
texts = st.lists(st.text(st.sampled_from("abÉé'sTt ll\n\t,.!12日́ \x1c<|>"), max_size=30), min_size=1, max_size=8)


def test_counts(docs, none):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in tokencount.count_tokens(docs, BYTE).collect())
    tok = Tokenizer.from_file(BYTE)
    assert got == Counter((r[0], len((r[1] or "").encode()), len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    assert tokencount.count_tokens(none, BYTE).count() == 0


@settings(max_examples=150, deadline=None)
@given(texts)
def test_counts_of_any_text(some):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(some)), pa.int64()), pa.array(some, pa.string())], names=["a", "b"])
    rows = pa.Table.from_batches(list(tokencount.postings(BYTE)([batch]))).sort_by("token")
    parts = pa.Table.from_batches(list(tokencount.resolve(BYTE)(rows.to_batches()))).group_by("uid").aggregate([("doc_id", "max"), ("n_tokens", "sum")]).to_pylist()
    tok = Tokenizer.from_file(BYTE) if not hasattr(test_counts_of_any_text, "tok") else test_counts_of_any_text.tok
    assert {r["doc_id_max"]: r["n_tokens_sum"] for r in parts} == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(some)}


@settings(max_examples=150, deadline=None)
@given(texts)
def test_ids_of_any_text(some):
    ids, sizes = packing.ids_of(WORD, pa.array(some, pa.string()))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    tok = packing.load(WORD)[0]
    for i, t in enumerate(some):
        assert ids[ends[i] : ends[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_pack(docs, none):
    width = 64
    rows = packing.pack_documents(docs, WORD, width=width).collect()
    tok = Tokenizer.from_file(WORD)
    want = Counter()
    for r in ROWS:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), width)):
            want[r[0], k, at, len(ids[at : at + width]), zlib.crc32(ids[at : at + width].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= width
    assert len(by) <= -(-sum(r["length"] for r in rows) // width) + 1
    assert packing.pack_documents(none, WORD).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1, max_size=25))
def test_plan_holds_each_piece_once(histogram):
    got: Counter = Counter()
    for n, lengths in packing.plan(histogram, 50, bins=10):
        assert n > 0 and sum(lengths) <= 50
        for x in lengths:
            got[x] += n
    assert got == Counter(histogram)


def test_nnls():
    a = np.array([[1.0, 0, 2], [0, 1, 1]])
    x = packing.nnls(a, np.array([4.0, 3.0]))
    assert (x >= 0).all() and np.allclose(a @ x, [4, 3], atol=1e-2)
