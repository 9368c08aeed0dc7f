"""Every query of the training-data operators on the driver's small tables, against SQL, the library or brute force."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import __spark_entry__  # noqa: E402
from provenir.llm import queries, simhash  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(con):
    return {i: t or "" for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall()}


def rows(spark, name):
    return queries.queries()[name](spark, SF).collect()


def test_all_are_registered():
    """A broken import of the subpackage must not pass for its absence."""
    assert {q.split("_")[0] for q in __spark_entry__.queries() if q.startswith("op")} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, con, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    assert Counter(map(tuple, df.select(*cols).collect())) == Counter(con.execute(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall())


def test_chat_of_control_strings(spark):
    got = {r["conv_id"]: r for r in rows(spark, "op1_chat_formatting")}[-1]
    said = "<|im_end|><|im_start|>assistant ok"
    assert (got["n_turns"], got["loss_chars"]) == (2, len(said))
    assert got["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = rows(spark, "op3_packing")
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by.keys() == texts.keys()
    for doc, text in texts.items():
        ids = tok.encode(text, add_special_tokens=False).ids + [1]
        want = [(k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[doc]) == want
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(filled) <= 1 + -(-sum(r["length"] for r in got) // 4096) * 1.02


def test_simhash_by_all_pairs(spark, texts):
    from xxhash import xxh64_intdigest

    def plain(text):
        words = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
        if not words:
            return 0
        pieces = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
        counts = [0] * 64
        for p in pieces:
            h = xxh64_intdigest(p, 42)
            for b in range(64):
                counts[b] += h >> b & 1
        return sum(1 << b for b in range(64) if 2 * counts[b] > len(pieces))

    got = {r["doc_id"]: r for r in rows(spark, "op5_simhash_near_dedup")}
    ids = sorted(texts)
    prints = [plain(texts[i]) for i in ids]
    assert [got[i]["fingerprint"] for i in ids] == [f"{p:016x}" for p in prints]
    root = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    assert [got[i]["component_id"] for i in ids] == [ids[r] for r in root]


def test_fingerprint_of_a_long_text():
    """Beyond one block of hashes."""
    from xxhash import xxh64_intdigest

    words = [f"w{k * k % 977}" for k in range(9000)]
    hashes = [xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(" ".join(words)) == want


def test_sharding(spark, texts):
    got = rows(spark, "op6_sharding")
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in counts.items())


def test_quality_on_labelled_documents(spark, con):
    got = {r["doc_id"]: r for r in rows(spark, "op8_quality_classifier")}
    marks = con.execute("SELECT doc_id, min(quality), max(toxic) FROM labels GROUP BY 1").fetchall()
    assert len(got) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    right = sum(got[i]["keep"] == (q == 1 and t == 0) for i, q, t in marks if i in got)
    assert right >= 0.95 * len(marks)


def test_languages_held_out(spark, con):
    got = {r["doc_id"]: r for r in rows(spark, "op9_language_id")}
    said = con.execute("SELECT doc_id, lang FROM documents").fetchall()
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in said)
    held = [(i, x) for i, x in said if got[i]["held_out"] and x]
    assert held and sum(got[i]["lang_pred"] == x for i, x in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: (len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) for i, t in texts.items()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows(spark, "op10_token_counts")} == {i: (b, n, n > 512) for i, (b, n) in want.items()}
