"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies.

Pass 1 (``mapInArrow``) splits each text into pre-tokens and, for a block of
documents, turns the frequencies round: one row per pre-token with its postings
(documents and frequencies). Pre-tokens that occur in many documents of a block
are hot keys; their postings would all meet in one task, so they are resolved
in place, from a table that each worker keeps. Pass 2 gathers the rows of each
remaining pre-token, tokenises every distinct one once, multiplies by the
frequencies and adds up per document. No token ids of a document are ever made.

A text that holds a special token's string goes through the library whole,
since its default handling cuts such strings out before pre-tokenising. Nulls
count as empty texts (0 bytes, 0 tokens). Each row of the input gives one row,
repeated rows and repeated or null ids too. An empty table gives an empty one.
Other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import table, tasks, trimmed

#: Documents and bytes in a block; pre-tokens in more than one of SHARE of its documents are resolved in place.
BLOCK, BLOCK_BYTES, SHARE = 4096, 16 << 20, 64
#: Documents of a block beyond which a pre-token's postings are dealt to so many places.
FREQUENT, SALTS = 16, 16
#: Entries of the table of hot pre-tokens that a worker keeps.
KEPT = 200_000
#: White space next to a space: there, cutting a text at single spaces would change its pre-tokens.
WHITE = " \t\n\r\f\v\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNEVEN = f" [{WHITE}]|[{WHITE}] "

#: A pre-token's payload: its documents (two bytes each, counted from ``base``), then their frequencies (a byte each).
#: A document's own row has no token; its payload is four longs: id, whether that is null, bytes, tokens counted so far.
ROWS = "token string, base bigint, payload binary"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
PARTS = "uid bigint, doc_id bigint, n_bytes bigint, n_tokens bigint"
_loaded: dict[str, tuple] = {}


def load(path: str):
    """The tokenizer of ``path``, its pre-token pattern, special strings and counts of hot pre-tokens; kept per worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        special = [t.content for t in tok.get_added_tokens_decoder().values()]
        _loaded[path] = (tok, regex.compile(public_tokenizers.PATTERN), special, {})
    return _loaded[path]


def count_pieces(tok, pieces: list[str]) -> list[int]:
    return [len(e) for e in tok.encode_batch_fast(pieces, add_special_tokens=False)] if pieces else []


def pre_tokens(pattern, texts: pa.Array, uneven: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pre-tokens of ``texts``; the number and the document of each occurrence.

    A single space between other characters always starts a pre-token, so texts
    are cut there and the pattern runs once for each distinct part.
    """
    parts = pc.split_pattern(pc.if_else(pa.array(uneven), "", texts), " ")
    flat = parts.flatten().dictionary_encode()
    codes = flat.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    head = np.ones(len(codes), bool)
    head[1:] = doc[1:] != doc[:-1]
    number: dict[str, int] = {}
    lists = [[number.setdefault(t, len(number)) for t in pattern.findall(f" {x}")] for x in flat.dictionary.to_pylist()]
    sizes = np.array([len(x) for x in lists], np.int64)
    every = np.fromiter((y for x in lists for y in x), np.int64)
    starts = np.cumsum(sizes) - sizes
    rest, doc_rest = codes[~head], doc[~head]
    n = sizes[rest]
    token = every[np.repeat(starts[rest] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    at = np.repeat(doc_rest, n)
    # First parts have no space before them; uneven texts go through the pattern whole.
    first = flat.dictionary.take(flat.indices.filter(pa.array(head))).to_pylist()
    whole = [(i, t) for i, t in zip(np.flatnonzero(uneven).tolist(), texts.filter(pa.array(uneven)).to_pylist())]
    odd = [(i, number.setdefault(t, len(number))) for i, x in [*enumerate(first), *whole] for t in pattern.findall(x)]
    if odd:
        more = np.array(odd, np.int64)
        token, at = np.concatenate([token, more[:, 1]]), np.concatenate([at, more[:, 0]])
    return list(number), token, at


def blocks(batches):
    """Slices of at most BLOCK documents and about BLOCK_BYTES of text."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES, side="right"))
            stop = min(max(stop, at + 1), at + BLOCK, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def postings(path: str):
    """Pass 1: postings of rare pre-tokens, and a row for each document with what is already counted."""

    def run(batches):
        from pyspark import TaskContext

        tok, pattern, special, known = load(path)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for block in blocks(batches):
            m, texts = block.num_rows, block.column(1)
            done = np.zeros(m, np.int64)
            marked = np.zeros(m, bool)
            for s in special:
                marked |= pc.match_substring(texts, s).to_numpy(False)
            if marked.any():
                done[marked] = count_pieces(tok, texts.filter(pa.array(marked)).to_pylist())
                plain = pc.if_else(pa.array(marked), "", texts)
            else:
                plain = texts
            tokens, token, at = pre_tokens(pattern, plain, pc.match_substring_regex(plain, UNEVEN).to_numpy(False))
            pairs, freq = np.unique(token * m + at, return_counts=True)
            token, at = pairs // m, pairs % m
            spread = np.bincount(token, minlength=len(tokens))
            hot = spread > max(m // SHARE, 4)
            names = [tokens[i] for i in np.flatnonzero(hot)]
            new = [t for t in names if t not in known]
            if len(known) + len(new) > KEPT:
                known.clear()
                new = names
            known.update(zip(new, count_pieces(tok, new)))
            pieces = np.zeros(len(tokens), np.int64)
            pieces[hot] = [known[t] for t in names]
            own = hot[token]
            done += np.bincount(at[own], freq[own] * pieces[token[own]], m).astype(np.int64)
            token, at, freq = token[~own], at[~own], freq[~own]
            # A frequency takes one byte; larger ones take several postings.
            copies = (freq + 254) // 255
            if (copies > 1).any():
                last = np.cumsum(copies) - 1
                token, at, left = np.repeat(token, copies), np.repeat(at, copies), freq - 255 * (copies - 1)
                freq = np.full(len(token), 255)
                freq[last] = left
            heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
            ends = np.concatenate([heads, [len(token)]])
            yield pa.RecordBatch.from_arrays([pa.array([tokens[i] for i in token[heads]], pa.string()), pa.array(np.full(len(heads), first)), payloads(at, freq, ends)], names=NAMES)
            ids = block.column(0)
            own = np.stack([ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(False), pc.binary_length(texts).to_numpy(), done], axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.string()), pa.array(first + np.arange(m)), binary(own, np.arange(m + 1) * 32)], names=NAMES)
            first += m

    return run


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def payloads(at: np.ndarray, freq: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Documents, then frequencies of each run of postings, in one binary value."""
    n = np.diff(ends)
    out = np.empty(3 * len(at), np.uint8)
    run = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(at)) - ends[run]
    place = 3 * ends[run]
    low = place + 2 * k
    out[low], out[low + 1] = at & 255, at >> 8
    out[place + 2 * n[run] + k] = freq
    return binary(out, 3 * ends)


def read_payloads(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents and frequencies of all postings in turn, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    n = np.diff(offsets) // 3
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(offsets[:-1], n)
    low = place + 2 * k
    return data[low].astype(np.int64) | data[low + 1].astype(np.int64) << 8, data[place + 2 * np.repeat(n, n) + k].astype(np.int64), n


def resolve(path: str):
    """Pass 2, over rows sorted by pre-token: count each distinct pre-token once, spread the counts over its documents."""

    def run(batches):
        tok = load(path)[0]
        last, last_n = None, 0
        for batch in batches:
            token = batch.column(0)
            if token.null_count:
                own = batch.filter(token.is_null())
                x = np.frombuffer(b"".join(own.column(2).to_pylist()), np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([own.column(1), pa.array(x[:, 0], mask=x[:, 1] > 0), pa.array(x[:, 2]), pa.array(x[:, 3])], names=["uid", "doc_id", "n_bytes", "n_tokens"])
                batch = batch.filter(token.is_valid())
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if distinct[0] == last:
                counted = [last_n, *count_pieces(tok, distinct[1:])]
            else:
                counted = count_pieces(tok, distinct)
            last, last_n = distinct[-1], counted[-1]
            docs, freq, sizes = read_payloads(batch.column(2))
            at = docs + np.repeat(batch.column(1).to_numpy(), sizes)
            got = freq * np.repeat(np.array(counted, np.int64)[coded.indices.to_numpy()], sizes)
            uid, where = np.unique(at, return_inverse=True)
            sums = np.bincount(where, got, len(uid)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.nulls(len(uid), pa.int64()), pa.nulls(len(uid), pa.int64()), pa.array(sums)], names=["uid", "doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``df``: ``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens``."""
    rows = df.select(F.col(key).cast("long"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(trimmed(postings(path)), ROWS)
    n = tasks(df.sparkSession)
    # A pre-token of many documents of a block is dealt by block as well, so it is counted up to SALTS times.
    salt = F.when(F.octet_length("payload") > 3 * FREQUENT, F.pmod(F.xxhash64("base"), F.lit(SALTS))).otherwise(F.lit(0))
    spot = F.when(F.col("token").isNull(), F.xxhash64("base")).otherwise(F.xxhash64("token", salt))
    dealt = rows.repartition(n, spot).sortWithinPartitions("token")
    parts = dealt.mapInArrow(trimmed(resolve(path)), PARTS)
    # The document's own row has its id and size; all others add tokens to it.
    return parts.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens")).drop("uid")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)
