"""Best-fit packing of tokenised documents: non-negative least squares over length patterns.

1. Each document is tokenised, ended by the end id and cut into pieces of at
   most ``width`` tokens (only longer documents are cut). The piece table, without
   ids, is written; the histogram of piece lengths has at most ``width`` rows.
2. On that histogram alone: lengths are grouped into coarse bins, patterns of few
   bins that fill a sequence are enumerated, repeat counts are fitted to the
   histogram by non-negative least squares and rounded down. Each pattern is
   realised with exact lengths in bulk (largest first, the last one best fit), and
   what is left is packed best fit, longest first, into open and new sequences.
   Every bulk step uses up a length or a class of open sequences, so that the work
   depends on ``width`` and not on the number of documents.
3. A piece's rank among those of its length comes from counts per (task, length)
   and its place within them; the plan maps a range of ranks to a run of sequences.
   No sort and no window spans the pieces of one length, so a length that a third
   of all documents share is no hot key.

Null texts count as empty ones: a document of only the end id. Repeated rows and
null ids are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenir.llm.common import materialise, table, trimmed

#: Distinct words whose ids a worker keeps; later ones are tokenised again when they come.
KEPT = 1_000_000
#: Bytes of text that are tokenised at once.
BLOCK_BYTES = 12 << 20
BINS, DEPTH = 32, 4
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, _task int, _nth bigint"
PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
#: Letters that are letters, and stay themselves under normalisation, in every Unicode version; then punctuation without an apostrophe.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
_loaded: dict[str, tuple] = {}


def load(path: str):
    """The tokenizer of ``path``, its special strings, which ids end a word, and ids of known words; kept per worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        ends = np.zeros(tok.get_vocab_size(), bool)
        ends[[i for t, i in tok.get_vocab().items() if t.endswith("</w>")]] = True
        _loaded[path] = (tok, [t.content for t in tok.get_added_tokens_decoder().values()], ends, {})
    return _loaded[path]


def ids_of_each(tok, texts: list[str]) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text, by the library alone."""
    return [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


def ids_of_words(tok, ends: np.ndarray, words: list[str], known: dict[str, bytes], kept: int = KEPT) -> list[bytes]:
    """The same for words without white space, with what ``known`` has of them.

    A run of letters is one pre-token, the same in lower case, whose last id is one
    that ends a word: many of them, with spaces between, are tokenised as one text
    and cut apart there.
    """
    parts = [(m[1].lower(), m[2]) if m else None for m in map(PLAIN.fullmatch, words)]
    stems = [w for w in {m[0] for m in parts if m} if w not in known]
    own: dict[str, bytes] = {"": b""}
    for at in range(0, len(stems), 2000):
        part = stems[at : at + 2000]
        ids = np.array(tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(ends[ids]) + 1
        if len(stops) != len(part):
            own.update(zip(part, ids_of_each(tok, part)))
            continue
        data, stops = ids.tobytes(), (4 * stops).tolist()
        own.update((w, data[a:b]) for w, a, b in zip(part, [0, *stops], stops))
    if len(known) + len(own) <= kept:
        known.update(own)
        own = known
    rest = list({m[1] for m in parts if m and m[1]} | {w for w, m in zip(words, parts) if not m})
    more = dict(zip(rest, ids_of_each(tok, rest)), **{"": b""})
    return [(own[m[0]] if m[0] in own else known[m[0]]) + more[m[1]] if m else more[w] for w, m in zip(words, parts)]


def ids_of(path: str, texts: pa.Array, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in turn, and how many each has.

    The tokenizer drops white space and never joins across it, so a text's ids are
    those of its words in turn: texts are cut at ASCII white space in Arrow, each
    distinct word is tokenised once per worker, and ids are gathered in numpy.
    Texts with a special token's string go through the library whole.
    """
    tok, special, ends, known = load(path)
    marked = np.zeros(len(texts), bool)
    for s in special:
        marked |= pc.match_substring(texts, s).to_numpy(False)
    whole = ids_of_each(tok, texts.filter(pa.array(marked)).to_pylist()) if marked.any() else []
    parts = pc.ascii_split_whitespace(pc.if_else(pa.array(marked), "", texts) if whole else texts)
    flat = parts.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    new = [w for w in words if w not in known]
    fresh = dict(zip(new, ids_of_words(tok, ends, new, known, kept)))
    if len(known) + len(fresh) <= kept:
        known.update(fresh)
        fresh = known
    chunks = [known[w] if w in known else fresh[w] for w in words] + whole
    sizes = np.array([len(c) // 4 for c in chunks], np.int64)
    starts = np.cumsum(sizes) - sizes
    every = np.frombuffer(b"".join(chunks), "<u4")
    codes, offsets = flat.indices.to_numpy(), parts.offsets.to_numpy()
    if whole:  # a marked text is one empty word so far
        codes = codes.copy()
        codes[offsets[:-1][marked]] = len(words) + np.arange(len(whole))
    n = sizes[codes]
    total = np.concatenate([[0], np.cumsum(n)])
    # Positions fit 32 bits: a block has a few MB of text, and a longer one is a single text.
    kind = np.int32 if total[-1] < 1 << 31 else np.int64
    ids = every[np.repeat((starts[codes] - total[:-1]).astype(kind), n) + np.arange(total[-1], dtype=kind)]
    return ids, total[offsets[1:]] - total[offsets[:-1]]


def blocks(batch, block_bytes: int):
    size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + block_bytes, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def cut(path: str, width: int, end_id: int, kept: int = KEPT, block_bytes: int = BLOCK_BYTES):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        nth: dict[int, int] = defaultdict(int)
        for batch in batches:
            for part in blocks(batch, block_bytes):
                ids, sizes = ids_of(path, part.column(1), kept)
                data, at, rows = memoryview(ids.astype("<u4", copy=False)).cast("B"), 0, []
                for doc, size in zip(part.column(0).to_pylist(), sizes.tolist()):
                    for piece, start in enumerate(range(0, size + 1, width)):
                        n = min(width, size + 1 - start)
                        crc = zlib.crc32(data[4 * (at + start) : 4 * min(at + start + n, at + size)])
                        rows.append((doc, piece, start, n, zlib.crc32(end, crc) if start + n > size else crc, task, nth[n]))
                        nth[n] += 1
                    at += size
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SCHEMA.types)], schema=SCHEMA)

    return run


SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("_task", pa.int32()), ("_nth", pa.int64())])


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min ||a x - b|| over x >= 0, by the active set method; ``a`` is small."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    slack = 1e-10 * np.abs(a).sum() * max(1.0, np.abs(b).max())
    for _ in range(10 * n):
        gain = np.where(free, -np.inf, a.T @ (b - a @ x))
        j = int(np.argmax(gain))
        if gain[j] <= slack:
            break
        free[j] = True
        while True:
            best = np.zeros(n)
            best[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (best <= 0)
            if not low.any():
                x = best
                break
            # As far towards the optimum of the free ones as none turns negative; what meets zero stays there.
            step = np.min(x[low] / np.maximum(x[low] - best[low], 1e-300))
            x = x + step * (best - x)
            free &= x > 1e-12 * max(1.0, x.max())
            x[~free] = 0
            if not free.any():
                break
    return x


def patterns(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of at most ``depth`` bin sizes (1 to ``bins``) that add up to ``bins``, largest first."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, most: int, got: tuple[int, ...]):
        if not left:
            out.append(got)
        elif len(got) < depth:
            for x in range(min(left, most), 0, -1):
                grow(left - x, x, (*got, x))

    grow(bins, bins, ())
    return out


class Stock:
    """Counts of lengths, with the largest one not above a limit."""

    def __init__(self, counts: dict[int, int]):
        self.count = dict(counts)
        self.lengths = sorted(k for k, n in counts.items() if n)

    def largest(self, low: int, high: int) -> int | None:
        i = bisect.bisect_right(self.lengths, high) - 1
        return self.lengths[i] if i >= 0 and self.lengths[i] >= low else None

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            self.lengths.pop(bisect.bisect_left(self.lengths, length))


def plan(histogram: dict[int, int], width: int, bins: int = BINS, depth: int = DEPTH) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths in order) of the sequences that hold exactly the pieces of ``histogram``."""
    bins = min(bins, width)
    grain = -(-width // bins)
    stock, classes = Stock(histogram), []
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)

    def close(n: int, got: tuple[int, ...]) -> None:
        left = width - sum(got)
        if left:
            room[left].append((n, got))
        else:
            classes.append((n, got))

    if full := stock.count.get(width):
        stock.take(width, full)
        classes.append((full, (width,)))
    forms = [p for p in patterns(bins, depth) if len(p) > 1]
    hist = np.zeros(bins)
    for length in stock.lengths:
        hist[-(-length // grain) - 1] += stock.count[length]
    if forms and hist.any():
        a = np.zeros((bins, len(forms)))
        for j, p in enumerate(forms):
            for x in p:
                a[x - 1, j] += 1
        fitted = np.floor(nnls(a, hist) + 1e-6).astype(np.int64)
        repeats, rest_of = np.zeros(len(forms), np.int64), hist.copy()
        for j in np.argsort(-fitted, kind="stable"):  # no bin is asked for more than it has
            own = a[:, j] > 0
            repeats[j] = min(fitted[j], int((rest_of[own] // a[own, j]).min()))
            rest_of -= repeats[j] * a[:, j]
        for j in np.argsort([-p[0] * bins - p[1] for p in forms], kind="stable"):
            left = int(repeats[j])
            while left > 0:
                got, taken = (), defaultdict(int)
                for k, x in enumerate(forms[j]):
                    rest = width - sum(got)
                    last = k == len(forms[j]) - 1
                    # The last slot takes the best fit of all lengths; the others take their own bin's largest.
                    length = stock.largest(1 if last else (x - 1) * grain + 1, rest if last else min(x * grain, rest))
                    while length is not None and stock.count[length] <= taken[length]:
                        length = stock.largest(1 if last else (x - 1) * grain + 1, length - 1)
                    if length is None:
                        break
                    got += (length,)
                    taken[length] += 1
                if not got:
                    break
                n = min(left, *(stock.count[x] // k for x, k in taken.items() if k))
                for x, k in taken.items():
                    if k:
                        stock.take(x, n * k)
                close(n, got)
                left -= n
    # Residuals: best fit, longest first, into the tightest open sequences.
    gaps = sorted(room)
    while stock.lengths:
        length = stock.lengths[-1]
        i = bisect.bisect_left(gaps, length)
        if i == len(gaps):
            n, got, gap = stock.count[length], (), width
            k = min(width // length, n)
            n = n // k
            stock.take(length, n * k)
            got = (length,) * k
        else:
            gap = gaps[i]
            m, got = room[gap].pop()
            n = min(m, stock.count[length])
            if n < m:
                room[gap].append((m - n, got))
            if not room[gap]:
                del room[gap]
                gaps.pop(i)
            stock.take(length, n)
            k, got = 1, (*got, length)
        left = width - sum(got)
        if left:
            if left not in room or not room[left]:
                bisect.insort(gaps, left)
            room[left].append((n, got))
        else:
            classes.append((n, got))
    return classes + [x for v in room.values() for x in v]


def place(classes: list[tuple[int, tuple[int, ...]]]):
    """Per length: starts of rank ranges, first sequence and offset of each range."""
    used: dict[int, int] = defaultdict(int)
    ranges: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    first = 0
    for n, got in classes:
        offset = 0
        for x in got:
            ranges[x].append((used[x], first, offset))
            used[x] += n
            offset += x
        first += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in ranges.items()}


def put(ranges: dict):
    def run(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, cuts) if len(order) else ():
                start, first, offset = ranges[int(length[at[0]])]
                k = np.searchsorted(start, rank[at], side="right") - 1
                seq[at], off[at] = first[k] + rank[at] - start[k], offset[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], names=[x.split()[0] for x in PLACED.split(", ")])

    return run


def pack_documents(df: DataFrame, path: str, width: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text", kept: int = KEPT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32, sequence_id and offset.

    ``kept`` words and ``block_bytes`` of text trade a worker's memory (about 200 bytes a
    word, 20 times the block) for time; results are the same.
    """
    texts = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pieces = materialise(texts.mapInArrow(trimmed(cut(path, width, end_id, kept, block_bytes)), PIECES), "pieces")
    counts = materialise(pieces.groupBy("_task", "length").agg(F.count("*").alias("_n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most ``width`` rows
    ranges = place(plan(histogram, width))
    # A window here has one row for each task; task blocks keep it short for any number of them.
    before = counts.select("_task", "length", (F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    # A row for each task and length: joined by sorting, since it grows with the number of tasks.
    ranked = pieces.join(before.hint("merge"), ["_task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_nth")).alias("rank"))
    return ranked.mapInArrow(put(ranges), PLACED)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
