"""Sentences, chunks and batches of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions.text import col, strip

SENTENCE = "document_id bigint, idx int, text string, char_start int, char_end int"
#: Where a segment ends: line breaks, East Asian ends at once, Latin ends before white space.
ENDS = re.compile(r"[\r\n]+|[。！？；]|[.!?;](?=\s)")
#: Words before a dot that does not end a sentence.
ABBREVIATIONS = frozenset("mr mrs ms dr prof sr jr st vs etc inc ltd co corp no fig eg ie al dept approx min max sec".split())
FULL_STOPS = re.compile(r"\n\n+|[.!?。！？]")


def spans(text: str) -> Iterator[tuple[int, int]]:
    """Sentence spans for coverage; each slice is the trimmed sentence."""
    at = 0
    for m in ENDS.finditer(text):
        yield from trimmed(text, at, m.start() if m[0][0] in "\r\n" else m.end())
        at = m.end()
    yield from trimmed(text, at, len(text))


def trimmed(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    own = text[a:b]
    body = own.strip()
    if body:
        a += len(own) - len(own.lstrip())
        yield a, a + len(body)


def careful_spans(text: str) -> Iterator[tuple[int, int]]:
    """Conservative spans: no end after abbreviations, initials and inside decimals; blank lines end."""
    start = at = 0
    while m := FULL_STOPS.search(text, at):
        if m[0][0] == "\n":
            yield from trimmed(text, start, m.start())
            start = at = m.end()
            continue
        i = m.start()
        if m[0] == ".":
            word = re.search(r"[A-Za-z]*$", text[max(0, i - 24) : i])[0].lower()
            inside = text[max(0, i - 1) : i].isdigit() and text[i + 1 : i + 2].isdigit()
            if inside or len(word) == 1 or word in ABBREVIATIONS:
                at = i + 1
                continue
        end = re.compile(r"[.!?。！？”’\"')\]]*").match(text, i + 1).end()
        if end >= len(text) or text[end].isspace():
            yield from trimmed(text, start, end)
            at = start = re.compile(r"[^\S\n]*").match(text, end).end()
        else:
            at = i + 1
    yield from trimmed(text, start, len(text))


#: Rows of a batch made Python objects at a time, and characters of sentences in a batch that goes out: a worker's memory is bounded by these, whatever the input's batches hold.
ROWS, CHARS = 16, 1 << 18


def splitter(rule):
    def run(batches):
        def block():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()))], names=["document_id", "idx", "text", "char_start", "char_end"])

        cols, held = [[] for _ in range(5)], 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for doc, text in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns)):
                    for k, (a, b) in enumerate(rule(text or "")):
                        for col, x in zip(cols, (doc, k, text[a:b], a, b)):
                            col.append(x)
                        held += b - a
                        if held >= CHARS:
                            yield block()
                            cols, held = [[] for _ in range(5)], 0
        yield block()

    return run


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", rule=spans) -> DataFrame:
    """D9 (or D7 by ``rule=careful_spans``): numbered sentences with offsets.

    One pass over the scan without an exchange: offsets need a scanner, and a window
    over exploded parts would move every text once.
    """
    return docs.select(F.col(key).cast("long"), text).mapInArrow(splitter(rule), SENTENCE)


def clause_split(c) -> Column:
    """Trimmed parts after ``.!?;`` and their East Asian forms before white space, or at line breaks."""
    parts = F.split(col(c), r"(?<=[.!?;。！？；])(?U:\s+)|\r?\n+")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def number_globally(rows: DataFrame, doc: str, pos: str, name: str = "idx") -> DataFrame:
    """K2: 1-based numbers over all documents in order of (doc, pos), by per-document counts and prefix sums.

    No window spans all rows: counts per document are added up in blocks of documents, and
    blocks are as wide as it takes for there to be some ten thousand of them.
    """
    ends = rows.agg(F.min(doc).alias("a"), F.max(doc).alias("b")).first()
    width = max(4096, ((ends["b"] or 0) - (ends["a"] or 0)) // 16_384)
    counts = rows.groupBy(doc).agg(F.count("*").alias("_n")).withColumn("_block", F.floor(F.col(doc) / width))
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_b"))
    before = blocks.withColumn("_base", F.coalesce(F.sum("_b").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_b")
    inner = Window.partitionBy("_block").orderBy(doc).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(before, "_block").select(doc, (F.col("_base") + F.col("_in")).alias("_start"))
    local = F.row_number().over(Window.partitionBy(doc).orderBy(pos))
    return rows.withColumn("_k", local).join(starts, doc).withColumn(name, (F.col("_start") + F.col("_k")).cast("long")).drop("_k", "_start")


def fixed_chunks(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """K6: pieces of ``size`` characters that share ``overlap`` with the piece before."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / F.lit(step)) - 1, F.lit(0)).cast("int")
    return docs.where(F.length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(0), last)).alias("chunk")).select(key, "chunk", F.substring(F.col(text), F.col("chunk") * step + 1, F.lit(size)).alias("text"))


def aligned_chunks(target: int = 6000, overlap: int = 600):
    """K5: whole sentences up to ``target`` characters, the next chunk going back over at most ``overlap`` of them."""

    def chunks(text: str) -> Iterator[tuple[int, int]]:
        own = list(careful_spans(text))
        size = [b - a for a, b in own]
        first = 0
        while first < len(own):
            stop, total = first + 1, size[first]
            while stop < len(own) and total + size[stop] <= target:
                total += size[stop]
                stop += 1
            yield own[first][0], own[stop - 1][1]
            if stop == len(own):
                return
            back, tail = stop, 0
            while back > first + 1 and tail + size[back - 1] <= overlap:
                back -= 1
                tail += size[back]
            first = back
    return chunks


def batches(rows: DataFrame, size: int, *order: str, by: str | None = None) -> DataFrame:
    """K7: number of the batch of ``size`` rows, in order, in each group of ``by``; without groups, of the one batch run that all rows make."""
    w = Window.partitionBy(by if by else F.lit(0)).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


#: Parts of a group whose running sizes are taken side by side.
SIDES = 64


def starts_within(rows: DataFrame, by: str, order: str, size: Column, limit: int) -> DataFrame:
    """Rows of each group with at most ``limit`` of ``size`` before them in order, and no text moved to find them.

    Sizes and order alone are summed, first in ``SIDES`` parts of each group: what a part holds before a row is no more than
    what the group holds, so a row over the limit there is over it in the group, and of those the first of each part
    goes on, which is enough to stop what follows it. What is left gives the place where each group ends.
    """
    own = rows.select(F.col(by).alias("_g"), F.col(order).alias("_o"), size.alias("_n"))
    before = lambda *keys: F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = own.withColumn("_p", F.pmod(F.xxhash64("_o"), F.lit(SIDES)))
    near = part.withColumn("_b", before("_g", "_p")).where(F.col("_b") <= limit)
    ends = near.withColumn("_b", before("_g")).where(F.col("_b") > limit).groupBy("_g").agg(F.min("_o").alias("_end"))
    cut = rows.join(ends, F.col(by).eqNullSafe(F.col("_g")), "left").where(F.col("_end").isNull() | (F.col(order) < F.col("_end")))
    return cut.select(*[rows[c] for c in rows.columns])


def budget_prefix(rows: DataFrame, budget: int, by: str, order: str, text: str) -> DataFrame:
    """K8: rows of each group while the running length stays within ``budget``."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    near = starts_within(rows, by, order, F.coalesce(F.length(text), F.lit(0)), budget)
    return near.withColumn("running", F.sum(F.length(text)).over(w)).where(F.col("running") <= budget)


#: A Latin letter, and after its word two more: content by W2, whatever else there is.
THREE_WORDS = "[a-zA-Z{0}][!-~{0}]* +[!-~{0}]+ +[!-~{0}]".format(r"\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F")


def is_boilerplate(c) -> Column:
    """Empty, numbering only, punctuation only, or fewer than four East Asian characters and words together.

    Most sentences have three plain words, which one search finds; the rest is asked in full.
    """
    return F.when(col(c).rlike(THREE_WORDS), False).otherwise(short_of_words(c))


def short_of_words(c) -> Column:
    t = strip(c)
    cjk = "[\\x{4E00}-\\x{9FFF}]"
    n_cjk = F.length(t) - F.length(F.regexp_replace(t, cjk, ""))
    rest = strip(F.regexp_replace(t, cjk, " "))
    n_words = F.when(rest == "", 0).otherwise(F.size(F.split(rest, r"(?U)\s+")))
    #: Characters of headings and numbering.
    heading = t.rlike(r"(?U)^[\d\s.、第章节()()\-—]+$")
    return (t == "") | heading | t.rlike(r"^[^\p{L}\p{N}]+$") | ~((n_cjk >= 6) | (n_words >= 3)) & (n_cjk + n_words < 4)
