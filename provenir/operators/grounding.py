"""Quotations in texts: located exactly, then normalised, then by token windows; sentence coverage."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions.text import line_number, normalize_search
from provenir.operators.matching import grams
from provenir.operators.segment import is_boilerplate
from provenir.sources.tables import keep

#: Least overlap of token sets, and source tokens beyond which windows are not tried.
FUZZY, MOST_TOKENS = 0.8, 4000
#: Characters that key a quotation without inner words.
PIECE = 6
#: Words of a quotation that key the corpus-wide lookup at most.
ANCHOR = 3
#: Keys of quotations up to which they are broadcast (some 16 bytes each, tokens some 30); beyond, they are joined by shuffle.
FEW = 200_000
#: Bytes of candidates with their quotations up to which these are broadcast to the texts.
LIGHT = 8 << 20


#: What parts words: ASCII that is no letter or digit, and sigma, whose lower case depends on what follows the word.
BETWEEN = "".join(chr(k) for k in range(1, 128) if not chr(k).isalnum()) + "\u03a3\u03c3\u03c2"


def split_words(c) -> Column:
    """Words, and empty ones between marks in turn; characters are replaced one by one, as splitting by a pattern takes several times as long."""
    return F.split(F.translate(c, BETWEEN, " " * len(BETWEEN)), " ")


def run_hashes(words: Column, n: int) -> Column:
    """Hashes of the runs of ``n`` words in turn."""
    first = F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return F.transform(first, lambda w, i: F.xxhash64(F.lit(n), w, *[F.get(words, i + k) for k in range(1, n)]))


def bounded(df: DataFrame, n: int) -> DataFrame:
    """``df`` (a column of keys or two) of ``n`` rows, to be broadcast where these are few."""
    return F.broadcast(df) if n <= FEW else df


def runs_of(words: Column, lengths: list[int]) -> Column:
    """Rows of the runs of ``max(lengths)`` words in turn as ``_w0``, ``_w1``, ...; at the end of a text the last words are null."""
    parts = [(words if k == 0 else F.slice(words, F.lit(k + 1), F.greatest(F.size(words) - k, F.lit(0)))).alias(f"_w{k}") for k in range(max(lengths))]
    return F.inline(F.arrays_zip(*parts))


def candidates(quotes: DataFrame, docs: DataFrame, quote_key: str, doc_key: str, quote: str, text: str, *forms) -> DataFrame:
    """Pairs of ``doc_key`` and ``quote_key`` among which are all where a document's text holds the quotation in one of the ``forms`` of both.

    A quotation's inner words stand whole, and in turn, in any text that holds it. Documents
    give the hashes of their runs of up to ``ANCHOR`` words that are runs of some quotation (runs
    of no quotation go no further); these are counted, and each quotation's rarest run is its key.
    Words are those of the first form, which a later one must not tell apart more. Quotations without an
    inner word go by the characters they have in each form, cut into pieces.
    """
    form = forms[0]
    q = quotes.select(F.col(quote_key), form(quote).alias("_q"), *[f(quote).alias(f"_q{k}") for k, f in enumerate(forms[1:], 1)])
    q = q.where(reduce(Column.__or__, [F.length("_q" + str(k or "")) > 0 for k in range(len(forms))]))
    d = docs.select(F.col(doc_key), form(text).alias("_t"))
    words = split_words("_q")
    q = q.withColumn("_w", F.when(F.size(words) > 2, F.array_remove(F.slice(words, 2, F.size(words) - 2), "")).otherwise(F.array().cast("array<string>")))
    q = q.withColumn("_n", F.least(F.size("_w"), F.lit(ANCHOR)))
    runs = F.lit(None).cast("array<bigint>")
    for n in range(1, ANCHOR + 1):
        runs = F.when(F.col("_n") == n, run_hashes(F.col("_w"), n)).otherwise(runs)
    keyed = keep(q.withColumn("_runs", F.array_distinct(runs)).drop("_w"), "quotations")
    lengths = sorted(r["_n"] for r in keyed.select("_n").distinct().collect())  # 0 to ANCHOR
    sizes = [n for n in lengths if n]
    found = []
    if sizes:
        asked = keyed.where("_n > 0").select(quote_key, F.explode("_runs").alias("_h"))
        every = keep(asked.select("_h").distinct(), "runs")
        # Rows and no lambda: generated code hashes them.
        each = d.select(doc_key, F.array_remove(split_words("_t"), "").alias("_d")).select(doc_key, runs_of(F.col("_d"), sizes))
        hashed = [F.when(F.col(f"_w{n - 1}").isNotNull(), F.xxhash64(F.lit(n), *[f"_w{k}" for k in range(n)])) for n in sizes]
        said = each.select(doc_key, (F.explode(F.array(*hashed)) if len(sizes) > 1 else hashed[0]).alias("_h")).where("_h IS NOT NULL")
        said = keep(said.join(bounded(every, every.count()), "_h", "left_semi").distinct(), "said")
        times = said.groupBy("_h").agg(F.count("*").alias("_times"))
        rarest = asked.join(times, "_h").groupBy(quote_key).agg(F.count("*").alias("_found"), F.min(F.struct("_times", "_h")).alias("_r"))
        # A text that holds a quotation holds all of its runs: one that no text has is in none.
        whole = rarest.join(keyed.select(quote_key, F.size("_runs").alias("_all")), quote_key).where("_found = _all")
        anchors = keep(whole.select(quote_key, F.col("_r._h").alias("_h")), "anchors")
        found.append(said.join(bounded(anchors, anchors.count()), "_h").select(doc_key, quote_key))
    if 0 in lengths:
        for i, f in enumerate(forms):
            own = f"_q{i}" if i else "_q"
            short = keyed.where((F.col("_n") == 0) & (F.length(own) > 0)).select(quote_key, F.col(own).alias("_q"), F.least(F.length(own), F.lit(PIECE)).alias("_k"))
            shown = docs.select(F.col(doc_key), f(text).alias("_t"))
            for k in sorted(r["_k"] for r in short.select("_k").distinct().collect()):  # 1 to PIECE
                piece = shown.select(doc_key, F.explode(grams("_t", k)).alias("_g"))
                found.append(piece.join(short.where(F.col("_k") == k).select(quote_key, F.left("_q", F.lit(k)).alias("_g")), "_g").select(doc_key, quote_key))
    if not found:
        return d.select(doc_key).join(keyed.select(quote_key), F.lit(False))
    return keep(reduce(DataFrame.unionByName, found).distinct(), "candidates")


def holding(pairs: DataFrame, quotes: DataFrame, docs: DataFrame, quote_key: str, doc_key: str, quote: str, text: str, form) -> DataFrame:
    """Of ``pairs``, those where the text holds the quotation, with both in their form (``_t``, ``_q``)."""
    # Each form is made for the candidates alone. While these are few, they travel and the texts stay.
    asked = pairs.join(quotes.select(F.col(quote_key), form(quote).alias("_q")), quote_key).where(F.length("_q") > 0)
    size = asked.agg(F.sum(F.octet_length("_q") + 16)).first()[0] or 0
    met = docs.select(F.col(doc_key), F.col(text).alias("_raw")).join(F.broadcast(asked) if size <= LIGHT else asked, doc_key)
    return met.select(doc_key, form("_raw").alias("_t"), quote_key, "_q").where(F.contains("_t", "_q"))


def contains_pairs(quotes: DataFrame, docs: DataFrame, quote_key: str, doc_key: str, quote: str, text: str, form=F.col, pairs: DataFrame | None = None) -> DataFrame:
    """``doc_key``, ``quote_key``, ``_t`` and ``_q`` where a document's text holds the quotation; ``form`` makes the form of a text to compare, ``pairs`` are candidates where they are known."""
    on = (quotes, docs, quote_key, doc_key, quote, text)
    return holding(candidates(*on, form) if pairs is None else pairs, *on, form)


def ground_exact(quotes: DataFrame, docs: DataFrame, quote_key: str = "item_id", doc_key: str = "doc_id", text: str = "text", pairs: DataFrame | None = None) -> DataFrame:
    """J9, first tier: first occurrence of each quotation in each text, with offsets and line."""
    hits = contains_pairs(quotes, docs, quote_key, doc_key, text, text, pairs=pairs)
    # Hits are written first: else a later filter on the offset moves into the join and is computed for every pair.
    hits = keep(hits.select(doc_key, quote_key, "_q", "_t"), "hits")
    at = F.expr("locate(_q, _t)") - 1
    placed = hits.withColumn("char_start", at)
    return placed.select(doc_key, quote_key, "char_start", (F.col("char_start") + F.length("_q")).alias("char_end"), line_number("_t", "char_start").alias("line"))


def ground_normalized(quotes: DataFrame, docs: DataFrame, quote_key: str = "item_id", doc_key: str = "doc_id", text: str = "text", pairs: DataFrame | None = None) -> DataFrame:
    """J9, second tier: pairs that agree in lower case with single spaces; offsets in the original text by ``map_back``."""
    hits = keep(contains_pairs(quotes, docs, quote_key, doc_key, text, text, normalize_search, pairs).select(doc_key, quote_key, "_q"), "hits")
    back = hits.join(docs.select(doc_key, F.col(text).alias("_o")), doc_key)
    return back.mapInArrow(map_back, f"{doc_key} bigint, {quote_key} bigint, char_start int, char_end int")


def place(quote: str, text: str) -> tuple[int, int] | None:
    """Where ``quote``, in lower case with single spaces, first stands in ``text`` so written; offsets in ``text`` itself."""
    found = [(m.start(), m[0]) for m in re.finditer(r"\S+", text)]
    low = [w.lower() for _, w in found]
    k = " ".join(low).find(quote)
    if k < 0 or not quote:
        return None
    starts = list(accumulate((len(w) + 1 for w in low), initial=0))

    def back(at: int) -> int:
        i = bisect_right(starts, at) - 1
        (begin, word), at = found[i], at - starts[i]
        if len(word) != len(low[i]):  # a few letters have a lower case of two characters
            at = next(n for n, end in enumerate(accumulate(len(c.lower()) for c in word)) if end > at)
        return begin + at

    return back(k), back(k + len(quote) - 1) + 1


def map_back(batches):
    """Offsets in the original text of a normalised quotation's first occurrence."""
    for b in batches:
        got = [place(quote, text) or (None, None) for quote, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.int32()), pa.array([y for _, y in got], pa.int32())], names=[b.schema.names[0], b.schema.names[1], "char_start", "char_end"])


def best_window(batches):
    """J10 per pair: the first window of as many tokens as the quotation with the highest overlap of token sets."""
    for b in batches:
        rows = []
        for doc, item, quote, text in zip(*(b.column(k).to_pylist() for k in range(4))):
            want = quote.lower().split()
            spans = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"\S+", text)]
            if not want or not spans or len(spans) > MOST_TOKENS:
                continue
            asked, n = set(want), len(want)
            best = None
            # Counts of the window's tokens move with it, so a step costs two updates and not a set.
            held: dict[str, int] = {}
            common = 0
            for i, (tok, _, _) in enumerate(spans):
                held[tok] = held.get(tok, 0) + 1
                common += held[tok] == 1 and tok in asked
                if i >= n:
                    old = spans[i - n][0]
                    held[old] -= 1
                    if not held[old]:
                        del held[old]
                        common -= old in asked
                if i >= n - 1 or i == len(spans) - 1:
                    score = common / (len(asked) + len(held) - common)
                    first = max(0, i - n + 1)
                    if score >= FUZZY and (best is None or score > best[0]):
                        best = (score, spans[first][1], spans[i][2])
            if best:
                rows.append((doc, item, *best))
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()))], names=[b.schema.names[0], b.schema.names[1], "score", "char_start", "char_end"])


def ground_fuzzy(quotes: DataFrame, docs: DataFrame, quote_key: str = "item_id", doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """J10 over a corpus: pairs with a window of overlap FUZZY or more; never counts as verified.

    Such a window holds at least FUZZY of the quotation's n distinct tokens, so it holds
    one of any n - ceil(FUZZY n) + 1 of them. Documents give their tokens that are some quotation's;
    these are counted, and the rarest ones of a quotation are what it looks documents up by. Texts meet only
    for the pairs this leaves, and only those are scanned that hold enough of all tokens.
    """
    words = lambda c: F.array_remove(F.array_distinct(F.split(normalize_search(c), " ")), "")
    q = keep(quotes.select(quote_key, F.col(text).alias("_q"), words(text).alias("_a")).where(F.size("_a") > 0), "quotations")
    own = q.select(quote_key, F.explode("_a").alias("tok"))
    every = keep(own.select("tok").distinct(), "tokens")
    held = keep(docs.select(doc_key, F.explode(words(text)).alias("tok")).join(bounded(every, every.count()), "tok", "left_semi"), "held")
    times = held.groupBy("tok").agg(F.count("*").alias("n"))
    # A quotation's tokens, rarest first.
    ranked = own.join(times, "tok", "left").groupBy(quote_key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "tok"))).alias("r"))
    first = F.size("r") - F.ceil(F.lit(FUZZY) * F.size("r") - 1e-9).cast("int") + 1
    asked = keep(ranked.select(quote_key, F.explode(F.slice("r", F.lit(1), first)).alias("x")).select(quote_key, "x.tok"), "asked")
    pairs = held.join(bounded(asked, asked.count()), "tok").select(doc_key, quote_key).distinct()
    # Enough of all tokens, from the tokens alone.
    size = q.select(quote_key, F.size("_a").alias("_n"))
    common = pairs.join(own, quote_key).join(held, [doc_key, "tok"], "left_semi").groupBy(doc_key, quote_key).agg(F.count("*").alias("_c"))
    pairs = keep(common.join(size, quote_key).where(F.col("_c") >= FUZZY * F.col("_n") - 1e-9).select(doc_key, quote_key), "candidates")
    both = pairs.join(q.select(quote_key, "_q"), quote_key).join(docs.select(doc_key, F.col(text).alias("_t")), doc_key)
    return both.select(doc_key, quote_key, "_q", "_t").mapInArrow(best_window, f"{doc_key} bigint, {quote_key} bigint, score double, char_start int, char_end int")


def page_of(offsets: DataFrame, pages: DataFrame, doc: str) -> DataFrame:
    """The page that holds an offset range's start, else the one with the largest overlap."""
    both = offsets.join(pages, doc)
    overlap = F.least("char_end", "page_end") - F.greatest("char_start", "page_start")
    rank = F.struct(((F.col("char_start") >= F.col("page_start")) & (F.col("char_start") < F.col("page_end"))).alias("holds"), overlap.alias("o"), (-F.col("page")).alias("p"))
    near = both.where((overlap > 0) | (F.col("char_start") == F.col("page_start")))
    return near.groupBy(*offsets.columns).agg(F.max_by("page", rank).alias("page"))


def cover(sentences: DataFrame, intervals: DataFrame, cap: int = 8, near: DataFrame | None = None) -> DataFrame:
    """Sentences with the first ``cap`` distinct node ids of citations that overlap them.

    Equal document and grid cell of offsets; a sentence and an interval that overlap
    share a cell, and a pair counts in the first cell that both touch. ``near``: the sentences of cited documents, where
    they can be had without splitting all texts once more.
    """
    cell = 512
    cells = lambda df: df.withColumn("_c", F.explode(F.sequence(F.floor(F.col("char_start") / cell), F.floor((F.col("char_end") - 1) / cell))))
    s = cells((sentences if near is None else near).select("document_id", "idx", "char_start", "char_end"))
    i = cells(intervals.select("document_id", "node_id", F.col("char_start"), F.col("char_end"))).select("document_id", "_c", "node_id", F.col("char_start").alias("a"), F.col("char_end").alias("b"))
    first = F.floor(F.greatest("char_start", "a") / cell)
    hit = s.join(i, ["document_id", "_c"]).where((F.col("a") < F.col("char_end")) & (F.col("b") > F.col("char_start")) & (F.col("_c") == first))
    # Written, so that its size is known: while it is small, the sentences' texts are not moved to meet it.
    by = keep(hit.groupBy("document_id", "idx").agg(F.slice(F.array_sort(F.collect_set("node_id")), 1, cap).alias("covered_by")), "covered")
    return sentences.join(by, ["document_id", "idx"], "left")


def coverage_status(covered: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Cited, else boilerplate, else the judge's verdict, else uncovered."""
    tier1 = F.when(F.size(F.coalesce("covered_by", F.array().cast("array<bigint>"))) > 0, "covered")
    tier2 = F.when(is_boilerplate("text"), "uncoverable")
    if verdicts is None:
        return covered.withColumn("status", F.coalesce(tier1, tier2, F.lit("uncovered")))
    known = verdicts.where(F.col("verdict").isin("covered", "partial", "uncovered", "uncoverable"))
    return covered.join(known, ["document_id", "idx"], "left").withColumn("status", F.coalesce(tier1, tier2, "verdict", F.lit("uncovered"))).drop("verdict")


def coverage_ratio(status: DataFrame, *by: str, target: float = 1.0) -> DataFrame:
    """A4: counts per status, covered share of what can be covered to four places, and whether it meets the target."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = status.groupBy(*by).agg(F.count("*").alias("total"), n("covered").alias("covered"), n("partial").alias("partial"), n("uncovered").alias("uncovered"), n("uncoverable").alias("uncoverable"))
    ratio = F.round(F.col("covered") / F.greatest(F.lit(1), F.col("total") - F.col("uncoverable")), 4)
    return out.withColumn("ratio", ratio).withColumn("meets_target", F.col("ratio") >= target)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """K3: the first row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
