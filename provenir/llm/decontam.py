"""Benchmark decontamination by template windows, in DataFrame operations only.

Texts become templates (control characters 1 to 5 in a text count as spaces). One number is one number
slot, with its points, grouping, fraction or percent ("3.5", "1,000", "3/4", "5%") or as a run of lower-case number
words ("twenty-five"; "one" only before another); a run of capitalised words that does not start a sentence is one name
slot, a measure after a number a unit slot, a sign between two numbers a word ("7 + 9" is slot, "+", slot), and all
else is lower-case words. Windows of ``WINDOW`` template tokens are hashed and joined
with those of the benchmark. A window without more words than slots says little as a
template: it counts for ``exact`` only, with its values. An item is found in
a document if the document holds at least ``SHARE`` of the item's windows and either
their slots hold the same values (``exact``), or each slot value of the item always
stands for one and the same value (``renamed``: a re-parameterised question). That is
judged for each occurrence by itself and for the document as a whole, so several
variants of an item, or a stray window elsewhere, do not hide one another. An
occurrence is what lies in a band, as wide as the item is long, of document position
minus item position; bands come twice, half a width apart, so none cuts all of a copy.

An item shorter than a window is one window of its own length, and documents are cut
into windows of the lengths of such items as well: an item of one word is found
wherever that word stands. Null and empty
texts hold nothing; items without words are never found. Rows with the same id are
one document; a null id is one as well. Repeated items are found each. Empty tables
give an empty result, or one without findings. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import materialise, table

WINDOW, SHARE = 5, 0.5
#: Marks of slots in a template: number, name, unit; the end of a slot's value; a sign. Control characters, so that no word holds them.
NUMBER, NAME, UNIT, END, SIGN = "\x01", "\x02", "\x03", "\x04", "\x05"
TENS = "twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety"
NUMERALS = f"two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|{TENS}|hundred|thousand|million|billion"
#: Runs in the patterns for Spark are possessive: a long one ("1/2/3/...") would else take a stack frame for each part.
DIGITS = r"\p{Nd}+(?:[.,/]\p{Nd}+)*%?"
SIGNS = "[-+*/=×÷]"
UNITS = "kg|g|mg|km|m|cm|mm|miles?|feet|foot|inch(?:es)?|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|pounds?|cents?|percent|liters?|litres?|ml|l|degrees?"
#: Benchmark windows up to which they are broadcast (about 60 bytes each); beyond, they are joined by shuffle.
BROADCAST = 500_000


def tokens(text: Column, values: bool = True) -> Column:
    """Words of a text in lower case; a slot is its mark, followed by its value if ``values``."""
    slot = lambda mark, value: mark + (value if values else "") + END
    edge = r"(?![\p{L}\p{Nd}])"
    spoken = rf"(?<![\p{{L}}\p{{Nd}}])(?=[efhmnost])(?:one[ -])?(?:{NUMERALS}){edge}(?:[ -](?:{NUMERALS}){edge})*+"
    digits = DIGITS.replace(")*", ")*+")
    named = rf"\p{{Lu}}\p{{Ll}}++(?![\p{{L}}\p{{Nd}}{NUMBER}])"
    t = F.regexp_replace(F.translate(text, NUMBER + NAME + UNIT + END + SIGN, " " * 5), f"{spoken}|{digits}", slot(NUMBER, "$0"))
    t = F.regexp_replace(t, rf"(?<=[^.!?:\s] ){named}(?: {named})*+", slot(NAME, "$0"))
    t = F.regexp_replace(F.lower(t), rf"({NUMBER}[^{END}]*{END}) *({SIGNS}) *(?={NUMBER})", f"$1{SIGN}$2")
    t = F.regexp_replace(t, rf"({NUMBER}[^{END}]*{END} *)({UNITS}){edge}", "$1" + slot(UNIT, "$2"))
    marked = rf"[{NUMBER}-{UNIT}][^{END}]*{END}" if values else f"[{NUMBER}-{UNIT}]"
    return F.regexp_extract_all(t, F.lit(rf"{marked}|{SIGN}.|[\p{{L}}\p{{Nd}}]+"), F.lit(0))


def window_rows(h: Column, lengths: list[int]) -> Column:
    """``at``, ``size`` and ``hash`` of each window of template words ``h``: of ``WINDOW`` words, and of each of the (shorter) ``lengths``."""
    row = lambda i, size, x: F.struct(i.alias("at"), F.lit(size).alias("size"), x.alias("hash"))
    starts = lambda size: F.when(F.size(h) >= size, F.sequence(F.lit(0), F.size(h) - size))
    cut = lambda n, *mark: F.transform(starts(n), lambda i: row(i, n, F.xxhash64(*mark, *[F.get(h, i + k) for k in range(n)])))
    out = [cut(WINDOW), *(cut(n, F.lit(-n)) for n in lengths)]
    return out[0] if len(out) == 1 else F.flatten(F.array_compact(F.array(*out)))


def window_hashes(h: Column, lengths: list[int]) -> Column:
    """The hashes alone."""
    return F.transform(window_rows(h, lengths), lambda r: r["hash"])


def windows(df: DataFrame, key: str, text: str, lengths: list[int] | None = None) -> DataFrame:
    """``key``, ``hash`` (of the template), ``at`` (position), ``slots`` (marks and values in order; empty without any), ``whole`` (words and values, of windows without more words than slots; else null) and ``words`` (in the text) of each window.

    ``lengths``: of shorter windows; None: a text shorter than a window is one of its own length, and others have none.
    """
    is_slot = lambda w: F.substring(w, 1, 1).isin(NUMBER, NAME, UNIT)
    t = df.select(F.col(key), tokens(F.col(text)).alias("w"))
    t = t.withColumn("h", F.transform("w", lambda w: F.when(is_slot(w), F.substring(w, 1, 1)).otherwise(w)))
    if lengths is None:
        rows = F.filter(window_rows(F.col("h"), list(range(1, WINDOW))), lambda r: (r["size"] == WINDOW) | (r["size"] == F.size("h")))
    else:
        rows = window_rows(F.col("h"), lengths)
    own = t.select(key, "w", F.size("w").alias("words"), F.explode(rows).alias("r")).select(key, "r.hash", "r.at", "r.size", F.slice("w", F.col("r.at") + 1, F.col("r.size")).alias("w"), "words")
    own = own.withColumn("slots", F.filter("w", is_slot))
    return own.select(key, "hash", "at", "slots", F.when(2 * F.size("slots") >= F.col("size"), F.array_join("w", " ")).alias("whole"), "words", "size")


def occurrences(at: Column, places: Column, words: Column) -> Column:
    """The bands that a document position falls in, for an item of ``words`` words with the window at ``places``; -1 is the whole document."""
    # Positions count from the item's own start and can be negative, which floor keeps apart.
    wide = F.transform(places, lambda p: F.floor((at - p["at"]) / words) * 2)
    shifted = F.transform(places, lambda p: F.floor((at - p["at"]) / words + 0.5) * 2 + 1)
    bands = F.transform(F.array_union(wide, shifted), lambda b: F.struct(F.lit(True).alias("one"), b.alias("band")))
    return F.array_append(bands, F.struct(F.lit(False).alias("one"), F.lit(0).cast("bigint").alias("band")))


def found_items(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", share: float = SHARE) -> DataFrame:
    """``key``, ``item``, ``kind`` (exact or renamed), ``share`` of the item's windows: each item found in a document."""
    asked = materialise(windows(bench.select(F.col(item).alias("_item"), F.col(text).alias("_text")), "_item", "_text"), "asked")
    lengths = sorted(r["size"] for r in asked.where(F.col("size") < WINDOW).select("size").distinct().collect())  # at most WINDOW - 1
    plain = F.col("whole").isNull()
    sizes = asked.groupBy("_item").agg(F.countDistinct(F.when(plain, F.col("hash"))).alias("_of"), F.countDistinct("hash", F.coalesce("whole", F.lit(""))).alias("_all"))
    # One row for each hash (and values, if slots are many) and item, with the places and their slots: repeats in an item do not multiply matches.
    asked = asked.groupBy("hash", "_item", "whole").agg(F.collect_set("slots").alias("_slots"), F.collect_set(F.struct("at")).alias("_places"), F.max("words").alias("_words"))
    small = asked.count() <= BROADCAST
    bound = F.broadcast if small else (lambda x: x)
    # First by hashes alone, from templates without values: what holds too few windows is found in no way.
    own = docs.select(F.col(key), F.col(text))
    said = own.select(key, tokens(F.col(text), values=False).alias("w")).select(key, F.explode(window_hashes(F.col("w"), lengths)).alias("hash"))
    weights = asked.groupBy("hash", "_item").agg(F.count(F.when(plain, 1)).alias("_plain"), F.count("*").alias("_any"))
    held = said.join(bound(weights), "hash").groupBy(key, "_item", "hash").agg(F.max("_plain").alias("_plain"), F.max("_any").alias("_any"))
    counts = held.groupBy(key, "_item").agg(F.sum("_plain").alias("n"), F.sum("_any").alias("n_any"))
    enough = ((F.col("n") >= share * F.col("_of")) & (F.col("_of") > 0)) | (F.col("n_any") >= share * F.col("_all"))
    close = materialise(counts.join(bound(sizes), "_item").where(enough).select(F.col(key).alias("_key"), "_item"), "close")
    # Then the slots of the documents that are left.
    left = own.join(close.select("_key").distinct(), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    met = windows(left, key, text, lengths).withColumnsRenamed({"whole": "_whole", "hash": "_hash"}).drop("words")
    hits = met.join(bound(asked), (F.col("hash") == F.col("_hash")) & F.col("whole").eqNullSafe(F.col("_whole")))
    hits = hits.select(key, "_item", "hash", "whole", "slots", "_slots", F.explode(occurrences(F.col("at"), F.col("_places"), F.col("_words"))).alias("_band"))
    same = F.array_contains("_slots", F.col("slots"))
    # Pairs of a benchmark value and a document value of the slots, for windows with one place in the item.
    pairs = F.when(plain & (F.size("_slots") == 1), F.zip_with(F.get("_slots", F.lit(0)), "slots", lambda b, d: F.struct(b.alias("b"), d.alias("d"))))
    seen = hits.groupBy(key, "_item", "_band", "hash", "whole").agg(F.max(same).alias("same"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    summed = seen.groupBy(key, "_item", "_band").agg(F.count(F.when(plain, 1)).alias("n"), F.count(F.when(plain & F.col("same"), 1)).alias("n_same"), F.count(F.when(F.col("same"), 1)).alias("n_whole"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    consistent = F.size(F.array_distinct(F.transform("pairs", lambda p: p["b"]))) == F.size("pairs")
    enough = lambda n: (F.col(n) >= share * F.col("_of")) & (F.col("_of") > 0)
    whole = F.col("n_whole") >= share * F.col("_all")
    kind = F.when(enough("n") & (F.col("n_same") < F.col("n")) & consistent, "renamed").when(enough("n_same") | whole, "exact")
    part = F.when(F.col("kind") == "renamed", F.col("n") / F.col("_of")).when(enough("n_same"), F.col("n_same") / F.col("_of")).otherwise(F.col("n_whole") / F.col("_all"))
    found = summed.join(bound(sizes), "_item").withColumn("kind", kind).where(F.col("kind").isNotNull()).select(key, F.col("_item").alias(item), "kind", part.alias("share"))
    # One row for each item and document: an exact occurrence before a renamed one.
    return found.groupBy(key, item).agg(F.min("kind").alias("kind"), F.max_by("share", F.struct(F.col("kind") == "exact", "share")).alias("share"))


def contaminated(docs: DataFrame, bench: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids with a finding, each once, with how many and which items."""
    return found_items(docs, bench, key).groupBy(key).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")).cast("array<string>"), ",").alias("items"), F.min("kind").alias("kind"))


def clean(docs: DataFrame, bench: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` in whose documents no item is found."""
    bad = materialise(contaminated(docs, bench, key).select(F.col(key).alias("_bad")), "bad")
    return docs.join(bad, docs[key].eqNullSafe(bad["_bad"]), "left_anti")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bad = contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    ids = docs.select("doc_id").distinct()
    found = ids.join(bad.withColumnRenamed("doc_id", "_bad"), F.col("doc_id").eqNullSafe(F.col("_bad")), "left")
    return found.select("doc_id", F.coalesce(F.col("n_items") > 0, F.lit(False)).alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.lit("")).alias("items"), F.coalesce("kind", F.lit("none")).alias("kind"))


def _sql(name: str, key: str) -> str:
    one = f"chr(6) || '(?:{NUMERALS})' || chr(7)"
    spoken = f"'(?:' || chr(6) || 'one' || chr(7) || '[ -])?' || {one} || '(?:[ -]' || {one} || ')*'"
    names = r"'([^.!?:\s] )(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*)([^\p{L}\p{Nd}\x01]|$)', '\1' || chr(2) || '\2' || chr(4) || '\3', 'g'"
    signs = rf"'(\x01[^\x04]*\x04) *({SIGNS}) *\x01', '\1' || chr(5) || '\2' || chr(1), 'g'"
    return rf"""
{name}_v AS (
  SELECT {key} AS id, regexp_replace(translate(text, chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6) || chr(7), '       '), '([\p{{L}}\p{{Nd}}]+)', chr(6) || '\1' || chr(7), 'g') AS t FROM {name} WHERE text IS NOT NULL
), {name}_d AS (
  SELECT id, regexp_replace(translate(regexp_replace(t, {spoken}, chr(1) || '\0' || chr(4), 'g'), chr(6) || chr(7), ''), '{DIGITS}', chr(1) || '\0' || chr(4), 'g') AS t FROM {name}_v
), {name}_n AS (
  SELECT id, lower(regexp_replace(regexp_replace(t, '([^\p{{L}}\p{{Nd}}.!?:\s\x01-\x05])( \p{{Lu}})', '\1\1\2', 'g'), {names})) AS t FROM {name}_d
), {name}_u AS (
  SELECT id, regexp_replace(regexp_replace(regexp_replace(t, {signs}), {signs}), '(\x01[^\x04]*\x04 *)({UNITS})([^\p{{L}}\p{{Nd}}]|$)', '\1' || chr(3) || '\2' || chr(4) || '\3', 'g') AS t FROM {name}_n
), {name}_s AS (
  SELECT row_number() OVER () AS r, id, regexp_extract_all(t, '[\x01-\x03][^\x04]*\x04|\x05.|[\p{{L}}\p{{Nd}}]+') AS w FROM {name}_u
), {name}_t AS (
  SELECT r, id, w, list_transform(w, lambda x: CASE WHEN x[1] IN (chr(1), chr(2), chr(3)) THEN x[1] ELSE x END) AS h FROM {name}_s WHERE len(w) > 0
), {name}_e AS (
  SELECT r, id, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS i, w, h FROM {name}_t
), {name}_w AS (
  SELECT id, array_to_string(h[i : i + {WINDOW - 1}], ' ') AS hash, list_filter(w[i : i + {WINDOW - 1}], lambda x: x[1] IN (chr(1), chr(2), chr(3))) AS slots, len(h[i : i + {WINDOW - 1}]) AS n FROM {name}_e
), {name}_k AS (
  SELECT id, hash, slots FROM {name}_w WHERE 2 * len(slots) < n
)"""


SQL = f"""
WITH {_sql("documents", "doc_id").strip()}, {_sql("benchmark", "item_id").strip()}, sizes AS (
  SELECT id AS item_id, count(DISTINCT hash) AS n_of FROM benchmark_k GROUP BY id
), asked AS (
  SELECT id AS item_id, hash, list_distinct(list(slots)) AS places FROM benchmark_k GROUP BY id, hash
), hits AS (
  SELECT d.id AS doc_id, a.item_id, d.hash, d.slots, a.places FROM documents_k AS d JOIN asked AS a USING (hash)
), pairs AS (
  SELECT DISTINCT doc_id, item_id, unnest(list_zip(places[1], slots)) AS p FROM hits WHERE len(slots) > 0 AND len(places) = 1
), agree AS (
  SELECT doc_id, item_id, count(DISTINCT p[1]) = count(DISTINCT p) AS ok FROM pairs GROUP BY ALL
), summed AS (
  SELECT doc_id, item_id, count(DISTINCT hash) AS n, count(DISTINCT hash) FILTER (len(slots) = 0 OR list_contains(places, slots)) AS n_same FROM hits GROUP BY ALL
), kinds AS (
  SELECT s.doc_id, s.item_id, CASE WHEN n >= {SHARE} * n_of AND n_same < n AND coalesce(ok, true) THEN 'renamed' WHEN n_same >= {SHARE} * n_of THEN 'exact' END AS kind
  FROM summed AS s JOIN sizes USING (item_id) LEFT JOIN agree AS a ON a.doc_id IS NOT DISTINCT FROM s.doc_id AND a.item_id = s.item_id
), bad AS (
  SELECT doc_id, count(*) AS n_items, array_to_string(list_sort(list(item_id)), ',') AS items, min(kind) AS kind FROM kinds WHERE kind IS NOT NULL GROUP BY doc_id
)
SELECT d.doc_id, n_items IS NOT NULL AS contaminated, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items, '') AS items, coalesce(kind, 'none') AS kind
FROM (SELECT DISTINCT doc_id FROM documents) AS d LEFT JOIN bad AS b ON b.doc_id IS NOT DISTINCT FROM d.doc_id
"""
