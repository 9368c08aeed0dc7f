"""Resolution, matching, merging and versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions.text import search_tokens, slugify


def contested(bases: DataFrame, mark: str) -> DataFrame:
    """``_base`` of those names (``_base``, ``_n`` rows each) whose numbering can meet another name or another's numbering.

    A name c = b + mark + k can be met by b only if b's rows get as far as k. Each of b's rows takes one
    number, and passes over those that are names themselves: where c is the i-th such name, k - 1 - i numbers
    before it are free, so b needs more rows than that. All other names are numbered by their own count.
    """
    digits = F.regexp_extract("_base", r"(\d+)$", 1)
    if mark:
        parts = bases.select(F.col("_base").alias("_c"), F.regexp_extract("_base", rf"(?s)^(.*){mark}([1-9]\d{{0,17}})$", 1).alias("_b"), F.regexp_extract("_base", rf"(?s)^(.*){mark}([1-9]\d{{0,17}})$", 2).alias("_k"))
    else:
        tail = F.least(F.length(digits), F.lit(18))
        each = bases.where(F.length(digits) > 0).select(F.col("_base").alias("_c"), F.explode(F.sequence(F.lit(1), tail)).alias("_l"))
        parts = each.select("_c", F.expr("left(_c, length(_c) - _l)").alias("_b"), F.expr("right(_c, _l)").alias("_k")).where(~F.col("_k").startswith("0"))
    parts = parts.where("_k <> ''").withColumn("_k", F.col("_k").cast("long"))
    # The beginnings that are names themselves come from the distinct ones: all names may begin alike ("handle_1", "handle_2"), and would else meet in one task.
    heads = parts.select("_b").distinct().join(bases.select(F.col("_base").alias("_b"), "_n"), "_b")
    forms = parts.join(heads, "_b")
    met = forms.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy("_k"))).where("_k - 1 - _i < _n")
    return met.select(F.explode(F.array("_b", "_c")).alias("_base")).distinct()


def numbered(rows: DataFrame, name: Column, order: str, out: str, mark: str) -> DataFrame:
    """``out``: the name, or with the first number from 2 (after ``mark``) that no earlier row's has.

    A name may itself end in a number ("x-2"). Names that such numbering can meet (``contested``) are taken one by
    one in order, in groups by what is before their numbers; all others are counted.
    """
    base = rows.withColumn("_base", name)
    number = rf"({mark}\d+)+$" if mark else r"\d+$"
    odd = contested(base.where("_base IS NOT NULL").groupBy("_base").agg(F.count("*").alias("_n")), mark)
    w = Window.partitionBy("_base").orderBy(order)
    plain = base.join(odd, "_base", "left_anti").withColumn("_k", F.row_number().over(w)).withColumn(out, F.when(F.col("_k") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit(mark), F.col("_k").cast("string"))))
    cols = [*rows.columns, out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` string"

    def one_by_one(pdf):
        pdf, taken, got = pdf.sort_values(order, kind="stable"), set(), []
        last: dict[str, int] = {}
        for b in pdf["_base"]:
            i, n = b, last.get(b, 1)
            while i in taken:
                n += 1
                i = f"{b}{mark}{n}"
            last[b] = n
            taken.add(i)
            got.append(i)
        return pdf.assign(**{out: got})[cols]

    mixed = base.join(odd, "_base", "left_semi").groupBy(F.regexp_replace("_base", number, "")).applyInPandas(one_by_one, schema)
    return plain.select(*cols).unionByName(mixed)


def mint_ids(rows: DataFrame, name: str, order: str, prefix: str = "objectType:") -> DataFrame:
    """``id``, a slug of the name; later ones of a slug get -2, -3, ... in order."""
    return numbered(rows, F.concat(F.lit(prefix), slugify(name)), order, "id", "-")


def resolve_first(rows: DataFrame, ref: str, targets: DataFrame, forms: list[tuple[Column, str]], out: str = "resolved") -> DataFrame:
    """The id of the first form of ``ref`` that a target has; ``forms``: (form of ref, target's column)."""
    found = rows
    names = []
    for k, (form, column) in enumerate(forms):
        look = targets.groupBy(F.col(column).alias(f"_f{k}")).agg(F.min("id").alias(f"_r{k}"))
        found = found.join(look, form == F.col(f"_f{k}"), "left").drop(f"_f{k}")
        names.append(f"_r{k}")
    return found.withColumn(out, F.coalesce(*names)).drop(*names)


#: Characters of the pieces by which names that contain each other find each other.
GRAM = 3


def grams(c: str, n: int = GRAM) -> Column:
    """The distinct pieces of ``n`` characters in turn."""
    s = F.col(c)
    return F.array_distinct(F.transform(F.when(F.length(s) >= n, F.sequence(F.lit(1), F.length(s) - n + 1)), lambda i: F.substring(s, i, F.lit(n))))


def containing(needles: DataFrame, stacks: DataFrame, needle: str, stack: str, n: int = GRAM) -> DataFrame:
    """Rows of both sides where ``stack`` contains ``needle`` of at least ``n`` characters.

    A text that holds a needle holds each of its pieces, so the join is by one of them
    (the last by hash, so that common beginnings do not all meet), at any number of rows.
    """
    one = needles.where(F.length(needle) >= n).withColumn("_g", F.array_max(F.transform(grams(needle, n), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"])
    return stacks.withColumn("_g", F.explode(grams(stack, n))).join(one, "_g").where(F.contains(stack, needle)).drop("_g")


def match_names(terms: DataFrame, nodes: DataFrame, least: int = GRAM) -> DataFrame:
    """For each term (``term_id``, ``keys`` in order) the first node (``node_id``, ``ord``, ``name``) whose name equals a key or one contains the other.

    Containment needs ``least`` characters on the shorter side. Pairs come through a
    shared piece of the shorter side, alike at every number of names.
    """
    keys = terms.select("term_id", F.posexplode("keys").alias("key_pos", "key")).where(F.length("key") > 0)
    n = nodes.select("node_id", "ord", "name")
    same = keys.join(n, F.col("key") == F.col("name"))
    inner, outer = containing(n, keys, "name", "key", least), containing(keys, n, "key", "name", least)
    cols = ["term_id", "key_pos", "node_id", "ord"]
    pairs = same.select(*cols).unionByName(inner.select(*cols)).unionByName(outer.select(*cols))
    return pairs.groupBy("term_id").agg(F.min_by("node_id", F.struct("key_pos", "ord")).alias("node_id"))


def lexical_seeds(questions: DataFrame, nodes: DataFrame, k: int = 8) -> DataFrame:
    """Top ``k`` nodes of each question: one for each token of label and id (repeats count) that the question has, 2 more if the label stands in it; ties by ``ord``.

    A question that meets no node gets the first ``k`` nodes with score 0.
    """
    q = questions.select("q_id", F.explode(F.array_distinct(search_tokens("text"))).alias("tok"))
    n = nodes.select("node_id", F.explode(search_tokens(F.concat_ws(" ", "label", F.col("node_id").cast("string")))).alias("tok")).groupBy("node_id", "tok").agg(F.count("*").alias("score"))
    shared = q.join(n, "tok").select("q_id", "node_id", "score")
    low = questions.select("q_id", F.lower("text").alias("_t"))
    label = nodes.where(F.length("label") > 0).select("node_id", F.lower("label").alias("_l"))
    inside = containing(label, low, "_l", "_t").select("q_id", "node_id", F.lit(2).cast("bigint").alias("score"))
    short = label.where(F.length("_l") < GRAM)
    # Labels of one or two characters are pieces themselves.
    for size in range(1, GRAM):
        piece = low.select("q_id", F.explode(grams("_t", size)).alias("_l"))
        inside = inside.unionByName(piece.join(short.where(F.length("_l") == size), "_l").select("q_id", "node_id", F.lit(2).cast("bigint").alias("score")))
    scored = shared.unionByName(inside).groupBy("q_id", "node_id").agg(F.sum("score").alias("score")).join(nodes.select("node_id", "ord"), "node_id")
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "ord")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q_id", "node_id", "score", "rank")
    first = [r["node_id"] for r in nodes.select("ord", "node_id").orderBy("ord").limit(k).collect()]  # k rows
    none = questions.select("q_id").join(best.select("q_id").distinct(), "q_id", "left_anti")
    rest = none.select("q_id", F.posexplode(F.array(*map(F.lit, first)) if first else F.array().cast("array<bigint>")).alias("_k", "node_id"))
    return best.unionByName(rest.select("q_id", "node_id", F.lit(0).cast("bigint").alias("score"), (F.col("_k") + 1).alias("rank")))


def merge_by_key(rows: DataFrame, key: Column, order: str, keep: list[str], best: list[str], lists: list[str]) -> DataFrame:
    """One row per key: first non-empty ``keep`` values in order, greatest ``best``, ordered unions of ``lists``."""
    aggs = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(order))).alias(c) for c in keep]
    aggs += [F.max(c).alias(c) for c in best]
    aggs += [F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v")))), lambda x: x["v"])).alias(c) for c in lists]
    return rows.groupBy(key.alias("key")).agg(*aggs, F.count("*").alias("members"))


def merge_preserve(snapshot: DataFrame, current: DataFrame, key: Column, order: str = "ord") -> DataFrame:
    """The snapshot, then what is new by content key and by id; an empty key falls back to the id."""
    keyed = lambda df: df.withColumn("_key", F.when(key != "", key).otherwise(F.col("id").cast("string")))
    old, new = keyed(snapshot), keyed(current)
    fresh = new.join(old.select("_key").distinct(), "_key", "left_anti").join(old.select("id").distinct(), "id", "left_anti")
    w = lambda c: Window.partitionBy(c).orderBy(order)
    fresh = fresh.withColumn("_a", F.row_number().over(w("_key"))).where("_a = 1").withColumn("_b", F.row_number().over(w("id"))).where("_b = 1")
    return snapshot.unionByName(fresh.select(*snapshot.columns))


def last_wins(parts: list[DataFrame], *keys: str) -> DataFrame:
    """Union of parts where a later part's row replaces an earlier one's of the same keys."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)])
    w = Window.partitionBy(*keys).orderBy(F.desc("_part"))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_part")


def remap(rows: DataFrame, columns: list[str], moved: DataFrame) -> DataFrame:
    """Every reference column through ``moved`` (``old``, ``new``)."""
    out = rows
    for c in columns:
        m = moved.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        out = out.join(m, F.col(c) == F.col("_old"), "left").withColumn(c, F.coalesce("_new", c)).drop("_old", "_new")
    return out


def latest(versions: DataFrame, key: str, version: str) -> DataFrame:
    """K4: each key's row of the highest version, without a sort of its versions."""
    cols = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*cols), version).alias("_r")).select(key, "_r.*")


def version_delta(counts: DataFrame, key: str, version: str, n: str = "n") -> DataFrame:
    """Net added and removed nodes against the version before."""
    was = F.lag(n, 1, 0).over(Window.partitionBy(key).orderBy(version))
    return counts.withColumn("_d", F.col(n) - was).withColumn("added", F.greatest("_d", F.lit(0))).withColumn("removed", F.greatest(-F.col("_d"), F.lit(0))).drop("_d")


def ordered_keys(rows: DataFrame, by: list[str], order: str, value: str, name: str = "columns") -> DataFrame:
    """Values of a group as an array in order."""
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias(name))


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """L4, L5."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
