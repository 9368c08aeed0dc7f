"""What is wrong with a layer's items, and the value that mends it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions.text import PROPERTY_TYPES, slugify
from provenir.operators.project import LAYERS

#: Closed vocabularies, in order.
SEVERITIES = ["info", "warn", "block"]
PROVENANCES = ["extracted", "inferred", "web_search", "merged", "human"]
REVIEWS = ["pending", "accepted", "edited", "merged", "rejected"]
RULE_KINDS = ["validation", "constraint", "derivation", "state_transition", "authorization", "temporal"]
ROW = ["index", "node_id", "kind", "level", "field", "fix"]


#: Words of a closed vocabulary at most: each is an expression of the plan.
WORDS = 500


def closed_vocabulary(rows: DataFrame, column: str, most: int = WORDS) -> list[str]:
    """The distinct values of a column, sorted; an error where they are too many to be a closed vocabulary."""
    words = [r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(words) > most:
        raise ValueError(f"{column} has over {most} values: no closed vocabulary")
    return sorted(words)


def nearest_word(value: Column, vocabulary: list[str]) -> Column:
    """the first word that begins with the value or the reverse, else the one of least edit distance; earlier words win."""
    v = F.lower(value)
    rank = []
    for k, w in enumerate(vocabulary):
        far = ~(F.lit(w).startswith(v) | v.startswith(F.lit(w)))
        rank.append(F.struct(far.alias("far"), F.when(far, F.levenshtein(v, F.lit(w))).otherwise(0).alias("d"), F.lit(k).alias("k"), F.lit(w).alias("w")))
    return F.array_min(F.array(*rank)).getField("w")


def suggest_fixes(items: DataFrame, layer: str, index: str = "index", text: str = "item") -> DataFrame:
    """(``index``, ``node_id``, ``kind``, ``level``, ``field``, ``fix`` as JSON or null where there is none) for each fault of JSON ``items``.

    New ids do not collide with an item's own; several new ids of one body are numbered by the caller (``project.coerce_id``).
    """
    prefix = next(p for p, owner in LAYERS.items() if owner == layer)
    v = F.try_parse_json(text)
    get = lambda path, kind="string": F.try_variant_get("_v", f"$.{path}", kind)
    of = lambda path: F.schema_of_variant(F.try_variant_get("_v", f"$.{path}", "variant"))
    rows = items.select(F.col(index).alias("index"), v.alias("_v")).withColumn("_kind", F.schema_of_variant("_v"))
    number = F.concat(F.lit("#"), F.col("index").cast("string"))
    is_text = lambda p: F.coalesce(of(p) == "STRING", F.lit(False))
    out = lambda where, kind, level, field, fix, ids=None: rows.where(where).select("index", (ids if ids is not None else node).alias("node_id"), F.lit(kind).alias("kind"), F.lit(level).alias("level"), F.lit(field).alias("field"), fix.alias("fix"))
    json = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    none = F.lit(None).cast("string")
    whole = F.coalesce(F.col("_kind").startswith("OBJECT"), F.lit(False))
    node = F.when(is_text("id"), get("id")).otherwise(number)
    parts = [out(~whole, "item_not_object", "error", "", none, number)]

    # Ids: a body of the name where there is none, else the same body under the layer's prefix.
    known = "^(" + "|".join([*LAYERS, "doc:", "ontology:", "inst:", "term:"]) + ")"
    taken = rows.where(whole & is_text("id")).select(get("id").alias("_id")).distinct()
    has_id = is_text("id") & (get("id") != "")
    name = F.coalesce(F.when(is_text("name"), get("name")), F.when(is_text("name.en"), get("name.en")), F.lit(""))
    want = F.concat(F.lit(prefix), slugify(F.regexp_replace(F.when(has_id, get("id")).otherwise(name), known, "")))
    bad = rows.where(whole & (~has_id | (want != get("id")))).withColumn("_want", want).select("index", "_want", has_id.alias("_has"), node.alias("node_id"))
    # The first free number: as many as there are ids of that body in a row from 2 on.
    family = taken.withColumn("_want", F.regexp_replace("_id", r"-\d+$", "")).withColumn("_n", F.when(F.col("_id") == F.col("_want"), 1).otherwise(F.regexp_extract("_id", r"-(\d+)$", 1).try_cast("int")))
    plain = taken.select(F.col("_id").alias("_want"), F.lit(1).alias("_n"))
    numbers = family.select("_want", "_n").unionByName(plain).where("_n IS NOT NULL").groupBy("_want").agg(F.array_sort(F.collect_set("_n")).alias("_ns"))
    free = F.array_min(F.filter(F.transform(F.sequence(F.lit(1), F.size("_ns") + 1), lambda k: F.when(~F.array_contains("_ns", k), k)), lambda k: k.isNotNull()))
    fixed = bad.join(numbers, "_want", "left").withColumn("_free", F.when(F.col("_ns").isNull() | ~F.array_contains("_ns", F.lit(1)), 1).otherwise(free))
    mended = json(F.when(F.col("_free") == 1, F.col("_want")).otherwise(F.concat_ws("-", "_want", F.col("_free").cast("string"))))
    parts.append(fixed.select("index", "node_id", F.when(F.col("_has"), "bad_id_prefix").otherwise("missing_field").alias("kind"), F.when(F.col("_has"), "warn").otherwise("error").alias("level"), F.lit("id").alias("field"), mended.alias("fix")))

    # Fields that all layers share, then those of objects, events and rules.
    numeric = F.coalesce(of("confidence").rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), F.lit(False))
    parts.append(out(whole & ~numeric, "missing_field", "warn", "confidence", F.lit("0.5")))
    parts.append(out(whole & ~F.coalesce(of("sources").startswith("ARRAY"), F.lit(False)), "missing_field", "warn", "sources", F.lit("[]")))
    closed = [("reviewState", REVIEWS, "pending"), ("provenance", PROVENANCES, "human")]
    if layer == "rules":
        closed += [("severity", SEVERITIES, "warn"), ("kind", RULE_KINDS, None)]
    for path, words, default in closed:
        if default:
            parts.append(out(whole & ~is_text(path), "missing_field", "warn", path, F.lit(f'"{default}"')))
        parts.append(out(whole & is_text(path) & ~get(path).isin(words), "bad_enum", "error", path, json(nearest_word(get(path), words))))
    if layer in ("objects", "events"):
        parts.append(out(whole & ~is_text("nameZh"), "missing_field", "warn", "nameZh", json(name)))
    if layer == "objects":
        prop = rows.where(whole).select("index", node.alias("node_id"), F.posexplode(F.try_variant_get("_v", "$.properties", "array<variant>")).alias("_k", "_p"))
        said = lambda p: F.try_variant_get("_p", f"$.{p}", "string")
        field = lambda p: F.concat(F.lit("properties."), F.col("_k").cast("string"), F.lit(f".{p}"))
        odd = said("type").isNotNull() & ~said("type").isin(*PROPERTY_TYPES, "List<String>") & ~said("type").rlike("^List<.+>$")
        parts.append(prop.where(odd).select("index", "node_id", F.lit("bad_enum").alias("kind"), F.lit("error").alias("level"), field("type").alias("field"), json(nearest_word(said("type"), [*PROPERTY_TYPES, "List<String>"])).alias("fix")))
        lost = F.coalesce(F.try_variant_get("_p", "$.is_foreign_key", "boolean"), F.lit(False)) & (F.coalesce(said("references"), F.lit("")) == "")
        parts.append(prop.where(lost).select("index", "node_id", F.lit("reference_without_target").alias("kind"), F.lit("error").alias("level"), field("references").alias("field"), none.alias("fix")))
    return reduce(DataFrame.unionByName, parts).select(*ROW)


def cluster_rules(rules: DataFrame, groups: DataFrame) -> DataFrame:
    """Each rule's cluster: its explicit group, else its hint, else its set of objects, else ``General``. ``groups``: group_id, rule_id, ord."""
    first = groups.groupBy("rule_id").agg(F.min_by("group_id", "ord").alias("_g"))
    objects = F.nullif(F.array_join(F.array_sort(F.array_distinct(F.coalesce("objects", F.array().cast("array<string>")))), "|"), F.lit(""))
    return rules.join(first, F.col("id") == F.col("rule_id"), "left").select("id", F.coalesce("_g", F.nullif(F.trim("hint"), F.lit("")), objects, F.lit("General")).alias("cluster"))


def use_case_coverage(links: DataFrame, cases: DataFrame, expected: DataFrame) -> DataFrame:
    """A5: share of found entities (``id``, ``found``) among those that each use case links to; one without links is judged by all."""
    n = expected.agg(F.count("*").alias("n"), F.count_if("found").alias("k")).first()  # one row
    own = links.join(expected, F.col("entity_id") == F.col("id")).groupBy("case_id").agg(F.count("*").alias("_n"), F.count_if("found").alias("_k"))
    total, hit = F.coalesce("_n", F.lit(n["n"])), F.coalesce("_k", F.lit(n["k"]))
    return cases.select("case_id").join(own, "case_id", "left").select("case_id", F.when(total == 0, 1.0).otherwise(hit / total).alias("coverage"))


def citation_issues(citations: DataFrame, nodes: DataFrame) -> DataFrame:
    """V2, per citation: unverified quotations, and citations of rules that need sources but name no sentence."""
    own = citations.join(nodes.select(F.col("id").alias("node_id"), "kind", "provenance"), "node_id")
    unsure = own.where(F.col("verified").eqNullSafe(False)).select("node_id", "ord", F.lit("quote_unverified").alias("issue"))
    bare = (F.col("kind") == "rule") & F.col("provenance").isin("extracted", "merged") & (F.size(F.coalesce("sentence_refs", F.array().cast("array<bigint>"))) == 0)
    return unsure.unionByName(own.where(bare).select("node_id", "ord", F.lit("missing_source").alias("issue")))


def coverage_target(explicit=None, configured: str | None = None) -> float:
    """The explicit target, else the configured one, else 1; in [0, 1], and 1 for what is no number."""
    import math

    try:
        x = float(explicit if explicit is not None else "1" if configured is None else configured or 0)
    except ValueError:
        return 1.0
    return min(1.0, max(0.0, x)) if math.isfinite(x) else 1.0

