"""Confidence, completeness and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions.text import clamp01, col

#: Fixed values of the rubric.
PRIOR, SELF_WEIGHT, BAND = 0.6, 0.25, (0.45, 0.8)
NO_SOURCES, NONE_VERIFIED = 0.7, 0.4
AGREEMENT = {"none": 0.9, "one": 1.0, "one_unverified": 0.85, "two": 1.05, "many": 1.1}
INTEGRITY_FLOOR, SCHEMA_FLOOR = 0.5, 0.7
KIND_WEIGHTS = {"object": 1.0, "relationship": 0.6, "rule": 1.0, "action": 1.4, "event": 0.9, "process": 1.3}
REVIEW_WEIGHTS = {"accepted": 1.25, "edited": 1.25, "human": 1.25, "merged": 1.1, "rejected": 0.0}


def rubric(self_rating, sources, verified, witnesses, refs, resolved, completeness) -> Column:
    """Base x grounding x agreement x integrity x schema, in [0, 1]."""
    r, n, v, w, t = col(self_rating), col(sources), col(verified), col(witnesses), F.coalesce(col(refs), F.lit(0))
    base = F.when(r.isNull() | F.isnan(r), PRIOR).otherwise(F.least(F.lit(BAND[1]), F.greatest(F.lit(BAND[0]), PRIOR + SELF_WEIGHT * (clamp01(r) - PRIOR))))
    grounding = F.when(n == 0, NO_SOURCES).when(v == 0, NONE_VERIFIED).otherwise(NONE_VERIFIED + (1 - NONE_VERIFIED) * v / n)
    agreement = F.when(w <= 0, AGREEMENT["none"]).when((w == 1) & (v > 0), AGREEMENT["one"]).when(w == 1, AGREEMENT["one_unverified"]).when(w == 2, AGREEMENT["two"]).otherwise(AGREEMENT["many"])
    held = F.least(F.greatest(F.coalesce(col(resolved), F.lit(0)), F.lit(0)), t)
    integrity = F.when(t <= 0, 1.0).otherwise(INTEGRITY_FLOOR + (1 - INTEGRITY_FLOOR) * held / t)
    schema = SCHEMA_FLOOR + (1 - SCHEMA_FLOOR) * clamp01(completeness)
    return clamp01(base * grounding * agreement * integrity * schema)


def weight_of(kind, review) -> Column:
    look = lambda d, c, default: F.coalesce(F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[col(c)], F.lit(default))
    return look(KIND_WEIGHTS, kind, 1.0) * look(REVIEW_WEIGHTS, review, 1.0)


def model_confidence(nodes: DataFrame, *by: str) -> DataFrame:
    """Weighted mean of ``confidence`` by kind and review; rejected nodes have no weight, nothing gives 0."""
    w = weight_of("kind", "review")
    return nodes.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(F.col("confidence") * w), F.nullif(F.sum(w), F.lit(0.0))), F.lit(0.0)).alias("confidence"))


def completeness(*slots: Column) -> Column:
    """Share of required slots that are filled."""
    return sum((F.coalesce(s, F.lit(False)).cast("int") for s in slots[1:]), F.coalesce(slots[0], F.lit(False)).cast("int")) / len(slots)


def recall(expected: DataFrame, layer: str = "layer", matched: str = "matched") -> DataFrame:
    """A5: recall per layer and over all of them; nothing expected gives 1."""
    rate = F.coalesce(F.try_divide(F.count_if(F.col(matched)), F.count("*")), F.lit(1.0))
    return expected.rollup(layer).agg(F.count("*").alias("expected"), F.count_if(F.col(matched)).alias("matched"), F.round(rate, 6).alias("recall")).withColumn(layer, F.coalesce(layer, F.lit("*")))
