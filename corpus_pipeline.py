"""Corpus pipeline: five stages over ``documents``, each by one operator.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``documents``, with their values, whatever other
columns there are.

The near-duplicate stage links texts of a 5-word Jaccard similarity of 0.8 or more. Most pairs are
found by SimHash tables and decided by their shingle sets; what the tables leave is found exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provenir.llm import decontam, langid, nearcopies, packing, quality
from provenir.llm.common import materialise, ship, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of likely quality that are not likely toxic."""
    ship(spark)
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language: reject texts without letters or without evidence for the predicted language."""
    ship(spark)
    known = docs.where(~langid.held_out())
    model = langid.fit(known)
    return langid.kept(docs, model, langid.floors(known, model))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document (by id) of each group of near copies: 5-word Jaccard of 0.8 or more."""
    ship(spark)
    return nearcopies.first_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which no benchmark item is found."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens."""
    import public_tokenizers

    ship(spark)
    # By this stage the executors' heaps have grown, so the workers keep less.
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), kept=60_000, block_bytes=1 << 20)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: the classifiers are fitted models; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
