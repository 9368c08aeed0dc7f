"""Queries of the training-data operators and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

import importlib

from provenir.llm.common import ship

#: Query, module, name of the SQL in it (None: the query is tested against brute force in tests/llm).
REGISTRY = [
    ("op1_chat_formatting", "chat", "SQL"),
    ("op2_decontamination", "decontam", "SQL"),
    ("op3_packing", "packing", None),
    ("op4_html_extraction", "html", "SQL"),
    ("op5_simhash_near_dedup", "simhash", None),
    ("op6_sharding", "sharding", None),
    ("op7_top_k", "topk", "SQL"),
    ("op8_quality_classifier", "quality", None),
    ("op9_language_id", "langid", None),
    ("op10_token_counts", "tokencount", None),
    ("op11_minhash_near_dedup", "minhash", "SQL"),
    ("op12_lexical_search", "lexical", "SQL"),
    ("op13_vector_codes", "codes", "SQL"),
]


def _query(module: str, name: str):
    def run(spark, sf_dir):
        ship(spark)
        return getattr(importlib.import_module(f"provenir.llm.{module}"), name)(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _query(module, name) for name, module, _ in REGISTRY}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"provenir.llm.{module}"), sql) for name, module, sql in REGISTRY if sql}
