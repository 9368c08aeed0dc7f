"""Enrichment by a language model behind one interface, with a deterministic stand-in.

Results of the stand-in are marked ``stub`` and never pass for a model's.
"""

from __future__ import annotations

import re
import time
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.operators.segment import sentences


class Client(Protocol):
    name: str

    def complete(self, prompt: str) -> str: ...


class Stub:
    """Answers nothing: every agent then takes its documented way without a model."""

    name = "stub"

    def complete(self, prompt: str) -> str:
        return "[]"


class ConfigError(Exception):
    """Not worth a second try."""


def call(client: Client, prompt: str, wait: float = 2.0) -> tuple[str | None, str | None]:
    """The reply or the error, after one more try."""
    for k in range(2):
        try:
            return client.complete(prompt), None
        except ConfigError as e:
            return None, str(e)
        except Exception as e:  # noqa: BLE001  whatever a client raises: the row degrades, the job goes on
            if k:
                return None, str(e)
            time.sleep(wait)
    return None, None


def call_json(client: Client, prompt: str, wait: float = 2.0) -> str | None:
    """A reply that is a JSON object or list, after one more try that asks for nothing else."""
    from provenir.functions.jsonfix import parses

    said, _ = call(client, prompt, wait)
    for k in range(2):
        if said is None:
            return None
        found = re.search(r"\{.*\}|\[.*\]", said, re.S)
        if found and parses(found[0]):
            return found[0]
        if not k:
            said, _ = call(client, f"{prompt}\n\n{said}\n\nThat could not be read as JSON. Answer once more with nothing but the JSON value.", wait)
    return None


def run_prompts(prompts: DataFrame, client: Client, in_flight: int = 3, wait: float = 2.0) -> DataFrame:
    """(id, prompt) to (id, reply, error, source), ``in_flight`` tasks at a time."""

    def run(batches):
        for b in batches:
            got = [call(client, p, wait) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r for r, _ in got], pa.string()), pa.array([e for _, e in got], pa.string()), pa.array([client.name] * len(got), pa.string())], names=["id", "reply", "error", "source"])

    return prompts.select(F.col("id").cast("string"), "prompt").repartition(in_flight).mapInArrow(run, "id string, reply string, error string, source string")


def rules_stub(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """M2's stand-in: sentences that oblige or forbid, as rules citing themselves."""
    s = sentences(docs, key, text)
    modal = F.regexp_extract(F.lower("text"), r"\b(must not|shall not|may not|must|shall|required to)\b", 1)
    return s.withColumn("modal", modal).where(F.col("modal") != "").select("document_id", "idx", "text", F.when(F.col("modal").contains("not"), "prohibition").otherwise("obligation").alias("kind"), "char_start", "char_end", F.lit("stub").alias("source"))


def keep_or_replace(rows: DataFrame, answers: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """M7: answered columns replace by key where they say something; rows are neither added nor dropped."""
    named = answers.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns]).dropDuplicates([key])
    out = rows.join(named, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.nullif(F.trim(f"_{c}"), F.lit("")), F.col(c))).drop(f"_{c}")
    return out


def route(agents: DataFrame) -> DataFrame:
    """Model of each agent: environment, then settings, then by purpose, then the default; very long inputs go to a long context."""
    tier = (
        F.when(F.col("chars") > 300_000, F.col("long_model"))
        .when(F.col("purpose") == "fast", F.coalesce("fast_model", "default_model"))
        .when(F.col("purpose") == "strong", F.coalesce("strong_model", "default_model"))
    )
    return agents.withColumn("model", F.coalesce(F.nullif("env_model", F.lit("")), F.nullif("settings_model", F.lit("")), tier, "default_model"))
