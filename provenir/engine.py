"""One object with the engine's verbs; each returns DataFrames or plain values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.functions.text import normalize_search
from provenir.operators import graph, grounding, integrity, matching, project, schema_seed, segment, stages
from provenir.sources import ddl, documents, store, tables


class Engine:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.store = store.Store(spark, folder or f"{tables.scratch(spark)}/models")

    # Ingest
    def parse(self, raw: DataFrame) -> DataFrame:
        return documents.parse(raw)

    def upload(self, folder: str) -> DataFrame:
        return documents.read_folder(self.spark, folder)

    def upload_schema(self, dumps: DataFrame) -> DataFrame:
        return ddl.parse_ddl(dumps)

    def introspect(self, database: str | None = None) -> DataFrame:
        return ddl.from_session(self.spark, database)

    def preview(self, facts: DataFrame) -> DataFrame:
        """Counts of a schema's parts."""
        return facts.groupBy("file").pivot("kind", ["table", "view", "column", "primary_key", "foreign_key", "unique", "check", "error"]).count().na.fill(0)

    # Run
    def seed(self, facts: DataFrame) -> dict[str, DataFrame]:
        """The model of a schema, without a language model."""
        return {"objects": schema_seed.objects(facts), "properties": schema_seed.properties(facts), "relationships": schema_seed.relationships(facts), "rules": schema_seed.rules(facts), "evidence": schema_seed.textualize(facts)}

    def staged(self, run_id: str, steps: dict) -> stages.Run:
        """A run of named stages that goes on where it stopped."""
        return stages.Run(self.spark, self.store.folder, run_id, steps)

    def sentences(self, docs: DataFrame) -> DataFrame:
        return segment.sentences(docs)

    def ground(self, quotes: DataFrame, docs: DataFrame) -> DataFrame:
        """Each pair by the first tier that finds it; fuzzy ones are not verified."""
        ends = ["doc_id", "item_id", "char_start", "char_end"]
        # Both sure tiers look through the same candidates: texts are cut into words once for them.
        pairs = grounding.candidates(quotes, docs, "item_id", "doc_id", "text", "text", normalize_search, F.col)
        exact = grounding.ground_exact(quotes, docs, pairs=pairs).select(*ends).withColumn("tier", F.lit("exact"))
        normal = grounding.ground_normalized(quotes, docs, pairs=pairs).select(*ends).join(exact.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti").withColumn("tier", F.lit("normalized"))
        sure = exact.unionByName(normal)
        fuzzy = grounding.ground_fuzzy(quotes, docs).select(*ends).join(sure.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti").withColumn("tier", F.lit("fuzzy"))
        return sure.unionByName(fuzzy).withColumn("verified", F.col("tier") != "fuzzy")

    def coverage(self, docs: DataFrame, intervals: DataFrame, target: float = 1.0) -> DataFrame:
        return grounding.coverage_ratio(grounding.coverage_status(grounding.cover(segment.sentences(docs), intervals)), "document_id", target=target)

    def validate(self, model: dict[str, DataFrame]) -> DataFrame:
        return integrity.dangling(model, integrity.MODEL_PATHS)

    # Query
    def infer(self, triples: DataFrame, questions: DataFrame, nodes: DataFrame, hops: int = 6) -> DataFrame:
        """Nodes within ``hops`` of the seeds of the questions' words."""
        seeds = matching.lexical_seeds(questions, nodes).select(F.col("node_id").cast("string").alias("node"))
        return graph.hops(triples, seeds, hops, tables.keep)

    # Store
    def list(self, domain: str | None = None) -> DataFrame:
        return self.store.list(domain)

    def get(self, model_id: str, version: int | None = None):
        return self.store.get(model_id, version)

    def save(self, model_id: str, name: str, domain: str, nodes: DataFrame) -> int:
        return self.store.save(model_id, name, domain, nodes)

    def publish(self, model_id: str, exclude_rejected: bool = False) -> int:
        return self.store.publish(model_id, exclude_rejected)

    def delete(self, model_id: str) -> None:
        self.store.delete(model_id)

    def generate(self, layer: DataFrame, name: str, project_name: str, version: int) -> DataFrame:
        return project.layer_file(layer, name, project_name, version)

    def import_graph(self, nodes: DataFrame, edges: DataFrame, folder: str) -> None:
        store.export_graph(nodes, edges, folder)
