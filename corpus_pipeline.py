"""A training corpus from raw documents, in five stages.

Each stage takes the documents that its predecessor kept; its result is stored as Parquet in
the shared folder and read again for the next one.  All stages but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.llm import decontaminate, languages, mixing, near_dups, sharding
from pairloom.llm.queries import MIX_SEED, SHARDS, mix_weights, source_domain, text_bytes
from pairloom.llm.tables import durable, read

#: Share of the tokens that the mixture keeps; every document is taken once at most.
KEEP_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a language: null, without a letter, or too close between two."""
    model = languages.fit(docs.where(~languages.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    judged = docs.withColumn("_judged", languages.predict(spark, model, F.col("text").cast("string")))
    return judged.where((F.col("_judged.lang_pred") != languages.UNKNOWN) & ~F.col("_judged.ambiguous")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group, the one with the smallest id; of repeated rows, one."""
    kept = near_dups.near_duplicates(docs).where("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with any word inside a benchmark window."""
    hit = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark")).where("contaminated")
    # Whether a document is hit depends on its text alone.
    keys = durable(hit.select(F.col("text_key").alias("_key")).distinct())
    return docs.join(keys, F.xxhash64("text") == F.col("_key"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that a mixture of one epoch takes."""
    total = F.expr(f"(corpus * {KEEP_PERCENT}) div 100")
    mixed = mixing.mix(docs, source_domain(F.col("source")), total, mix_weights(), epochs=1, seed=MIX_SEED)
    taken = durable(mixed.where("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    return docs.join(taken, same, "left_semi")


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every document its shard and its place in it."""
    return sharding.shard(docs, SHARDS, text_bytes(F.col("text")))


STAGES = [
    ("language", identify_language), ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_contaminated), ("mixture", mix_sources), ("shards", write_shards),
]

#: No SQL: the language model is trained, and MinHash has no counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
