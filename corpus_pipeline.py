"""A corpus pipeline of five stages: reject, deduplicate, decontaminate, mix, shard.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it back as the next stage's ``docs``. All stages but the last
return the columns of documents.

Edge cases are those of the operators: a null or empty text has no word and is rejected by the first stage; of
copies without id one stays, if none has an id; of repeated rows one stays; a stage without rows hands on none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import decontam, mixing, quality, sharding, shared, simhash

SHARDS = 24


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the ordinal classifier, learned from the labelled documents, gives the highest grade."""
    model = quality.fit(docs, quality.graded(shared.table(spark, sf_dir, "labels")))
    return quality.score(docs, model).where("keep").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one row, that with the smallest id, of each component of linked fingerprints."""
    return simhash.dedupe(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontam.clean(docs, shared.table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as their source's target asks: none, once, or up to three times."""
    return mixing.mix(docs).select(*docs.columns)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot; copies of a document share its shard and get slots of their own."""
    return sharding.shard(docs, shards=SHARDS).select(*docs.columns, "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality classifier", reject_low_quality),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("sharding", assign_shards),
]

#: The first two stages (a trained model, 64-bit fingerprints) have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared.work_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = shared.materialize(stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return docs
