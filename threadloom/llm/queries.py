"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, langid, license_scan, mixing, quality, shared, sharding, simhash, sql, url_filter, warc


def sharding_gapless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property of operator 1, by shard: slots are 0 to one less than its rows, each once."""
    slots = sharding.op1_sharding(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("d"), F.min("slot").alias("a"), F.max("slot").alias("z"))
    return slots.select("shard", ((F.col("a") == 0) & (F.col("z") == F.col("n") - 1) & (F.col("d") == F.col("n"))).alias("gapless"))


def mixing_near_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property of operator 5, by source: the words taken are as near the target as the longest document is long."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = mixing.copies(docs).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.max("size").alias("longest"))
    return taken.select("source", (F.abs(F.col("taken") - F.col("target")) <= F.col("longest")).alias("near"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_url_filters": url_filter.op2_url_filters,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_quality": quality.op4_quality,
        "op5_mixing": mixing.op5_mixing,
        "op6_ann": ann.op6_ann,
        "op7_language_id": langid.op7_language_id,
        "op8_simhash": simhash.op8_simhash,
        "op9_warc": warc.op9_warc,
        "op10_decontamination": decontam.op10_decontamination,
        "sharding_gapless": sharding_gapless,
        "mixing_near_targets": mixing_near_targets,
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql() | {
        "sharding_gapless": "SELECT range::INTEGER AS shard, true AS gapless FROM range(24)",
        "mixing_near_targets": "SELECT DISTINCT source, true AS near FROM documents",
    }
