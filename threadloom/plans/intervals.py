"""Ranges of ordered entries: positions, coverage, overlap, merging, windows by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters of entries that a planner reads at once.
WINDOW = 300_000


def positions(parts: DataFrame, entries: DataFrame, *keys: str) -> DataFrame:
    """Parts with the positions ``low`` and ``high`` of their first and last entries; parts of unknown entries go."""
    where = entries.select(*keys, "id", "position")
    low = where.select(*keys, F.col("id").alias("firstEntryId"), F.col("position").alias("low"))
    high = where.select(*keys, F.col("id").alias("lastEntryId"), F.col("position").alias("high"))
    return parts.join(low, [*keys, "firstEntryId"]).join(high, [*keys, "lastEntryId"])


def covered(entries: DataFrame, parts: DataFrame, *keys: str) -> DataFrame:
    """Entries with each part (low, high) that holds them: an equi-join on the session with the range as its residual."""
    e, p = entries.alias("e"), parts.alias("p")
    on = [F.col(f"e.{k}") == F.col(f"p.{k}") for k in keys] + [F.col("e.position").between(F.col("p.low"), F.col("p.high"))]
    rest = [F.col(f"p.{c}") for c in parts.columns if c not in keys]
    return e.join(p, on).select("e.*", *rest)


def overlapping(parts: DataFrame, *keys: str, start: int = -1) -> DataFrame:
    """Adds ``overlaps``: whether a part begins no later than any part before it ends."""
    before = F.max("high").over(Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("overlaps", F.col("low") <= F.coalesce(before, F.lit(start)))


def merged(spans: DataFrame, *keys: str) -> DataFrame:
    """Spans (low, high) of each key put together where they overlap or touch."""
    order = Window.partitionBy(*keys).orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("low") <= reach, 0).otherwise(1)).over(order)
    return spans.withColumn("island", island).groupBy(*keys, "island").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("spans")).drop("island")


def window(entries: DataFrame, size: Column, *keys: str, limit: int = WINDOW) -> DataFrame:
    """The entries from the start of each key whose sizes add up to the limit at most; the first one always."""
    order = Window.partitionBy(*keys).orderBy("position")
    return entries.withColumn("so_far", F.sum(size).over(order)).withColumn("nth", F.row_number().over(order)).where((F.col("so_far") <= limit) | (F.col("nth") == 1)).drop("nth")


def reach(parts: DataFrame, *keys: str, at: DataFrame | None = None, personal: str = "personal") -> DataFrame:
    """(keys, organizations) that plans reach: of all parts, or (with ``at``: keys, position) of those that hold an entry."""
    held = parts if at is None else covered(at.select(*keys, "position"), parts, *keys)
    return held.select(*keys, F.explode("organizations").alias("o")).where(F.col("o") != personal).groupBy(*keys).agg(F.array_sort(F.collect_set("o")).alias("organizations"))


def common(origins: DataFrame, reaches: DataFrame, *keys: str) -> DataFrame:
    """(keys, allowed): organizations that every quoted origin reaches; null if one is unknown.

    ``origins`` has (keys, origin), ``reaches`` (origin, organizations). An organization is common if as many
    origins reach it as there are: a count, so that no arrays are intersected in one place.
    """
    joined = origins.select(*keys, "origin").distinct().join(reaches.select("origin", "organizations"), "origin", "left")
    totals = joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("organizations").isNull()).alias("unknown"))
    counted = joined.select(*keys, F.explode("organizations").alias("o")).groupBy(*keys, "o").agg(F.count(F.lit(1)).alias("m"))
    shared = totals.join(counted, [*keys], "left").groupBy(*keys, "unknown").agg(F.array_sort(F.collect_list(F.when(F.col("m") == F.col("n"), F.col("o")))).alias("allowed"))
    return shared.select(*keys, F.when(~F.col("unknown"), F.col("allowed")).alias("allowed"))
