"""Leases on sessions that a writer records itself: holding, fulfilling, and what a collector should do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRACE = 1000  # milliseconds between a transcript's last change and the fulfilment that covers it


def hold(claims: DataFrame, wanted: DataFrame, now: int, ttl: int) -> tuple[DataFrame, DataFrame]:
    """(claims, refused) after ``wanted`` (source, sessionId, claimant): another's live, unfulfilled lease isn't taken over."""
    keys = ["source", "sessionId"]
    held = claims.select(*keys, F.col("claimant").alias("other"), F.col("expiresAt").alias("until"), "fulfilledBy")
    judged = wanted.join(held, keys, "left").withColumn("refused", F.coalesce((F.col("other") != F.col("claimant")) & (F.col("until") > now) & F.col("fulfilledBy").isNull(), F.lit(False)))
    taken = judged.where(~F.col("refused")).select(*keys, "claimant", F.lit(now + ttl).cast("long").alias("expiresAt"), F.lit(None).cast("string").alias("fulfilledBy"), F.lit(None).cast("long").alias("fulfilledAt"))
    return claims.join(taken.select(*keys), keys, "left_anti").unionByName(taken.select(*claims.columns)), judged.where("refused").select(*keys, "claimant")


def fulfil(claims: DataFrame, done: DataFrame, now: int) -> DataFrame:
    """Claims with those that their claimant fulfilled (source, sessionId, claimant, fulfilledBy) marked so."""
    keys = ["source", "sessionId", "claimant"]
    by = claims.drop("fulfilledBy", "fulfilledAt").join(done.select(*keys), keys, "left_semi").join(done, keys)
    marked = by.withColumn("fulfilledAt", F.lit(now).cast("long"))
    return claims.join(done.select(*keys), keys, "left_anti").unionByName(marked.select(*claims.columns))


def superseded_by(sessions: DataFrame, done: DataFrame) -> DataFrame:
    """(id, supersededBy): raw captures of a fulfilled session, or of its subagents (``<session>/…``), and their parts.

    Both sides of the alternative are equalities (the session id, or what stands before its first slash), so they
    are two hash joins and no nested loop.
    """
    roots = done.select("source", F.col("sessionId").alias("root"), F.col("fulfilledBy").alias("supersededBy"))
    own = sessions.withColumn("root", F.explode(F.array_distinct(F.array("sessionId", F.substring_index("sessionId", "/", 1)))))
    raw = own.join(roots, ["source", "root"]).where(F.col("id") != F.col("supersededBy")).select("id", "supersededBy").distinct()
    parts = sessions.where("partOf is not null").select("id", F.col("partOf").alias("whole")).join(raw.withColumnRenamed("id", "whole"), "whole").select("id", "supersededBy")
    return raw.unionByName(parts).groupBy("id").agg(F.max("supersededBy").alias("supersededBy"))


def state(expires: Column, fulfilled_by: Column, fulfilled_at: Column, modified: Column, now: Column | int) -> Column:
    """none, live, fulfilled or lapsed, of a claim's columns (null if there is none)."""
    now = now if isinstance(now, Column) else F.lit(now)
    covered = fulfilled_by.isNotNull() & fulfilled_at.isNotNull() & (modified.isNull() | (modified <= fulfilled_at + GRACE))
    return F.when(expires.isNull(), "none").when(expires > now, "live").when(covered, "fulfilled").otherwise("lapsed")


def states(sessions: DataFrame, claims: DataFrame, now: int) -> DataFrame:
    """(source, sessionId, state, until) of sessions (source, sessionId, modifiedAt); a subagent follows its root's claim unless it has its own."""
    keys = F.array_distinct(F.array("sessionId", F.substring_index("sessionId", "/", 1)))
    found = sessions.withColumn("claimed", F.explode(keys)).join(claims.select("source", F.col("sessionId").alias("claimed"), "expiresAt", "fulfilledBy", "fulfilledAt"), ["source", "claimed"], "left")
    own = found.groupBy("source", "sessionId", "modifiedAt").agg(F.max_by(F.struct("expiresAt", "fulfilledBy", "fulfilledAt"), F.when(F.col("expiresAt").isNotNull(), F.col("claimed"))).alias("c"))
    judged = state(F.col("c.expiresAt"), F.col("c.fulfilledBy"), F.col("c.fulfilledAt"), F.col("modifiedAt"), now)
    return own.select("source", "sessionId", judged.alias("state"), F.when(judged == "live", F.col("c.expiresAt")).alias("until"))
