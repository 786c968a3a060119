"""Delivery to destinations: what to publish, what to take back, and when to try again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.digests import quoted

#: Milliseconds: first wait after a failure, and the longest.
FIRST_WAIT, LONGEST_WAIT = 30_000, 1_800_000
DELETES = 100


def always_personal(source: Column, provider: Column) -> Column:
    return (source == "muse") | F.coalesce(provider == "meta", F.lit(False))


def wait(failures: Column) -> Column:
    """Milliseconds to wait after so many failures: doubling, up to half an hour."""
    return F.least(F.lit(FIRST_WAIT) * F.pow(F.lit(2.0), F.least(failures, F.lit(20)) - 1), F.lit(LONGEST_WAIT)).cast("long")


def outage(status: Column) -> Column:
    """Whether a failure means that a destination is down rather than that it refuses."""
    return status.isNull() | (status >= 500)


def destination_identity(url: Column, kind: Column, integration: Column, resource: Column, standalone: str = "standalone") -> Column:
    """What tells destinations apart, as JSON: origin (host in lower case, no default port), path, and what is there."""
    part = lambda what: F.try_parse_url(url, F.lit(what))
    scheme, port = F.lower(part("PROTOCOL")), F.regexp_extract(part("AUTHORITY"), r":(\d+)$", 1)
    usual = (port == "") | ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    origin = F.concat(scheme, F.lit("://"), F.lower(part("HOST")), F.when(usual, F.lit("")).otherwise(F.concat(F.lit(":"), port)))
    path = F.when(F.coalesce(part("PATH"), F.lit("")) == "", F.lit("/")).otherwise(part("PATH"))
    place = F.when(kind == standalone, quoted(kind)).otherwise(F.concat(F.lit("["), F.concat_ws(",", quoted(kind), quoted(integration), quoted(resource)), F.lit("]")))
    return F.concat(F.lit("["), quoted(origin), F.lit(","), quoted(path), F.lit(","), place, F.lit("]"))


def after_attempts(backoff: DataFrame, attempts: DataFrame, now: int) -> DataFrame:
    """The back-off table (key, failures, until) after attempts (key, ok): successes leave it, failures wait longer."""
    tried = backoff.join(attempts, "key", "full")
    failed = F.coalesce("failures", F.lit(0)) + 1
    rows = tried.where(F.col("ok").isNull() | ~F.col("ok"))
    count = F.when(F.col("ok").isNull(), F.col("failures")).otherwise(failed)
    return rows.select("key", count.cast("int").alias("failures"), F.when(F.col("ok").isNull(), F.col("until")).otherwise(F.lit(now) + wait(failed)).cast("long").alias("until"))


def routes(sessions: DataFrame, destinations: DataFrame) -> DataFrame:
    """(id, destination, storedDigest, revision): parts and the destinations of their organizations; superseded and personal ones go nowhere."""
    free = sessions.where(F.col("partOf").isNotNull() & F.col("supersededBy").isNull() & ~always_personal(F.col("source"), F.col("provider")))
    return free.select("id", "storedDigest", "revision", F.explode("routedTo").alias("organization")).join(destinations, "organization").select("id", "destination", "storedDigest", "revision").distinct()


def to_publish(routed: DataFrame, receipts: DataFrame, now: int | None = None, backoff: DataFrame | None = None) -> DataFrame:
    """Routes whose destination hasn't acknowledged the stored digest, and that don't wait."""
    acknowledged = receipts.select("id", "destination", F.col("digest").alias("acked"))
    due = routed.join(acknowledged, ["id", "destination"], "left").where(~F.col("acked").eqNullSafe(F.col("storedDigest"))).drop("acked")
    if backoff is None:
        return due
    key = F.concat_ws("|", "id", "destination")
    waiting = backoff.where(F.col("until") > now).select("key")
    return due.withColumn("key", key).join(waiting, "key", "left_anti").join(waiting.withColumnRenamed("key", "destination"), "destination", "left_anti").drop("key")


def delivery_counts(sessions: DataFrame, routed: DataFrame, receipts: DataFrame) -> DataFrame:
    """(destination, delivered, pending) of what is routed there."""
    acknowledged = receipts.select("id", "destination", F.col("digest").alias("acked"))
    known = routed.join(sessions.select("id", "supersededBy"), "id").where("supersededBy is null").join(acknowledged, ["id", "destination"], "left")
    done = F.coalesce(F.col("acked") == F.col("storedDigest"), F.lit(False))
    return known.groupBy("destination").agg(F.count_if(done).alias("delivered"), F.count_if(~done).alias("pending"))


def acknowledge(outbox: DataFrame, receipts: DataFrame, acks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outbox, receipts) after acknowledgements (id, destination, revision, digest, expected): one of another digest doesn't count."""
    good = acks.where(F.col("digest") == F.col("expected"))
    rows = good.groupBy("id", "destination").agg(F.max_by("digest", "revision").alias("digest"), F.max("revision").alias("upto"))
    left = outbox.join(rows.select("id", "destination", "upto"), ["id", "destination"], "left").where(F.col("upto").isNull() | (F.col("revision") > F.col("upto"))).select(*outbox.columns)
    kept = receipts.join(rows.select("id", "destination"), ["id", "destination"], "left_anti")
    return left, kept.unionByName(rows.select("id", "destination", "digest"))


def release(outbox: DataFrame, destinations: DataFrame) -> DataFrame:
    """The outbox without destinations that aren't configured; without any configured it stays as it is."""
    return outbox if destinations.isEmpty() else outbox.join(destinations.select("destination").distinct(), "destination", "left_semi")


def keep(candidates: DataFrame, sessions: DataFrame, plans: DataFrame, destinations: DataFrame, publish: bool) -> DataFrame:
    """Candidates (id, destination, heldDigest) that may stay at a destination (destination, organization, cleanup).

    A part stays while it is routed there and not superseded. A whole session stays only with publishing off and
    cleanup of leaked copies only, if a plan sends just this digest there whole.
    """
    rows = candidates.join(destinations, "destination").join(sessions.select("id", "partOf", "routedTo", "supersededBy", "source", "provider"), "id")
    rows = rows.join(plans.select("id", "wholeTo", "wholeDigests"), "id", "left")
    current, personal = F.col("supersededBy").isNull(), always_personal(F.col("source"), F.col("provider"))
    routed = F.array_contains("routedTo", F.col("organization")) & ~personal
    whole = F.lit(not publish) & (F.col("cleanup") == "leaked") & ~personal & F.array_contains("wholeTo", F.col("organization")) & F.array_contains("wholeDigests", F.col("heldDigest"))
    stays = current & F.when(F.col("partOf").isNotNull(), routed).otherwise(whole)
    return rows.where(F.coalesce(stays, F.lit(False))).select("id", "destination").distinct()


def reconcile(sessions: DataFrame, plans: DataFrame, receipts: DataFrame, pending: DataFrame, listed: DataFrame, destinations: DataFrame, publish: bool = True, limit: int = DELETES) -> DataFrame:
    """(id, destination) of copies to delete at destinations in this pass: candidates that may not stay, so many a destination.

    Candidates are receipts, pending deletes and what destinations list (id, destination, digest); destinations
    with cleanup off are left alone.
    """
    there = listed.select("id", "destination", F.col("digest").alias("listedDigest"))
    sent = receipts.select("id", "destination", F.col("digest").alias("sentDigest"))
    every = sent.join(there, ["id", "destination"], "full").join(pending.select("id", "destination").distinct().withColumn("owed", F.lit(True)), ["id", "destination"], "full")
    known = every.groupBy("id", "destination").agg(F.max(F.coalesce("listedDigest", "sentDigest")).alias("heldDigest"))
    candidates = known.join(destinations.where("cleanup <> 'off'").select("destination"), "destination", "left_semi")
    gone = candidates.join(keep(candidates, sessions, plans, destinations, publish), ["id", "destination"], "left_anti")
    place = F.row_number().over(Window.partitionBy("destination").orderBy("id"))
    return gone.withColumn("place", place).where(F.col("place") <= limit).select("id", "destination")


def dry_run(deletes: DataFrame) -> DataFrame:
    """(destination, count, ids): what a pass would delete; at most ``DELETES`` ids a destination."""
    return deletes.groupBy("destination").agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list("id")).alias("ids"))


def moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, adds, deletes, move): how the organizations that sessions go to change."""
    both = before.select("id", F.col("organizations").alias("was")).join(after.select("id", F.col("organizations").alias("will")), "id", "full")
    none = F.array().cast("array<string>")
    was, will = F.array_sort(F.coalesce("was", none)), F.array_sort(F.coalesce("will", none))
    name = lambda a: F.when(F.size(a) > 0, F.array_join(a, "+")).otherwise(F.lit("nowhere"))
    return both.select("id", F.array_except(will, was).alias("adds"), F.array_except(was, will).alias("deletes"), F.concat(name(was), F.lit(" → "), name(will)).alias("move"))


def held_by(sessions: DataFrame, receipts: DataFrame, destinations: DataFrame) -> DataFrame:
    """(id, organizations) whose destinations hold a session or any of its parts."""
    family = sessions.select("id", F.col("id").alias("copy")).unionByName(sessions.where("partOf is not null").select(F.col("partOf").alias("id"), F.col("id").alias("copy")))
    held = family.join(receipts.select(F.col("id").alias("copy"), "destination"), "copy").join(destinations.select("destination", "organization"), "destination")
    return held.groupBy("id").agg(F.array_sort(F.collect_set("organization")).alias("organizations"))
