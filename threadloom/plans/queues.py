"""Work queues: what is due for tagging and planning, and what becomes of the answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digests import stagger
from ..operators.listing import exempt_run

HOUR, MINUTE = 3_600_000, 60_000


def suggestion_queue(sessions: DataFrame, suggestions: DataFrame, key: str, limit: int) -> DataFrame:
    """Newest sessions that aren't runs and have no suggestion for their present digest under this key."""
    made = suggestions.select("id", F.col("digest").alias("for"), F.col("key").alias("under"))
    due = sessions.where(exempt_run(F.col("tags")).isNull()).join(made, "id", "left").where(~(F.col("for").eqNullSafe(F.col("digest")) & F.col("under").eqNullSafe(F.lit(key))))
    return due.orderBy(F.desc("seq")).limit(limit).drop("for", "under")


def record_suggestions(answers: DataFrame, sessions: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(suggestions, outcomes): the last answer of each session, if it is for its present digest; unknown tags are dropped.

    ``answers`` is (id, digest, key, by, tags, at, order); outcomes count stale, refused (no such session), recorded
    and dropped tags.
    """
    current = sessions.select("id", F.col("digest").alias("now"))
    judged = answers.join(current, "id", "left").withColumn("outcome", F.when(F.col("now").isNull(), "refused").when(F.col("now") != F.col("digest"), "stale").otherwise("recorded"))
    vocabulary = known.agg(F.collect_set("tag").alias("known"))  # the tag definitions of one store: one small row
    vocabulary = vocabulary.first()["known"]
    good = judged.where(F.col("outcome") == "recorded").withColumn("kept", F.filter("tags", lambda t: t.isin(vocabulary) | F.startswith(t, F.lit("project:")) if vocabulary else F.startswith(t, F.lit("project:"))))
    fields = ("digest", "key", "by", "kept", "at")
    last = good.groupBy("id").agg(F.max_by(F.struct(*fields), "order").alias("s")).select("id", "s.digest", "s.key", "s.by", F.col("s.kept").alias("tags"), "s.at")
    counts = judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    dropped = good.agg(F.sum(F.size("tags") - F.size("kept")).alias("n")).select(F.lit("dropped").alias("outcome"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return last, counts.unionByName(dropped)


def routing_due(sessions: DataFrame, plans: DataFrame, now: int, limit: int, context: str | None = None, charter: str | None = None, unplanned: bool = False, without_parents: bool = False, interval: int = HOUR, paused: int = 30 * MINUTE, spread: int = 10 * MINUTE) -> DataFrame:
    """(id, reason, depth) of sessions due for planning: parents before their subagents, the oldest capture first.

    A session whose only reason is new entries waits for its interval, put off by a steady offset of its own, or
    until it pauses. A subagent without a plan waits for its parent's plan.
    """
    own = plans.select("id", F.lit(True).alias("planned"), "due", F.col("at").alias("plannedAt"), F.col("contextKey").alias("ctx"), F.col("key").alias("chr"))
    whole = sessions.where(F.col("partOf").isNull() & F.col("supersededBy").isNull() & exempt_run(F.col("tags")).isNull() & ~F.coalesce(F.col("lineageKind") == "part", F.lit(False)))
    rows = whole.join(own, "id", "left")
    has = F.coalesce("planned", F.lit(False))
    differs = lambda column, value: F.lit(value is not None and not unplanned) & ~F.col(column).eqNullSafe(F.lit(value))
    due = F.col("due") == "partial" if unplanned else F.col("due").isNotNull()
    reason = F.when(~has, "unplanned").when(F.col("due").isNotNull(), F.col("due")).when(differs("ctx", context), "context").when(differs("chr", charter), "charter")
    wanted = rows.where(~has | F.coalesce(due, F.lit(False)) | (has & (differs("ctx", context) | differs("chr", charter)))).withColumn("reason", reason)
    if not without_parents:
        ready = plans.where("plan is not null").select(F.col("id").alias("parentId"), F.lit(True).alias("ready"))
        wanted = wanted.join(ready, "parentId", "left").where(F.col("planned") | F.col("lineageKind").isNull() | F.col("ready"))
    is_paused = F.lit(now) - F.col("capturedAt") >= paused
    fresh = F.col("reason") == "new entries"
    waits = fresh & ~is_paused & (F.lit(now) < F.col("plannedAt") + interval + stagger(F.col("id"), spread))
    shown = F.when(fresh & is_paused, F.lit("new entries, paused")).otherwise(F.col("reason"))
    depth = F.coalesce("lineageDepth", F.when(F.col("lineageKind").isNotNull(), 1).otherwise(0))
    return wanted.where(~waits).select("id", shown.alias("reason"), depth.alias("depth"), "capturedAt").orderBy("depth", "capturedAt", "id").limit(limit).select("id", "reason", "depth")


def mark_related(plans: DataFrame, sessions: DataFrame, changed: DataFrame) -> DataFrame:
    """Plans with ``due`` set to related for parents and children of changed sessions, where nothing is due yet."""
    children = sessions.where("partOf is null").join(changed.select(F.col("id").alias("parentId")), "parentId", "left_semi").select("id")
    parents = sessions.join(changed.select("id"), "id", "left_semi").where(F.col("parentId").isNotNull() & ~F.coalesce(F.col("lineageKind") == "part", F.lit(False))).select(F.col("parentId").alias("id"))
    related = children.unionByName(parents).distinct().withColumn("related", F.lit(True))
    return plans.join(related, "id", "left").withColumn("due", F.coalesce("due", F.when(F.col("related"), F.lit("related")))).drop("related")


def review_queue(plans: DataFrame, limit: int, sure: float = 0.6) -> DataFrame:
    """Plans for a person to read: held ones first, then the least sure, then the latest."""
    confidence = F.coalesce(F.array_min(F.transform("parts", lambda p: p["confidence"])), F.lit(1.0))
    held = F.col("status") == "held"
    unread = F.col("reviewedAt").isNull()
    asks = unread & ((F.size("redactions") > 0) | (confidence < sure) | (F.size("heldForReview") > 0))
    ranked = plans.where(held | asks).select("id", held.alias("held"), confidence.alias("confidence"), F.size("redactions").alias("redactions"), "at")
    return ranked.orderBy(F.desc("held"), "confidence", F.desc("at"), "id").limit(limit)


def reviewed(plans: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Plans that a person has read leave the queue: what was held for review is free again."""
    read = ids.select("id", F.lit(now).cast("long").alias("__read"))
    out = plans.join(read, "id", "left")
    cleared = F.when(F.col("__read").isNotNull(), F.array().cast("array<string>")).otherwise(F.col("heldForReview"))
    return out.withColumn("heldForReview", cleared).withColumn("reviewedAt", F.coalesce("__read", "reviewedAt")).drop("__read")


def tag_in_batches(sessions: list[dict], decide: Callable[[list[dict]], dict[str, dict] | None], batch: int = 8, stop_after: int = 6) -> dict[str, dict]:
    """Answers of a tagger, asked in batches: a batch that fails is halved, missing answers are asked once more.

    After so many failures in a row nothing more is asked. ``decide`` is the model: it gets sessions and returns
    answers by id, or None (or raises) when it fails.
    """
    waiting = [(sessions[k : k + batch], True) for k in range(0, len(sessions), batch)]
    answers: dict[str, dict] = {}
    failures = 0
    while waiting and failures < stop_after:
        group, again = waiting.pop(0)
        try:
            found = decide(group)
        except Exception:  # noqa: BLE001  the model's failures are counted, whatever they are
            found = None
        if found is None:
            failures += 1
            if len(group) > 1:
                half = len(group) // 2
                waiting[:0] = [(group[:half], again), (group[half:], again)]
            continue
        failures = 0
        answers |= {s["id"]: found[s["id"]] for s in group if s["id"] in found}
        missing = [s for s in group if s["id"] not in found]
        if missing and again:
            waiting.insert(0, (missing, False))
    return answers


def sensitivity_checked(sessions: DataFrame, plans: DataFrame) -> DataFrame:
    """(id, checked) of every part: whether its source's plan was checked for sensitivity by the model that made it.

    ``plans`` has id, checked and checkKey (the key that a check by that model leaves); a part without a plan isn't.
    """
    parts = sessions.where("partOf is not null").select("id", "partOf")
    made = plans.select(F.col("id").alias("partOf"), F.coalesce(F.col("checked") == F.col("checkKey"), F.lit(False)).alias("ok"))
    return parts.join(made, "partOf", "left").select("id", F.coalesce("ok", F.lit(False)).alias("checked"))
