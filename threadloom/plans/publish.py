"""What a plan publishes, and parts as snapshots of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digests import part_session_id
from ..functions.redaction import redacted
from ..functions.text import typed_prompt_udf
from ..schema import TOOL_KINDS
from . import intervals

PERSONAL = "personal"


def published(parts: DataFrame, entries: DataFrame, prune: DataFrame, foreign: DataFrame, sticky: DataFrame, *keys: str) -> DataFrame:
    """(keys, firstEntryId, lastEntryId, organizations, entryIds) of each part that publishes something.

    An entry is left out if it is pruned or sticky (keys, id), or quotes a session (keys, id, allowed) that isn't
    allowed everywhere the part goes. Personal organizations never publish.
    """
    work = parts.withColumn("organizations", F.array_remove("organizations", PERSONAL)).where(F.size("organizations") > 0)
    held = intervals.covered(entries.select(*keys, "id", "position"), intervals.positions(work, entries, *keys), *keys)
    out = prune.select(*keys, "id").unionByName(sticky.select(*keys, "id")).distinct()
    quoted = foreign.select(*keys, "id", F.lit(True).alias("quotes"), "allowed")
    kept = held.join(out, [*keys, "id"], "left_anti").join(quoted, [*keys, "id"], "left")
    free = F.col("quotes").isNull() | F.coalesce(F.size(F.array_except("organizations", "allowed")) == 0, F.lit(False))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda e: e["id"])
    return kept.where(free).groupBy(*keys, "firstEntryId", "lastEntryId", "organizations").agg(ids.alias("entryIds"))


def sensitive(parts: DataFrame, entries: DataFrame, noted: DataFrame, *keys: str) -> DataFrame:
    """(keys, id) of entries that stay: those noted before, and those of sensitive parts."""
    held = intervals.covered(entries.select(*keys, "id", "position"), intervals.positions(parts.where("sensitive"), entries, *keys), *keys)
    return held.select(*keys, "id").unionByName(noted.select(*keys, "id")).distinct()


def snapshots(sessions: DataFrame, parts: DataFrame, entries: DataFrame, redactions: DataFrame, projects: DataFrame, rosters: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(part sessions, part entries): kept entries without tool activity, redacted, titled from their own first prompt.

    ``projects`` is (organization, projectId), ``rosters`` (organization, name). A part carries the project and
    project tags of its organizations, run tags, and no references, goals or runs.
    """
    part = [*keys, "firstEntryId"]
    chosen = parts.select(*part, F.explode("entryIds").alias("id"), "organizations").join(entries.where(~F.col("kind").isin(*TOOL_KINDS)), [*keys, "id"])
    spoken = redactions.groupBy(*keys).agg(F.collect_list(F.struct("text", "reason", "echoOnly")).alias("spans"))
    names = parts.select(*part, F.explode("organizations").alias("organization")).join(rosters, "organization").groupBy(*part).agg(F.collect_set("name").alias("roster"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    dressed = chosen.join(spoken, [*keys], "left").join(names, part, "left")
    clean = dressed.withColumn("original", F.col("text")).withColumn("text", redacted(F.col("text"), none(F.col("spans"), "array<struct<text:string,reason:string,echoOnly:boolean>>"), none(F.col("roster"), "array<string>")))
    ids = part_session_id(F.col("sessionId"), F.col("firstEntryId"))
    lines = clean.join(sessions.select(*keys, "sessionId"), [*keys]) if "sessionId" not in keys else clean
    lines = lines.withColumn("part", ids)
    prompt = F.coalesce(typed_prompt_udf(F.when(F.col("kind").isin("user", "event"), F.col("text"))), F.col("text"))
    titled = lines.withColumn("title", F.when(F.col("kind").isin("user", "event"), F.left(F.trim(F.regexp_replace(prompt, r"(?U)\s+", " ")), F.lit(200))))
    facts = titled.groupBy(*part, "part").agg(F.min_by("title", F.when(F.col("title").isNotNull(), F.col("position"))).alias("title"), F.count(F.lit(1)).alias("kept"), F.count_if(F.col("text") != F.col("original")).alias("redacted"))
    own = parts.select(*part, F.explode("organizations").alias("organization")).join(projects, "organization").groupBy(*part).agg(F.collect_set("projectId").alias("projects"))
    placed = intervals.positions(parts, entries, *keys).select(*part, "lastEntryId", (F.col("high") - F.col("low") + 1).alias("span"))
    made = facts.join(placed, part).join(own, part, "left").join(sessions, [*keys])
    mine = none(F.col("projects"), "array<string>")
    carried = F.filter("tags", lambda t: F.startswith(t, F.lit("run:")) | (F.startswith(t, F.lit("project:")) & F.array_contains(mine, F.substr(t, F.lit(9)))))
    note = F.concat(F.lit("A part of its session: "), "kept", F.lit(" of "), "span", F.lit(" entries in its range; "), F.col("span") - F.col("kept"), F.lit(" pruned; "), "redacted", F.lit(" redacted; tool activity is never kept"))
    rows = made.select(
        F.col("part").alias("sessionId"), F.col("sessionId").alias("parentSessionId") if "sessionId" not in keys else F.col("sessionId").alias("parentSessionId"),
        "firstEntryId", "lastEntryId", F.coalesce(F.nullif("title", F.lit("")), F.lit("Session part")).alias("title"),
        F.when(F.array_contains(mine, F.col("projectId")), F.col("projectId")).alias("projectId"), carried.alias("tags"), note.alias("omission"),
    )
    return rows, titled.select(F.col("part").alias("sessionId"), "position", "id", "kind", "text")
