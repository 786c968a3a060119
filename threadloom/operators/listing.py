"""Listings of sessions: tags with edits over them, filters, search, keyset pages, summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as words
from ..functions.references import INTEGRATIONS, Integration, references

#: Tags of runs, in the order in which they exempt a session. ``host`` stands for a host's own subagents.
RUN_TAGS = {"oracle": "run:oracle", "host": "run:host", "test": "run:test"}
RUN_INFERRED = "run:inferred"


@dataclass(frozen=True)
class Filter:
    """What a listing asks for; None asks for nothing. Tri-states are exclude, include or only."""

    project: str | None = None
    source: str | None = None
    actor: str | None = None
    provider: str | None = None
    access: str | None = None
    parts: str = "exclude"
    exempt: str = "exclude"
    tag: str | None = None
    suggested: str | None = None
    model: str | None = None
    effort: str | None = None
    reference: tuple[str, str] | None = None


def distinct_minus(base: Column, added: Column, removed: Column) -> Column:
    """(base ∪ added) ∖ removed, in order of first appearance."""
    return F.array_except(F.array_distinct(F.concat(base, added)), removed)


def latest_edits(edits: DataFrame, key: str = "id") -> DataFrame:
    """(key, added, removed): per session the tags whose last edit adds or removes them. ``edits`` is a log (key, tag, added, seq)."""
    last = edits.groupBy(key, "tag").agg(F.max_by("added", "seq").alias("added"), F.min("seq").alias("first"))
    tags = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(F.col("added") == flag, F.struct("first", "tag")))), lambda x: x["tag"])
    return last.groupBy(key).agg(tags(F.lit(True)).alias("added"), tags(F.lit(False)).alias("removed"))


def exempt_run(tags: Column) -> Column:
    """The kind of run that exempts a session, if any."""
    return F.coalesce(*[F.when(F.array_contains(tags, t), F.lit(k)) for k, t in RUN_TAGS.items()], F.lit(None).cast("string"))


def droppable_run(tags: Column, host_agent: Column) -> Column:
    """The kind of run that lets a session be dropped: a host's own subagent, or a tag that wasn't inferred."""
    return F.when(F.coalesce(host_agent, F.lit(False)), F.lit("host")).when(~F.array_contains(tags, RUN_INFERRED), exempt_run(tags))


#: Folders that hold scratch files of the system.
TEMPORARY = ("/tmp", "/private/tmp", "/var/folders", "/private/var/folders")
#: Of a path's segments, which tell a run and of what kind, in order; ``{}`` is where a segment may go on.
RUN_SEGMENTS = (("oracle", (".oracle",)), ("oracle", ("bench", ".runs")), ("oracle", ("bench", ".runs-{}")), ("host", ("decision-receipts", "primed-{}")), ("test", ("decision-receipts",)), ("test", ("scratchpad",)))


def inferred_run(cwd: Column, temporary: tuple[str, ...] = TEMPORARY) -> Column:
    """The kind of run that a working directory tells: evaluation workspaces, primed fixtures, scratch folders."""
    closed = F.concat(cwd, F.lit("/"))
    under = F.lit(False)
    for folder in temporary:
        under = under | F.startswith(closed, F.lit(folder + "/"))
    holds = lambda parts: F.contains(closed, F.lit("/" + "/".join(parts).removesuffix("{}") + ("" if parts[-1].endswith("{}") else "/")))
    kinds = [F.when(holds(parts), F.lit(kind)) for kind, parts in RUN_SEGMENTS]
    scratch = F.when(under, F.when(F.contains(closed, F.lit("/oracle-")), F.lit("oracle")).otherwise(F.lit("test")))
    evaluation = F.when(scratch == "oracle", scratch)
    return F.coalesce(*kinds[:3], evaluation, kinds[3], scratch, *kinds[4:])


def identity_tags(source: Column, session: Column, project: Column, agent_type: Column, host_agents: tuple[str, ...] = (), personal: str = "P", watched: tuple[str, str] = ("", "")) -> Column:
    """Run tags that a session's identity tells: a host's own subagent, the project kept for tests, or a host's watched
    session (``watched``: the host's source and a pattern of its session ids)."""
    host = agent_type.isin(*host_agents) if host_agents else F.lit(False)
    test = (project == personal) | ((source == watched[0]) & session.rlike(watched[1]))
    tag = F.when(F.coalesce(host, F.lit(False)), F.lit(RUN_TAGS["host"])).when(F.coalesce(test, F.lit(False)), F.lit(RUN_TAGS["test"]))
    return F.array_compact(F.array(tag))


def projects(sessions: DataFrame, unrouted: str = "unrouted", personal: str = "P") -> DataFrame:
    """Distinct projects that sessions are routed to, in order."""
    return sessions.where(F.col("projectId").isNotNull() & ~F.col("projectId").isin(unrouted, personal)).select("projectId").distinct().orderBy("projectId")


def define_tag(definitions: DataFrame, new: DataFrame) -> DataFrame:
    """Definitions (actorId, tag, description) with new ones in place of those of the same actor and tag; no actor is everyone's."""
    named = new.select(F.coalesce("actorId", F.lit("")).alias("actorId"), "tag", "description").dropDuplicates(["actorId", "tag"])
    return definitions.join(named, ["actorId", "tag"], "left_anti").unionByName(named)


def undefine_tag(definitions: DataFrame, gone: DataFrame) -> DataFrame:
    """Definitions without those of (actorId, tag)."""
    return definitions.join(gone.select(F.coalesce("actorId", F.lit("")).alias("actorId"), "tag"), ["actorId", "tag"], "left_anti")


def overlay(sessions: DataFrame, edits: DataFrame, suggestions: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Sessions with ``tags`` and ``suggestedTags`` as they are after edits. Base tags are capturedTags and identityTags.

    A suggestion counts for the digest that it was made for, and a person's edits always win.
    """
    none = F.array().cast("array<string>")
    out = sessions.join(latest_edits(edits, key), key, "left").withColumns({c: F.coalesce(c, none) for c in ("added", "removed")})
    base = F.concat(F.coalesce("capturedTags", none), F.coalesce("identityTags", none)) if "identityTags" in sessions.columns else F.coalesce("capturedTags", none)
    out = out.withColumn("tags", distinct_minus(base, F.col("added"), F.col("removed")))
    if suggestions is None:
        return out.withColumn("suggestedTags", none).drop("added", "removed")
    named = suggestions.select(key, F.col("digest").alias("for"), F.col("tags").alias("proposed"))
    out = out.join(named, key, "left")
    current = F.when(F.col("for") == F.col("digest"), F.array_distinct("proposed")).otherwise(none)
    return out.withColumn("suggestedTags", F.array_except(F.array_except(current, "tags"), "removed")).drop("added", "removed", "for", "proposed")


def _tri(state: str, flag: Column) -> Column:
    if state not in ("exclude", "include", "only"):
        raise ValueError("a tri-state is exclude, include or only")
    return F.lit(True) if state == "include" else flag if state == "only" else ~flag


def where(sessions: DataFrame, f: Filter) -> DataFrame:
    """Applies a filter to overlaid sessions. Equalities on plain columns reach the scan."""
    for column, value in (("projectId", f.project), ("source", f.source), ("actorId", f.actor), ("provider", f.provider), ("accessPath", f.access)):
        if value is not None:
            sessions = sessions.where(F.col(column) == value)
    if "partOf" in sessions.columns:
        sessions = sessions.where(_tri(f.parts, F.col("partOf").isNotNull()))
    if "tags" in sessions.columns:
        sessions = sessions.where(_tri(f.exempt, exempt_run(F.col("tags")).isNotNull()))
    if f.tag is not None:
        sessions = sessions.where(F.array_contains("tags", f.tag))
    if f.suggested is not None:
        sessions = sessions.where(F.array_contains("suggestedTags", f.suggested))
    if f.model is not None:
        sessions = sessions.where(F.exists("models", lambda m: m["model"] == f.model))
    if f.effort is not None:
        sessions = sessions.where(F.exists("models", lambda m: (m["effort"] == f.effort) & (F.lit(f.model is None) | (m["model"] == F.lit(f.model)))))
    if f.reference is not None:
        sessions = sessions.where(F.exists("references", lambda r: (r["integration"] == f.reference[0]) & (r["ref"] == f.reference[1])))
    return sessions


def named(title: Column, tags: Column, query: str) -> Column:
    """True if the title or a tag contains the whole query."""
    q = F.lit(query.lower())
    return F.contains(F.lower(title), q) | F.exists(tags, lambda t: F.contains(F.lower(t), q))


def page(sessions: DataFrame, limit: int, before: int | None = None, seq: str = "seq") -> DataFrame:
    """A page, newest first, with one row more if there is another page. One plan: a filter and a top-k."""
    rows = sessions if before is None else sessions.where(F.col(seq) < before)
    return rows.orderBy(F.desc(seq)).limit(limit + 1)


def search(sessions: DataFrame, chunks: DataFrame, query: str, limit: int, key: str = "id", before: int | None = None) -> DataFrame:
    """A page of the sessions whose current chunks hold a term, or whose title or tags hold the query."""
    wanted = words.terms_of(query)
    if not wanted:
        return page(sessions, limit, before)
    hits = chunks.where(words.score(F.col("text"), wanted) > 0).select(key).distinct().withColumn("hit", F.lit(True))
    found = sessions.join(hits, key, "left").where(F.col("hit") | named(F.col("title"), F.col("tags"), query)).drop("hit")
    return page(found, limit, before)


def model_counts(entries: DataFrame, *keys: str) -> DataFrame:
    """(keys, models): entries for each (model, effort), in order of first appearance."""
    counted = entries.where(F.col("model").isNotNull()).groupBy(*keys, "model", "effort").agg(F.count(F.lit(1)).alias("entries"), F.min("position").alias("first"))
    return counted.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "model", "effort", "entries"))), lambda m: F.struct(m["model"].alias("model"), m["effort"].alias("effort"), m["entries"].alias("entries"))).alias("models"))


def reference_counts(entries: DataFrame, recorded: DataFrame, *keys: str, integrations: tuple[Integration, ...] = INTEGRATIONS, limit: int = 25) -> DataFrame:
    """(keys, integration, ref, recorded, mentions, rank): recorded references first, then the most mentioned.

    ``recorded`` has (keys, place, integration, ref). Mentions are counted before anything is ranked.
    """
    known = [i.key for i in integrations]
    each = entries.select(*keys, "position", F.posexplode(references(F.col("text"), integrations)).alias("n", "r"))
    # First seen: integration by integration, then entry by entry.
    place = F.struct(F.lit(1).alias("group"), F.array_position(F.array(*map(F.lit, known)), F.col("r.integration")).cast("long").alias("i"), F.col("position").cast("long").alias("p"), F.col("n").cast("long").alias("n"))
    told = F.struct(F.lit(0).alias("group"), F.lit(0).cast("long").alias("i"), F.col("place").cast("long").alias("p"), F.lit(0).cast("long").alias("n"))
    mentions = each.select(*keys, F.col("r.integration").alias("integration"), F.col("r.ref").alias("ref"), place.alias("first"), F.lit(1).alias("m"))
    given = recorded.where(F.col("integration").isin(known)).select(*keys, "integration", "ref", told.alias("first"), F.lit(0).alias("m"))
    counted = mentions.unionByName(given).groupBy(*keys, "integration", "ref").agg(F.sum("m").alias("mentions"), F.min("first").alias("first")).withColumn("recorded", F.col("first.group") == 0)
    order = Window.partitionBy(*keys).orderBy(F.desc("recorded"), F.desc("mentions"), "first")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("first")


def session_digest(entries: DataFrame, *keys: str) -> DataFrame:
    """What a tagger reads of a session: counts, top tools, first prompts, first and last reply, whether it was aborted.

    Conditional aggregates in one pass; lists are bounded (4 prompts, 8 tools) by ranks before they are gathered.
    """
    from .activity import call_name

    kind, text = F.col("kind"), F.col("text")
    typed = entries.withColumn("typed", F.when(kind.isin("user", "event"), words.typed_prompt_udf(F.when(kind.isin("user", "event"), text))))
    is_prompt = (kind == "user") & F.col("typed").isNotNull()
    is_task = (kind == "event") & F.col("typed").isNotNull() & ~F.startswith(F.ltrim(text), F.lit("{"))
    reply = (kind == "assistant") & (F.trim(text) != "")
    prompts = typed.where(is_prompt).withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("position"))).where("k <= 4").groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "typed"))), lambda p: words.clip(p["typed"], 500)).alias("prompts")
    )
    tools = entries.where(kind == "tool-call").select(*keys, "position", F.left(F.coalesce(call_name(text), F.lit("tool")), F.lit(60)).alias("tool"))
    tools = tools.groupBy(*keys, "tool").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"))
    top = tools.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first"))).where("k <= 8")
    top = top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "tool", "n"))), lambda t: F.struct(t["tool"].alias("tool"), t["n"].alias("n"))).alias("tools"))
    counts = typed.groupBy(*keys).agg(
        F.count_if(is_prompt).alias("promptCount"), F.count_if(kind == "assistant").alias("assistantCount"), F.count_if(kind == "tool-call").alias("toolCalls"), F.count_if(kind == "event").alias("events"),
        F.min_by(text, F.when(reply, F.col("position"))).alias("first"), F.max_by(text, F.when(reply, F.col("position"))).alias("last"),
        F.min_by("typed", F.when(is_task, F.col("position"))).alias("task"),
        F.bool_or(F.regexp_like(text, F.lit(r"^\s*\[Request interrupted by user"))).alias("aborted"),
    )
    replies = F.array_compact(F.array(words.clip(F.col("first"), 400), F.when(F.col("assistantCount") > 1, words.clip(F.col("last"), 400))))
    out = counts.join(prompts, [*keys], "left").join(top, [*keys], "left")
    return out.select(
        *keys, "promptCount", "assistantCount", "toolCalls", "events", F.coalesce("tools", F.array().cast("array<struct<tool:string,n:bigint>>")).alias("tools"),
        F.coalesce("prompts", F.array().cast("array<string>")).alias("prompts"), F.when(F.col("promptCount") == 0, words.clip(F.col("task"), 500)).alias("task"), replies.alias("replies"), "aborted",
    )


def tag_usage(listed: DataFrame, definitions: DataFrame, key: str = "id") -> DataFrame:
    """Defined tags, with their descriptions, how many sessions carry each."""
    used = listed.select(key, F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("sessions"))
    return definitions.join(used, "tag", "left").withColumn("sessions", F.coalesce("sessions", F.lit(0)).cast("long"))
