"""Records of any dialect put together: entries in order, sessions, and files that are rejected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import typed_prompt_udf
from ..operators.activity import person_results
from ..schema import MAX_BYTES, MAX_ENTRIES, MAX_TEXT
from . import transcripts
from .dialects import DIALECTS

IMPORTED = "Import contains public transcript records only; source history may be incomplete"


@dataclass
class Imported:
    """What a scan gives: one row a session, one row an entry, and (file, error) of files that are rejected."""

    sessions: DataFrame
    entries: DataFrame
    rejected: DataFrame


def _items(records: DataFrame) -> DataFrame:
    """One row an item, with its id, its kind, and the typed prompt that it holds."""
    each = records.select("*", F.posexplode("items").alias("seq", "i"))
    text, asked = F.col("i.text"), F.col("i.kind")
    typed = each.withColumn("typed", F.when(asked.isin("user", "event"), typed_prompt_udf(F.when(asked.isin("user", "event"), text))))
    person = (asked != "user") | (~F.col("written") & F.col("typed").isNotNull())
    producing = ("assistant", "tool-call", "reasoning-summary")
    return typed.select(
        "file", "line", "seq", "session", "timestamp", "written", "compact", "typed",
        F.concat(F.coalesce("record", F.concat(F.lit("line-"), F.col("line"))), F.lit(":"), F.col("i.suffix")).alias("id"),
        F.when(person, asked).otherwise(F.lit("event")).alias("kind"),
        text.alias("text"), F.col("i.callId").alias("callId"),
        F.concat(F.lit("line:"), F.col("line")).alias("sourceRef"),
        F.when(asked.isin(*producing), F.col("model")).alias("model"),
        F.when(asked.isin(*producing), F.col("effort")).alias("effort"),
    )


def _unique(items: DataFrame) -> DataFrame:
    """The first of the items of each id; ``conflict`` says whether they differ."""
    same = Window.partitionBy("file", "id")
    identity = F.xxhash64("kind", "text", F.coalesce("callId", F.lit("\0")))
    marked = items.withColumn("identity", identity).withColumn("place", F.row_number().over(same.orderBy("line", "seq")))
    return marked.withColumn("conflict", F.min("identity").over(same) != F.max("identity").over(same)).where("place = 1").drop("place", "identity")


def assemble(records: DataFrame, source: str, source_id: str, captured_at: float, project_id: str | None = None) -> Imported:
    """Sessions and entries of the records (``dialects.RECORD``) of one dialect.

    A file is rejected whole: for mixed sessions, conflicting ids, sizes beyond the limits, or no session; a file
    without turns is an empty transcript. ``captured_at`` is epoch milliseconds, given so that reruns agree.
    """
    items = _unique(_items(records))
    # A prompt that someone else wrote titles the session only if nothing was typed.
    open_prompt = F.col("typed").isNotNull() & ~F.col("compact")
    order = F.struct("line", "seq")
    per_file = items.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.octet_length("text").cast("long")).alias("bytes"),
        F.max(F.length("text")).alias("longest"),
        F.bool_or("conflict").alias("conflict"),
        F.min_by("typed", F.when(open_prompt & (F.col("kind") == "user"), order)).alias("prompt"),
        F.min_by("typed", F.when(open_prompt & (F.col("kind") == "event") & F.col("written"), order)).alias("task"),
        F.bool_or(F.col("kind") == "reasoning-summary").alias("reasoning"),
    )
    said = records.select("file", "line", F.posexplode("omissions").alias("seq", "omission")).groupBy("file", "omission").agg(F.min(order).alias("first"))
    omissions = said.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "omission"))), lambda x: x["omission"]).alias("omitted"))
    facts = records.groupBy("file").agg(
        F.min("session").alias("session"),
        (F.min("session") != F.max("session")).alias("mixed"),
        F.min_by("lineage", F.when(F.col("lineage").isNotNull(), F.col("line"))).alias("lineage"),
        F.max_by("provider", F.when(F.col("provider").isNotNull(), F.col("line"))).alias("provider"),
        F.bool_or("subscription").alias("subscription"),
    )
    known = facts.join(per_file, "file", "left").join(omissions, "file", "left")
    error = (
        F.when(F.col("mixed"), F.lit("Mixed transcript sessions"))
        .when(F.col("session").isNull(), F.lit("Transcript must identify a session and contain supported records"))
        .when(F.col("conflict"), F.lit("Conflicting transcript record"))
        .when((F.col("bytes") > MAX_BYTES) | (F.col("n") > MAX_ENTRIES) | (F.col("longest") > MAX_TEXT), F.lit("Supported transcript content exceeds the size limit"))
        .when(F.col("n").isNull(), F.lit("Transcript holds no turns"))
    )
    judged = known.withColumn("error", error)
    access = F.when(F.lit(source) == "muse", F.lit("subscription")).when(F.col("subscription"), F.lit("subscription")).otherwise(F.lit("unknown"))
    evidence = F.when(F.lit(source) == "muse", F.lit("harness")).when(F.col("subscription"), F.lit("transcript"))
    sessions = judged.where("error is null").select(
        "file", F.lit(1).alias("schemaVersion"), F.lit(source_id).alias("sourceId"), F.lit(source).alias("source"), F.col("session").alias("sessionId"),
        F.left(F.coalesce("prompt", "task", "session"), F.lit(160)).alias("title"), F.lit(project_id).cast("string").alias("projectId"),
        F.struct(F.coalesce("provider", F.lit("openai")).alias("provider"), access.alias("accessPath"), evidence.alias("evidence")).alias("runtime"),
        "lineage", F.array().cast("array<string>").alias("tags"), F.lit(float(captured_at)).alias("capturedAt"),
        F.struct(
            F.when(F.col("reasoning"), F.lit("summaries-only")).otherwise(F.lit("unavailable")).alias("reasoning"),
            F.lit("partial").alias("completeness"),
            F.concat(F.array(F.lit(IMPORTED)), F.coalesce("omitted", F.array().cast("array<string>"))).alias("omissions"),
        ).alias("coverage"),
    )
    whole = items.join(judged.where("error is null").select("file", F.col("session").alias("sessionId")), "file")
    numbered = whole.withColumn("position", F.row_number().over(Window.partitionBy("file").orderBy("line", "seq")) - 1)
    entries = numbered.select("file", "sessionId", "position", "id", F.lit(None).cast("string").alias("turnId"), "callId", "kind", "text", "timestamp", "sourceRef", "model", "effort")
    return Imported(sessions, person_results(entries, "file"), judged.where("error is not null").select("file", "error"))


def read(spark: SparkSession, paths: str | list[str], source: str, source_id: str, captured_at: float, project_id: str | None = None, known: DataFrame | None = None) -> Imported:
    """Imports all transcripts of a dialect below the paths; ``known`` is the ledger of files to pass over."""
    files = transcripts.scan(spark, paths, source)
    files = transcripts.unread(files, known) if known is not None else files
    parsed, malformed = transcripts.records(transcripts.lines(files))
    out = assemble(DIALECTS[source](parsed), source, source_id, captured_at, project_id)
    return Imported(out.sessions, out.entries, out.rejected.unionByName(malformed).unionByName(transcripts.not_utf8(files)))


def preview(found: Imported) -> DataFrame:
    """What an import would do, a row a file: status, entries, characters, coverage or error."""
    sizes = found.entries.groupBy("file").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.length("text").cast("long")).alias("characters"))
    ready = found.sessions.join(sizes, "file").select("file", F.lit("ready").alias("status"), "entries", "characters", F.col("coverage.completeness").alias("coverage"), F.lit(None).cast("string").alias("error"))
    refused = found.rejected.select("file", F.lit("rejected").alias("status"), F.lit(0).cast("long").alias("entries"), F.lit(0).cast("long").alias("characters"), F.lit(None).cast("string").alias("coverage"), "error")
    return ready.unionByName(refused)


def spawn_of(child: Column, lines: DataFrame) -> DataFrame:
    """(child, parentEntryId, agentType): the first record of a parent's stream that names the child session."""
    event = transcripts.text_at("$.payload.event.child_session_id")
    named = lines.where(transcripts.text_at("$.payload.kind") == "run").select("file", "line", event.alias("child"), F.struct(F.concat(transcripts.text_at("$.id"), F.lit(":spawn")).alias("parentEntryId"), F.left(transcripts.text_at("$.payload.event.reminder_agent_id"), F.lit(200)).alias("agentType")).alias("m"))
    return named.where(F.col("child") == child if child is not None else F.col("child").isNotNull()).groupBy("file", "child").agg(F.min_by("m", "line").alias("m")).select("file", "child", "m.*")


def desktop(spark: SparkSession, paths: str | list[str], source_id: str, captured_at: float, project_id: str | None = None) -> Imported:
    """Imports desktop-reader exports: one JSON document a file, turns newest first, text of both sides only."""
    schema = "thread struct<id:string,title:string>, page struct<hasMore:boolean>, turns array<struct<id:string,startedAt:double,completedAt:double,items:array<struct<type:string,id:string,text:string,content:array<struct<type:string,text:string>>>>>>"
    docs = spark.read.schema(schema).option("multiLine", True).json(paths).select(F.col("_metadata.file_path").alias("file"), "*")
    turns = docs.select("file", F.col("thread.id").alias("sessionId"), F.posexplode(F.reverse("turns")).alias("t", "turn"))
    items = turns.select("file", "sessionId", "t", "turn", F.posexplode("turn.items").alias("i", "item")).where(F.col("item.type").isin("userMessage", "agentMessage"))
    user = F.col("item.type") == "userMessage"
    spoken = F.array_join(F.transform(F.filter("item.content", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    text = F.coalesce("item.text", spoken)
    entries = items.where(text != "").select(
        "file", "sessionId", (F.row_number().over(Window.partitionBy("file").orderBy("t", "i")) - 1).alias("position"), F.col("item.id").alias("id"), F.col("turn.id").alias("turnId"), F.lit(None).cast("string").alias("callId"),
        F.when(user, F.lit("user")).otherwise(F.lit("assistant")).alias("kind"), text.alias("text"),
        (F.when(user, F.col("turn.startedAt")).otherwise(F.col("turn.completedAt")) * 1000).alias("timestamp"),
        F.concat(F.lit("chatgpt:"), "sessionId", F.lit(":"), F.col("item.id")).alias("sourceRef"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("effort"),
    )
    spoke = entries.select("file").distinct()
    note = "Desktop conversation text only; tool activity, attachments, alternate branches and citation targets are not exported. Reader text may be truncated."
    older = "Older conversation turns are not included in this page."
    sessions = docs.join(spoke, "file", "left_semi").select(
        "file", F.lit(1).alias("schemaVersion"), F.lit(source_id).alias("sourceId"), F.lit("chatgpt").alias("source"), F.col("thread.id").alias("sessionId"), F.col("thread.title").alias("title"),
        F.lit(project_id).cast("string").alias("projectId"), F.array().cast("array<string>").alias("tags"), F.lit(float(captured_at)).alias("capturedAt"),
        F.struct(F.lit("unavailable").alias("reasoning"), F.lit("partial").alias("completeness"), F.array_compact(F.array(F.lit(note), F.when(F.col("page.hasMore"), F.lit(older)))).alias("omissions")).alias("coverage"),
    )
    return Imported(sessions, entries, docs.join(spoke, "file", "left_anti").select("file", F.lit("The export contains no readable messages").alias("error")))
