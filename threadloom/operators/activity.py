"""The person's side of tool activity, and sessions without it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.digests import quoted
from ..functions.references import INTEGRATIONS, Integration, references
from ..schema import TOOL_KINDS

# How harnesses word a person's answers, choices and refusals.
ANSWERED = r"^(?:The user answered|Your questions have been answered): "
REJECTED = r"^The user doesn't want to proceed with this tool use\."
SAID = r"the user said:\s*"
CLARIFY = r"^The user wants to clarify these questions\."
APPROVED = r"^User has approved your plan\."
SPAWNS = ("Agent", "Task", "spawn_agent", "subagent_spawn")
ASKS, ASKS_LATER, REPLY = "request_user_input", "request_user_input_async", "send_user_message_question_reply"
NOT_KEPT = "Tool calls and tool results are not kept: the setting to capture them is off."
#: References of a session at most.
REFERENCES = 100


def call_name(call: Column) -> Column:
    """A tool call's name, under either of its keys."""
    v = F.try_parse_json(call)
    return F.coalesce(*[F.nullif(F.try_variant_get(v, k, "string"), F.lit("")) for k in ("$.name", "$.tool")])


def call_input(call: Column) -> Column:
    """A tool call's input as a variant; arguments written as a string are parsed."""
    v = F.try_parse_json(call)
    raw = F.coalesce(F.try_variant_get(v, "$.input", "variant"), F.try_variant_get(v, "$.arguments", "variant"))
    written = F.schema_of_variant(raw) == "STRING"
    return F.when(written, F.try_parse_json(F.try_variant_get(raw, "$", "string"))).otherwise(raw)


def _input(field: str) -> Column:
    return F.try_variant_get(F.col("asked"), field, "string")


def _codex_answer(text: Column) -> Column:
    """Answers by question id, written with their questions; null if the result has none."""
    given = F.from_json(F.get_json_object(text, "$.answers"), "map<string,struct<answers:array<string>>>")
    questions = F.from_json(F.to_json(F.try_variant_get(F.col("asked"), "$.questions", "variant")), "array<struct<id:string,question:string>>")
    question = lambda k: F.coalesce(F.get(F.filter(questions, lambda q: q["id"] == k), F.lit(0))["question"], k)
    said = F.filter(F.transform(F.map_entries(given), lambda e: F.struct(e["key"].alias("k"), F.filter(e["value"]["answers"], lambda a: a != "").alias("a"))), lambda e: F.size(e["a"]) > 0)
    parts = F.transform(said, lambda e: F.concat(F.lit('"'), question(e["k"]), F.lit('"="'), F.array_join(e["a"], ", "), F.lit('"')))
    return F.when(F.size(parts) > 0, F.concat(F.lit("The user answered: "), F.array_join(parts, ", ")))


def person_results(entries: DataFrame, *keys: str) -> DataFrame:
    """Tool results that carry a person's answer or choice become user or event entries; others stay.

    A result is joined with the last call of its id in its session: one equi-join on (keys, callId), calls
    reduced to one a key first. Only entries that are results take part; the rest pass by.
    """
    columns = entries.columns
    calls = entries.where((F.col("kind") == "tool-call") & F.col("callId").isNotNull()).groupBy(*keys, "callId").agg(F.max_by("text", "position").alias("call"))
    others = entries.where(F.col("kind") != "tool-result")
    asked = entries.where(F.col("kind") == "tool-result").join(calls, [*keys, "callId"], "left").withColumn("name", call_name(F.col("call"))).withColumn("asked", call_input(F.col("call")))
    text = F.col("text")
    rejected, said = F.regexp_like(text, F.lit(REJECTED)), F.regexp_like(text, F.lit(SAID))
    feedback = F.trim(F.regexp_replace(text, rf"(?s)^.*?{SAID}", ""))
    command = _input("$.command")
    refusal = F.concat(
        F.lit('{"rejected":'), quoted(F.coalesce("name", F.lit("tool use"))),
        F.coalesce(F.when(F.length(command).between(1, 500), F.concat(F.lit(',"command":'), quoted(command))), F.lit("")), F.lit("}"),
    )
    answer = F.when(F.col("name") == ASKS, _codex_answer(text))
    become = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("text"))
    shape = (
        F.when(F.regexp_like(text, F.lit(ANSWERED)), become("user", text))
        .when(rejected & said & (feedback != "") & F.regexp_like(feedback, F.lit(CLARIFY)), become("event", text))
        .when(rejected & said & (feedback != ""), become("user", text))
        .when(rejected & ~said, become("event", refusal))
        .when(F.regexp_like(text, F.lit(APPROVED)), become("event", text))
        .when(answer.isNotNull(), become("user", answer))
    )
    judged = asked.withColumn("shape", shape)
    changed = judged.select(*[F.coalesce(f"shape.{c}", c).alias(c) if c in ("kind", "text") else F.col(c) for c in columns])
    return others.select(*columns).unionByName(changed)


def strip(entries: DataFrame, *keys: str) -> DataFrame:
    """Entries without tool calls and results, but for spawns of subagents and unanswered questions, kept as events."""
    columns = entries.columns
    tool = F.col("kind").isin(*TOOL_KINDS)
    named = entries.where(F.col("kind") == "tool-call").withColumn("name", call_name(F.col("text"))).withColumn("asked", call_input(F.col("text")))
    detail = F.left(F.coalesce(*[F.nullif(_input(f"$.{k}"), F.lit("")) for k in ("description", "agent_type", "subagent_type")]), F.lit(500))
    spawn = F.concat(F.lit('{"spawned":'), quoted(F.col("name")), F.coalesce(F.concat(F.lit(',"description":'), quoted(detail)), F.lit("")), F.lit("}"))
    spawned = named.where(F.col("name").isin(*SPAWNS)).withColumn("text", spawn)
    asking = named.where((F.col("name") == ASKS_LATER) & F.col("callId").isNotNull())
    replies = entries.where(~tool & F.contains("text", F.lit(REPLY)))
    # Few rows on both sides: questions asked in passing, and messages that answer one, within a session.
    answered = asking.alias("q").join(replies.alias("r"), [F.col(f"q.{k}") == F.col(f"r.{k}") for k in keys] + [F.contains("r.text", F.col("q.callId"))], "left_anti")
    questions = F.from_json(F.to_json(F.try_variant_get(F.col("asked"), "$.questions", "variant")), "array<struct<question:string,title:string>>")
    texts = F.array_compact(F.transform(questions, lambda q: F.coalesce(F.nullif(q["question"], F.lit("")), F.nullif(q["title"], F.lit("")))))
    open_ones = answered.withColumn("texts", texts).where(F.size("texts") > 0).withColumn("text", F.concat(F.lit('{"asked":'), F.to_json("texts"), F.lit("}")))
    event = lambda df: df.select(*[F.lit("event").alias(c) if c == "kind" else F.lit(None).cast("string").alias(c) if c in ("model", "effort") else F.col(c) for c in columns])
    return entries.where(~tool).unionByName(event(spawned)).unionByName(event(open_ones))


def dropped_references(entries: DataFrame, kept: DataFrame, *keys: str, integrations: tuple[Integration, ...] = INTEGRATIONS) -> DataFrame:
    """(keys, references, cut): those linked only from dropped tool activity, most mentioned first, ``REFERENCES`` at most."""
    mentioned = lambda df: df.select(*keys, "position", F.posexplode(references(F.col("text"), integrations)).alias("n", "r")).select(*keys, "position", "n", "r.*")
    dropped = mentioned(entries.where(F.col("kind").isin(*TOOL_KINDS)))
    only = dropped.join(mentioned(kept).select(*keys, "integration", "ref").distinct(), [*keys, "integration", "ref"], "left_anti")
    counted = only.groupBy(*keys, "integration", "ref").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("position", "n")).alias("first"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first")))
    kept_ones = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= REFERENCES, F.struct("rank", "integration", "ref")))), lambda x: F.struct(x["integration"].alias("integration"), x["ref"].alias("ref")))
    return ranked.groupBy(*keys).agg(kept_ones.alias("references"), F.greatest(F.count(F.lit(1)) - REFERENCES, F.lit(0)).alias("cut"))
