"""Three transcript dialects as one table of records.

A dialect turns (file, line, text, v) into rows of ``RECORD``: what session the record belongs to, the items that
it adds, and what it leaves out. Everything is column expressions over the parsed record; what depends on records
before it (the model of a turn, copied history, accepted intents) is a window over the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.digests import quoted
from ..schema import LINEAGE_DDL
from .transcripts import at, kind_at, text_at

ITEM = "array<struct<kind:string,text:string,suffix:string,callId:string>>"
RECORD = ("file", "line", "session", "lineage", "provider", "subscription", "record", "timestamp", "model", "effort", "written", "compact", "items", "omissions")

# What an import says about what it leaves out: fixed values, but for the last, which says it in words of its own.
NO_REASONING = "Private reasoning is not included"
NO_SECRET_REASONING = "Private reasoning and encrypted payloads are not included"
NOT_TEXT = "Non-text message content is not included"
NOT_TOOL_TEXT = "Non-text tool content is not included"
ONLY_TOOL_TEXT = "Only text tool output blocks are included"
COPIED = "History copied from the parent session is kept with the parent session only"


def _so_far():
    return Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _none(ddl: str) -> Column:
    return F.lit(None).cast(ddl)


def _list(path: str) -> Column:
    """An array field as an array of variants; empty if it is no array."""
    return F.when(F.startswith(kind_at(path), F.lit("ARRAY")), F.coalesce(at(path, "array<variant>"), F.array().cast("array<variant>"))).otherwise(F.array().cast("array<variant>"))


def _of(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _string(v: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", _of(v, path))


def _item(kind: Column | str, text: Column, suffix: Column, call: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), text.alias("text"), suffix.alias("suffix"), (_none("string") if call is None else call).alias("callId"))


def _suffix(name: str, i: Column) -> Column:
    return F.concat(F.lit(f"{name}-"), i)


def _items(*lists: Column) -> Column:
    return F.filter(F.concat(*[x.cast(ITEM) for x in lists]), lambda x: x["text"] != "")


def _omitted(*said: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(text)) for when, text in said]))


def _raw(path: str) -> Column:
    """A field's JSON with its keys in the order written."""
    return F.when(kind_at(path) == "STRING", quoted(at(path))).otherwise(F.get_json_object("text", path))


def _call(name: Column, key: str, value: Column) -> Column:
    """A tool call as JSON; what is absent is left out."""
    fields = F.array_compact(F.array(F.when(name.isNotNull(), F.concat(F.lit('"name":'), quoted(name))), F.when(value.isNotNull(), F.concat(F.lit(f'"{key}":'), value))))
    return F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))


def _millis(path: str) -> Column:
    number = F.when(~kind_at(path).eqNullSafe("STRING"), at(path, "double"))
    return F.coalesce(number, F.unix_millis(F.try_to_timestamp(text_at(path))).cast("double"))


def _lineage(**fields: Column) -> Column:
    kinds = [f.split() for f in LINEAGE_DDL.split(", ")]
    return F.struct(*[fields.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds])


def _texts_of(v: Column, kinds: tuple[str, ...]) -> Column:
    """The texts of an array's text blocks, joined by lines."""
    blocks = F.filter(v.cast("array<variant>"), lambda b: _of(b, "$.type").isin(*kinds))
    return F.array_join(F.transform(blocks, lambda b: F.coalesce(_of(b, "$.text"), F.lit(""))), "\n")


def claude(rows: DataFrame) -> DataFrame:
    agent_file = F.nullif(F.regexp_extract("file", r"/agent-([^/]+)\.jsonl$", 1), F.lit(""))
    session, agent = text_at("$.sessionId"), F.coalesce(text_at("$.agentId"), agent_file)
    sidechain = F.coalesce(at("$.isSidechain", "boolean"), F.lit(False))
    of_agent = session.isNotNull() & agent.isNotNull() & (sidechain | agent_file.isNotNull())
    kind = text_at("$.type")
    turn = kind.isin("user", "assistant")
    flag = lambda path: F.coalesce(at(path, "boolean"), F.lit(False))
    origin = F.when(F.startswith(kind_at("$.origin"), F.lit("OBJECT")), ~text_at("$.origin.kind").eqNullSafe("human")).otherwise(F.coalesce(F.startswith(text_at("$.entrypoint"), F.lit("sdk")), F.lit(False)))
    written = (kind == "user") & (flag("$.isMeta") | flag("$.isCompactSummary") | sidechain | origin)
    blocks, content = F.col("blocks"), "$.message.content"
    of_kind = lambda b: _of(b, "$.type")
    result_kind = lambda b: F.schema_of_variant(F.try_variant_get(b, "$.content", "variant"))
    result = lambda b: F.when(result_kind(b) == "STRING", _of(b, "$.content")).when(F.startswith(result_kind(b), F.lit("ARRAY")), _texts_of(F.try_variant_get(b, "$.content", "variant"), ("text",))).otherwise(F.lit(""))
    # Inputs keep the order of their keys, so they are cut from the text and not printed from the variant.
    inputs = F.from_json(F.get_json_object("text", content), "array<struct<input:string>>")
    one = lambda b, i: (
        F.when(of_kind(b) == "text", _item(kind, _string(b, "$.text"), _suffix("text", i)))
        .when(of_kind(b) == "tool_use", _item("tool-call", _call(_string(b, "$.name"), "input", F.get(inputs, i)["input"]), _suffix("call", i), _string(b, "$.id")))
        .when(of_kind(b) == "tool_result", _item("tool-result", result(b), _suffix("result", i), _string(b, "$.tool_use_id")))
    )
    plain = F.when(turn & (kind_at(content) == "STRING"), F.array(_item(kind, at(content), F.lit("text"))).cast(ITEM)).otherwise(F.array().cast(ITEM))
    thinking = F.exists(blocks, lambda b: of_kind(b).isin("thinking", "redacted_thinking"))
    other = F.exists(blocks, lambda b: ~F.coalesce(of_kind(b).isin("text", "tool_use", "tool_result", "thinking", "redacted_thinking"), F.lit(False)))
    media = F.exists(blocks, lambda b: (of_kind(b) == "tool_result") & F.startswith(result_kind(b), F.lit("ARRAY")) & F.exists(_of(b, "$.content", "array<variant>"), lambda x: ~of_kind(x).eqNullSafe("text")))
    assistant = kind == "assistant"
    return rows.withColumn("blocks", F.when(turn, _list(content)).otherwise(F.array().cast("array<variant>"))).select(
        "file", "line",
        F.when(of_agent, F.concat(session, F.lit("/agent-"), agent)).otherwise(session).alias("session"),
        F.when(of_agent, _lineage(kind=F.lit("subagent"), parentSessionId=session, rootSessionId=session)).alias("lineage"),
        F.lit("anthropic").alias("provider"),
        text_at("$.quotaLimits.rateLimitType").isNotNull().alias("subscription"),
        text_at("$.uuid").alias("record"),
        _millis("$.timestamp").alias("timestamp"),
        F.when(assistant, text_at("$.message.model")).alias("model"),
        F.when(assistant, text_at("$.effort")).alias("effort"),
        F.coalesce(written, F.lit(False)).alias("written"),
        flag("$.isCompactSummary").alias("compact"),
        _items(plain, F.filter(F.transform(blocks, one), lambda x: x.isNotNull())).alias("items"),
        _omitted((thinking, NO_REASONING), (other, NOT_TEXT), (media, NOT_TOOL_TEXT)).alias("omissions"),
    )


def codex(rows: DataFrame) -> DataFrame:
    kind, item = text_at("$.type"), text_at("$.payload.type")
    meta = F.when(kind == "session_meta", F.struct(
        text_at("$.payload.id").alias("id"),
        F.coalesce(F.lower(text_at("$.payload.model_provider")), F.lit("openai")).alias("provider"),
        F.coalesce(text_at("$.payload.source.subagent.thread_spawn.parent_thread_id"), text_at("$.payload.parent_thread_id")).alias("parent"),
        text_at("$.payload.forked_from_id").alias("forked"),
        kind_at("$.payload.source.subagent").isNotNull().alias("subagent"),
        F.coalesce(text_at("$.payload.source.subagent.thread_spawn.agent_role"), text_at("$.payload.agent_role")).alias("role"),
        F.coalesce(text_at("$.payload.source.subagent.thread_spawn.agent_nickname"), text_at("$.payload.agent_nickname")).alias("nickname"),
        at("$.payload.source.subagent.thread_spawn.depth", "int").alias("depth"),
        ((text_at("$.payload.source") == "exec") | ~F.regexp_like(text_at("$.payload.originator"), F.lit("(?i)^codex")) | F.regexp_like(text_at("$.payload.originator"), F.lit("^codex_(?:exec|sdk|mcp)"))).alias("scripted"),
    ))
    seen = rows.withColumn("m", F.first(meta, ignorenulls=True).over(_so_far()))
    turn = F.when(kind == "turn_context", F.struct(text_at("$.payload.model").alias("model"), text_at("$.payload.effort").alias("effort")))
    m = F.col("m")
    nested = m["parent"].isNotNull() | m["forked"].isNotNull()
    own = (kind == "turn_context") & (text_at("$.payload.turn_id") > m["id"])
    past = F.coalesce(F.max(F.coalesce(own, F.lit(False))).over(_so_far()), F.lit(False))
    seen = seen.withColumn("turn", F.last(turn, ignorenulls=True).over(_so_far())).withColumn("copied", F.coalesce(nested, F.lit(False)) & ~past)
    p = "$.payload"
    message = (kind == "response_item") & (item == "message") & text_at(f"{p}.role").isin("user", "assistant")
    calls = (kind == "response_item") & item.isin("function_call", "custom_tool_call")
    results = (kind == "response_item") & item.isin("function_call_output", "custom_tool_call_output")
    reasoning = (kind == "response_item") & (item == "reasoning")
    aborted = (kind == "event_msg") & (item == "turn_aborted") & (text_at(f"{p}.reason") == "interrupted")
    spoken = ("input_text", "output_text", "text")
    texts = F.transform(_list(f"{p}.content"), lambda b, i: F.when(_of(b, "$.type").isin(*spoken), _item(text_at(f"{p}.role"), _string(b, "$.text"), _suffix("text", i))))
    output = F.when(kind_at(f"{p}.output") == "STRING", at(f"{p}.output")).when(F.startswith(kind_at(f"{p}.output"), F.lit("ARRAY")), _texts_of(F.try_variant_get("v", f"{p}.output", "variant"), spoken)).otherwise(F.lit(""))
    summaries = F.transform(_list(f"{p}.summary"), lambda b, i: _item("reasoning-summary", _string(b, "$.text"), _suffix("summary", i)))
    empty = F.array().cast(ITEM)
    items = (
        F.when(message, F.filter(texts, lambda x: x.isNotNull()).cast(ITEM))
        .when(calls, F.array(_item("tool-call", _call(text_at(f"{p}.name"), "arguments", F.coalesce(_raw(f"{p}.arguments"), _raw(f"{p}.input"))), F.lit("call"), text_at(f"{p}.call_id"))).cast(ITEM))
        .when(results, F.array(_item("tool-result", output, F.lit("result"), text_at(f"{p}.call_id"))).cast(ITEM))
        .when(reasoning, summaries.cast(ITEM))
        .when(aborted, F.array(_item("event", F.lit("[Request interrupted by user]"), F.lit("aborted"))).cast(ITEM))
        .otherwise(empty)
    )
    lineage = F.when(nested, _lineage(
        kind=F.when(m["subagent"], F.lit("subagent")).otherwise(F.lit("fork")), parentSessionId=F.coalesce(m["parent"], m["forked"]), agentType=m["role"], agentName=m["nickname"], depth=m["depth"]
    ))
    image = message & F.exists(_list(f"{p}.content"), lambda b: ~F.coalesce(_of(b, "$.type").isin(*spoken), F.lit(False)))
    said = _omitted((image, NOT_TEXT), (results & ~kind_at(f"{p}.output").eqNullSafe("STRING"), ONLY_TOOL_TEXT), (reasoning, NO_SECRET_REASONING))
    live = ~F.col("copied") & (kind != "session_meta")
    return seen.select(
        "file", "line", m["id"].alias("session"), lineage.alias("lineage"), m["provider"].alias("provider"),
        (live & (kind == "event_msg") & (item == "token_count") & text_at(f"{p}.rate_limits.plan_type").isNotNull()).alias("subscription"),
        F.coalesce(text_at("$.uuid"), text_at(f"{p}.id")).alias("record"),
        _millis("$.timestamp").alias("timestamp"),
        F.col("turn.model").alias("model"), F.col("turn.effort").alias("effort"),
        F.coalesce((m["scripted"] | m["subagent"]) & message & (text_at(f"{p}.role") == "user"), F.lit(False)).alias("written"),
        F.lit(False).alias("compact"),
        _items(F.when(live, items).otherwise(empty)).alias("items"),
        F.when(F.col("copied") & (kind != "session_meta"), F.array(F.lit(COPIED))).when(live, said).otherwise(F.array().cast("array<string>")).alias("omissions"),
    )


def muse(rows: DataFrame) -> DataFrame:
    rows = rows.where(F.startswith(kind_at("$.stream"), F.lit("OBJECT")))
    kind, p, e = text_at("$.payload_type"), "$.payload", "$.payload.event"
    run = text_at(f"{p}.kind") == "run"
    event = F.when(run, text_at(f"{e}.kind"))
    model = (
        F.when(kind == "runtime.model_reconfigure.completed", text_at(f"{p}.record.effective.model_id"))
        .when(kind.isin("run.model.configured", "runtime.session.metadata"), text_at(f"{p}.record.model_id"))
        .when(event == "model_completed", text_at(f"{e}.model"))
    )
    intent = kind == "runtime.user_intent.accepted"
    refill = _list(f"{p}.refill_blocks")
    messages = F.flatten(F.transform(_list(f"{p}.model_messages"), lambda m: F.coalesce(_of(m, "$.content", "array<variant>"), F.array().cast("array<variant>"))))
    blocks = F.when(F.size(refill) > 0, refill).otherwise(messages)
    is_text = lambda b: F.coalesce(_of(b, "$.kind") == "text", F.lit(False))
    said = F.array_join(F.transform(F.filter(blocks, is_text), lambda b: _of(b, "$.text")), "\n")
    accepted = F.when(intent, F.array_compact(F.array(text_at(f"{p}.intent_id"), F.when(said != "", said))))
    seen = rows.withColumn("model", F.last(model, ignorenulls=True).over(_so_far())).withColumn("accepted", F.flatten(F.collect_list(accepted).over(_so_far())))
    repeats = F.coalesce(F.array_contains("accepted", text_at(f"{p}.run_id")), F.lit(False)) | F.coalesce(F.array_contains("accepted", text_at(f"{e}.prompt")), F.lit(False))
    session_run = (kind == "runtime.session") & run
    # Arguments keep the order of their keys.
    arguments = F.from_json(F.get_json_object("text", f"{e}.tool_calls"), "array<struct<args:string>>")
    args = lambda c, i: F.when(F.schema_of_variant(F.try_variant_get(c, "$.args", "variant")) == "STRING", quoted(_of(c, "$.args"))).otherwise(F.get(arguments, i)["args"])
    calls = F.transform(_list(f"{e}.tool_calls"), lambda c, i: _item("tool-call", _call(_string(c, "$.name"), "arguments", args(c, i)), _suffix("call", i), _string(c, "$.call_id")))
    results = F.transform(_list(f"{e}.results"), lambda r, i: _item("tool-result", _string(r, "$.text"), _suffix("result", i), _string(r, "$.tool_call_id")))
    texts = F.filter(F.transform(blocks, lambda b, i: F.when(is_text(b), _item("user", _string(b, "$.text"), _suffix("text", i)))), lambda x: x.isNotNull())
    one = lambda kind, text, suffix: F.array(_item(kind, text, F.lit(suffix))).cast(ITEM)
    child = text_at(f"{e}.child_session_id")
    spawn = F.concat(F.lit('{"spawned":'), quoted(F.coalesce(text_at(f"{e}.reminder_agent_id"), F.lit("subagent"))), F.lit(',"sessionId":'), quoted(child), F.lit("}"))
    known = event.isin("started", "assistant_message_committed", "reasoning_summary_committed", "reasoning_committed", "assistant_tool_calls_committed", "tool_result_batch_committed")
    empty = F.array().cast(ITEM)
    items = (
        F.when(intent, texts.cast(ITEM))
        .when(~F.coalesce(session_run, F.lit(False)), empty)
        .when((event == "started") & ~repeats, one("user", text_at(f"{e}.prompt"), "prompt"))
        .when(event == "assistant_message_committed", one("assistant", text_at(f"{e}.text"), "text"))
        .when(event == "reasoning_summary_committed", one("reasoning-summary", text_at(f"{e}.text"), "summary"))
        .when(event == "assistant_tool_calls_committed", calls.cast(ITEM))
        .when(event == "tool_result_batch_committed", results.cast(ITEM))
        .when(~F.coalesce(known, F.lit(False)) & child.isNotNull(), one("event", spawn, "spawn"))
        .otherwise(empty)
    )
    named = F.lower(text_at(f"{p}.record.provider_id"))
    provider = F.last(F.when(F.regexp_like(named, F.lit("^[a-z0-9][a-z0-9_-]{0,63}$")), named), ignorenulls=True).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    written = F.when(intent, ~text_at(f"{p}.semantic_kind.kind").eqNullSafe("chat")).otherwise(run & (event == "started"))
    return seen.select(
        "file", "line", F.when(text_at("$.stream.kind") == "session", text_at("$.stream.id")).alias("session"),
        _none(f"struct<{LINEAGE_DDL.replace(' ', ':').replace(',:', ',')}>").alias("lineage"),
        F.coalesce(provider, F.lit("meta")).alias("provider"), F.lit(True).alias("subscription"), text_at("$.id").alias("record"),
        F.floor(at("$.recorded_at", "double") / 1000).cast("double").alias("timestamp"),
        F.col("model"), _none("string").alias("effort"), F.coalesce(written, F.lit(False)).alias("written"), F.lit(False).alias("compact"),
        _items(items).alias("items"),
        _omitted((intent & F.exists(blocks, lambda b: ~is_text(b)), NOT_TEXT), (session_run & (event == "reasoning_committed"), NO_SECRET_REASONING)).alias("omissions"),
    )


DIALECTS = {"claude-code": claude, "codex": codex, "muse": muse}
