"""Chunks of entries, lexical matching over them, and selection within a token budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import digests, text as words

#: Tokens of a chunk, and of a search's context, by default; characters tried first for each token.
CHUNK, CONTEXT, WIDTH = 512, 2048, 3
#: What is left of a piece that is too long, and the least budget worth filling.
SHRINK, LEAST = 0.8, 16
MAX_CHUNK, MAX_CONTEXT = 8192, 32768

PIECES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("tokens", T.IntegerType())]))


def fit(text: str, start: int, budget: int, count: Callable[[str], int]) -> int:
    """End of the piece from ``start`` that a budget holds: cut by a fifth until it does. One character always fits."""
    end = min(len(text), start + budget * WIDTH)
    while end - start > 1 and count(text[start:end]) > budget:
        end = start + max(1, int((end - start) * SHRINK))
    return end


def pieces(text: str, budget: int = CHUNK, count: Callable[[str], int] = words.estimate_tokens) -> Iterator[tuple[int, int, int]]:
    """(start, end, tokens) of a text's chunks: they follow each other, and put together they are the text."""
    start = 0
    while start < len(text):
        end = fit(text, start, budget, count)
        yield start, end, count(text[start:end])
        start = end


def chunk(entries: DataFrame, *keys: str, budget: int = CHUNK, count: Callable[[str], int] = words.estimate_tokens) -> DataFrame:
    """(keys, entryId, sourceRef, kind, start, end, text, tokens, id, position): chunks of every entry, in order.

    Only places are made in Python; the text is cut in the JVM. Most entries fit one chunk and never leave it.
    """
    if not 16 <= budget <= MAX_CHUNK:
        raise ValueError("a chunk's budget is 16 to 8192 tokens")
    cut = F.pandas_udf(lambda texts: texts.map(lambda t: [{"start": a, "end": b, "tokens": n} for a, b, n in pieces(t, budget, count)]), PIECES)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), words.token_count(F.col("text")).alias("tokens")))
    short = (F.length("text") <= budget * WIDTH) & (words.token_count(F.col("text")) <= budget) & F.lit(count is words.estimate_tokens)
    placed = entries.where(F.length("text") > 0).withColumn("long", ~short).withColumn("p", F.when(F.col("long"), cut(F.when(F.col("long"), F.col("text")).otherwise(F.lit("")))).otherwise(whole))
    each = placed.select(*keys, F.col("position").alias("entry"), F.col("id").alias("entryId"), "sourceRef", "kind", "text", F.posexplode("p").alias("n", "piece"))
    part = F.substring(F.col("text"), F.col("piece.start") + 1, F.col("piece.end") - F.col("piece.start"))
    made = each.select(*keys, "entry", "n", "entryId", "sourceRef", "kind", F.col("piece.start").alias("start"), F.col("piece.end").alias("end"), part.alias("text"), F.col("piece.tokens").alias("tokens"))
    order = Window.partitionBy(*keys).orderBy("entry", "n")
    return made.withColumn("id", digests.chunk_id(F.col("entryId"), F.col("start"), F.col("end"), F.col("text"))).withColumn("position", F.row_number().over(order) - 1).drop("entry", "n")


def rank(chunks: DataFrame, query: str, *keys: str) -> DataFrame:
    """Chunks that hold any term, with their score and rank within the keys: more terms first, then by position."""
    wanted = words.terms_of(query)
    scored = chunks.withColumn("score", words.score(F.col("text"), wanted).cast("int"))
    some = scored.where(F.col("score") > 0) if wanted else scored
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "position")))


def matching(sessions: DataFrame, chunks: DataFrame, query: str, *keys: str) -> DataFrame:
    """Sessions with a chunk of their current revision that holds any term; an empty query matches all."""
    wanted = words.terms_of(query)
    if not wanted:
        return sessions
    held = chunks.where(words.score(F.col("text"), wanted) > 0).select(*keys)
    return sessions.join(held, [*keys], "left_semi")


def _excerpt(c: Column, room: Column, wanted: list[str]) -> Column:
    """A part of a chunk that the room holds, from a little before its first term."""
    low = F.lower(c["text"])
    places = F.array_min(F.filter(F.array(*[F.instr(low, F.lit(t)) for t in wanted]) if wanted else F.array(F.lit(1)), lambda p: p > 0))
    offset = F.greatest(F.lit(0), F.coalesce(places, F.lit(1)) - 1 - F.floor(room / 4)).cast("int")
    length = F.least(F.length(c["text"]) - offset, room * WIDTH).cast("int")
    fits = lambda n: F.octet_length(F.substring(c["text"], offset + 1, n)) <= room * 4
    shrunk = F.aggregate(F.sequence(F.lit(1), F.lit(40)), length, lambda n, _: F.when(fits(n), n).otherwise(F.greatest(F.lit(1), F.floor(n * SHRINK).cast("int"))))
    text = F.substring(c["text"], offset + 1, shrunk)
    return F.struct(c["position"].alias("position"), (c["start"] + offset).alias("start"), (c["start"] + offset + shrunk).alias("end"), text.alias("text"), words.token_count(text).alias("tokens"))


def select(ranked: DataFrame, query: str, *keys: str, budget: int = CONTEXT) -> DataFrame:
    """(keys, used, matching, chunks): each session's best chunks within the budget, the last ones as excerpts.

    A fold over the session's ranked chunks, in the JVM. A budget holds at most ``budget / LEAST`` chunks of that
    size or more, but small chunks are many, so only ranks that can matter are gathered: up to the budget itself.
    """
    if not LEAST <= budget <= MAX_CONTEXT:
        raise ValueError("a context's budget is 16 to 32768 tokens")
    wanted = words.terms_of(query)
    counted = ranked.withColumn("matching", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("rank") <= budget)
    fields = ("rank", "position", "start", "end", "text", "tokens")
    lists = counted.groupBy(*keys).agg(F.first("matching").alias("matching"), F.array_sort(F.collect_list(F.struct(*fields))).alias("c"))
    kept = "array<struct<position:int,start:int,end:int,text:string,tokens:int>>"
    begin = F.struct(F.lit(0).alias("used"), F.array().cast(kept).alias("chunks"))

    def step(a: Column, c: Column) -> Column:
        room = F.lit(budget) - a["used"]
        whole = F.struct(c["position"].alias("position"), c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("text"), c["tokens"].alias("tokens"))
        taken = F.when(c["tokens"] <= room, whole).otherwise(_excerpt(c, room, wanted))
        more = F.transform(F.array(taken), lambda t: F.struct((a["used"] + t["tokens"]).alias("used"), F.concat(a["chunks"], F.array(t)).alias("chunks")))
        return F.when(room < LEAST, a).otherwise(F.get(more, F.lit(0)))

    folded = lists.withColumn("f", F.aggregate("c", begin, step))
    return folded.select(*keys, F.col("f.used").alias("used"), "matching", F.col("f.chunks").alias("chunks"))


def across(listed: DataFrame, ranked: DataFrame, query: str, key: str, order: str, budget: int = CONTEXT) -> list[dict]:
    """The search's budget across a page of sessions, in listing order: each takes what is left.

    A page has 100 sessions at most, so this is one collect of their best chunks and a fold on the driver; a
    session that finds no room is still listed, without chunks.
    """
    page = [r[key] for r in listed.orderBy(order).select(key).limit(100).collect()]
    best = {r[key]: r for r in select(ranked.join(listed.select(key), key, "left_semi"), query, key, budget=budget).collect()}
    wanted, left, out = words.terms_of(query), budget, []
    for session in page:
        taken = []
        for c in best[session]["chunks"] if session in best else []:
            if left < LEAST:
                break
            if c["tokens"] <= left:
                taken.append(c.asDict())
            else:
                low = c["text"].lower()
                first = min((p for t in wanted if (p := low.find(t)) >= 0), default=0)
                offset = max(0, first - left // 4)
                end = fit(c["text"], offset, left, words.estimate_tokens)
                part = c["text"][offset:end]
                taken.append({"position": c["position"], "start": c["start"] + offset, "end": c["start"] + end, "text": part, "tokens": words.estimate_tokens(part)})
            left -= taken[-1]["tokens"]
        out.append({key: session, "chunks": taken})
    return out
