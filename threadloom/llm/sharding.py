"""Sharding by jump consistent hashing (Lamping and Veach): a stable key and the shard count decide.

No ring table is kept. When the shard count grows by one, a row either stays or moves to the new shard.

Edge cases: a null key is placed as key 0; rows repeating a key share its shard and get slots of their own;
null text has no bytes and no checksum; an empty table gives an empty result; input columns named like an
added column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

# Fixed value of the published algorithm: the multiplier of its generator, in 32-bit halves below.
MULTIPLIER = 2862933555777941757
_MH, _ML = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF


def _low16(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFF))


def _low32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def _partial(a: Column, m: int) -> Column:
    """a * m modulo 2^32, as a sum below 2^49: 16-bit limbs keep every product within a long."""
    high = _low16(F.shiftrightunsigned(a, 16) * F.lit(m))
    return _low16(a) * F.lit(m) + F.shiftleft(high, 16)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a long key among ``shards``, as an int; the generator's 64-bit arithmetic is unsigned."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), _low32(key).alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(a: Column, _: Column) -> Column:
        t1 = F.shiftrightunsigned(a["lo"], 16) * F.lit(_ML)
        low = _low16(a["lo"]) * F.lit(_ML) + F.shiftleft(_low16(t1), 16) + F.lit(1).cast("long")
        carry = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(t1, 16)
        high = _low32(carry + _partial(a["hi"], _ML) + _partial(a["lo"], _MH))
        halves = F.transform(F.array(F.struct(high.alias("hi"), _low32(low).alias("lo"))), lambda k: F.struct(
            k["hi"].alias("hi"),
            k["lo"].alias("lo"),
            a["j"].alias("b"),
            F.floor((a["j"] + 1) * (F.lit(2147483648.0) / (F.shiftrightunsigned(k["hi"], 1) + 1).cast("double"))).cast("long").alias("j"),
        ))[0]
        return F.when(a["j"] >= shards, a).otherwise(halves)

    # Every step raises j, so that as many steps as shards always suffice; most keys stop after ln(shards).
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda a: a["b"].cast("int"))


def key_of(df: DataFrame, column: str) -> Column:
    """Integral keys are used as they are, others by their 64-bit hash."""
    kind = df.schema[column].dataType
    return F.col(column).cast("long") if isinstance(kind, T.IntegralType) else F.when(F.col(column).isNotNull(), F.xxhash64(F.col(column)))


ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def place(df: DataFrame, key: str = "doc_id", shards: int = 24, text: str = "text") -> DataFrame:
    """Adds size, text_crc32, law, shard and grown_shard to the rows of ``df``: what each row decides by itself."""
    df = shared.names_free(df, *ADDED)
    number = key_of(df, key)
    return df.select(
        *df.columns,
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.col(text)).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(number, shards).alias("shard"),
        jump_hash(number, shards + 1).alias("grown_shard"),
    )


def number_slots(placed: DataFrame, key: str = "doc_id", rows: int | None = None) -> DataFrame:
    """Adds slot to rows that have been placed: 0, 1, ... without gaps within a shard.

    A shard's rows are dealt into groups by key, size and checksum, so a key that many rows share is spread, whatever
    its texts; see ``shared.ranked``.
    """
    spread = F.coalesce(F.pmod(key_of(placed, key), F.lit(1 << 31)), F.lit(0).cast("long")) + F.col("size") + F.coalesce("text_crc32", F.lit(0))
    ranked = shared.ranked(placed, ["shard"], [], spread, [key, "size", "text_crc32"], shared.work_dir(placed.sparkSession), rows)
    rest = [c for c in placed.columns if c not in ADDED]
    return ranked.select(*rest, "size", "text_crc32", "law", "shard", (F.col("__rank") - 1).cast("long").alias("slot"), "grown_shard")


def shard(df: DataFrame, key: str = "doc_id", shards: int = 24, text: str = "text", rows: int | None = None) -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard to the rows of ``df``."""
    return number_slots(place(df, key, shards, text), key, rows)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = shared.materialize(place(docs).drop("text"), shared.work_dir(spark), "placed")  # texts are read once
    return number_slots(placed).select("doc_id", *ADDED)
