"""Mixing sources to target weights by systematic sampling.

Within a source, documents stand in an order by size; each has the expected number of copies that its source's
target asks for. Those numbers are summed up from the start, one random offset is added, and a document is emitted
once for each integer boundary that its stretch crosses. The offset comes from a seeded hash of the source's name, so
reruns agree. Where rows are in order of size, the words taken differ from the target by less than the source's
longest document has: a document's copies differ from their expectation by rounding only, which the order makes small
for all but the longest.

Edge cases: null text has size 0; null sources form one source, last in order; repeated rows are rows of their
own; sources without words, and empty tables, take nothing; input columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

WEIGHTS = (1, 2, 3)
#: No source, and no document, is taken more than so many times over.
MOST = 3
#: Seed of the offsets.
SEED = "mix 1"


def size_class(size: Column) -> Column:
    """Monotone in size: exact below 16, then 8 classes to each doubling. So a source has a few hundred classes at most."""
    bits = F.length(F.bin(size)) - 1
    return F.when(size < 16, size).otherwise(F.lit(8) * (bits - 2) + F.call_function("shiftright", size, bits - 3) - 8).cast("int")


def targets(groups: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target of each source, from rows (source, words).

    Sources in order of code point (null last) have the weights in turn. A source's target is the lower of
    ``most * source_size`` and ``level * weight``; the level is where the targets add up to all words, which is
    where resharing the excess ends. Sources are ordered by the level that fills them, and a running sum over
    them finds the level. This works on one row per source, never on documents.
    """
    total = groups.groupBy("source").agg(F.sum("words").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = total.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1))
    full = F.col("source_size") * most / F.col("__w")
    by_level = Window.orderBy(full, F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = weighed.select(
        "source", "source_size", "__w", full.alias("__full"),
        F.coalesce(F.sum(F.col("source_size") * most).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__filled"),
        F.sum("__w").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("__open"),
        F.sum("source_size").over(everything).alias("__all"),
    )
    # The level if this source and those after it are not full; the first for which that holds gives the level.
    leveled = summed.withColumn("__level", (F.col("__all") - F.col("__filled")) / F.col("__open"))
    level = F.min(F.when(F.col("__level") <= F.col("__full"), F.struct("__full", "__level"))).over(everything)["__level"]
    target = F.when(F.col("__full") <= level, F.col("source_size") * most).otherwise(level * F.col("__w")).cast("double")
    return leveled.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """A source's one offset, in [0, 1): 32 bits of a hash of seed and name."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + " "), F.coalesce(source.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def copies(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, rows: int | None = None) -> DataFrame:
    """(key, text_hash, source, size, source_size, target, copies) for every row of ``docs``.

    Texts are read once, for their sizes and hashes; the rest works on these small rows. Ranks run over (size class,
    group, size, key) within a source; ``shared.ranked`` spreads a source or a size that a third of all rows have.
    """
    folder = shared.work_dir(docs.sparkSession)
    number = F.pmod(F.col(key).cast("long"), F.lit(1 << 31)) if _integral(docs, key) else F.pmod(F.xxhash64(key), F.lit(1 << 31))
    read = docs.select(
        F.col(key).alias("__key"), F.col(source).alias("source"), shared.word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("text_hash"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("__octets"), F.coalesce(number, F.lit(0).cast("long")).alias("__number"),
    )
    sized = shared.materialize(read.select("*", size_class(F.col("size")).alias("__class")), folder, "sized")
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("words")), weights, most)
    ranked = shared.ranked(sized, ["source"], ["__class"], F.col("__number") + F.col("__octets"), ["size", "__key", "__octets", "text_hash"], folder, rows)
    known = ranked.alias("r").join(aims.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "t.source_size", "t.target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    passed = lambda rank: F.floor(rank * rate + offset(F.col("source"), seed))
    return known.select(F.col("__key").alias(key), "text_hash", "source", "size", "source_size", "target", (passed(F.col("__rank")) - passed(F.col("__rank") - 1)).cast("long").alias("copies"))


def _integral(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **settings) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as it is taken.

    Texts meet their copies in one join by key and text. Rows that share both also share their copies out: evenly,
    the rest to some of them.
    """
    folder = shared.work_dir(docs.sparkSession)
    own, hashed = docs.columns, F.xxhash64(F.col(text))
    taken = copies(docs, text, source, key, **settings).groupBy(F.col(key).alias("__key"), "text_hash").agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__alike"))
    wanted = shared.materialize(taken.where("__copies > 0"), folder, "wanted")
    met = docs.withColumn("__hash", hashed).join(wanted, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("text_hash")))
    single = met.where("__alike = 1").select(*own, "__copies")
    several = wanted.where("__alike > 1")
    if not several.isEmpty():
        alike = docs.withColumn("__hash", hashed).join(several, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("text_hash")))
        written = shared.materialize(alike.select(*own, "__key", "__hash", "__copies", "__alike", F.monotonically_increasing_id().alias("__number")), folder, "alike")
        ranked = shared.ranked(written, ["__key", "__hash"], [], F.col("__number"), ["__number"], shared.work_dir(docs.sparkSession))
        share = F.floor(F.col("__copies") / F.col("__alike")) + F.when(F.col("__rank") <= F.col("__copies") % F.col("__alike"), 1).otherwise(0)
        single = single.unionByName(ranked.select(*own, share.alias("__copies")))
    return single.select(*own, F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int"))).alias("__copy")).select(*own)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
