"""Helpers that several operators share: table access, the shared work folder, text expressions."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local master may run without that setting; it then gets a temporary folder, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="threadloom-")
            spark.sparkContext.setCheckpointDir(base)
        base = base if "://" in base or base.startswith("file:") else "file://" + base
    return f"{base.rstrip('/')}/threadloom-{uuid.uuid4().hex}"


def materialize(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in a shared folder and read it back: cuts lineage, survives lost executors."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a folder's URI names, and the folder's path there, for Python workers."""
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. An all-ASCII text takes the faster built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Rows of small tables (some 50 bytes each) up to which they are broadcast.
BROADCAST = 1_000_000


def rows_a_group(n: int) -> int:
    """How many of ``n`` rows are numbered together: grows with the root, between 500 and 100,000."""
    return min(100_000, max(500, math.floor(4 * math.sqrt(n))))


def ranked(df: DataFrame, part: list[str], tiers: list[str], spread: Column, order: list[str], folder: str, rows: int | None = None) -> DataFrame:
    """Adds ``__rank``: 1, 2, ... without gaps within each value of ``part`` (null is one), in the order of ``tiers``.

    No value is sorted in one task. Rows of a (part, tiers) are dealt into groups, as many as their count asks for, by
    ``spread``, a long; groups are numbered each by itself, in the order of ``order``, from offsets that a running sum
    over counts gives. If rows agree so much that a group gets far too large all the same, rows are written with
    numbers of their own, and these deal them out. Tables of counts are written to ``folder``, so that ``df`` is
    read no more often than for the counts and for the rows.
    """
    by = [*part, *tiers]

    def meet(left: DataFrame, right: DataFrame, on: list[str], small: bool) -> DataFrame:
        right = right.select(*[F.col(c).alias(f"__on_{k}") for k, c in enumerate(on)], *[c for c in right.columns if c not in on])
        same = F.lit(True)
        for k, c in enumerate(on):
            same = same & left[c].eqNullSafe(right[f"__on_{k}"])
        return left.join(F.broadcast(right) if small else right, same).drop(*[f"__on_{k}" for k in range(len(on))])

    counts = materialize(df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")), folder, "counts")
    seen = counts.agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("c")).first()
    rows = rows or rows_a_group(seen["n"] or 0)
    small = seen["c"] + (seen["n"] or 0) / rows <= BROADCAST
    groups = counts.select(*by, F.greatest(F.ceil(F.col("__n") / rows), F.lit(1)).alias("__groups"))

    def dealt(table: DataFrame, by_what: Column) -> DataFrame:
        return meet(table, groups, by, small).withColumn("__group", F.pmod(by_what, F.col("__groups"))).drop("__groups")

    grouped = dealt(df, spread)
    sizes = materialize(grouped.groupBy(*by, "__group").agg(F.count(F.lit(1)).alias("__n")), folder, "groups")
    if not sizes.where(F.col("__n") > 4 * rows).isEmpty():
        written = materialize(df.withColumn("__row", F.monotonically_increasing_id()), folder, "rows")
        grouped = dealt(written, F.xxhash64("__row"))
        sizes = materialize(grouped.groupBy(*by, "__group").agg(F.count(F.lit(1)).alias("__n")), folder, "regroups")
        grouped = grouped.drop("__row")
    before = Window.partitionBy(*part).orderBy(*tiers, "__group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy(*by, "__group").orderBy(*order)
    return meet(grouped, offsets, [*by, "__group"], small).withColumn("__rank", F.col("__offset") + F.row_number().over(within)).drop("__group", "__offset")


def names_free(df: DataFrame, *names: str) -> DataFrame:
    """Drops columns of the input that an operator is about to add under the same names."""
    return df.drop(*[c for c in df.columns if c in names])
