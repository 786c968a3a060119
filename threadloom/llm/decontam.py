"""Benchmark decontamination: a hash set of the test items' n-grams against every window of the training texts.

Words are runs of ASCII letters and digits and of non-ASCII characters, with A-Z lower-cased. A window is ten
consecutive words of an item; an item of fewer words (but not none) is one window. Every position of every
document is hashed and looked up; hits are verified word by word. Documents or just the hit spans can go.

Edge cases: null and empty texts have no words and no hits; repeated rows are each reported; items without
words, and an empty benchmark, hit nothing; null item ids are no items; other columns, whatever their names,
take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text that keeps its capitals.
CASED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
N = 10
#: Distinct windows up to which the set is broadcast: some 200 bytes each, for a window is sent without its items. A
#: larger set is joined by shuffle.
BROADCAST = 1_000_000


def words(text: Column) -> Column:
    """The words of a text; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(shared.ascii_lower(text), F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def _hash(array: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(array, at + k) for k in range(length)])


def window_items(benchmark: DataFrame, n: int = N, item: str = "item_id", text: str = "text") -> DataFrame:
    """(length, hash, window, item): which items hold which window, each pair once."""
    items = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    at = items.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda i: F.slice("w", i + 1, n))).alias("window"))
    hashed = F.coalesce(*[F.when(F.size("window") == k, _hash(F.col("window"), F.lit(0), k)) for k in range(1, n + 1)])
    return at.distinct().select(F.size("window").alias("length"), hashed.alias("hash"), "window", "item")


def item_windows(benchmark: DataFrame, n: int = N, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of the items: length, hash, words and kind. Windows that the same items hold are of one kind.

    A kind is a digest of the items' number, sum and exclusive or of hashes, so no list of items is ever put together
    for a window, however many items share it.
    """
    each = F.xxhash64("item")
    kind = F.md5(F.concat_ws(":", F.count(F.lit(1)), F.sum(each.cast("decimal(20,0)")), F.bit_xor(F.xxhash64(F.lit(1), "item"))))
    return window_items(benchmark, n, item, text).groupBy("length", "hash", "window").agg(kind.alias("kind"))


def find(docs: DataFrame, benchmark: DataFrame, n: int = N, key: str = "doc_id", text: str = "text", broadcast: int = BROADCAST) -> DataFrame:
    """(key, text_hash, n_words, n_rows, spans, kinds): one row for each distinct (key, text), hit or not.

    ``n_rows`` counts its repeated rows, ``spans`` has start and length of every verified window, ``kinds`` the windows'
    kinds. Each document sends one row of its own through the lookup besides those of its hits, so that one scan and
    one shuffle of such small rows do everything.
    """
    windows = item_windows(benchmark, n)
    sizes = [(r["length"], r["c"]) for r in windows.groupBy("length").agg(F.count(F.lit(1)).alias("c")).orderBy("length").collect()]  # n rows at most
    lengths, small = [k for k, _ in sizes], sum(c for _, c in sizes) <= broadcast
    read = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), words(F.col(text)).alias("w"))
    at = read.select("key", "text_hash", "w", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("at"))
    probes = [F.struct(F.lit(k).alias("length"), F.when((F.col("at") >= 0) & (F.col("at") + k <= F.size("w")), _hash(F.col("w"), F.col("at"), k)).alias("hash")) for k in lengths]
    if len(probes) == 1:
        probed = at.select("*", F.lit(lengths[0]).alias("length"), probes[0]["hash"].alias("hash"))
    elif probes:
        probed = at.select("*", F.explode(F.array(*probes)).alias("p")).select("key", "text_hash", "w", "at", "p.*")
        probed = probed.where(F.col("hash").isNotNull() | ((F.col("at") < 0) & (F.col("length") == lengths[0])))
    else:
        probed = at.where("at < 0").select("*", F.lit(0).alias("length"), F.lit(None).cast("long").alias("hash"))
    if small:
        # Within the broadcast join's code the words go along by reference.
        found = probed.join(F.broadcast(windows), ["length", "hash"], "left").where((F.col("at") < 0) | F.col("window").isNotNull())
    else:
        # A shuffle would copy the words for every place: places are looked up alone, and hits join their texts again.
        places = probed.where("at >= 0").select("key", "text_hash", "at", "length", "hash").join(windows, ["length", "hash"])
        hits = places.groupBy("key", "text_hash").agg(F.collect_set(F.struct("at", "length", "window", "kind")).alias("hits"))
        own = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("length"), F.lit(None).cast("array<string>").alias("window"), F.lit(None).cast("string").alias("kind")))
        joined = read.alias("r").join(hits.alias("h"), F.col("r.key").eqNullSafe(F.col("h.key")) & (F.col("r.text_hash") == F.col("h.text_hash")), "left")
        found = joined.select("r.key", "r.text_hash", "w", F.explode(F.when(F.col("hits").isNull(), own).otherwise(F.concat(own, "hits"))).alias("p")).select("key", "text_hash", "w", "p.*")
    kept = found.where((F.col("at") < 0) | (F.slice("w", F.col("at") + 1, F.col("length")) == F.col("window")))
    small_rows = kept.select("key", "text_hash", F.size("w").alias("n_words"), "at", F.when(F.col("at") >= 0, F.struct("at", "length")).alias("span"), F.when(F.col("at") >= 0, F.col("kind")).alias("kind"))
    return small_rows.groupBy("key", "text_hash", "n_words").agg(
        F.count_if(F.col("at") < 0).alias("n_rows"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
    )


def held_items(kinds: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """(kinds, items) for rows with an array ``kinds``: the sorted items that hold any of them, put together once for each distinct array."""
    pairs, windows = window_items(benchmark, n), item_windows(benchmark, n)
    # Any one window of a kind has the items of all of them.
    one = windows.groupBy("kind").agg(F.min(F.struct("length", "hash", "window")).alias("o")).select("kind", "o.*")
    of_kind = pairs.join(one, ["length", "hash", "window"]).select("kind", "item")
    asked = kinds.select("kinds").distinct().select("kinds", F.explode("kinds").alias("kind"))
    return asked.join(of_kind, "kind").groupBy("kinds").agg(F.array_sort(F.collect_set("item")).alias("items"))


def covered(spans: Column) -> Column:
    """Number of words inside any of the sorted spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(s["at"] + s["length"] - F.greatest(a["end"], s["at"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["at"] + s["length"]).alias("end"))
    return F.aggregate(spans, start, step, lambda a: a["n"].cast("long"))


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """One row for each row of ``docs``: key, n_words, n_hit, n_items, items_sha256, contaminated.

    Lists of items are put together, counted and digested once for each distinct set of kinds; texts get the figures only.
    """
    n = settings.get("n", N)
    folder = shared.work_dir(docs.sparkSession)
    found = shared.materialize(find(docs, benchmark, key=key, **settings), folder, "found")
    digests = held_items(found.where(F.size("kinds") > 0), benchmark, n).select("kinds", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    # Texts without a hit, nearly all, need no list and would be one key of the join.
    nothing = found.where(F.size("kinds") == 0).select("*", F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"))
    named = found.where(F.size("kinds") > 0).join(digests, "kinds").select(nothing.columns).unionByName(nothing)
    n_hit = covered(F.col("spans"))
    each = named.select("*", F.explode(F.array_repeat(F.lit(0), F.col("n_rows").cast("int"))).alias("__row"))
    return each.select(
        F.col("key").alias(key),
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        "n_items",
        "items_sha256",
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with hit words and what parts them cut out."""
    hits = find(docs, benchmark, key=key, text=text, **settings).where(F.size("spans") > 0).select("key", "text_hash", "spans")
    same = F.col(f"d.{key}").eqNullSafe(F.col("h.key")) & (F.xxhash64(F.col(f"d.{text}")) == F.col("h.text_hash"))
    if remove == "documents":
        return docs.alias("d").join(hits.alias("h"), same, "left_anti")
    if remove != "spans":
        raise ValueError("remove is documents or spans")
    joined = docs.alias("d").join(hits.alias("h"), same, "left")
    tokens = F.regexp_extract_all(F.col(f"d.{text}"), F.lit(CASED), F.lit(0))
    gaps = F.split(F.col(f"d.{text}"), CASED, -1)  # one more than words: before the first, between, after the last
    # Linear: positions of hit words, those of all others, and each of these words with the gap that follows it. Tokens
    # and gaps are named more than once below, so the optimizer keeps them as columns and doesn't repeat them by word.
    hit = F.flatten(F.transform(F.coalesce("h.spans", F.array().cast("array<struct<at:int,length:int>>")), lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))
    marked = joined.select(*[F.col(f"d.{c}").alias(f"d_{k}") for k, c in enumerate(docs.columns)], tokens.alias("__tokens"), gaps.alias("__gaps"), hit.alias("__hit"))
    every = F.when(F.size("__tokens") > 0, F.sequence(F.lit(0), F.size("__tokens") - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.transform(F.array_except(every, "__hit"), lambda i: F.concat(F.get("__tokens", i), F.get("__gaps", i + 1)))
    own = F.col(f"d_{docs.columns.index(text)}")
    cut = F.when(F.size("__hit") == 0, own).otherwise(F.concat(F.get("__gaps", F.lit(0)), F.array_join(kept, "")))
    return marked.select(*[(cut if c == text else F.col(f"d_{k}")).alias(c) for k, c in enumerate(docs.columns)])


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return report(shared.table(spark, sf_dir, "documents").select("doc_id", "text"), shared.table(spark, sf_dir, "benchmark").select("item_id", "text"))
