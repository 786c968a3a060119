"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index over them, and connected components.

A fingerprint has 64 bits; a bit is set if it is set in more than half of the hashes of the text's shingles.
Fingerprints that differ in at most three bits are linked. Copies share a fingerprint, so links are sought among
distinct fingerprints only, each with its smallest id.

The index: codes are sorted by Gray rank across the cluster, so that neighbours in that order share many bits, and
cut into ranges, which are written as tables. Above a range stands an upper node with the bits that all its codes
share; within it nodes factor out shared bits in the same way, down to single codes. A search for all links sends
each range's codes through the nodes of every range: pairs of ranges whose upper nodes differ in more than three
shared bits are pruned as a whole, and so is each group further down as soon as its accumulated differences pass
three. Codes are written once; a task reads the ranges that its pairs need. What it reports are links that span the
components of a pair rather than all pairs, so a large group of near copies doesn't grow quadratically.

Edge cases: a text without words (null, empty or white space) has fingerprint zero, linked like any other; fewer
words than a shingle count as one; null ids take part but are never a component's id unless there is no other;
repeated rows are each returned by ``cluster``, and ``dedupe`` keeps one row of a component, repeated rows included; an
empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, shared

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Codes of a range, and the most ranges: beyond their product ranges grow, up to some 100 MB each at 5e10 codes.
RANGE, RANGES = 8192, 4096
#: Children of a node of the index.
FAN = 8
#: Queries that go through the index together, and nodes that they may have reached before they are split up.
CHUNK, FRONTIER = 256, 2_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text, as an unsigned number."""
    if text is None:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, n, 65536):
        some = range(start, min(n, start + 65536))
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in some], dtype=np.uint64)
        counts += bit_counts(hashes)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set. Eight byte-wide counters are added at once, in runs of 255."""
    padded = np.zeros((len(hashes) + 254) // 255 * 255, dtype=np.uint64)
    padded[: len(hashes)] = hashes
    runs = padded.reshape(-1, 255)
    counts = np.zeros((8, 8), dtype=np.int64)  # byte, bit
    for bit in range(8):
        lanes = ((runs >> np.uint64(bit)) & np.uint64(0x0101010101010101)).sum(axis=1, dtype=np.uint64)
        counts[:, bit] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts.reshape(64)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])

    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the sequence of Gray codes."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Distinct codes in Gray order; each upper node has the bits that all below it share and no node above it has.

    A search adds up differences in those bits on its way down, and leaves a whole group as soon as the sum
    passes the distance. Levels are arrays, so that many queries go down together.
    """

    def __init__(self, codes: np.ndarray, fan: int = FAN):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        self.fan = fan
        every = np.uint64(0xFFFFFFFFFFFFFFFF)
        masks, values = [np.full(len(codes), every)], [self.codes]  # from the leaves up: shared bits, and their values
        while len(values[-1]) > 1:
            starts = np.arange(0, len(values[-1]), fan)
            ones = np.bitwise_and.reduceat(values[-1] & masks[-1], starts)
            zeros = np.bitwise_and.reduceat(~values[-1] & masks[-1], starts)
            masks.append(ones | zeros)
            values.append(ones)
        self.levels = []  # from the root down: bits first fixed at a node, and their values
        for k in range(len(masks) - 1, -1, -1):
            own = masks[k] if k == len(masks) - 1 else masks[k] & ~np.repeat(masks[k + 1], fan)[: len(masks[k])]
            self.levels.append((own, values[k] & own))

    def search(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(query position, code position) of all pairs within the distance."""
        return self._down(np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64), np.zeros(len(queries), dtype=np.uint8), queries, distance, 0)

    def _down(self, q, node, so_far, queries, distance, depth):
        while depth < len(self.levels):
            if len(q) > FRONTIER:  # bounds memory where many codes are near each other
                half = len(q) // 2
                parts = [self._down(q[at], node[at], so_far[at], queries, distance, depth) for at in (slice(half), slice(half, None))]
                return np.concatenate([parts[0][0], parts[1][0]]), np.concatenate([parts[0][1], parts[1][1]])
            mask, value = self.levels[depth]
            if depth:
                width = np.minimum(self.fan, len(mask) - node * self.fan)
                q, so_far, node = np.repeat(q, width), np.repeat(so_far, width), np.repeat(node * self.fan, width) + _counting(width)
            so_far = so_far + np.bitwise_count((queries[q] ^ value[node]) & mask[node])
            near = so_far <= distance
            q, node, so_far = q[near], node[near], so_far[near]
            depth += 1
        return q, node


def _counting(widths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of runs of the given widths."""
    ends = np.cumsum(widths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - widths, widths)


def spanning_links(codes: np.ndarray, index: GrayIndex, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that join ``codes`` and those of the index just as all pairs within the distance do: fewer than codes."""
    every, at = np.unique(np.concatenate([codes, index.codes]), return_inverse=True)  # a code may stand on both sides
    mine, theirs = at[: len(codes)], at[len(codes) :]
    root = np.arange(len(every))
    a, b = [], []
    for start in range(0, len(codes), CHUNK):
        q, found = index.search(codes[start : start + CHUNK], distance)
        q, found = mine[q + start], theirs[found]
        while True:
            apart = root[q] != root[found]
            if not apart.any():
                break
            q, found = q[apart], found[apart]
            low, high = np.minimum(root[q], root[found]), np.maximum(root[q], root[found])
            high, first = np.unique(high, return_index=True)  # each root joins one lower root a round
            a.append(every[q[first]])
            b.append(every[found[first]])
            root[high] = low[first]
            while not np.array_equal(up := root[root], root):
                root = up
    none = codes[:0]
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def near_ranges(nodes: list[tuple[int, int, int]], distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Pairs of ranges that their upper nodes, (range, AND of its codes, OR of its codes), don't prune: the first not after the second."""
    names = np.array([n[0] for n in nodes], dtype=np.int64)
    ones, any_one = (np.array([n[k] for n in nodes], dtype=np.int64).view(np.uint64) for k in (1, 2))
    shared_bits = ones | ~any_one
    out = []
    for k in range(len(nodes)):
        near = np.bitwise_count((ones[k] ^ ones[k:]) & shared_bits[k] & shared_bits[k:]) <= distance
        out += [(int(names[k]), int(j)) for j in names[k:][near]]
    return out


def _search_ranges(folder: str, distance: int):
    def codes_of(number: int) -> np.ndarray:
        files, base = shared.open_folder(folder)
        return pq.read_table(f"{base}/range={number}", columns=["fp"], filesystem=files, partitioning=None)["fp"].to_numpy().view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, others in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = codes_of(number)
                for other in others:
                    x, y = spanning_links(mine, GrayIndex(mine if other == number else codes_of(other)), distance)
                    yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in (x, y)], ["a", "b"])

    return run


def gray_order(code):
    """Gray rank of a code as a column; unsigned order but for the first bit, which is as good."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def links(codes: DataFrame, folder: str, codes_a_range: int = RANGE, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that connect distinct codes (column fp) just as all pairs within the distance do.

    Codes are shuffled once, into Gray order. The driver sees the upper nodes, ``RANGES`` rows at most, and no code.
    """
    spark = codes.sparkSession
    count = codes.count()
    ranges = max(1, min(RANGES, math.ceil(count / codes_a_range)))
    ordered = codes.select("fp").repartitionByRange(ranges, gray_order(F.col("fp"))).select("fp", F.spark_partition_id().alias("range"))
    ordered.write.mode("overwrite").partitionBy("range").parquet(f"{folder}/ranges")
    written = spark.read.schema("fp long, range int").parquet(f"{folder}/ranges")
    nodes = written.groupBy("range").agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("any")).orderBy("range").collect()
    of: dict[int, list[int]] = {}
    for i, j in near_ranges([tuple(n) for n in nodes], distance):
        of.setdefault(i, []).append(j)
    work = [(i, js[k : k + 4]) for i, js in of.items() for k in range(0, len(js), 4)]  # a unit of work: one range against four
    units = spark.createDataFrame(work, "range int, others array<int>").repartition(max(1, min(len(work), 16 * RANGES)), F.col("range"), F.col("others"))
    return units.mapInArrow(_search_ranges(f"{folder}/ranges", distance), "a long, b long")


def _rooted(codes: DataFrame, folder: str, distance: int) -> DataFrame:
    """(fp, least, root): the distinct codes, each with the least fingerprint of its component."""
    stars = shared.materialize(components.connected(links(codes, folder, distance=distance), folder), folder, "stars")
    return codes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    folder = shared.work_dir(docs.sparkSession)
    prints = shared.materialize(fingerprints(docs, key, text, shingle), folder, "fingerprints")
    codes = shared.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), folder, "codes")
    rooted = _rooted(codes, folder, distance)
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with exactly one row of each component: that with the smallest id (none comes last), then text hash.

    Rows that agree in both are counted, and only those are compared as a whole, by a hash of all columns. The rest
    is told apart by (id, text hash), so a text stays though its id repeats with another text.
    """
    folder = shared.work_dir(docs.sparkSession)
    ids, hashed = F.col(key).cast("long"), F.xxhash64(F.col(text))
    rows = docs.select(ids.alias("doc_id"), F.col(text).alias("text"), hashed.alias("text_hash"))
    prints = rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long, text_hash long")
    pieces = shared.materialize(prints.groupBy("fp", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")), folder, "pieces")
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    codes = shared.materialize(pieces.groupBy("fp").agg(F.min(own).alias("least")), folder, "codes")
    rooted = _rooted(codes, folder, distance)
    kept = rooted.groupBy("root").agg(F.min("least").alias("kept"))
    chosen = rooted.join(kept, "root").select("fp", "kept")
    same = F.col("kept.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("kept.text_hash") == F.col("text_hash"))
    marked = pieces.join(chosen, "fp").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "n", same.alias("stays"))
    gone = shared.materialize(marked.where(~F.col("stays") | (F.col("n") > 1)), folder, "gone")
    at = ids.eqNullSafe(F.col("__id")) & (hashed == F.col("__hash"))
    single = docs.join(gone, at, "left_anti")
    repeated = gone.where("stays")
    if repeated.isEmpty():
        return single
    copies = docs.join(repeated, at, "left_semi").groupBy(ids.alias("__id"), hashed.alias("__hash"))
    one = copies.agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return single.unionByName(one)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = cluster(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
