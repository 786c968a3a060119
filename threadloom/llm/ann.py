"""Approximate nearest neighbours by inner product, with randomly rotated one-bit codes.

Index: vectors belong to cells around centres, which come from a bounded sample. A vector's residual from its centre is
rotated by a random orthogonal matrix; the signs of the result, packed into bits, are its code. Two scalars correct
it: the residual's length and the inner product of the unit residual with its code. Every vector is indexed.

Search: a query's rotated components are rounded to ``PLANES`` bits each, and the inner product with a code is
estimated from counts of common bits, one count for each plane. An error bound holds with high probability; a
candidate whose upper bound stays below the score of the k-th best so far is left out, and all others are scored
again from the original vectors, in double precision, summed in order. Vectors are scaled by powers of two for all
estimates, so that no finite number overflows there.

A query visits the cells whose centres have the largest inner products with it. How many is measured, not assumed: for
``CALIBRATION`` queries the exact neighbours among all vectors are found in one pass, and as many cells are visited as
hold ``recall`` of them (and k candidates at least). Data without clusters need many; ``recall=1`` visits all.

The index is a table in the shared folder, a folder a cell. Queries are dealt into groups whose best cells lie near each
other; a group's task reads the cells that its queries visit, block by block, and what it found so far raises the
bound for what is still to come. It returns k + 1 ids a query, whatever the number of vectors: neither vectors nor
results are multiplied in a shuffle.

Skew: of equal vectors only those with the k + 1 smallest ids can be among anyone's k nearest, so others aren't searched,
which loses nothing; equal queries are searched once and answered each; a cell of any size is read in blocks, and
queries that share a best cell are cut into groups.

Edge cases: vectors that are null, empty, zero or hold null or non-finite numbers take no part, nor do rows without
id, nor those whose number of dimensions is not the table's most frequent one (ties: the smaller). A query's own id is
never its neighbour. Query rows that repeat an id are each answered; candidate rows that do all count. Ties go to the
smaller id; scores beyond the range of doubles are infinite; fewer candidates than k give them all; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset as ds
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

K = 20
#: Vectors of a cell on average, the most numbers in the centres of all cells, and sampled vectors for each centre.
CELL, CENTRES, PER_CENTRE = 4096, 1 << 21, 8
#: Candidates that are read at once, and queries that go through the cells together.
CANDIDATES, QUERIES = 8192, 512
#: Queries whose exact neighbours tell how many cells to visit, and the share of these that visited cells must hold.
CALIBRATION, RECALL = 128, 0.97
#: Bits of a query's rounded component.
PLANES = 4
#: Width of the error bound in standard deviations: 4 leaves out a true neighbour about once in 30,000.
WIDTH = 4.0
SEED = 20240229


def takes_part(vector: Column) -> Column:
    """True if there is no null, nan or infinite component, and one that isn't zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: F.coalesce(bad(x), F.lit(True))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centres: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits (64 to a number), residual lengths, and inner products of the unit residuals with their codes."""
    residual = vectors - centres
    length = np.linalg.norm(residual, axis=1)
    unit = (residual / np.where(length > 0, length, 1)[:, None]) @ turn.T
    fit = np.abs(unit).sum(axis=1) / math.sqrt(vectors.shape[1])
    return pack(unit > 0), length, fit


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit numbers."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def common_bits(codes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Number of bits that each code has in common with one row of bits."""
    counts = np.bitwise_count(codes[:, 0] & bits[0]).astype(np.int64)
    for k in range(1, codes.shape[1]):
        counts += np.bitwise_count(codes[:, k] & bits[k])
    return counts


class Block:
    """Codes and vectors of a block of one cell, searched for one query at a time. All but ``exact`` is scaled."""

    def __init__(self, ids, exact, codes, length, fit, centre, turn, power: int = 0, width: float = WIDTH):
        scaled, dims = np.ldexp(exact, -power), exact.shape[1]
        self.power, self.ids, self.exact, self.scaled, self.codes, self.centre, self.turn, self.width, self.dims = power, ids, exact, scaled, codes, centre, turn, width, dims
        usable = fit > 0
        safe = np.where(usable, fit, 1)
        self.scale = np.where(usable, length / safe / math.sqrt(dims), 0)
        self.spread = np.where(usable, length * np.sqrt(np.maximum(0, 1 - fit**2)) / safe * width / math.sqrt(max(1, dims - 1)), 0)
        self.ones = common_bits(codes, np.full(codes.shape[1], ~np.uint64(0)))
        self.longest = float(np.linalg.norm(scaled, axis=1).max()) if len(ids) else 0.0
        self.repeats = len(np.unique(ids)) < len(ids)

    def bounds(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products with a scaled query, from packed bits, and how far off they may be."""
        turned = self.turn @ query
        low = turned.min()
        step = (turned.max() - low) / ((1 << PLANES) - 1)
        levels = np.rint((turned - low) / step).astype(np.int64) if step > 0 else np.zeros(self.dims, dtype=np.int64)
        planes = pack(((levels[None, :] >> np.arange(PLANES)[:, None]) & 1).astype(bool))
        counted = sum(common_bits(self.codes, plane) << j for j, plane in enumerate(planes))
        signed = 2 * (low * self.ones + step * counted) - (low * self.dims + step * levels.sum())
        rounding = self.width * step * math.sqrt(self.dims / 12) * self.scale
        return query @ self.centre + self.scale * signed, np.linalg.norm(query) * self.spread + rounding

    def reach(self, scaled_query: np.ndarray, k: int, least: float) -> np.ndarray:
        """Positions of all rows that may be among the k + 1 best ids, if a scaled score below ``least`` can't be."""
        first = np.arange(len(self.ids))
        room = 1e-10 * np.linalg.norm(scaled_query) * self.longest  # what rounding may take
        if len(first) <= k + 1 and least == -np.inf:
            return first
        estimate, off = self.bounds(scaled_query)
        if len(first) > k + 1 and not self.repeats:
            # The most promising are scored; what can't reach the least of them is left out.
            promising = np.argpartition(estimate, -k - 1)[-k - 1 :]
            least = max(least, (self.scaled[promising] @ scaled_query).min())
        first = np.flatnonzero(estimate + off >= least - room)
        scores = self.scaled[first] @ scaled_query
        if len(first) > k + 1 and not self.repeats:
            least = max(least, np.partition(scores, -k - 1)[-k - 1])
        # Only what rounding could bring among the best is summed in the order that the result is defined by.
        return first[scores >= least - room]


class Best:
    """The rows of the k + 1 best ids of one query so far: enough for k whichever id is the query's own."""

    def __init__(self, query: np.ndarray, scaled: np.ndarray, k: int):
        self.query, self.scaled, self.k = query, scaled, k
        self.ids, self.scores, self.least = np.empty(0, dtype=np.int64), np.empty(0), -np.inf

    def meet(self, block: Block) -> None:
        first = block.reach(self.scaled, self.k, self.least)
        if not len(first):
            return
        ids = np.concatenate([self.ids, block.ids[first]])
        scores = np.concatenate([self.scores, exact_scores(self.query, block.exact[first])])
        order = np.lexsort((ids, -scores))
        ids, scores = ids[order], scores[order]
        new = np.zeros(len(ids), dtype=bool)
        new[np.unique(ids, return_index=True)[1]] = True
        seen = np.cumsum(new)
        self.ids, self.scores = ids[seen <= self.k + 1], scores[seen <= self.k + 1]
        if seen[-1] > self.k:  # in the units of scaled scores, which never overflow
            worst = self.scores[-1]
            self.least = float(np.ldexp(worst, self.shift(block.power))) if np.isfinite(worst) else -np.inf

    def shift(self, power: int) -> int:
        """Power of two between exact and scaled scores."""
        return -power - int(np.frexp(np.abs(self.query).max())[1])


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    total = np.zeros(len(vectors))
    with np.errstate(over="ignore", invalid="ignore"):
        for q, column in zip(query, vectors.T, strict=True):
            total += q * column
    return total


def find_centres(sample: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Centres by Lloyd's rounds over a sample, from evenly spaced rows; a centre without vectors stays where it is."""
    centres = sample[np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(np.int64)].copy()
    for _ in range(rounds):
        mine = np.concatenate([nearest_centre(sample[i : i + 4096], centres) for i in range(0, len(sample), 4096)])
        sizes = np.bincount(mine, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, sample)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(1, sizes)[:, None], centres)
    return centres


def nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(vectors @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)


def visiting_order(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argsort(-(queries @ centres.T), axis=1, kind="stable")


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _unit(queries: np.ndarray) -> np.ndarray:
    """Each query scaled by a power of two of its own: that changes no order."""
    return np.ldexp(queries, -np.frexp(np.abs(queries).max(axis=1, initial=0))[1][:, None])


def _useful(table: DataFrame, k: int) -> DataFrame:
    """Rows that can be among anyone's k nearest: of equal vectors those of the k + 1 smallest ids, k rows of each at most."""
    hashed = F.xxhash64("vector")
    often = table.groupBy(hashed.alias("h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("h")
    if often.isEmpty():
        return table
    repeated = table.join(often, hashed == F.col("h"), "left_semi")
    ids = repeated.withColumn("__r", F.row_number().over(Window.partitionBy("vector", "vec_id").orderBy("vec_id"))).where(F.col("__r") <= k)
    least = ids.withColumn("__d", F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("__d") <= k + 1)
    return table.join(often, hashed == F.col("h"), "left_anti").unionByName(least.select(table.columns))


def nearest(vectors: DataFrame, queries: Column, k: int = K, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL, cell: int = CELL, block: int = CANDIDATES, group: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row that ``queries`` selects."""
    spark, folder = vectors.sparkSession, shared.work_dir(vectors.sparkSession)
    # Single-precision vectors travel as they are; all arithmetic on them is in double precision.
    kind = vectors.schema[vector].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    valid = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asked")).where(takes_part(F.col("vector")) & F.col("vec_id").isNotNull())
    largest = F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))))
    sizes = valid.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"), largest.alias("most")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dims, n, power = sizes["d"], sizes["n"], int(np.frexp(sizes["most"])[1])
    valid = valid.where(F.size("vector") == dims)

    # Centres, from a sample that their number bounds.
    count = max(1, min(math.ceil(n / cell), CENTRES // dims))
    wanted = PER_CENTRE * count
    hashed = F.xxhash64("vector")
    sample = valid.select("vector", hashed.alias("h")).where(F.pmod("h", F.lit(max(1, n // (2 * wanted)))) == 0).dropDuplicates(["h"]).orderBy("h").limit(wanted)
    centres = find_centres(np.ldexp(np.array([r["vector"] for r in sample.collect()], dtype=np.float64), -power), count)
    shipped = spark.sparkContext.broadcast(centres)  # ``CENTRES`` numbers at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dims)
        for batch in batches:
            scaled = np.ldexp(_matrix(batch.column(1), dims), -power)
            mine = nearest_centre(scaled, shipped.value)
            codes, length, fit = encode(scaled, shipped.value[mine], turn)
            columns = [pa.array(mine, pa.int32()), batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(fit)]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "vec_id", "vector", "code", "length", "fit"])

    kinds = f"cell int, vec_id long, vector {kind}, code binary, length double, fit double"
    coded = _useful(valid.select("vec_id", "vector"), k).mapInArrow(assign, kinds)
    # A cell's rows come together, and those of a large one are split up again, as far as sizes ask for.
    coded.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/index")
    index = spark.read.schema(kinds).parquet(f"{folder}/index").select("cell", "vec_id", "vector")
    sizes_of = np.zeros(len(centres), dtype=np.int64)
    for r in index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each centre
        sizes_of[r["cell"]] = r["n"]

    # Query rows, and the distinct vectors that are searched for.
    rows = shared.materialize(valid.where("asked").select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").alias("query_id"), "vector"), folder, "rows")
    asked = shared.materialize(rows.groupBy("vector").agg(F.min("row").alias("qid")).select("qid", "vector"), folder, "asked")
    visits = _visits(index, asked, centres, sizes_of, dims, power, k, recall)

    def cells_of(found: np.ndarray) -> list[np.ndarray]:
        order = visiting_order(_unit(found), shipped.value)
        enough = (np.cumsum(sizes_of[order], axis=1) > k).argmax(axis=1) if sizes_of.sum() > k else np.full(len(order), len(sizes_of))
        return [o[: max(visits, int(e) + 1)] for o, e in zip(order, enough, strict=True)]

    def first_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.argsort(_line_up(shipped.value))
        for batch in batches:
            best = np.argmax(_unit(_matrix(batch.column(1), dims)) @ shipped.value.T, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place[best], pa.int32())], ["qid", "vector", "place"])

    def blocks_of(cell: int, turn: np.ndarray) -> Iterator[Block]:
        files, base = shared.open_folder(f"{folder}/index")
        for batch in ds.dataset(f"{base}/cell={cell}", format="parquet", filesystem=files, partitioning=None).to_batches(columns=["vec_id", "vector", "code", "length", "fit"], batch_size=block, batch_readahead=1, fragment_readahead=1, use_threads=False):
            if batch.num_rows:
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1)
                yield Block(batch.column(0).to_numpy(), _matrix(batch.column(1), dims), codes, batch.column(3).to_numpy(), batch.column(4).to_numpy(), shipped.value[cell], turn, power)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dims)
        for batch in batches:
            for start in range(0, batch.num_rows, group):
                part = batch.slice(start, group)
                queries = _matrix(part.column(1), dims)
                scaled, visiting = _unit(queries), cells_of(queries)
                found = [Best(q, u, k) for q, u in zip(queries, scaled, strict=True)]
                asking: dict[int, list[int]] = {}
                for i, cells in enumerate(visiting):
                    for c in cells:
                        asking.setdefault(int(c), []).append(i)
                # The cells that promise most to the group come first, so that later ones meet high bounds.
                promise = scaled.mean(axis=0) @ shipped.value.T
                for c in sorted((c for c in asking if sizes_of[c]), key=lambda c: (-promise[c], c)):
                    for some in blocks_of(c, turn):
                        for i in asking[c]:
                            found[i].meet(some)
                qids = np.repeat(part.column(0).to_numpy(), [len(f.ids) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(qids), pa.array(np.concatenate([f.ids for f in found])), pa.array(np.concatenate([f.scores for f in found]))], ["qid", "vec_id", "score"])

    groups = max(1, math.ceil(asked.count() / group))
    dealt = asked.mapInArrow(first_cell, f"qid long, vector {kind}, place int").repartitionByRange(groups, "place", "qid")
    near = dealt.select("qid", "vector").mapInArrow(search, "qid long, vec_id long, score double")
    named = rows.join(asked, "vector").select("row", "query_id", "qid")
    answers = named.join(near, "qid").where(F.col("vec_id") != F.col("query_id"))
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _line_up(centres: np.ndarray) -> np.ndarray:
    """An order of the centres in which those that stand near each other follow each other, roughly."""
    coarse = find_centres(centres, math.ceil(math.sqrt(len(centres))), rounds=2)
    return np.lexsort((centres[:, 0], nearest_centre(centres, coarse)))


def _visits(index: DataFrame, asked: DataFrame, centres: np.ndarray, sizes_of: np.ndarray, dims: int, power: int, k: int, recall: float) -> int:
    """How many cells hold the wanted share of the exact neighbours of a bounded sample of the queries."""
    if recall >= 1 or len(centres) == 1:
        return len(centres)
    few = asked.orderBy(F.xxhash64("vector"), "qid").limit(CALIBRATION).collect()
    if not few:
        return 1
    queries = _unit(np.array([r["vector"] for r in few], dtype=np.float64))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, cells = np.empty((len(queries), 0)), np.empty((len(queries), 0), dtype=np.int32)
        for batch in batches:
            now = np.concatenate([scores, queries @ np.ldexp(_matrix(batch.column(1), dims), -power).T], axis=1)
            mine = np.concatenate([cells, np.tile(batch.column(0).to_numpy(), (len(queries), 1))], axis=1)
            top = np.argsort(-now, axis=1, kind="stable")[:, : k + 1]
            scores, cells = np.take_along_axis(now, top, axis=1), np.take_along_axis(mine, top, axis=1)
        at = np.repeat(np.arange(len(queries)), scores.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(cells.ravel(), pa.int32()), pa.array(scores.ravel())], ["at", "cell", "score"])

    found = index.select("cell", "vector").mapInArrow(best, "at int, cell int, score double")
    top = found.withColumn("__r", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), "cell"))).where(F.col("__r") <= k + 1).select("at", "cell").collect()
    place = np.argsort(visiting_order(queries, centres), axis=1)
    depth = np.sort([int(place[r["at"], r["cell"]]) for r in top])  # k + 1 for each of the sample
    return int(depth[min(len(depth) - 1, math.ceil(recall * len(depth)))]) + 1


def op6_ann(spark, sf_dir: str) -> DataFrame:
    vectors = shared.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 20 == 0)
