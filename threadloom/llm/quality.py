"""Quality classifier: ordinal cumulative-link regression on graded ratings, over hashed text features.

Grades are ordered, 0 to ``grades - 1``. One weight vector gives a text its score; ordered thresholds part the score
into grades: P(grade >= k) = sigmoid(score - threshold_k). The expected grade is the sum of these tail probabilities,
and a tail probability selects. Features are hashed: words by presence, so that one telling word counts in a text of
any length, and shares of token shapes, so that style counts whatever the length.

Training maximises the cumulative-link likelihood, P(grade = k) = P(grade >= k) - P(grade >= k + 1), on a bounded,
deterministic sample of labelled rows (``ROWS`` in expectation, twice that at most, in the order of a hash); each of
them is read whole, and so is every text that is scored.

Edge cases: null and empty texts have no features, get the grade that the thresholds alone give, and are never
kept; rows without label aren't learned from; a grade that no learned row has keeps its place on the scale; without any
label, or with one grade only, every text with a word is kept; repeated rows are each scored, and learned from once;
input columns named like an added one are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Labelled rows to learn from, in expectation.
ROWS = 6000
#: Grades of the scale.
GRADES = 3
#: Hash space of words.
BITS = 16
#: Words of fewer training texts than this have no weight.
RARE = 4
EPOCHS, RATE, DECAY, SPARSE = 150, 0.5, 2e-4, 1e-3
#: Least distance of two thresholds: below it a grade would have no probability.
GAP = 1e-3
#: A text is kept if the probability of the highest grade is this at least.
KEEP = 0.5
ADDED = ("expected_grade", "p_tail", "p_top", "keep")

SHAPES = 12


@dataclass
class Model:
    """Weights of words, then of shapes; increasing thresholds, one less than grades."""

    words: np.ndarray
    shapes: np.ndarray
    thresholds: np.ndarray

    def score(self, features: tuple[np.ndarray, np.ndarray]) -> float:
        return float(self.words[features[0]].sum() + self.shapes @ features[1])

    def tails(self, score: float) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -40, 40)))


_EDGES = re.compile(r"^[^\w]+|[^\w]+$")
_SHAPE_CACHE: dict[str, tuple[tuple[int, ...], int]] = {}
_TAIL = re.compile(r"[^\w]+$")


def _hash(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def _token(token: str) -> tuple[tuple[int, ...], int]:
    """Hashed features and shape of a token.

    Hashed are the word, without punctuation at its ends and lower-cased, and the marks at its end, if any. Shapes are
    how a token ends, if in a symbol or a mark that ends no clause, else how its letters and digits look.
    """
    bare = _EDGES.sub("", token)
    tail = _TAIL.search(token)
    last = unicodedata.category(token[-1])
    if not bare:
        shape = 0
    elif last[0] == "S":
        shape = 1
    elif tail and token[-1] not in ".,;:?\"'" and last not in ("Pe", "Pf"):
        shape = 2
    elif any(c.isdigit() for c in bare):
        shape = 4 if bare.isdigit() else 5
    elif len(bare) > 1 and bare.isupper():
        shape = 6
    elif "http" in bare or "@" in bare or "/" in bare:
        shape = 7
    elif bare[0].isupper():
        shape = 8
    else:
        shape = 9
    return (_hash(bare.lower()),) + ((_hash("\0" + tail[0]),) if tail and bare else ()), shape


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words, and shares of shapes (the last two: share of distinct tokens, log of their number)."""
    tokens = (text or "").split()
    shapes = np.zeros(SHAPES)
    if not tokens:
        return np.empty(0, dtype=np.int64), shapes
    counts: dict[str, int] = {}
    for t in tokens:
        counts[t] = counts.get(t, 0) + 1
    ids = set()
    for t, n in counts.items():
        found = _SHAPE_CACHE.get(t)
        if found is None:
            if len(_SHAPE_CACHE) > 200_000:
                _SHAPE_CACHE.clear()
            found = _SHAPE_CACHE[t] = _token(t)
        ids.update(found[0])
        shapes[found[1]] += n
    shapes[:10] /= len(tokens)
    shapes[10] = len(counts) / len(tokens)
    shapes[11] = np.log1p(len(tokens)) / 10
    return np.fromiter(ids, dtype=np.int64, count=len(ids)), shapes


def likelihood(scores: np.ndarray, y: np.ndarray, thresholds: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log-likelihood of grades ``y`` under cumulative links, and its gradients by each score and each threshold."""
    n, top = len(y), len(thresholds)
    tails = 1 / (1 + np.exp(np.clip(thresholds[None, :] - scores[:, None], -40, 40)))
    tails = np.concatenate([np.ones((n, 1)), tails, np.zeros((n, 1))], axis=1)  # P(grade >= 0), ..., P(grade >= top + 1)
    at = np.arange(n)
    above, below = tails[at, y], tails[at, y + 1]
    p = np.maximum(above - below, 1e-12)
    by_threshold = np.zeros((n, top + 2))
    by_threshold[at, y] -= above * (1 - above) / p
    by_threshold[at, y + 1] += below * (1 - below) / p
    return float(np.log(p).mean()), (1 - above - below) / n, by_threshold[:, 1 : top + 1].sum(axis=0) / n


def _apart(thresholds: np.ndarray) -> np.ndarray:
    """In order, and at least ``GAP`` from each other."""
    steps = GAP * np.arange(len(thresholds))
    return np.maximum.accumulate(thresholds - steps) + steps


def train(texts: list[str | None], grades: list[int], epochs: int = EPOCHS, scale: int = GRADES) -> Model:
    """Maximum likelihood with Adagrad over all rows at once; the same sample gives the same model."""
    y = np.array(grades, dtype=np.int64)
    if len(set(grades)) < 2:
        return Model(np.zeros(1 << BITS), np.zeros(SHAPES), np.zeros(0))
    if y.min() < 0 or y.max() >= scale:
        raise ValueError(f"grades must be from 0 to {scale - 1}")
    rows = [features(t) for t in texts]
    n = len(rows)
    words, thresholds = np.zeros(1 << BITS), np.linspace(-1, 1, scale - 1) if scale > 2 else np.zeros(1)
    at = np.repeat(np.arange(n), [len(r[0]) for r in rows])
    ids = np.concatenate([r[0] for r in rows])
    spread = np.bincount(ids, minlength=1 << BITS)
    use = spread[ids] >= RARE
    at, ids = at[use], ids[use]
    shape = np.stack([r[1] for r in rows])
    mean, width = shape.mean(axis=0), shape.std(axis=0) + 1e-6
    standard = (shape - mean) / width
    ws = np.zeros(SHAPES)
    sums = [np.full_like(x, 1e-8) for x in (words, ws, thresholds)]
    for _ in range(epochs):
        score = np.bincount(at, weights=words[ids], minlength=n) + standard @ ws
        _, each, by_threshold = likelihood(score, y, thresholds)
        steps = (np.bincount(ids, weights=each[at], minlength=1 << BITS), standard.T @ each - DECAY * ws, by_threshold)
        for value, step, total in zip((words, ws, thresholds), steps, sums, strict=True):
            total += step**2
            value += RATE * step / np.sqrt(total)
        # Words whose gradient stays within the noise of a few texts keep no weight.
        words = np.sign(words) * np.maximum(0, np.abs(words) - RATE * SPARSE / np.sqrt(sums[0]))
        thresholds = _apart(thresholds)
    return Model(words, ws / width, thresholds + float(mean @ (ws / width)))


def fit(docs: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "grade", rows: int = ROWS, scale: int = GRADES) -> Model:
    """Learns from texts whose key has a rating. Of repeated ratings the lowest counts."""
    rated = ratings.where(F.col(grade).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(grade).alias("__g"))
    n = rated.count()
    some = rated.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < min(1_000_000, int(1_000_000 * rows / max(1, n))))
    some = F.broadcast(some.orderBy(F.xxhash64(key), key).limit(2 * rows))  # bounded by the parameter, so texts needn't be shuffled to meet it
    met = docs.select(key, F.col(text).alias("__t")).where("__t is not null").join(some, key).select(key, "__g", "__t", F.xxhash64(key, "__t").alias("__o"))
    # A rated key may repeat with many texts: distinct ones, in the order of a hash, up to the bound.
    found = met.dropDuplicates(["__o"]).orderBy("__o").limit(2 * rows).collect()
    return train([r["__t"] for r in found], [r["__g"] for r in found], scale=scale)


def score(docs: DataFrame, model: Model, text: str = "text", keep: float = KEEP) -> DataFrame:
    """Adds expected_grade, p_tail (of each threshold), p_top (of the highest grade) and keep to every row."""
    rest = shared.names_free(docs, *ADDED)
    schema = "expected_grade double, p_tail array<double>, p_top double, keep boolean"
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: 2^BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            at = batch.schema.get_field_index(text)
            tails, any_word = [], []
            for t in batch.column(at):
                f = features(t.as_py())
                tails.append(m.tails(m.score(f)))
                any_word.append(len(f[0]) > 0)
            top = np.array([x[-1] if len(x) else 1.0 for x in tails])
            columns = [pa.array([float(x.sum()) for x in tails], pa.float64()), pa.array([x.tolist() for x in tails], pa.list_(pa.float64())), pa.array(top, pa.float64()), pa.array((top >= keep) & np.array(any_word, dtype=bool))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "expected_grade", "p_tail", "p_top", "keep"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(run, f"{kinds}, {schema}")


def graded(labels: DataFrame) -> DataFrame:
    """Grades of ``labels``: 0 toxic, 1 of low quality, 2 good; a missing label counts as neither good nor toxic."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1).alias("grade"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, graded(shared.table(spark, sf_dir, "labels")))
    scored = score(docs, model)
    return scored.select("doc_id", "expected_grade", F.get("p_tail", F.lit(0)).alias("p_not_toxic"), F.col("p_top").alias("p_good"), "keep")
