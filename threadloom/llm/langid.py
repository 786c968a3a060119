"""Language identification of words by a linear-chain conditional random field.

Each word of a text gets a label by forward-backward over learned transitions, so that code-switched texts come
apart into their languages (``label`` with ``runs``). A word's features are its character n-grams of UTF-8 bytes with marked word ends (so
those at an end are its affixes), the word itself, and the languages whose learned lexicon has it. A text's
language is the one with the largest mean marginal over its words; that mean is the score.

Training: the words of a document are labelled with the document's language; half of the sequences are put together
from pieces of two documents, so that transitions are learned. The sample is bounded: ``TEXTS`` rows of a language in
expectation and twice that at most, in the order of a hash, each distinct text once and whole. Every language that the
learned rows have is a label; a model takes half a megabyte for each, and training several.

Prediction reads whole texts, each as one sequence. Texts of more than ``SEGMENT`` words go through in segments, and
all segments of a batch advance together: first each one's transfer matrix, then the messages that pass between them,
and with these the words' marginals, which are those of the whole sequences. Memory is bounded by ``PART`` words or ``CHARACTERS``,
whichever comes first. A run of more than 4,096 letters, as in writing without spaces, is several words.

Edge cases: null texts and texts without a letter are ``und`` with score 0; without any labelled text everything
is ``und``; a single label gets score 1; repeated rows are each labelled; an empty table gives an empty result;
input columns named like an added one are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Texts of each language to learn from, in expectation.
TEXTS = 300
#: Words of a training sequence, and of a decoded segment (for up to 16 labels; more labels have longer ones, for a
#: segment's matrix takes work by the square of their number).
SEQUENCE, SEGMENT = 48, 256
#: Hash space of features; n-gram sizes in bytes.
BITS, GRAMS = 17, (2, 3, 4)
#: A word is in a language's lexicon if so many of its uses, and this share of them, are there.
LEXICON_USES, LEXICON_SHARE = 3, 0.8
EPOCHS, RATE = 4, 0.3
#: Words, and characters, of a decoded batch of texts, and of a part of a long text.
PART, CHARACTERS = 65536, 500_000
NONE = "und"
ADDED = ("lang_pred", "score")
#: What ``label`` adds on request: runs of words of one language, with code point offsets and their mean marginal.
RUNS = ("runs", "array<struct<start: int, end: int, lang: string, marginal: double>>")

# A longer run of letters is cut, which bounds what a word's features take.
_LETTERS = re.compile(r"[^\W\d_]{1,4096}")
_MASK = np.uint64((1 << BITS) - 1)


def words(text: str | None) -> list[str]:
    """Runs of letters."""
    return _LETTERS.findall(text) if text else []


def places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``words(text)`` starts and ends in the text, in code points."""
    found = np.array([m.span() for m in _LETTERS.finditer(text)], dtype=np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)


class Words:
    """Hashed features of a sequence of words, lower-cased, all at once: n-grams from one byte string, and the words themselves."""

    def __init__(self, tokens: list[str]):
        data = np.frombuffer((" " + " ".join(tokens) + " ").lower().encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint64)
        gaps = np.flatnonzero(data == 32)
        self.starts, self.n = gaps[:-1], len(tokens)  # each word begins at the gap before it
        lengths = np.diff(gaps)
        owner = np.repeat(np.arange(self.n), lengths)  # of each byte but the last gap, with the gap before it
        inner = np.ones(len(data), dtype=bool)
        inner[gaps] = False
        before = np.concatenate([[0], np.cumsum(~inner)])  # gaps before each place
        self.ids, self.owners = [], []
        for size in GRAMS:
            places = np.arange(len(data) - size + 1)
            # No gap within: only the first and the last byte may be one.
            whole = before[places + size - 1] - before[places + 1] == 0
            places = places[whole]
            gram = np.zeros(len(places), dtype=np.uint64)
            for k in range(size):
                gram = (gram << np.uint64(8)) | data[places + k]
            self.ids.append(_mix(gram, size).astype(np.int64))
            self.owners.append(owner[np.minimum(places, len(owner) - 1)])
        power = np.uint64(0x100000001B3) ** (np.arange(len(data) - 1) - np.repeat(self.starts, lengths)).astype(np.uint64)
        self.hash = np.add.reduceat((data[:-1] + np.uint64(1)) * power, self.starts) if self.n else np.empty(0, dtype=np.uint64)
        self.ids.append(_mix(self.hash, 77).astype(np.int64))
        self.owners.append(np.arange(self.n))

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each word's n-grams (their mean, times 4) and of the word itself."""
        out = np.zeros((self.n, weights.shape[1]), dtype=np.float32)
        for ids, owners in zip(self.ids[:-1], self.owners[:-1], strict=True):
            count = np.maximum(1, np.bincount(owners, minlength=self.n)).astype(np.float32)
            sums = np.zeros((self.n, weights.shape[1]), dtype=np.float32)
            if len(ids):
                starts = np.flatnonzero(np.diff(owners, prepend=-1))
                sums[owners[starts]] = np.add.reduceat(weights[ids], starts, axis=0)
            out += sums * (np.float32(4) / count)[:, None]
        return out + weights[self.ids[-1]]

    def gradient(self, miss: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, miss.shape[1]))
        for k, (ids, owners) in enumerate(zip(self.ids, self.owners, strict=True)):
            each = miss[owners] if k == len(GRAMS) else miss[owners] * (4 / np.maximum(1, np.bincount(owners, minlength=self.n))[owners])[:, None]
            for label in range(miss.shape[1]):
                out[:, label] += np.bincount(ids, weights=each[:, label], minlength=size)
        return out


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # of hashed features
    lexicon: np.ndarray  # languages of each hashed word: bits of as many 64-bit numbers as the labels take
    lexical: np.ndarray  # weights of (lexicon's language, label)
    start: np.ndarray
    move: np.ndarray

    def emissions(self, seq: Words) -> np.ndarray:
        return seq.emissions(self.weights) + self.held(seq).astype(np.float32) @ self.lexical.astype(np.float32)

    def held(self, seq: Words) -> np.ndarray:
        """Ones where the lexicon of a label has a word: (words, labels)."""
        at = np.arange(len(self.labels))
        return (self.lexicon[seq.ids[-1]][:, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


def _together(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Order of sequences, longest first, where each begins, and how many have more than 0, 1, ... words."""
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    return order, (np.cumsum(lengths) - lengths)[order], [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest)]


def _probable(emit: np.ndarray) -> np.ndarray:
    return np.exp(emit - emit.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30


def transfers(emit: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each segment in ``emit`` the matrix that takes the message before it to the message at its last word, but for
    a factor. Where ``begin``, the segment begins a sequence, and each row has the start."""
    order, begins, alive = _together(lengths)
    p, step = _probable(emit), np.exp(move)
    out = np.empty((len(lengths), *step.shape))
    for t, n in enumerate(alive):
        at = begins[:n] + t
        before = np.where(begin[order][:, None, None], np.exp(start)[None, None, :], step) if t == 0 else out[:n] @ step
        out[:n] = before * p[at][:, None, :]
        out[:n] /= out[:n].sum(axis=(1, 2), keepdims=True)
    back = np.empty_like(out)
    back[order] = out
    return back


def across(matrices: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What enters each segment of one sequence, and what comes back to its end, from the segments' matrices."""
    entry, leave = np.empty(matrices.shape[:2]), np.empty(matrices.shape[:2])
    step, message = np.exp(move), np.full(len(start), 1 / len(start))
    for k, matrix in enumerate(matrices):
        entry[k] = np.exp(start) if k == 0 else message @ step
        message = message @ matrix
        message /= message.sum()
    message = np.ones(len(start))
    for k in range(len(matrices) - 1, -1, -1):
        leave[k] = message
        message = matrices[k] @ message
        message /= message.sum()
    return entry, leave


def marginals(emit: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, entry: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over sequences that stand one after the other in ``emit``: marginals of words, and sums of
    those of transitions. Sequences advance together, longest first, in scaled probabilities. For segments of a longer
    sequence, ``entry`` has the message that enters each first word, and ``leave`` the one that comes back to each last."""
    n, labels = emit.shape
    order, begins, alive = _together(lengths)
    longest = len(alive)
    p, step = _probable(emit), np.exp(move)
    ahead, back, scale = np.empty((n, labels)), np.ones((n, labels)), np.empty(n)
    if leave is not None:
        back[np.cumsum(lengths) - 1] = leave
    enter = np.exp(start) if entry is None else entry[order]
    for t in range(longest):
        at = begins[: alive[t]] + t
        now = (enter if t == 0 else ahead[at - 1] @ step) * p[at]
        scale[at] = now.sum(axis=1)
        ahead[at] = now / scale[at][:, None]
    moves = np.zeros((labels, labels))
    for t in range(longest - 2, -1, -1):
        at = begins[: alive[t + 1]] + t
        right = p[at + 1] * back[at + 1] / scale[at + 1][:, None]
        back[at] = right @ step.T
        moves += (ahead[at].T @ right) * step
    found = ahead * back
    return found / found.sum(axis=1, keepdims=True), moves


def train(samples: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """From (language, text) pairs, in their order; the same pairs give the same model."""
    labels = sorted({lang for lang, _ in samples})
    size, k = 1 << BITS, len(labels)
    model = Model(labels, np.zeros((size, k), dtype=np.float32), np.zeros((size, (k + 63) // 64), dtype=np.uint64), np.zeros((k, k)), np.zeros(k), np.zeros((k, k)))
    if k < 2:
        return model
    draw = np.random.default_rng(seed)
    at = {lang: label for label, lang in enumerate(labels)}
    pieces = [(at[lang], w[i : i + SEQUENCE]) for lang, text in samples for w in [words(text)] for i in range(0, len(w), SEQUENCE)]
    uses = np.zeros((size, k))
    for label, ws in pieces:
        uses[:, label] += np.bincount(Words(ws).ids[-1], minlength=size)
    total = uses.sum(axis=1)
    for label in range(k):
        inside = (uses[:, label] >= LEXICON_USES) & (uses[:, label] >= LEXICON_SHARE * total)
        model.lexicon[inside, label >> 6] |= np.uint64(1 << (label & 63))
    sums = [np.full_like(x, 1e-6, dtype=np.float64) for x in (model.weights, model.lexical, model.start, model.move)]
    for _ in range(epochs):
        order = draw.permutation(len(pieces))
        sequences = []
        for i in range(0, len(order) - 1, 2):
            (a, x), (b, y) = pieces[order[i]], pieces[order[i + 1]]
            if draw.random() < 0.5:  # one code-switched sequence of two halves
                cut, rest = len(x) // 2, len(y) // 2
                sequences += [(x[:cut] + y[rest:], [a] * cut + [b] * (len(y) - rest)), (y[:rest] + x[cut:], [b] * rest + [a] * (len(x) - cut))]
            else:
                sequences += [(x, [a] * len(x)), (y, [b] * len(y))]
        for i in range(0, len(sequences), 256):
            batch = [s for s in sequences[i : i + 256] if s[0]]
            if not batch:
                continue
            seq, gold = Words([w for s in batch for w in s[0]]), np.array([g for s in batch for g in s[1]])
            lengths = np.array([len(s[0]) for s in batch])
            found, moves = marginals(model.emissions(seq), lengths, model.start, model.move)
            miss = np.eye(k)[gold] - found
            firsts = np.cumsum(lengths) - lengths
            follows = np.ones(len(gold), dtype=bool)
            follows[firsts] = False
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[:-1][follows[1:]], gold[1:][follows[1:]]), 1)
            steps = (seq.gradient(miss, size), model.held(seq).astype(float).T @ miss, miss[firsts].sum(axis=0), seen - moves)
            for value, grad, total_sq in zip((model.weights, model.lexical, model.start, model.move), steps, sums, strict=True):
                grad = grad / len(batch)
                total_sq += grad**2
                value += (RATE * grad / np.sqrt(total_sq)).astype(value.dtype)
    return model


def _parts(text: str) -> Iterator[list[str]]:
    """The words of a text in parts of bounded size."""
    found: list[str] = []
    size = 0
    for m in _LETTERS.finditer(text):
        found.append(m.group())
        size += m.end() - m.start()
        if len(found) == PART or size >= CHARACTERS:
            yield found
            found, size = [], 0
    if found:
        yield found


def _cut(n: int, labels: int) -> np.ndarray:
    size = SEGMENT * max(1, labels // 16)
    return np.array([min(size, n - i) for i in range(0, n, size)], dtype=np.int64)


def _whole(texts: list[list[str]], model: Model) -> list[np.ndarray]:
    """Marginals of the words of texts that are held together."""
    sizes = [len(ws) for ws in texts]
    emit = model.emissions(Words([w for ws in texts for w in ws]))
    cuts = [_cut(n, len(model.labels)) for n in sizes]
    lengths = np.concatenate(cuts)
    count = np.array([len(c) for c in cuts])
    first = np.cumsum(count) - count
    begin = np.zeros(len(lengths), dtype=bool)
    begin[first] = True
    entry, leave = np.tile(np.exp(model.start), (len(lengths), 1)), np.ones((len(lengths), len(model.labels)))
    several = np.repeat(count > 1, count)  # segments of texts that have more than one
    if several.any():
        matrices = np.empty((len(lengths), *model.move.shape))
        matrices[several] = transfers(emit[np.repeat(several, lengths)], lengths[several], model.start, model.move, begin[several])
        for f, c in zip(first, count, strict=True):
            if c > 1:
                entry[f : f + c], leave[f : f + c] = across(matrices[f : f + c], model.start, model.move)
    return np.split(marginals(emit, lengths, model.start, model.move, entry, leave)[0], np.cumsum(sizes)[:-1])


def _long(text: str, model: Model) -> Iterator[np.ndarray]:
    """Marginals of a text's words as of one sequence, part by part: parts are featurised twice rather than held."""
    matrices = []
    for part in _parts(text):
        lengths = _cut(len(part), len(model.labels))
        matrices.append(transfers(model.emissions(Words(part)), lengths, model.start, model.move, (np.arange(len(lengths)) == 0) & (not matrices)))
    entry, leave = across(np.concatenate(matrices), model.start, model.move)
    at = 0
    for part in _parts(text):
        lengths = _cut(len(part), len(model.labels))
        yield marginals(model.emissions(Words(part)), lengths, model.start, model.move, entry[at : at + len(lengths)], leave[at : at + len(lengths)])[0]
        at += len(lengths)


def _decode(texts: list[str | None], model: Model, runs: bool) -> tuple[list[tuple[str, float]], list[list[dict]]]:
    """Language and score of whole texts, and with ``runs`` their words' labels, all from one forward-backward pass."""
    out: list[tuple[str, float]] = [(NONE, 0.0)] * len(texts)
    if not model.labels:
        return out, [[] for _ in texts]
    sums, counts = np.zeros((len(texts), len(model.labels))), np.zeros(len(texts))
    own: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]  # of each part: words' labels and marginals
    waiting: list[tuple[int, list[str]]] = []
    held = 0

    def take(i: int, found: np.ndarray) -> None:
        sums[i] += found.sum(axis=0)
        counts[i] += len(found)
        if runs:
            best = found.argmax(axis=1)
            own[i].append((best, found[np.arange(len(best)), best]))

    def flush() -> None:
        nonlocal held
        for (i, _), found in zip(waiting, _whole([ws for _, ws in waiting], model) if waiting else (), strict=True):
            take(i, found)
        waiting.clear()
        held = 0

    for i, text in enumerate(texts):
        if len(text or "") > CHARACTERS:
            for found in _long(text, model) if _LETTERS.search(text) else ():
                take(i, found)
        elif ws := words(text):
            waiting.append((i, ws))
            held += len(text)
            if held >= CHARACTERS:
                flush()
    flush()
    for i in np.flatnonzero(counts):
        means = sums[i] / counts[i]
        best = int(np.argmax(np.round(means, 12)))
        out[i] = (model.labels[best], float(min(1.0, means[best])))
    return out, [_runs(texts[i], parts, model.labels) if parts else [] for i, parts in enumerate(own)]


def _runs(text: str, parts: list[tuple[np.ndarray, np.ndarray]], labels: list[str]) -> list[dict]:
    """Runs of words with the same label, in order."""
    best, marginal = (np.concatenate(x) for x in zip(*parts, strict=True))
    starts, ends = places(text)
    first = np.flatnonzero(np.diff(best, prepend=-1))
    count = np.diff(first, append=len(best))
    means = np.minimum(1.0, np.add.reduceat(marginal, first) / count)
    return [{"start": int(starts[f]), "end": int(ends[f + n - 1]), "lang": labels[best[f]], "marginal": float(m)} for f, n, m in zip(first, count, means, strict=True)]


def predict(texts: list[str | None], model: Model) -> list[tuple[str, float]]:
    """Language and score of whole texts."""
    return _decode(texts, model, False)[0]


def fit(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", texts: int = TEXTS) -> Model:
    """Learns from rows that ``learn`` selects and whose language is known; the same rate of each language's rows."""
    known = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("t"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return train([])
    rates = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1_000_000, max(1, 1_000_000 * texts // n)))])
    rate = F.try_element_at(rates, F.col("lang"))
    drawn = F.xxhash64("k", "t")
    some = known.where(F.pmod(F.xxhash64("k", "t", F.lit(1)), F.lit(1_000_000)) < rate).select("lang", drawn.alias("o"), "t")
    # Repeated rows count once; the bound holds whatever the draw, and the same rows are taken each time.
    found = some.dropDuplicates(["lang", "o"]).orderBy("o", "lang").limit(2 * texts * len(counts)).collect()
    return train([(r["lang"], r["t"]) for r in found])


def label(docs: DataFrame, model: Model, text: str = "text", runs: bool = False) -> DataFrame:
    """Adds lang_pred and score to every row, and with ``runs`` its words' labels, as runs of words of one language.

    Nothing but the text is looked at. A text without a letter, and any text if there is no label, has no run.
    """
    rest = shared.names_free(docs, *ADDED, *RUNS[:1] if runs else ())
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights a label, whatever the rows
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, parted = _decode(batch.column(batch.schema.get_field_index(text)).to_pylist(), shipped.value, runs)
            added = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())] + ([pa.array(parted, kind)] if runs else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *ADDED, *RUNS[:1]][: len(batch.columns) + len(added)])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(run, f"{kinds}, lang_pred string, score double" + (f", {' '.join(RUNS)}" if runs else ""))


def fold(key: str = "doc_id") -> Column:
    """Held-out documents have remainder 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3, F.lit(0))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"), fold() != 1)
    return label(docs.select("doc_id", (fold() == 1).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
