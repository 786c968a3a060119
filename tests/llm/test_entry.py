"""The registered queries against their SQL, and the pipeline's contract."""

import hashlib
import itertools
from collections import Counter

import numpy as np
import pytest
from compare import connect, same
from pyspark.sql import functions as F
from test_models import plain_print, roots
from test_native import ITEMS, PASSAGE, jump, plain_report

import corpus_pipeline
from threadloom.llm import mixing, quality, queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_equal(name, spark, sf):
    same(queries.queries()[name](spark, sf), connect(sf), queries.oracle_sql()[name])


def test_accuracy_on_held_out_documents(spark, sf):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in queries.queries()["op7_language_id"](spark, sf).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) / len(out) >= 0.95


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "mixing sources", "sharding"]
    out = corpus_pipeline.run(spark, sf)
    assert set(docs.columns) < set(out.columns) and 0 < out.count()
    by = {}
    for r in out.select("shard", "slot").collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def fixture():
    """Documents with good, poor and toxic texts, copies, near copies, passages, repeated rows, nulls and long texts."""
    draw = np.random.default_rng(9)
    words = [f"{a}{b}{c}" for a in ("ri", "va", "sto", "mo") for b in ("ver", "lley", "ne", "on") for c in ("", "s", "ing")]
    prose = lambda n: " ".join(draw.choice(words, n))
    texts = [prose(int(n)) + "." for n in draw.integers(20, 120, 150)]
    texts += ["BUY!! NOW!! CHEAP!! DEALS!! " * int(n) + prose(5) for n in draw.integers(3, 20, 60)] + [f"idiot {prose(30)} idiot" for _ in range(60)]
    rows = [(k, t, ("a", "b", "c", None)[k % 4]) for k, t in enumerate(texts)]
    labels = [(k, int(k < 150), int(k >= 210)) for k, *_ in rows if k % 3] + [(1200 + k, 1, 0) for k in range(10)]
    rows += [(1000 + k, texts[k], "b") for k in range(0, 40, 2)] + [(1100 + k, texts[k].upper(), "a") for k in range(0, 40, 4)]
    rows += [(1200 + k, prose(20) + " " + PASSAGE + " " + prose(20), "c") for k in range(10)] + [rows[3], rows[3], rows[5]]
    rows += [(3, prose(60), "a"), (None, prose(50), "b"), (None, prose(50), None), (None, None, "a"), (2000, "", "b"), (2001, prose(30_000), "a")]
    return rows, labels


def plain_copies(rows):
    """Copies that systematic sampling takes of each (doc_id, text, source), by row."""
    size = [len((t or "").split()) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sources)}
    target, left = {}, float(sum(total.values()))
    while len(target) < len(sources):
        rest = [s for s in sources if s not in target]
        level = left / sum(weight[s] for s in rest)
        full = [s for s in rest if level * weight[s] >= 3 * total[s]]
        target |= {s: 3.0 * total[s] for s in full} if full else {s: level * weight[s] for s in rest}
        left -= sum(3 * total[s] for s in full)
    out = [0] * len(rows)
    for s in sources:
        offset = int(hashlib.md5(f"{mixing.SEED} {s or ''}".encode()).hexdigest()[:8], 16) / 2**32
        mine = sorted((k for k in range(len(rows)) if rows[k][2] == s), key=lambda k: (size[k], rows[k][0] is not None, rows[k][0] or 0, len((rows[k][1] or "").encode())))
        for rank, k in enumerate(mine, 1):
            rate = target[s] / total[s] if total[s] else 0.0
            out[k] = int(np.floor(rank * rate + offset) - np.floor((rank - 1) * rate + offset))
    return out


def test_pipeline_by_brute_force(spark, tmp_path):
    rows, labels = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text"))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([i for i in ITEMS if i[0] in (10, 9, 7)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plain = lambda df: Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())

    model = quality.fit(docs, quality.graded(spark.read.parquet(f"{tmp_path}/labels.parquet")))
    keep = {t: bool((t or "").split()) and model.tails(model.score(quality.features(t)))[-1] >= 0.5 for _, t, _ in rows}
    good = [r for r in rows if keep[r[1]]]
    assert plain(corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))) == Counter(good)
    assert sum(r[0] is not None and 150 <= r[0] < 270 for r in good) < 12 < 140 < sum(r[0] is not None and r[0] < 150 for r in good)

    prints = [plain_print(t) for _, t, _ in good]
    group = roots(len(good), [(i, j) for i, j in itertools.combinations(range(len(good)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3])
    second = docs.where(F.coalesce(F.col("text").isin([t for t in keep if keep[t]]), F.lit(False)))
    kept = plain(corpus_pipeline.STAGES[1][1](spark, second, str(tmp_path)))
    where = {r: g for r, g in zip(good, group, strict=True)}
    assert kept.total() == len(set(group)) == len({where[r] for r in kept})
    for r in kept:
        ids = [x[0] for x, g in zip(good, group, strict=True) if g == where[r] and x[0] is not None]
        assert r[0] == min(ids, default=None)

    items = [i for i in ITEMS if i[0] in (10, 9, 7)]
    clean = [r for r in kept.elements() if not plain_report(r[1], items)[4]]
    assert len(clean) == kept.total() - 10
    third = spark.createDataFrame(list(kept.elements()), "doc_id long, text string, source string")
    assert plain(corpus_pipeline.STAGES[2][1](spark, third, str(tmp_path))) == Counter(clean)

    copies = plain_copies(clean)
    mixed = Counter()
    for r, n in zip(clean, copies, strict=True):
        mixed[r] += n
    mixed = +mixed
    assert plain(corpus_pipeline.STAGES[3][1](spark, spark.createDataFrame(clean, "doc_id long, text string, source string"), str(tmp_path))) == mixed

    out = corpus_pipeline.run(spark, str(tmp_path))
    assert plain(out) == mixed
    for r in out.collect():
        assert r["shard"] == jump(r["doc_id"] or 0, 24)
