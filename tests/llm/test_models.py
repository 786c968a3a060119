"""Quality classifier, language identification, SimHash, nearest neighbours and WARC against brute force, and edge cases."""

import gzip
import hashlib
import io
import itertools
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.llm import ann, langid, quality, shared, simhash, warc

LONG = "lorem ipsum dolor " * 20_000


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def plain_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


@given(st.text(alphabet="abc \n\té", max_size=400))
@settings(deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)


def cluster_of_codes():
    draw = np.random.default_rng(1)
    codes = set()
    for base in draw.integers(0, 2**63, 30, dtype=np.uint64):
        for _ in range(15):
            code = int(base)
            for bit in draw.integers(0, 64, draw.integers(0, 6)):
                code ^= 1 << int(bit)
            codes.add(code)
    return np.array(sorted(codes), dtype=np.uint64)


def test_gray_index_finds_all_pairs():
    index = simhash.GrayIndex(cluster_of_codes())
    far = np.bitwise_count(index.codes[:, None] ^ index.codes[None, :])
    assert set(zip(*index.search(index.codes, 3), strict=True)) == set(zip(*np.where(far <= 3), strict=True))
    ranks = simhash.gray_rank(index.codes)
    assert (ranks[1:] > ranks[:-1]).all()


@pytest.mark.parametrize("codes_a_range,distance", [(8192, 3), (60, 3), (3, 3), (60, 6), (60, 0)])
def test_links_connect_what_pairs_do(spark, codes_a_range, distance):
    codes = cluster_of_codes()
    near = np.argwhere(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= distance)
    at = {int(c): k for k, c in enumerate(codes)}
    df = spark.createDataFrame([(int(c) - (1 << 64) if c >= 1 << 63 else int(c),) for c in codes], "fp long")
    found = [(at[r["a"] % (1 << 64)], at[r["b"] % (1 << 64)]) for r in simhash.links(df, shared.work_dir(spark), codes_a_range, distance).collect()]
    assert roots(len(codes), found) == roots(len(codes), [tuple(p) for p in near])


def test_upper_nodes_prune_only_what_is_far():
    codes = cluster_of_codes()
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    parts = np.array_split(codes, 40)
    nodes = [(k, *(int(f.reduce(p).view(np.int64)) for f in (np.bitwise_and, np.bitwise_or))) for k, p in enumerate(parts)]
    kept = set(simhash.near_ranges(nodes))
    for i, j in itertools.combinations_with_replacement(range(40), 2):
        if (np.bitwise_count(parts[i][:, None] ^ parts[j][None, :]) <= 3).any():
            assert (i, j) in kept
    assert len(kept) < 40 * 41 / 2


def test_links_of_a_hot_range(spark):
    """100,000 codes within a narrow stretch of the Gray order, against components by flipping bits."""
    draw = np.random.default_rng(5)
    low = np.unique(draw.integers(0, 1 << 24, 100_000, dtype=np.uint64))
    codes = np.unique(np.concatenate([low | np.uint64(0xABCDEF << 40), draw.integers(0, 2**64 - 1, 3000, dtype=np.uint64)]))
    order = {int(c): k for k, c in enumerate(codes)}
    flips = [f for n in (1, 2, 3) for f in itertools.combinations(range(24), n)]
    pairs = []
    for k in [*range(300), *draw.integers(300, len(flips), 200)]:  # all flips of one and two bits, and some of three
        flipped = codes ^ np.uint64(sum(1 << b for b in flips[k]))
        at = np.minimum(np.searchsorted(codes, flipped), len(codes) - 1)
        found = np.flatnonzero((codes[at] == flipped) & (at > np.arange(len(codes))))
        pairs.append(np.stack([found, at[found]]))
    x, y = np.concatenate(pairs, axis=1)
    assert len(x) > 10_000
    df = spark.createDataFrame([(int(np.int64(c.view(np.int64))),) for c in codes], "fp long")
    out = [(order[r["a"] % (1 << 64)], order[r["b"] % (1 << 64)]) for r in simhash.links(df, shared.work_dir(spark)).collect()]
    assert all((int(codes[a]) ^ int(codes[b])).bit_count() <= 3 for a, b in out)
    mine = np.array(roots(len(codes), out))
    assert (mine[x] == mine[y]).all()


def test_simhash_edges(spark):
    text = " ".join(f"w{k}" for k in range(400))
    rows = [(5, text), (3, text.upper()), (9, text + " more"), (7, None), (2, ""), (8, " \n"), (None, None), (None, "alone here now"), (4, "alone here"), (4, "alone here"), (11, LONG)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, fp int")
    out = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.cluster(df).collect()]
    prints = [plain_print(t) for _, t in rows]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3]
    groups = roots(len(rows), pairs)
    least = {g: min((rows[k][0] for k in range(len(rows)) if groups[k] == g and rows[k][0] is not None), default=None) for g in groups}
    assert sorted(out, key=repr) == sorted(((rows[k][0], prints[k], least[groups[k]]) for k in range(len(rows))), key=repr)
    kept = simhash.dedupe(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([2, 3, 4, 11, None], key=repr)
    assert simhash.cluster(df.limit(0)).count() == 0


def test_one_row_of_each_component(spark):
    text = " ".join(f"w{k}" for k in range(400))
    rows = [(5, text, "a"), (3, text.upper(), "a"), (9, text + " more", "b"), (2, "", "a"), (None, None, "a"), (None, "no id here", "a"), (None, "no id here", "b"), (None, "NO id here", "a")]
    rows += [(4, "alone here", "a"), (4, "alone here", "b"), (4, "alone here", "a"), (9, "clean text of a repeated id", "a"), (5, "another clean one", "c"), (11, LONG, "a"), (None, LONG, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    prints = [plain_print(t) for _, t, _ in rows]
    groups = roots(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3])
    import corpus_pipeline

    out = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    assert set(out) <= set(rows)
    found = [groups[rows.index(r)] for r in out]
    assert sorted(found) == sorted(set(groups))
    for r, g in zip(out, found, strict=True):
        assert r[0] == min((rows[k][0] for k in range(len(rows)) if groups[k] == g and rows[k][0] is not None), default=None)
    assert [r[0] for r in out if "clean" in (r[1] or "")].count(9) == 1
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), "").count() == 0
    clash = spark.createDataFrame([(3, "b b b b"), (5, "a a a a"), (5, "b b b b")], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.dedupe(clash).collect()) == [(3, "b b b b"), (5, "a a a a")]
    same = spark.createDataFrame([(7, "x y z"), (7, "x y z")], "doc_id long, text string")
    assert [tuple(r) for r in simhash.dedupe(same).collect()] == [(7, "x y z")]


def exact_nearest(rows, k=20):
    """For each query row, in order: [(vec_id, score)] by brute force over all rows with another id."""
    ids, matrix = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    out = []
    for q, v in rows:
        if q % 20 == 0:
            score = ann.exact_scores(np.array(v, dtype=np.float64), matrix)
            out.append((q, [(int(ids[j]), score[j]) for j in np.lexsort((ids, -score)) if ids[j] != q][:k]))
    return out


def answers(df, **settings):
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, **settings).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(near) for q, near in found.items()}


@pytest.mark.parametrize("settings", [{}, {"cell": 50, "block": 40, "group": 10, "recall": 1.0}, {"cell": 50, "block": 40, "group": 10}])
def test_nearest_neighbours(spark, settings):
    draw = np.random.default_rng(3)
    vectors = draw.standard_normal((700, 16)).astype(np.float32)
    vectors[100:160] = vectors[0]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    bad = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] + [1.0] * 15), (1060, [None] + [1.0] * 15), (1080, [float("inf")] * 16), (1100, [1.0, 2.0]), (1120, []), (None, [1.0] * 16)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows + bad], "vec_id long, embedding array<float>, rank int")
    found, want = answers(df, **settings), dict(exact_nearest(rows))
    assert sorted(found) == sorted(want)
    exact = dict(rows)
    hits = 0
    for q, near in found.items():
        assert [r for r, _, _ in near] == list(range(1, 21))
        assert all(s == ann.exact_scores(np.array(exact[q]), np.array([exact[v]]))[0] for _, v, s in near)
        hits += len({v for _, v, _ in near} & {v for v, _ in want[q]})
    assert hits / (20 * len(found)) >= (0.9 if "cell" in settings and "recall" not in settings else 0.999)
    assert [v for _, v, _ in found[0]] == list(range(100, 120))  # ties to the smaller id
    few = ann.nearest(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 4
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_of_large_and_small_numbers(spark):
    draw = np.random.default_rng(4)
    rows = [(k, (draw.standard_normal(8) * 10.0 ** draw.integers(-200, 100)).tolist()) for k in range(60)] + [(100, [2e38] * 8), (120, [1e200] * 8), (140, [1e-300] * 8), (141, [-1e150] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {q: [(r, v, s) for r, (v, s) in enumerate(near, 1)] for q, near in exact_nearest(rows)}
    assert answers(df, recall=1.0) == want
    assert answers(df, recall=1.0, cell=10) == want


def test_nearest_of_repeated_ids_and_ties(spark):
    draw = np.random.default_rng(6)
    rows = [(k // 3, draw.standard_normal(6).tolist()) for k in range(180)] + [(40, [1.0] * 6)] * 30 + [(k, [1.0] * 6) for k in range(200, 260)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want: dict = {}
    for q, near in exact_nearest(rows):
        want.setdefault(q, []).extend((r, v, s) for r, (v, s) in enumerate(near, 1))
    for settings in ({}, {"cell": 20, "block": 7, "group": 3}):
        assert answers(df, recall=1.0, **settings) == {q: sorted(near) for q, near in want.items()}
    tied = [(k, [2.0, 2.0]) for k in range(50)]
    assert answers(spark.createDataFrame(tied, "vec_id long, embedding array<double>"), recall=1.0) == {q: [(r, v, s) for r, (v, s) in enumerate(near, 1)] for q, near in exact_nearest(tied)}


def test_estimates_keep_their_bounds():
    draw = np.random.default_rng(8)
    vectors, centre, turn = draw.standard_normal((4000, 64)), draw.standard_normal(64) * 0.1, ann.rotation(64)
    codes, length, fit = ann.encode(vectors, centre, turn)
    assert codes.dtype == np.uint64 and codes.shape == (4000, 1)
    block = ann.Block(np.arange(4000), vectors, codes, length, fit, centre, turn)
    outside = 0
    for query in draw.standard_normal((50, 64)):
        estimate, off = block.bounds(query)
        outside += (np.abs(estimate - vectors @ query) > off).sum()
    assert outside <= 200_000 / 3000


def test_warc(spark):
    page = "<p>" + "é" * 60
    rows = [(3, "http://a/ü b", page), (1, "http://b", page), (2, None, page), (2, None, page), (4, "x", "tiny"), (5, "x", "tiny"), (6, "x", None), (None, "x", page), (7, "x", LONG), (1, "http://b", page)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int")
    out = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()), key=repr)

    def want(id, html):
        data = (html or "").encode()
        revisit = html == page and id != 1
        return id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None

    assert out == sorted((want(a, c) for a, _, c in rows), key=repr)
    back = warc.round_trip(df)
    assert warc.unanswered(back).count() == 0
    assert warc.unanswered(back.withColumn("payload_digest", F.when(F.col("record_type") == "revisit", "0").otherwise(F.col("payload_digest")))).count() == 4
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_members():
    records = [warc.make_record(k, "http://x/é", b"body %d " % k * 300, None, False) for k in range(3)]
    stream = b"".join(records)
    assert gzip.decompress(stream).count(b"WARC/1.1\r\n") == 3  # any gzip reader takes it
    assert zlib.decompressobj(31).decompress(records[0]).endswith(b"\r\n\r\n")
    for step in (1, 7, 1 << 20):

        class Slow(io.BytesIO):
            def read(self, n=-1):
                return super().read(min(n, step))

        assert [r["record_id"] for r in warc.read_records(Slow(stream))] == [warc.record_id(k) for k in range(3)]
    ids = [warc.make_record(5, "x", b"small", None, False, f"0.{k}") for k in range(2)] + [warc.make_record(None, "x", b"p" * 200, None, False, "0.2")]
    assert [r["record_id"] for r in warc.read_records(io.BytesIO(b"".join(ids)))] == ["<urn:page:5:0.0>", "<urn:page:5:0.1>", "<urn:page:none:0.2>"]
    endless = gzip.decompress(records[0]).replace(b"\r\n\r\nbody", b"\r\n" + b"x" * (3 << 20) + b"body", 1)
    with pytest.raises(warc.BadRecord):
        list(warc.read_records(io.BytesIO(gzip.compress(endless))))
    for broken in (stream[:-5], stream[:40], records[0][:-30] + records[1]):
        with pytest.raises(warc.BadRecord):
            list(warc.read_records(io.BytesIO(broken)))
    plain = gzip.decompress(records[0])
    for changed in (plain.replace(b"body 0", b"bodY 0", 1), plain.replace(b"Content-Length: 2", b"Content-Length: 1"), plain.replace(b"WARC/1.1", b"HTTP/1.1")):
        with pytest.raises(warc.BadRecord):
            list(warc.read_records(io.BytesIO(gzip.compress(changed))))


GOOD, JUNK, RUDE = "the river runs along a quiet valley", "BUY!! NOW!! CHEAP!! DEALS!! CLICK!!", "the river runs along an idiot valley"


def test_quality(spark):
    texts = [(k, (GOOD, JUNK, RUDE)[k % 3] + f" w{k}") for k in range(300)]
    rows = [(k, t, "x") for k, t in texts] + [(1000, None, "x"), (1001, "", "x"), (None, GOOD, "x"), (1002, GOOD * 5000, "x"), (1, JUNK, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep string")
    labels = spark.createDataFrame([(k, int(k % 3 != 1), int(k % 3 == 2)) for k in range(0, 240)] + [(5000, 1, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, quality.graded(labels))
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    out = {}
    for r in quality.score(docs, model).collect():
        out.setdefault(r["doc_id"], r)
        assert 0 <= r["expected_grade"] <= 2 and r["p_tail"][0] >= r["p_tail"][1]
    assert all(out[k]["keep"] == (k % 3 == 0) for k in range(240, 300))
    assert not out[1000]["keep"] and not out[1001]["keep"] and out[None]["keep"]
    again = quality.fit(docs.repartition(5), quality.graded(labels))
    assert np.array_equal(model.words, again.words)
    none = quality.fit(docs, quality.graded(labels.limit(0)))
    assert all(r["keep"] == bool(r["text"]) for r in quality.score(docs, none).collect())
    assert quality.score(docs.limit(0), model).count() == 0


def test_likelihood_and_its_gradients():
    """Against the definition, and differences; every grade of the scale, also one that no row has."""
    draw = np.random.default_rng(2)
    scores, y, thresholds = draw.normal(size=40), draw.choice([0, 1, 3], 40), np.array([-1.0, 0.2, 0.9])

    def plain(scores, thresholds):
        total = 0.0
        for s, k in zip(scores, y, strict=True):
            tail = [1.0] + [1 / (1 + np.exp(t - s)) for t in thresholds] + [0.0]
            total += np.log(tail[k] - tail[k + 1])
        return total / len(y)

    value, by_score, by_threshold = quality.likelihood(scores, y, thresholds)
    assert abs(value - plain(scores, thresholds)) < 1e-12
    for j, found in enumerate(by_score):
        step = np.eye(len(scores))[j] * 1e-6
        assert abs((plain(scores + step, thresholds) - plain(scores - step, thresholds)) / 2e-6 - found) < 1e-8
    for j, found in enumerate(by_threshold):
        step = np.eye(3)[j] * 1e-6
        assert abs((plain(scores, thresholds + step) - plain(scores, thresholds - step)) / 2e-6 - found) < 1e-8


def test_grades_are_those_of_the_scale():
    texts = [(GOOD, JUNK)[k % 2] + f" w{k}" for k in range(200)]
    model = quality.train(texts, [2 - k % 2 for k in range(200)])
    assert len(model.thresholds) == 2
    good, junk = (model.tails(model.score(quality.features(t + " w1"))) for t in (GOOD, JUNK))
    assert good[0] > 0.95 and junk[0] > 0.9 and good[1] > 0.9 and junk[1] < 0.2  # nothing is toxic
    assert list(quality._apart(np.array([1.0, 0.5, 2.0]))) == [1.0, 1.0 + quality.GAP, 2.0]
    with pytest.raises(ValueError):
        quality.train(texts, [k % 4 for k in range(200)])


WORDS = {"en": "the of and with river stone water house think".split(), "de": "der und mit straße wasser schön haus denken nicht".split()}


def prose(lang, seed, n=40):
    draw = np.random.default_rng(seed)
    return " ".join(draw.choice(WORDS[lang], n)) + "."


def test_language_id(spark):
    rows = [(k, prose(("en", "de")[k % 2], k), ("en", "de")[k % 2], 1) for k in range(120)] + [(500, None, "en", 1), (501, "12 !!", "de", 1), (502, prose("de", 3, 90_000), None, 1), (None, prose("en", 5), None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.fit(docs, langid.fold() != 1)
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.label(docs, model).collect()}
    assert all(out[k][0] == ("en", "de")[k % 2] and out[k][1] > 0.8 for k in range(120))
    assert out[500] == out[501] == ("und", 0.0) and out[502][0] == "de" and out[None][0] == "en"
    assert langid.label(docs, langid.train([])).where("lang_pred <> 'und'").count() == 0
    assert langid.label(docs.limit(0), model).count() == 0
    mixed = langid.words(prose("en", 1, 20) + " " + prose("de", 2, 20))
    found, _ = langid.marginals(model.emissions(langid.Words(mixed)), np.array([40]), model.start, model.move)
    labels = [model.labels[k] for k in found.argmax(axis=1)]
    assert labels.count("en") in range(17, 24) and labels[0] == "en" and labels[-1] == "de"


def test_runs_of_languages(spark, monkeypatch):
    docs = spark.createDataFrame([(k, prose(("en", "de")[k % 2], k), ("en", "de")[k % 2]) for k in range(120)], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    one, two = prose("en", 1, 20), prose("de", 2, 20)
    texts = ["İ, " + one + " " + two, None, "12 !!", "", one]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in langid.label(df, model, runs=True).collect()}
    assert [(out[k]["lang_pred"], out[k]["score"]) for k in range(5)] == langid.predict(texts, model)
    assert all(out[k]["runs"] == [] for k in (1, 2, 3)) and [r["lang"] for r in out[4]["runs"]] == ["en"]
    seq = langid.Words(langid.words(texts[0]))
    found, _ = langid.marginals(model.emissions(seq), np.array([seq.n]), model.start, model.move)
    want, at = [], 0
    for lang, ws in itertools.groupby(zip(found.argmax(axis=1), langid.words(texts[0]), found.max(axis=1), strict=True), key=lambda x: model.labels[x[0]]):
        ws = list(ws)
        want.append((lang, [w for _, w, _ in ws], sum(p for *_, p in ws) / len(ws)))
    assert {"en", "de"} == {lang for lang, *_ in want} and len(out[0]["runs"]) == len(want)
    for r, (lang, ws, p) in zip(out[0]["runs"], want, strict=True):
        assert r["lang"] == lang and abs(r["marginal"] - p) < 1e-9
        assert langid.words(texts[0][r["start"] : r["end"]]) == ws
        assert r["start"] >= at
        at = r["end"]
    assert abs(out[0]["runs"][-1]["start"] - texts[0].index(two)) < 20 and out[0]["runs"][-1]["end"] == len(texts[0]) - 1
    monkeypatch.setattr(langid, "PART", langid.SEGMENT)
    monkeypatch.setattr(langid, "CHARACTERS", 2000)
    long = prose("de", 3, 3000)
    assert [(r["lang"], r["start"], r["end"]) for r in langid._decode([long], model, True)[1][0]] == [("de", 0, len(long) - 1)]


@pytest.mark.parametrize("part", [1 << 16, 90])
def test_long_texts_are_one_sequence(monkeypatch, part):
    """Segments and parts change nothing: marginals are those of forward-backward over the whole sequence."""
    model = langid.train([(lang, prose(lang, k)) for k in range(40) for lang in ("en", "de")])
    text = " ".join(prose(lang, k, n) for k, (lang, n) in enumerate([("en", 130), ("de", 77), ("en", 3), ("de", 5), ("en", 101)]))
    whole = model.emissions(langid.Words(langid.words(text)))
    want, _ = langid.marginals(whole, np.array([len(whole)]), model.start, model.move)
    monkeypatch.setattr(langid, "SEGMENT", 20)
    monkeypatch.setattr(langid, "PART", part)
    assert np.allclose(np.concatenate(list(langid._long(text, model))), want, atol=1e-9)
    short = langid.words(prose("en", 77, 9))
    found = langid._whole([short, langid.words(text), short], model)
    assert np.allclose(found[1], want, atol=1e-9) and np.allclose(found[0], found[2])
    assert np.allclose(found[0], langid.marginals(model.emissions(langid.Words(short)), np.array([9]), model.start, model.move)[0])
    means = want.mean(axis=0)
    assert langid.predict([text], model)[0] == (model.labels[int(means.argmax())], pytest.approx(means.max()))


def test_a_word_of_ten_megabytes_takes_bounded_memory():
    import tracemalloc

    model = langid.train([(lang, prose(lang, k)) for k in range(10) for lang in ("en", "de")])
    text = "straße" * 1_700_000
    tracemalloc.start()
    assert langid.predict([text, "12 " * 400_000], model) == [("de", pytest.approx(1, abs=0.1)), ("und", 0.0)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


def test_the_sample_is_the_same_however_rows_are_dealt(spark):
    rows = [(k % 50, prose(("en", "de")[k % 2], k), ("en", "de")[k % 2]) for k in range(300)] + [(7, prose("en", 1), "en")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = langid.fit(docs, F.lit(True), texts=40), langid.fit(docs.repartition(7), F.lit(True), texts=40)
    assert np.array_equal(one.weights, two.weights)


def test_more_than_64_languages(spark):
    names = [f"l{k:02}" for k in range(70)]
    own = lambda k: [f"{chr(97 + k // 9)}{c}{chr(97 + k % 9)}{c}x" for c in "aeiouy"]
    rows = [(k * 8 + j, " ".join(np.random.default_rng(k * 8 + j).choice(own(k), 30)), names[k]) for k in range(70) for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.col("doc_id") % 8 != 0)
    assert model.labels == names
    out = {r["doc_id"]: r["lang_pred"] for r in langid.label(docs.where("doc_id % 8 = 0"), model).collect()}
    assert [out[k * 8] for k in range(70)] == names


def test_marginals_by_enumeration():
    draw = np.random.default_rng(0)
    emit, lengths = draw.normal(size=(9, 3)).astype(np.float32), np.array([2, 4, 3])
    start, move = draw.normal(size=3), draw.normal(size=(3, 3))
    found, moves = langid.marginals(emit, lengths, start, move)
    at, expected = 0, np.zeros((3, 3))
    for n in lengths:
        e, z, m, t = emit[at : at + n], 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for y in itertools.product(range(3), repeat=int(n)):
            s = np.exp(start[y[0]] + sum(e[i, y[i]] for i in range(n)) + sum(move[y[i], y[i + 1]] for i in range(n - 1)))
            z += s
            for i in range(n):
                m[i, y[i]] += s
            for i in range(n - 1):
                t[y[i], y[i + 1]] += s
        assert np.allclose(m / z, found[at : at + n], atol=1e-5)
        expected, at = expected + t / z, at + n
    assert np.allclose(expected, moves, atol=1e-5)
