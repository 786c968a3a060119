"""Sharding, URL filters, license scan, mixing and decontamination against brute force, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from threadloom.llm import decontam, license_scan, mixing, sharding, url_filter

LONG = "lorem ipsum " * 3_000


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901234, *range(50, 90)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24, 1000):
        assert [r["s"] for r in df.select(sharding.jump_hash(F.col("k"), n).alias("s")).collect()] == [jump(k, n) for k in keys]


@pytest.mark.parametrize("rows_a_group", [None, 7, 1])
def test_sharding_edges(spark, rows_a_group):
    rows = [(1, "a", 9), (1, "a", 9), (1, "b", 9), (None, None, 9), (None, "x", 9), (2, "", 9), (3, LONG, 9)] + [(k, "é", 0) for k in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = [r.asDict() for r in sharding.shard(df, shards=5, rows=rows_a_group).collect()]
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
        assert r["shard"] == jump(r["doc_id"] or 0, 5)
        assert r["grown_shard"] in (r["shard"], 5)
        assert r["size"] == len((r["text"] or "").encode()) + 8
        assert r["text_crc32"] == (None if r["text"] is None else zlib.crc32(r["text"].encode()))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard(df.limit(0)).count() == 0


def test_hot_keys_are_spread(spark):
    """A third of all rows with one key and text, a third without key: no group of rows grows with them."""
    rows = [(7, "same")] * 400 + [(None, f"text {k}") for k in range(400)] + [(k, "x") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sharding.shard(df, shards=4, rows=10)
    by = defaultdict(list)
    for r in out.collect():
        by[r["shard"]].append(r["slot"])
        assert r["shard"] == jump(r["doc_id"] or 0, 4)
    assert sum(map(len, by.values())) == 1200 and all(sorted(s) == list(range(len(s))) for s in by.values())
    sources = df.withColumn("source", F.when(F.col("doc_id") == 7, "hot").otherwise("rest"))
    out = mixing.copies(sources, rows=10).collect()
    taken = Counter()
    for r in out:
        taken[r["source"]] += r["copies"] * r["size"]
    target = {r["source"]: r["target"] for r in out}
    assert len(out) == 1200 and all(abs(taken[s] - target[s]) <= 2 for s in target)
    mixed = mixing.mix(sources, rows=10)
    assert Counter(r["source"] for r in mixed.collect()) == Counter({s: sum(r["copies"] for r in out if r["source"] == s) for s in target})


URLS = ["http://A.Example.ORG/es/x", "https://example.org/en/12?q", "https://example.org/en/2", "http://xexample.org/es/", "http://b.com/fr/a#f", "http://com/de/", "http://x.net", "x.org/es/", "http://org", None, "", "http://a.com/FR/", "ftp://u@e.org:80/p"]


def plain_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else "allow"


@pytest.mark.parametrize("inline", [64, 0])
def test_url_filter(spark, inline):
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, rule string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, inline=inline).collect()}
    assert out == {k: plain_judge(u) for k, u in enumerate([*URLS, URLS[0]])}
    assert url_filter.judge(df.limit(0), inline=inline).count() == 0


@pytest.mark.parametrize("inline", [64, 0])
def test_url_rules_of_all_shapes(spark, inline):
    """Rules without path, hosts without ASCII letters, an empty host, line breaks, and very long URLs."""
    rules = (url_filter.Rule("block", "example.com", ""), url_filter.Rule("block", "пример.рф", "/x"), url_filter.Rule("allow", "", "/y"), url_filter.Rule("block", "-", "/"))
    urls = ["http://example.com", "http://example.com\n", "http://example.com/", "http://a.example.com/q", "http://example.comx/", "http://пример.рф/xy", "http://b.пример.рф/", "http:///y", "http://a./yz", "http://-/", "http://a.-/", "http://" + "a." * 300_000 + "example.com/" + "z" * 500_000, "http://" + "a." * 300_000 + "example.org"]
    want = ["block", "allow", "block", "block", "allow", "block", "allow", "allow", "allow", "block", "block", "block", "allow"]
    names = ["example.com", None, "example.com", "example.com", None, "пример.рф/x", None, "/y", "/y", "-/", "-/", "example.com", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, rules, inline=inline).collect()}
    assert out == dict(enumerate(zip(names, want, strict=True)))
    assert all(r.tokens for r in rules)


def test_url_index_takes_the_rarest_token(spark):
    df = spark.createDataFrame([("example.org", "/es/"), ("example.org", "/en/1"), ("other.org", "/")], "host string, path string")
    index = url_filter.rarest_tokens(df, url_filter.RULES)
    assert index[url_filter.Rule("block", "example.org", "/es/")] == "es"
    assert index[url_filter.Rule("block", "example.org", "/en/1")] == "en"


def test_mixing(spark):
    rows = [(k, "w " * (k % 37), f"s{k % 5}") for k in range(600)] + [(None, None, None), (None, None, None), (700, LONG, "s1"), (700, "", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = [r.asDict() for r in mixing.copies(df).collect()]
    again = [r.asDict() for r in mixing.copies(df.repartition(3)).collect()]
    assert sorted(map(repr, out)) == sorted(map(repr, again)) and len(out) == len(rows)
    words = Counter()
    for _, t, s in rows:
        words[s] += len((t or "").split())
    order = sorted((s for s in words if s is not None)) + [None]
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, 0.0), set(order)
    left = float(sum(words.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 3 * words[s]}
        for s in full or open_:
            target[s] = 3.0 * words[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ -= full or open_
    taken = Counter()
    for r in out:
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9) and r["source_size"] == words[r["source"]]
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    longest = {s: max(len((t or "").split()) for _, t, x in rows if x == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in order)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in out)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_without_words(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [(r["target"], r["copies"]) for r in mixing.copies(df).collect()] == [(0.0, 0), (0.0, 0)]


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_report(text, items):
    w, hit, held = tokens(text), set(), set()
    for id, t in items:
        v = tokens(t)
        n = min(10, len(v))
        windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                held.add(str(id))
    return len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)


PASSAGE = "Alpha beta, gamma DELTA epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [(10, PASSAGE), (9, "x " + PASSAGE), (3, "short item"), (4, ""), (5, None), (6, "É lan"), (7, PASSAGE)]
DOCS = [(1, "start " + PASSAGE.lower() + " end"), (1, "start " + PASSAGE.lower() + " end"), (2, "a short-item here, short"), (3, None), (4, ""), (None, "É LAN é lan"), (5, PASSAGE + " " + PASSAGE), (6, LONG + PASSAGE), (7, "beta gamma delta epsilon zeta eta theta iota kappa lambda")]


def frames(spark, items=ITEMS):
    docs = spark.createDataFrame([(a, b, 1) for a, b in DOCS], "doc_id long, text string, length int")
    return docs, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_decontamination(spark, broadcast):
    docs, items = frames(spark)
    out = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.report(docs, items, broadcast=broadcast).collect()]
    assert sorted(out, key=repr) == sorted(((id, *plain_report(t, ITEMS)) for id, t in DOCS), key=repr)


def test_decontamination_of_shared_prompts(spark):
    """Thousands of items share a passage, and a text holds it thousands of times."""
    items = [(k, PASSAGE) for k in range(3000)] + [(5000, "own words of one item only and some more of them"), (5001, PASSAGE + " tail")]
    rows = [(1, (PASSAGE + " ") * 3000 + "end"), (2, PASSAGE), (3, "x " + PASSAGE + " tail y"), (4, "own words of one item only and some more of them"), (5, "clean")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontam.report(docs, bench).collect()}
    digest = lambda ids: hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
    every = [*range(3000), 5001]
    assert out == {1: (36000, 3001, digest(every)), 2: (12, 3001, digest(every)), 3: (13, 3001, digest(every)), 4: (11, 1, digest([5000])), 5: (0, 0, digest([]))}
    cut = {r["doc_id"]: r["text"] for r in decontam.clean(docs, bench, remove="spans").collect()}
    assert cut == {1: "end", 2: "", 3: "x y", 4: "", 5: "clean"}


def test_decontamination_removes(spark):
    docs, items = frames(spark)
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [3, 4]
    cut = {(r["doc_id"], r["text"]) for r in decontam.clean(docs, items, remove="spans").collect()}
    assert (1, "start end") in cut and (2, "a here, short") in cut and (3, None) in cut
    assert all(not plain_report(t, ITEMS)[4] for _, t in cut if t and "alpha" in t.lower())
    nothing = decontam.report(docs, items.limit(0))
    assert nothing.where("contaminated").count() == 0 and nothing.count() == len(DOCS)
    assert decontam.report(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("literal,broadcast", [(license_scan.LITERAL, license_scan.BROADCAST), (0, license_scan.BROADCAST), (0, 0)])
def test_license_scan(spark, literal, broadcast):
    apache = license_scan.TEMPLATES["apache-2.0"]
    words = apache.split()
    damaged = " ".join(words[:12] + words[13:])
    rows = [(1, "x y " + license_scan.TEMPLATES["mit-notice"] + " z"), (1, "x y " + license_scan.TEMPLATES["mit-notice"] + " z"), (2, None), (3, ""), (4, "released under the"), (5, LONG + apache.upper() + LONG), (6, "a b c " + damaged), (None, "Licensed under CC BY-NC 4.0."), (7, "word " * 500), (8, license_scan.TEMPLATES["mit"])]
    df = spark.createDataFrame([(a, b, "c") for a, b in rows], "doc_id long, text string, licenses string")
    out = sorted(((r["doc_id"], r["licenses"]) for r in license_scan.scan(df, literal=literal, broadcast=broadcast).collect()), key=repr)
    assert out == sorted([(1, "mit-notice"), (1, "mit-notice"), (2, ""), (3, ""), (4, ""), (5, "apache-2.0,apache-2.0-notice"), (6, "apache-2.0,apache-2.0-notice"), (None, "cc-by-nc-4.0-notice"), (7, ""), (8, "mit")], key=repr)
    assert license_scan.scan(df.limit(0)).count() == 0
    assert all((1 - license_scan.likeness(c)) ** license_scan.bands(c) <= 1 - license_scan.RECALL for c in (1, 2, 4, 8, 64))


@pytest.mark.parametrize("literal", [license_scan.LITERAL, 0])
def test_license_scan_of_texts_full_of_notices(spark, literal, monkeypatch):
    """Every word is part of a notice: windows are cut once each, within blocks, and none is missed at a block's end."""
    monkeypatch.setattr(license_scan, "BLOCK", 256)
    notice, mit = license_scan.TEMPLATES["apache-2.0-notice"], license_scan.TEMPLATES["mit"]
    rows = [(k, "word " * k + mit + " word" * 300) for k in range(0, 300, 23)] + [(1000, (notice + " ") * 4000), (1001, (mit + " ") * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["licenses"] for r in license_scan.scan(df, literal=literal).collect()}
    assert out == {k: "mit" for k in range(0, 300, 23)} | {1000: "apache-2.0-notice", 1001: "mit"}


def test_license_templates_tell_versions_apart(spark):
    free = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
    other = {"gpl-2.0": ("General Public License", "2"), "gpl-3.0": ("General Public License", "3"), "lgpl-2.1": ("Lesser General Public License", "2.1"), "lgpl-3.0-notice": ("Lesser General Public License", "3"), "agpl-3.0": ("Affero General Public License", "3")}
    want = {free.format(*v): k for k, v in other.items()} | {f"This work is licensed under the GNU General Public License, version {v}.": f"gpl-{v}.0-notice" for v in (2, 3)}
    want |= {t: k for k, t in license_scan.TEMPLATES.items()}
    want[license_scan.TEMPLATES["apache-2.0"]] = "apache-2.0,apache-2.0-notice"
    texts = sorted(want)
    out = license_scan.scan(spark.createDataFrame([(k, "before it all " + t + " and after") for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {texts[r["doc_id"]]: r["licenses"] for r in out} == want
    assert {"mpl-2.0", "isc", "zlib", "unlicense", "cc0-1.0", "cc-by-sa-4.0", "cc-by-nd-4.0"} <= set(license_scan.TEMPLATES)
