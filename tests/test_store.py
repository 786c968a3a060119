"""The store's state machine, claims and evidence, by example."""

import json

from pyspark.sql import functions as F

from threadloom import schema
from threadloom.operators import chunks, claims, evidence, store

CAPTURE = "id string, arrival long, digest string, storedDigest string, transcriptDigest string, capturedAt double, previousDigest string, checked boolean, restore boolean, drop boolean"
TOMB = "id string, digest string, transcriptDigest string"


def cap(arrival, digest, at=1.0, transcript="t", previous=None, checked=False, restore=False, drop=False, stored=None, id="a"):
    return (id, arrival, digest, stored, transcript, at, previous, checked, restore, drop)


def outcomes(spark, *captures, sessions=(), tombs=()):
    held = spark.createDataFrame(list(sessions), store.SESSION)
    dead = spark.createDataFrame(list(tombs), TOMB)
    folded = store.capture(spark.createDataFrame(list(captures), CAPTURE), held, dead)
    rows = sorted(folded.collect(), key=lambda r: (r["id"], r["arrival"] < 0, r["arrival"]))
    return [(r["outcome"], r["revision"]) for r in rows if r["outcome"] != "state"], folded, held, dead


def test_capture_states(spark):
    got, folded, held, dead = outcomes(
        spark, cap(1, "x"), cap(2, "x"), cap(3, "y", at=0.5), cap(4, "y", previous="z", checked=True), cap(5, "y", previous="x", checked=True), cap(6, "z", stored="y", at=2.0), cap(7, "q", drop=True), cap(8, "w", transcript="t"), cap(9, "v", transcript="new"),
    )
    assert got == [("stored", 1), ("unchanged", 1), ("stale", 1), ("conflict", 1), ("stored", 2), ("touched", 2), ("dropped", 0), ("deleted", 0), ("stored", 1)]
    sessions, tombs = store.after(folded, held, dead)
    assert [(r["id"], r["digest"], r["revision"]) for r in sessions.collect()] == [("a", "v", 1)] and tombs.count() == 0


def test_tombstones(spark):
    got, folded, held, dead = outcomes(spark, cap(1, "x", transcript="same"), cap(2, "x2", transcript="same"), tombs=[("a", "x", "same")])
    assert got == [("deleted", 0), ("deleted", 0)]
    assert store.after(folded, held, dead)[1].first()["digest"] == "x2"
    assert outcomes(spark, cap(1, "x", transcript="same", restore=True), tombs=[("a", "x", "same")])[0] == [("stored", 1)]


def test_read_and_lift(spark):
    sessions = spark.createDataFrame([("a", 3)], "id string, revision int")
    revisions = spark.createDataFrame([("a", 3, "d3")], "id string, revision int, digest string")
    assert [store.read(revisions, sessions, "a", r).first()["status"] for r in (None, 3, 2, 9)] == ["found", "found", "compacted", "missing"]
    snap = spark.createDataFrame([("a", ["run:test", "x"])], "id string, tags array<string>")
    edits = spark.createDataFrame([("a", "run:test", False)], "id string, tag string, added boolean")
    assert store.lift(snap, edits).first()["tags"] == ["x"]


def test_claims(spark):
    ddl = "source string, sessionId string, claimant string, expiresAt long, fulfilledBy string, fulfilledAt long"
    held = spark.createDataFrame([("codex", "s", "w1", 100, None, None)], ddl)
    wanted = spark.createDataFrame([("codex", "s", "w2"), ("codex", "t", "w2")], "source string, sessionId string, claimant string")
    after, refused = claims.hold(held, wanted, 50, 10)
    assert [r["sessionId"] for r in refused.collect()] == ["s"] and after.count() == 2
    assert claims.hold(held, wanted, 150, 10)[1].count() == 0
    done = spark.createDataFrame([("codex", "s", "w1", "A")], "source string, sessionId string, claimant string, fulfilledBy string")
    assert claims.fulfil(held, done, 60).first()["fulfilledAt"] == 60
    rows = spark.createDataFrame([("A", "codex", "s", None), ("B", "codex", "s", None), ("C", "codex", "s/agent-1", None), ("P", "codex", "z", "B"), ("D", "codex", "s2", None)], "id string, source string, sessionId string, partOf string")
    assert sorted(r["id"] for r in claims.superseded_by(rows, done).collect()) == ["B", "C", "P"]


def test_evidence(spark):
    call = lambda name, given: json.dumps({"name": name, "input": given})
    rows = [
        ("s", 0, "e0", "tool-call", call("Read", {"file_path": "/w/a/x"})), ("s", 1, "e1", "user", "see https://github.com/o/r/pull/1"),
        ("s", 2, "e2", "tool-call", call("Bash", {"command": "echo > /w/a/b/y && cat /w/a/z && gh pr create -R o/r && ls /w && echo > /q"})), ("s", 3, "e3", "assistant", "done"),
    ]
    entries = spark.createDataFrame(rows, "sid string, position int, id string, kind string, text string").withColumn("cwd", F.lit("/w/a"))
    kept = entries.where("kind <> 'tool-call'").select("sid", "id")
    roots = spark.createDataFrame([("top", "/w"), ("a", "/w/a"), ("b", "/w/a/b")], "projectId string, root string")
    repos = spark.createDataFrame([("a", "o/r")], "projectId string, repository string")
    found = evidence.collect(entries, kept, roots, repos, "sid")
    got = {(r["anchor"], r["field"], r["key"]): r["n"] for r in found.collect()}
    assert got == {("e1", "reads", "a"): 2, ("e1", "references", "o/r"): 1, ("e1", "writes", "b"): 1, ("e1", "writes", "a"): 1, ("e1", "unattributed", ""): 1}
    orgs = spark.createDataFrame([("a", "acme")], "projectId string, organization string")
    by = {r["organization"]: (r["writes"], r["reads"], r["references"]) for r in evidence.by_organization(found, orgs, repos, "sid").collect()}
    assert by == {"acme": (1, 2, 1), "personal": (1, 0, 0)}
    concept = spark.createDataFrame([("x.ts", "core")], "path string, concept string")
    named = spark.createDataFrame([("s", 0, "tool-call", "read /w/a/x.ts and x.ts")], "sid string, position int, kind string, text string")
    assert [(r["tag"], r["n"]) for r in evidence.concepts(named, concept, roots, "sid").collect()] == [("concept:core", 2)]


def test_selection_keeps_the_budget(spark):
    rows = [("s", k, f"e{k}", "user", ("needle " if k % 2 else "hay ") * 60 + str(k)) for k in range(6)]
    entries = spark.createDataFrame(rows, "sid string, position int, id string, kind string, text string").withColumn("sourceRef", F.lit("r"))
    ranked = chunks.rank(chunks.chunk(entries, "sid", budget=64), "needle", "sid")
    for budget in (16, 100, 250, 2048):
        got = chunks.select(ranked, "needle", "sid", budget=budget).first()
        assert got["used"] <= budget and got["used"] == sum(c["tokens"] for c in got["chunks"])
        assert all("needle" in c["text"] for c in got["chunks"])
    listed = spark.createDataFrame([("s", 1), ("none", 2)], "sid string, seq int")
    pages = chunks.across(listed, ranked, "needle", "sid", "seq", budget=100)
    assert [p["sid"] for p in pages] == ["s", "none"] and sum(c["tokens"] for c in pages[0]["chunks"]) <= 100


def test_snapshot_checks(spark):
    entry = lambda id: (id, None, None, "user", "hi", None, "r", None, None)
    good = (1, "00000000-0000-7000-8000-000000000000", "codex", "s", "T", None, None, None, None, None, [], [], [], 1.0, ("unavailable", "partial", []), [entry("a"), entry("b")])
    bad = (*good[:4], "", *good[5:-1], [entry("a"), entry("a")])
    df = spark.createDataFrame([good, bad], schema.SNAPSHOT_DDL)
    valid, rejected = schema.validated(df)
    assert valid.count() == 1 and rejected.first()["issues"] == ["title", "duplicate entry ids"]


def test_long_histories_of_one_session(spark):
    """All captures of one session among many, in more than one batch of rows, judged as the plain fold would."""
    captures = [cap(k, f"d{k % 7}", at=float(k), transcript=f"t{k}") for k in range(25_000)] + [cap(k, "x", id=f"s{k}") for k in range(200)]
    got, folded, held, dead = outcomes(spark, *captures)
    assert got.count(("unchanged", 1)) == 0 and sum(o == "stored" for o, _ in got) == 25_200
    sessions, _ = store.after(folded, held, dead)
    assert {r["id"]: r["revision"] for r in sessions.collect()}["a"] == 25_000


def test_captures_are_tried_again(spark):
    captures = spark.createDataFrame([cap(1, "x", previous="old", checked=True), cap(2, "y", previous="old", checked=True)], CAPTURE)
    held = spark.createDataFrame([("a", "w", "w", "t", 3, 0.5, None, None, [])], store.SESSION)
    none = spark.createDataFrame([], TOMB)
    once = [r["outcome"] for r in store.capture(captures, held, none).orderBy("arrival").collect() if r["outcome"] != "state"]
    again = [r["outcome"] for r in store.capture_again(captures, held, none).orderBy("arrival").collect() if r["outcome"] != "state"]
    assert once == ["conflict", "conflict"] and again == ["stored", "stored"]


def test_lifted_revisions(spark):
    sessions = spark.createDataFrame([("a", 2, "s2"), ("b", 1, "s1")], "id string, revision int, storedDigest string")
    revisions = spark.createDataFrame([("a", 1, "d1", ["run:test"]), ("a", 2, "d2", ["run:test", "x"]), ("b", 1, "e1", ["y"])], "id string, revision int, digest string, tags array<string>")
    chunks_of = spark.createDataFrame([("a", 1, "old"), ("a", 2, "text"), ("b", 1, "other")], "id string, revision int, text string")
    edits = spark.createDataFrame([("a", "run:test", False), ("b", "y", False)], "id string, tag string, added boolean")
    s, r, c = store.store_lifted(sessions, revisions, chunks_of, edits)
    assert sorted((x["id"], x["revision"]) for x in s.collect()) == [("a", 3), ("b", 1)]
    assert sorted((x["id"], x["revision"], tuple(x["tags"])) for x in r.collect()) == [("a", 1, ("run:test",)), ("a", 3, ("x",)), ("b", 1, ("y",))]
    assert sorted((x["revision"], x["text"]) for x in c.collect()) == [(1, "old"), (1, "other"), (3, "text")]


def test_small_registers(spark):
    from threadloom.operators import listing
    from threadloom.plans import queues, sync

    tags = spark.createDataFrame([("", "a", "old"), ("x", "a", None)], "actorId string, tag string, description string")
    new = spark.createDataFrame([(None, "a", "new"), ("x", "b", "b")], "actorId string, tag string, description string")
    defined = listing.define_tag(tags, new)
    assert sorted(map(tuple, defined.collect())) == [("", "a", "new"), ("x", "a", None), ("x", "b", "b")]
    assert listing.undefine_tag(defined, new.where("tag = 'a'")).count() == 2
    routed = spark.createDataFrame([("b",), ("a",), ("P",), ("unrouted",), (None,), ("a",)], "projectId string")
    assert [r["projectId"] for r in listing.projects(routed).collect()] == ["a", "b"]
    held = spark.createDataFrame([("p1", "s"), ("p2", "t"), ("s", None)], "id string, partOf string")
    plans = spark.createDataFrame([("s", "k", "k"), ("t", None, "k")], "id string, checked string, checkKey string")
    assert {r["id"]: r["checked"] for r in queues.sensitivity_checked(held, plans).collect()} == {"p1": True, "p2": False}
    urls = spark.createDataFrame([("HTTPS://Host.test:443", "standalone", None, None), ("https://host.test/", "standalone", None, None), ("http://host.test:8080/x", "hub", "i", "r")], "url string, kind string, i string, r string")
    seen = [r["d"] for r in urls.select(sync.destination_identity(F.col("url"), F.col("kind"), F.col("i"), F.col("r")).alias("d")).collect()]
    assert seen[0] == seen[1] == '["https://host.test","/","standalone"]' and seen[2] == '["http://host.test:8080","/x",["hub","i","r"]]'
    dirs = spark.createDataFrame([(d,) for d in ("/private/var/folders/x", "/tmp/oracle-1", "/w/bench/.runs/1", "/w/bench/.runs-old", "/w/decision-receipts/primed-1", "/w/scratchpad", "/tmpx", "/w/.oracle")], "cwd string")
    assert [r["k"] for r in dirs.select(listing.inferred_run(F.col("cwd")).alias("k")).collect()] == ["test", "oracle", "oracle", "oracle", "host", "test", None, "oracle"]
    ids = spark.createDataFrame([("hub", "watch-A", None, None), ("codex", "s", "P", None), ("codex", "s", "q", "helper"), ("codex", "s", None, None)], "source string, sessionId string, projectId string, agent string")
    tagged = ids.select(listing.identity_tags(F.col("source"), F.col("sessionId"), F.col("projectId"), F.col("agent"), ("helper",), "P", ("hub", "^watch-[AB]$")).alias("t"))
    assert [r["t"] for r in tagged.collect()] == [["run:test"], ["run:test"], ["run:host"], []]
