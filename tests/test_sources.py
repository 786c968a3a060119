"""Transcript dialects, from files to sessions and entries."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom.operators import activity
from threadloom.sources import sessions, transcripts
from threadloom.streaming import ingest


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows), encoding="utf-8")


def claude(uuid, kind, content, **more):
    human = {"origin": {"kind": "human"}} if kind == "user" else {}
    model = {"model": "m1"} if kind == "assistant" else {}
    return {"sessionId": "s1", "uuid": uuid, "type": kind, "timestamp": "2026-01-02T10:00:00.000Z", **human, "message": {"role": kind, "content": content, **model}, **more}


def read(spark, path, source):
    found = sessions.read(spark, str(path), source, "0000", 1.0)
    entries = [r.asDict() for r in found.entries.orderBy("file", "position").collect()]
    return [r.asDict(True) for r in found.sessions.orderBy("file").collect()], entries, {r["file"].rpartition("/")[2]: r["error"] for r in found.rejected.collect()}


REFUSED = "The user doesn't want to proceed with this tool use. The tool use was rejected"


def test_claude(spark, tmp_path):
    write(tmp_path / "a.jsonl", [
        claude("u1", "user", [{"type": "text", "text": "Fix the tests"}]), "",
        claude("a1", "assistant", [{"type": "thinking", "thinking": "x"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "rm x", "b": 1, "a": 2}}]),
        claude("u2", "user", [{"type": "tool_result", "tool_use_id": "t1", "content": REFUSED}]),
        claude("a2", "assistant", "done [x]", effort="high"),
        claude("u3", "user", "<system-reminder>no</system-reminder>"),
        claude("u3", "user", "<system-reminder>no</system-reminder>"),
        claude("u4", "user", [{"type": "tool_result", "tool_use_id": "t1", "content": REFUSED + " the user said:\nuse y"}]),
    ])
    write(tmp_path / "bad.jsonl", [claude("u1", "user", "hi"), "{nope"])
    write(tmp_path / "list.jsonl", [claude("u1", "user", "hi"), "[1]"])
    write(tmp_path / "mixed.jsonl", [claude("u1", "user", "hi"), claude("u2", "user", "hi", sessionId="other")])
    write(tmp_path / "conflict.jsonl", [claude("u1", "user", "hi"), claude("u1", "user", "ho")])
    write(tmp_path / "empty.jsonl", [{"sessionId": "s9", "type": "system"}])
    write(tmp_path / "sub/agent-77.jsonl", [claude("k1", "user", "Do it", isSidechain=True, sessionId="s2"), claude("k2", "assistant", [{"type": "text", "text": "ok"}], isSidechain=True, sessionId="s2")])
    (tmp_path / "latin.jsonl").write_bytes(b'{"a":"\xff"}')
    found, entries, rejected = read(spark, tmp_path, "claude-code")
    assert [s["sessionId"] for s in found] == ["s1", "s2/agent-77"]
    first = found[0]
    assert (first["title"], first["runtime"]["accessPath"], first["coverage"]["omissions"][1:]) == ("Fix the tests", "unknown", ["Private reasoning is not included"])
    assert (found[1]["title"], found[1]["lineage"]["parentSessionId"], found[1]["lineage"]["kind"]) == ("Do it", "s2", "subagent")
    mine = [e for e in entries if e["sessionId"] == "s1"]
    assert [(e["id"], e["kind"]) for e in mine] == [("u1:text-0", "user"), ("a1:call-1", "tool-call"), ("u2:result-0", "event"), ("a2:text", "assistant"), ("u3:text", "event"), ("u4:result-0", "user")]
    assert mine[1]["text"] == '{"name":"Bash","input":{"command":"rm x","b":1,"a":2}}'
    assert mine[2]["text"] == '{"rejected":"Bash","command":"rm x"}'
    assert (mine[3]["model"], mine[3]["effort"], mine[0]["timestamp"]) == ("m1", "high", 1767348000000.0)
    assert rejected == {
        "bad.jsonl": "Invalid transcript JSON at line 2", "list.jsonl": "Invalid transcript record at line 2", "mixed.jsonl": "Mixed transcript sessions",
        "conflict.jsonl": "Conflicting transcript record", "empty.jsonl": "Transcript holds no turns", "latin.jsonl": "The transcript is not UTF-8",
    }
    shown = {r["file"].rpartition("/")[2]: r["status"] for r in sessions.preview(sessions.read(spark, str(tmp_path), "claude-code", "0", 1.0)).collect()}
    assert shown["a.jsonl"] == "ready" and shown["bad.jsonl"] == "rejected"


def item(**payload):
    return {"type": "response_item", "timestamp": "2026-01-02T10:00:00Z", "payload": payload}


def test_codex(spark, tmp_path):
    write(tmp_path / "r.jsonl", [
        {"type": "session_meta", "payload": {"id": "c1", "originator": "codex_cli", "model_provider": "OpenAI"}},
        {"type": "turn_context", "payload": {"model": "g", "effort": "low", "turn_id": "t"}},
        item(type="message", role="user", content=[{"type": "input_text", "text": "hello there"}, {"type": "input_image"}]),
        item(type="function_call", name="shell", call_id="x", arguments='{"cmd":"ls"}'),
        item(type="function_call_output", call_id="x", output="files"),
        {"type": "turn_context", "payload": {"model": "h"}},
        item(type="reasoning", summary=[{"text": "think"}]),
        {"type": "event_msg", "payload": {"type": "token_count", "rate_limits": {"plan_type": "plus"}}},
        {"type": "event_msg", "payload": {"type": "turn_aborted", "reason": "interrupted"}},
    ])
    write(tmp_path / "fork.jsonl", [
        {"type": "session_meta", "payload": {"id": "c5", "originator": "codex_cli", "forked_from_id": "c1"}},
        {"type": "session_meta", "payload": {"id": "c1", "originator": "codex_cli"}},
        item(type="message", role="user", content=[{"type": "input_text", "text": "copied"}]),
        {"type": "turn_context", "payload": {"model": "g", "turn_id": "c6"}},
        item(type="message", role="user", content=[{"type": "input_text", "text": "own"}]),
    ])
    write(tmp_path / "exec.jsonl", [{"type": "session_meta", "payload": {"id": "e1", "originator": "codex_exec"}}, item(type="message", role="user", content=[{"type": "input_text", "text": "scripted"}])])
    found, entries, rejected = read(spark, tmp_path, "codex")
    assert not rejected
    by_id = {s["sessionId"]: s for s in found}
    assert by_id["c1"]["runtime"] == {"provider": "openai", "accessPath": "subscription", "evidence": "transcript"}
    assert by_id["c5"]["lineage"]["kind"] == "fork" and by_id["c5"]["lineage"]["parentSessionId"] == "c1"
    of = lambda s: [(e["kind"], e["text"], e["model"], e["effort"]) for e in entries if e["sessionId"] == s]
    assert of("c1") == [("user", "hello there", None, None), ("tool-call", '{"name":"shell","arguments":"{\\"cmd\\":\\"ls\\"}"}', "g", "low"), ("tool-result", "files", None, None), ("reasoning-summary", "think", "h", None), ("event", "[Request interrupted by user]", None, None)]
    assert of("c5") == [("user", "own", None, None)]
    assert of("e1") == [("event", "scripted", None, None)] and by_id["e1"]["title"] == "scripted"


def muse(id, kind, payload):
    return {"schema_version": 1, "id": id, "stream": {"kind": "session", "id": "m1"}, "recorded_at": 1700000000123456, "payload_type": kind, "payload": payload}


def test_muse(spark, tmp_path):
    run = lambda id, **event: muse(id, "runtime.session", {"kind": "run", "run_id": "i1", "event": event})
    write(tmp_path / "m1/session.jsonl", [
        muse("r0", "runtime.session.metadata", {"record": {"model_id": "mm", "provider_id": "Meta"}}),
        muse("r1", "runtime.user_intent.accepted", {"intent_id": "i1", "semantic_kind": {"kind": "chat"}, "refill_blocks": [{"kind": "text", "text": "hi"}, {"kind": "image"}]}),
        run("r2", kind="started", prompt="hi"),
        run("r3", kind="assistant_tool_calls_committed", tool_calls=[{"name": "read_file", "call_id": "c", "args": {"path": "/x", "a": 1}}]),
        run("r4", kind="tool_result_batch_committed", results=[{"tool_call_id": "c", "text": "out"}]),
        run("r5", kind="assistant_message_committed", text="bye"), {"frame": 1},
        run("r6", kind="linked", child_session_id="kid", reminder_agent_id="mem"),
    ])
    write(tmp_path / "m1/other.jsonl", ["{nope"])
    found, entries, rejected = read(spark, tmp_path, "muse")
    assert not rejected and len(found) == 1
    assert [(e["kind"], e["text"], e["timestamp"]) for e in entries] == [(k, t, 1700000000123.0) for k, t in (("user", "hi"), ("tool-call", '{"name":"read_file","arguments":{"path":"/x","a":1}}'), ("tool-result", "out"), ("assistant", "bye"), ("event", '{"spawned":"mem","sessionId":"kid"}'))]
    lines = transcripts.records(transcripts.lines(transcripts.scan(spark, str(tmp_path), "muse")))[0]
    from pyspark.sql import functions as F

    spawn = sessions.spawn_of(F.lit("kid"), lines).first()
    assert (spawn["parentEntryId"], spawn["agentType"]) == ("r6:spawn", "mem")


def test_desktop(spark, tmp_path):
    doc = {"thread": {"id": "t", "kind": "chatgpt", "title": "T"}, "page": {"order": "newest_first", "hasMore": True}, "turns": [
        {"id": "2", "startedAt": 20, "completedAt": None, "items": [{"type": "userMessage", "id": "b", "content": [{"type": "text", "text": "later"}]}]},
        {"id": "1", "startedAt": 10, "completedAt": 11, "items": [{"type": "userMessage", "id": "a", "text": "first"}, {"type": "tool", "id": "x"}, {"type": "agentMessage", "id": "c", "text": "answer"}]},
    ]}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    found = sessions.desktop(spark, str(tmp_path), "0", 1.0)
    assert [(r["kind"], r["text"], r["timestamp"]) for r in found.entries.orderBy("position").collect()] == [("user", "first", 10000.0), ("assistant", "answer", 11000.0), ("user", "later", 20000.0)]
    assert len(found.sessions.first()["coverage"]["omissions"]) == 2


def test_sidecars_and_ancestors(spark, tmp_path):
    from pyspark.sql import functions as F

    write(tmp_path / "agent-7.jsonl", [claude("k1", "user", "Do it", isSidechain=True, sessionId="s2")])
    found = sessions.read(spark, str(tmp_path), "claude-code", "0", 1.0).sessions
    meta = spark.createDataFrame([(f"file:{tmp_path}/agent-7.meta.json", '{"agentType":"x","parentAgentId":"6","spawnDepth":2,"isFork":true}')], "file string, t string").withColumn("v", F.parse_json("t"))
    line = transcripts.with_sidecars(found, meta).first()["lineage"]
    assert (line["kind"], line["parentSessionId"], line["agentType"], line["depth"]) == ("fork", "s2/agent-6", "x", 2)
    nested = spark.createDataFrame([("/r/A/subagent/B/subagent/C/session.jsonl",), ("/r/A/session.jsonl",)], "f string").select(transcripts.ancestors(F.col("f")).alias("a"))
    assert [r["a"] for r in nested.collect()] == [["B", "A"], []]


def test_head_metadata(spark, tmp_path):
    write(tmp_path / "a.jsonl", [{"x": 1}, claude("u1", "user", "hi", cwd="rel"), claude("u2", "user", "hi", cwd="/w", gitBranch="b"), claude("u3", "user", "hi", cwd="/z")])
    row = transcripts.head_metadata(transcripts.lines(transcripts.scan(spark, str(tmp_path)))).first()
    assert (row["cwd"], row["branch"], row["session"]) == ("/w", "b", "s1")


def test_strip_keeps_spawns_and_open_questions(spark):
    def e(k, kind, text, call=None):
        return ("s", k, f"e{k}", call, kind, text)

    rows = [
        e(0, "user", "go"), e(1, "tool-call", '{"name":"Task","input":{"description":"d"}}', "c1"), e(2, "tool-result", "github.com/o/r/pull/1", "c1"),
        e(3, "tool-call", '{"name":"request_user_input_async","input":{"questions":[{"question":"q?"}]}}', "c2"),
        e(4, "tool-call", '{"name":"request_user_input_async","input":{"questions":[{"question":"r?"}]}}', "c3"),
        e(5, "user", "send_user_message_question_reply c3 yes"), e(6, "tool-call", '{"name":"Read"}', "c4"),
    ]
    df = spark.createDataFrame(rows, "sid string, position int, id string, callId string, kind string, text string")
    kept = activity.strip(df, "sid")
    assert [(r["id"], r["kind"], r["text"]) for r in kept.orderBy("position").collect()] == [("e0", "user", "go"), ("e1", "event", '{"spawned":"Task","description":"d"}'), ("e3", "event", '{"asked":["q?"]}'), ("e5", "user", rows[5][5])]
    refs = activity.dropped_references(df, kept, "sid").first()
    assert ([r["ref"] for r in refs["references"]], refs["cut"]) == (["o/r#1"], 0)


def test_codex_answers(spark):
    call = '{"name":"request_user_input","arguments":"{\\"questions\\":[{\\"id\\":\\"q1\\",\\"question\\":\\"Which?\\"}]}"}'
    rows = [("s", 0, "e0", "c", "tool-call", call), ("s", 1, "e1", "c", "tool-result", '{"answers":{"q1":{"answers":["A","B"]},"q2":{"answers":[]}}}'), ("s", 2, "e2", "z", "tool-result", "User has approved your plan. Go"), ("s", 3, "e3", "c", "tool-result", "plain")]
    df = spark.createDataFrame(rows, "sid string, position int, id string, callId string, kind string, text string")
    found = {r["id"]: (r["kind"], r["text"]) for r in activity.person_results(df, "sid").collect()}
    assert found["e1"] == ("user", 'The user answered: "Which?"="A, B"')
    assert found["e2"][0] == "event" and found["e3"][0] == "tool-result"


@pytest.mark.parametrize("times", [2])
def test_stream_is_idempotent(spark, tmp_path, times):
    write(tmp_path / "in/a.jsonl", [claude("u1", "user", "one")])
    run = lambda: ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "ck"), "claude-code", "0000", 1.0).awaitTermination()
    for _ in range(times):
        run()
    tables = ingest.Tables(spark, str(tmp_path / "store"))
    assert [(r["revision"]) for r in tables.read("sessions").collect()] == [1]
    write(tmp_path / "in/b.jsonl", [claude("u1", "user", "one"), claude("a1", "assistant", "two")])
    run()
    assert [r["revision"] for r in tables.read("sessions").collect()] == [2]
    assert [(r["position"], r["text"]) for r in tables.read("entries").orderBy("position").collect()] == [(0, "one"), (1, "two")]
    assert [r["outcome"] for r in tables.read("outcomes").collect()] == ["stored"]


def test_a_batch_costs_what_it_changes(spark, tmp_path, monkeypatch):
    """Segments of equal batches stay equal while the store grows; merges bound their number; replaced ones go."""
    import os

    monkeypatch.setattr(ingest, "BUCKETS", 2)
    store, tables = tmp_path / "store", ingest.Tables(spark, str(tmp_path / "store"), fan=3)
    size = lambda name: sum(f.stat().st_size for f in (store / f"segments/entries/segment={name}").rglob("*.parquet"))
    write(tmp_path / "0/a.jsonl", [claude(f"u{k}", "user", " ".join(str(hash((k, j))) for j in range(200)), sessionId="big") for k in range(300)])
    for k in range(1, 7):
        write(tmp_path / f"{k}/a.jsonl", [claude("u1", "user", "words of one length"), claude("a1", "assistant", f"answer {k // 2}")])
    sizes = []
    for batch in range(7):
        found = sessions.read(spark, str(tmp_path / str(batch)), "claude-code", "0000", float(batch))
        for _ in range(2):  # repeated: nothing happens
            ingest.store_batch(tables, found, batch)
        names = [n for _, n in tables.manifest()["segments"]]
        sizes.append(size(f"{batch:012d}"))
        assert len(names) <= 4
    assert sorted(r["revision"] for r in tables.read("sessions").collect()) == [1, 4]
    assert tables.read("entries").count() == 302 and tables.read("entries").where("text = 'answer 3'").count() == 1
    assert sizes[0] > 50 * sizes[1] and max(x for x in sizes[1:] if x) < 1.2 * min(x for x in sizes[1:] if x)
    assert len(os.listdir(store / "segments/entries")) <= len(names) + 3 and not [w for w in os.listdir(store / "work") if not w.startswith(".")]
    assert sum(map(size, names)) < 1.1 * sizes[0]  # superseded entries are gone from what was merged


def test_files_of_a_session_arrive_by_time(spark):
    from threadloom.sources.sessions import Imported

    e = "file string, id string, callId string, kind string, text string, timestamp double, sourceRef string, model string, effort string, position int"
    found = Imported(
        spark.createDataFrame([(f, "0", "codex", "s", f, 1.0) for f in ("b", "a", "c")], "file string, sourceId string, source string, sessionId string, title string, capturedAt double"),
        spark.createDataFrame([(f, f, None, "user", f, 1.0, "r", None, None, 0) for f in ("a", "b", "c")], e), None,
    )
    times = spark.createDataFrame([("a", 30), ("b", 10), ("c", 10)], "file string, t long").select("file", F.timestamp_seconds("t").alias("modified"))
    assert [r["file"] for r in ingest.captures(found, times).orderBy("arrival").collect()] == ["b", "c", "a"]


def test_collector_cache_and_totals(spark):
    files = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 2, 1), ("d", 1, 1)], "file string, size long, modified long")
    cache = spark.createDataFrame([("a", 1, 1, "x", "imported", 900), ("b", 1, 1, "y", "held", 900), ("c", 1, 1, "x", "imported", 900), ("d", 1, 1, "x", "imported", 100)], "file string, size long, modified long, routing string, outcome string, at long")
    read, good = transcripts.cached(files, cache, F.lit("x"), now=1000, revalidate=500)
    assert sorted(r["file"] for r in read.collect()) == ["b", "c", "d"] and [r["file"] for r in good.collect()] == ["a"]
    results = spark.createDataFrame([(1, 2, 0, 0, 1), (3, 0, 1, 0, 0)], "imported int, unchanged int, held int, dropped int, failed int")
    assert tuple(transcripts.scan_totals(results).first()) == (4, 2, 1, 0, 1)
    assert tuple(transcripts.scan_totals(results.limit(0)).first()) == (0, 0, 0, 0, 0)
    groups = transcripts.collection_groups(spark.createDataFrame([("z", "codex", "/d", 1), ("y", "muse", "/d", 2), ("x", "codex", "/d", 3)], "id string, source string, directory string, seq int"))
    assert [(r["source"], r["collectors"]) for r in groups.collect()] == [("codex", ["z", "x"]), ("muse", ["y"])]
    pairs = lambda *rows: spark.createDataFrame(rows, "projectId string, root string")
    remotes = spark.createDataFrame([("/b", "git@github.com:O/R.git"), ("/a", "https://example.org/x/y")], "root string, url string")
    found = transcripts.project_map(pairs(("p", "/b"), ("p", "/a"), ("q", "/q")), pairs(("p", "/b"), ("p", "/w")), pairs(("q", "/old")), remotes).collect()
    assert [tuple(r) for r in found] == [("p", ["/a", "/b"], ["/w"], None, ["o/r"]), ("q", ["/q"], None, ["/old"], [])]


def test_remote_stores(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from threadloom.sources import remote

    class Store(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            start = int(asked.get("cursor") or 0)
            items = [{"id": f"s{k}", "title": "t", "digest": "d", "revision": k} for k in range(start, min(250, start + asked["limit"]))]
            body = json.dumps({"items": items} | ({"nextCursor": str(start + asked["limit"])} if start + asked["limit"] < 250 else {})).encode()
            self.send_response(200 if self.headers["Authorization"] == "Bearer k" else 401)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(remote.RemoteListing)
    listed = spark.read.format("remote_listing").option("stores", json.dumps([url])).option("token", "k").load()
    assert sorted(r["revision"] for r in listed.collect()) == list(range(250))
    stores = spark.createDataFrame([(url,), ("http://127.0.0.1:9",)], "store string")
    found = remote.search(stores, "q", limit=3, token="k", wait=5).collect()
    assert sorted(r["id"] for r in found if r["error"] is None) == ["s0", "s1", "s2"] and sum(r["error"] is not None for r in found) == 1
    server.shutdown()


def test_exact_tokens(spark):
    import os

    import tiktoken

    from threadloom.functions import tokens
    from threadloom.operators import chunks

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary file")
    text = "The river's water, 12345 houses\n\n and größer <|endoftext|> " * 40
    count = tokens.counter(path)
    assert 0 < count(text) < len(text) and count("") == 0
    df = spark.createDataFrame([("s", 0, "e", "r", "user", text), ("s", 1, "f", "r", "user", "kurz")], "sid string, position int, id string, sourceRef string, kind string, text string")
    cut = chunks.chunk(df, "sid", budget=64, count=count).orderBy("position").collect()
    assert "".join(c["text"] for c in cut if c["entryId"] == "e") == text
    assert all(c["tokens"] == count(c["text"]) <= 64 for c in cut)
    assert df.select(tokens.token_count(F.col("text"), path).alias("n")).first()["n"] == count(text)
    assert tiktoken.__name__
