"""Plan validation, the planner's loop, and queues, by example."""

import json

import pytest

from threadloom.plans import planner, publish, queues
from threadloom.plans.validate import Context, parse_answer, validate

ENTRIES = [(f"e{k}", f"text {k}") for k in range(6)]
KINDS = ["user"] * 6


def context(**more):
    given = {"entries": ENTRIES, "start": 0, "through": 5, "organizations": frozenset({"acme", "zeta"}), "evidence": {"e0": frozenset({"acme"}), "e4": frozenset({"zeta"})}}
    return Context(**(given | more))


def part(low, high, *organizations, **more):
    return {"from": low, "to": high, "organizations": list(organizations), **more}


def proposal(*parts, **more):
    return {"parts": list(parts), "prune": [], "redactions": [], "rationale": "r"} | more


def test_valid_plan():
    got = validate(proposal(part(0, 2, "acme"), part(3, 5, "zeta", confidence=0.9), prune=[{"entry": 1, "why": "w"}]), context())
    assert got.status == "valid"
    assert [(p["firstEntryId"], p["lastEntryId"], p["organizations"]) for p in got.plan["parts"]] == [("e0", "e2", ["acme"]), ("e3", "e5", ["zeta"])]
    assert got.plan["prune"] == [{"entryId": "e1", "reason": "w"}] and got.plan["throughEntryId"] == "e5"


@pytest.mark.parametrize(
    ("plan", "issue"),
    [
        (proposal(part(0, 3, "acme"), part(3, 5, "zeta")), "overlaps"),
        (proposal(part(0, 9, "acme")), "outside"),
        (proposal(part(3, 2, "acme")), "outside"),
        (proposal(part(0, 5, "other")), "unknown organizations"),
        (proposal(part(0, 3, "zeta")), "no evidence for zeta"),
        (proposal(part(0, 2, "acme"), redactions=[{"entry": 9, "text": "x", "reason": "secret"}]), "outside the entries"),
        (proposal(part(1, 2, "acme", continues=True)), "continues the last part"),
    ],
)
def test_held_plans(plan, issue):
    got = validate(plan, context())
    assert got.status == "held" and any(issue in i for i in got.issues)


def test_bad_redaction_holds_its_part_only():
    got = validate(proposal(part(0, 2, "acme"), part(3, 5, "zeta"), redactions=[{"entry": 1, "text": "nope", "reason": "secret"}, {"entry": 4, "text": "text 4", "reason": "secret"}]), context())
    assert [p["organizations"] for p in got.plan["parts"]] == [["personal"], ["zeta"]]
    assert got.plan["heldForReview"] == ["e0", "e1", "e2"]
    assert {(r["text"], r.get("echoOnly", False)) for r in got.plan["redactions"]} == {("nope", True), ("text 4", False)}


def test_narrowing():
    plan = proposal(part(0, 2, "acme"), part(3, 5, "zeta"))
    assert [p["organizations"] for p in validate(plan, context(parent_reach=frozenset({"acme"}))).plan["parts"]] == [["acme"], ["personal"]]
    assert [p["organizations"] for p in validate(plan, context(decided_personal=True)).plan["parts"]] == [["personal"], ["personal"]]
    assert validate(proposal(part(0, 2, "acme", "personal")), context()).plan["parts"][0]["organizations"] == ["personal"]
    child = context(children=[("e1", frozenset({"zeta"}))])
    assert validate(proposal(part(0, 2, "zeta")), child).status == "valid"


def test_sticky_sensitive_and_continuation():
    first = validate(proposal(part(0, 1, "acme"), part(2, 2, sensitive=True)), context(through=2)).plan
    assert first["sensitive"] == ["e2"]
    assert validate(proposal(part(3, 5, "zeta")), context(start=3, prior=first)).plan["sensitive"] == ["e2"]
    over = context(start=3, prior=first, sensitive=frozenset({"e4"}))
    assert "kept personal as sensitive" in validate(proposal(part(3, 5, "zeta")), over).issues[0]
    opened = validate(proposal(part(0, 2, "acme")), context(through=2)).plan
    went_on = context(start=3, prior=opened, evidence={"e0": frozenset({"acme"}), "e3": frozenset({"acme"})})
    parts = validate(proposal(part(3, 5, "acme", continues=True)), went_on).plan["parts"]
    assert [(p["firstEntryId"], p["lastEntryId"]) for p in parts] == [("e0", "e5")]


def test_clipped_entries_and_personal_talk():
    assert "not shown whole" in validate(proposal(part(0, 2, "acme")), context(clipped=frozenset({"e1"}))).issues[0]
    talk = proposal(part(0, 2, "acme"), redactions=[{"entry": 1, "text": "text", "reason": "career"}])
    assert validate(talk, context()).plan["parts"][0]["organizations"] == ["acme"]
    held = validate(talk, context(hold_personal_talk=True)).plan
    assert held["parts"][0]["organizations"] == ["personal"] and held["heldForReview"] == ["e0", "e1", "e2"]


def test_answers():
    assert parse_answer('Sure: {"parts": [{"from": 0, "to": 1, "organizations": []}]} done')["redactions"] == []
    for bad in ("", "{", "{}", '{"parts": [{"from": -1, "to": 1, "organizations": []}]}'):
        assert parse_answer(bad) is None


def test_second_pass():
    said = json.dumps(proposal(part(0, 2, "acme"), part(3, 5, "zeta")))
    run = lambda answer: planner.plan_session(context(), KINDS, lambda _: said, answer, "key").plan
    clean = run(lambda _: '{"hold": false, "redactions": [{"entry": "E0", "text": "text", "reason": "secret"}]}' if True else "")
    assert clean["parts"][1]["organizations"] == ["personal"]  # its answer names an entry of another part
    assert clean["parts"][0]["organizations"] == ["acme"] and clean["checked"] == "key"
    assert [p["organizations"] for p in run(lambda _: '{"hold": true}')["parts"]] == [["personal"]] * 2
    assert all(p["sensitive"] for p in run(lambda _: '{"hold": true}')["parts"])

    def fails(_):
        raise OSError

    assert run(fails)["heldForReview"] == [f"e{k}" for k in range(6)]
    assert planner.plan_session(context(evidence={}), KINDS, fails).plan["parts"][0]["organizations"] == ["personal"]


def test_record_counts_decisions():
    verdict = validate(proposal(part(0, 2, "acme")), context())
    one = planner.record(planner.Record(), verdict)
    assert (one.version, one.status) == (1, "valid")
    assert planner.record(one, validate(proposal(part(0, 2, "acme"), rationale="other words"), context())).version == 1
    assert planner.record(one, validate(proposal(part(0, 9, "acme")), context())).status == "held"


def test_tagging_in_batches():
    sessions = [{"id": str(k)} for k in range(10)]
    calls = []

    def decide(group):
        calls.append(len(group))
        if len(group) > 4:
            return None
        return {s["id"]: {"tags": []} for s in group if s["id"] != "3" or len(group) == 1}

    assert len(queues.tag_in_batches(sessions, decide)) == 10
    assert calls[0] == 8 and 1 in calls
    assert queues.tag_in_batches(sessions, lambda _: None) == {}


def test_plan_all_and_part_snapshots(spark):
    rows = [("s", [("e0", "user", "hello secret world"), ("e1", "tool-call", "{}"), ("e2", "assistant", "ok")], ["acme"], {"e0": ["acme"]})]
    df = spark.createDataFrame(rows, "id string, entries array<struct<id:string,kind:string,text:string>>, organizations array<string>, evidence map<string,array<string>>")
    answer = json.dumps(proposal(part(0, 2, "acme")))
    row = planner.plan_all(df, lambda _: answer).first()
    assert row["status"] == "valid" and json.loads(row["plan"])["parts"][0]["organizations"] == ["acme"]
    entries = spark.createDataFrame([("s", 0, "e0", "user", "hello secret world"), ("s", 1, "e1", "tool-call", "{}"), ("s", 2, "e2", "assistant", "the SECRET  world")], "sid string, position int, id string, kind string, text string")
    parts = spark.createDataFrame([("s", "e0", "e2", ["acme"], ["e0", "e1", "e2"])], "sid string, firstEntryId string, lastEntryId string, organizations array<string>, entryIds array<string>")
    sessions = spark.createDataFrame([("s", "sess", "p1", ["project:p1", "project:p2", "run:test", "x"])], "sid string, sessionId string, projectId string, tags array<string>")
    said = spark.createDataFrame([("s", "secret world", "secret", False)], "sid string, text string, reason string, echoOnly boolean")
    made, lines = publish.snapshots(sessions, parts, entries, said, spark.createDataFrame([("acme", "p1")], "organization string, projectId string"), spark.createDataFrame([], "organization string, name string"), "sid")
    head = made.first()
    assert (head["sessionId"], head["title"], head["projectId"], head["tags"]) == ("sess#part-e0", "hello [redacted: secret]", "p1", ["project:p1", "run:test"])
    assert "2 of 3 entries" in head["omission"] and "2 redacted" in head["omission"]
    assert [r["text"] for r in lines.orderBy("position").collect()] == ["hello [redacted: secret]", "the [redacted: secret]"]
