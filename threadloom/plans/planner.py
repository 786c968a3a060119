"""Planning of sessions with a model: prompt text, answers, the sensitivity pass, and recording.

``decide`` is the model: it gets a prompt and returns text. All that comes from it passes ``validate``; a second
pass shows it each part as it would publish, and can only take away. Failures count as a refusal to publish.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from .validate import PERSONAL, Context, Verdict, parse_answer, validate

Decide = Callable[[str], str]
CLIP = 400


def render(context: Context, kinds: list[str], before: int = 3) -> str:
    """The entries to plan, numbered, after a few clipped ones for context, with the evidence of each."""
    lines = []
    for k in range(max(0, context.start - before), context.through + 1):
        id, text = context.entries[k]
        shown = text if k >= context.start else text[:CLIP] + ("…" if len(text) > CLIP else "")
        where = ", ".join(sorted(context.evidence.get(id, ())))
        lines.append(f"E{k} {kinds[k]}{f' [{where}]' if where else ''}{' (already planned)' if k < context.start else ''}: {shown}")
    return "\n".join(lines)


def charter_key(*parts: str) -> str:
    """What a plan was made under: prompts and model. Plans made under another are due again."""
    return hashlib.sha256(json.dumps(parts, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:32]


def published(plan: dict, context: Context) -> Iterator[tuple[list[str], list[int]]]:
    """(organizations, positions) of each part that would publish."""
    out = {p["entryId"] for p in plan["prune"]} | set(plan["sensitive"]) | set(plan["heldForReview"])
    for part in plan["parts"]:
        going = [o for o in part["organizations"] if o != PERSONAL]
        kept = [k for k in range(context.at[part["firstEntryId"]], context.at[part["lastEntryId"]] + 1) if context.entries[k][0] not in out]
        if going and kept:
            yield going, kept


def read_sensitivity(text: str, inside: set[int]) -> tuple[str | None, list[dict]]:
    """(why the part is held or None, redactions) of an answer; whatever can't be read holds the part."""
    low, high = text.find("{"), text.rfind("}")
    try:
        answer = json.loads(text[low : high + 1]) if 0 <= low < high else None
    except ValueError:
        answer = None
    if not isinstance(answer, dict):
        return "unreadable", []
    if answer.get("hold") is True:
        return PERSONAL, []
    found = []
    for r in answer["redactions"] if isinstance(answer.get("redactions"), list) else []:
        at = r.get("entry") if isinstance(r, dict) else None
        at = int(at.removeprefix("E")) if isinstance(at, str) and re.fullmatch(r"E?\d+", at) else at
        if at not in inside or isinstance(at, bool) or not isinstance(r.get("text"), str) or not r["text"]:
            return "unreadable", []
        found.append({"entry": at, "text": r["text"], "reason": r["reason"] if isinstance(r.get("reason"), str) else "other"})
    return (None, found) if answer.get("hold") is False else ("unreadable", [])


def second_pass(proposal: dict, context: Context, kinds: list[str], decide: Decide) -> dict:
    """The proposal with what the sensitivity pass takes away from each part that would publish."""
    first = validate(proposal, context)
    if first.status != "valid":
        return proposal
    out = proposal | {"parts": [dict(p) for p in proposal["parts"]], "redactions": list(proposal["redactions"])}
    for going, kept in published(first.plan, context):
        shown = [k for k in kept if context.start <= k <= context.through]
        if not shown:
            continue
        part = next(p for p in out["parts"] if p["from"] <= shown[0] <= p["to"])
        prompt = f"## Part for {', '.join(going)}\n" + "\n".join(f"E{k} {kinds[k]}: {context.entries[k][1]}" for k in shown)
        try:
            why, more = read_sensitivity(decide(prompt), set(shown))
        except Exception:  # noqa: BLE001  a failed call holds the part, whatever failed
            why, more = "unreadable", []
        if why:
            part |= {"organizations": [], "continues": False, "held": PERSONAL if PERSONAL in (why, part.get("held")) else why}
        out["redactions"] += more
    return out


def plan_session(context: Context, kinds: list[str], decide: Decide, sensitivity: Decide | None = None, key: str | None = None) -> Verdict:
    """One session planned: asked, parsed, checked by the second pass, validated. Without any evidence nothing is asked."""
    whole = {"parts": [{"from": context.start, "to": context.through, "organizations": []}], "prune": [], "redactions": [], "rationale": "no evidence"}
    proposal = whole
    if context.allowed(context.start, context.through):
        proposal = parse_answer(decide(render(context, kinds)))
        if proposal is None:
            return Verdict("held", None, ["the answer is no plan"])
        if sensitivity:
            proposal = second_pass(proposal, context, kinds, sensitivity)
    context.checked = key if sensitivity else None
    return validate(proposal, context)


@dataclass
class Record:
    """A session's plan on record; its version counts changes of decisions, not of words."""

    version: int = 0
    status: str = "none"
    plan: dict | None = None
    issues: tuple[str, ...] = ()


def _decisions(plan: dict | None) -> str:
    return json.dumps([plan[k] for k in ("parts", "prune", "redactions", "throughEntryId")] if plan else None, sort_keys=True)


def record(held: Record, verdict: Verdict) -> Record:
    """The record after a verdict: a held one keeps the plan before it, a valid one replaces it."""
    if verdict.status != "valid":
        return Record(held.version, "held", held.plan, tuple(verdict.issues))
    return Record(held.version + (_decisions(held.plan) != _decisions(verdict.plan)), "valid", verdict.plan)


def plan_all(sessions: DataFrame, decide: Decide, key: str = "id") -> DataFrame:
    """(id, status, plan, issues) of sessions with their entries, organizations and evidence as JSON columns.

    A session's entries fit one planner window, so they are one row; sessions are planned where they lie.
    ``sessions`` has id, entries (array of struct id, kind, text), organizations (array), evidence (map of entry id
    to array of organizations).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                entries = [e if isinstance(e, dict) else e.asDict() for e in r["entries"]]
                evidence = {k: frozenset(v) for k, v in (r["evidence"].items() if isinstance(r["evidence"], dict) else r["evidence"] or [])}
                context = Context([(e["id"], e["text"]) for e in entries], 0, len(entries) - 1, frozenset(r["organizations"]), evidence)
                verdict = plan_session(context, [e["kind"] for e in entries], decide) if entries else Verdict("held", None, ["no entries"])
                rows.append((r[key], verdict.status, json.dumps(verdict.plan) if verdict.plan else None, list(verdict.issues)))
            yield pd.DataFrame(rows, columns=[key, "status", "plan", "issues"])

    kind = sessions.schema[key].dataType.simpleString()
    return sessions.mapInPandas(run, f"{key} {kind}, status string, plan string, issues array<string>")
