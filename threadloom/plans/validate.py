"""Validation of a proposed plan: what a model says never sends anything where evidence doesn't allow it.

One session's plan is small and its rules depend on one another, so a session is judged as a whole, in a grouped
function; the relational pieces (positions, reach, what is published) are in ``intervals`` and ``publish``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from ..functions.redaction import PERSONAL_ONLY, REASONS

PERSONAL = "personal"
MAX_SPAN, MAX_REASON, MAX_RATIONALE = 2000, 500, 1000


@dataclass
class Context:
    """What a proposal is judged against. Positions index ``entries``; ``start`` to ``through`` were shown."""

    entries: list[tuple[str, str]]  # id, text
    start: int
    through: int
    organizations: frozenset[str]
    evidence: dict[str, frozenset[str]] = field(default_factory=dict)  # entry id: organizations with evidence there
    started: str | None = None  # the organization in whose project the session began
    children: list[tuple[str, frozenset[str]]] = field(default_factory=list)  # spawning entry id, organizations
    decided: frozenset[str] = frozenset()
    decided_personal: bool = False
    parent_reach: frozenset[str] | None = None
    prior: dict | None = None
    sensitive: frozenset[str] = frozenset()
    held: frozenset[str] = frozenset()
    clipped: frozenset[str] = frozenset()
    hold_personal_talk: bool = False
    checked: str | None = None

    def __post_init__(self):
        self.at = {id: k for k, (id, _) in enumerate(self.entries)}

    def ids(self, low: int, high: int) -> list[str]:
        return [id for id, _ in self.entries[low : high + 1]]

    def allowed(self, low: int, high: int) -> set[str]:
        """Organizations for which a range has evidence of its own, of subagents it spawned, or a person's decision."""
        inside = set(self.ids(low, high))
        found = {o for id in inside for o in self.evidence.get(id, ())} | set(self.decided) | ({self.started} if self.started else set())
        for spawn, theirs in self.children:
            if spawn in inside:
                found |= theirs
        return found - {PERSONAL}


@dataclass
class Verdict:
    status: str
    plan: dict | None = None
    issues: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def _work(organizations: Iterable[str]) -> set[str]:
    return set(organizations) - {PERSONAL}


def _range_of(part: dict, context: Context) -> tuple[int, int] | None:
    low, high = context.at.get(part["firstEntryId"]), context.at.get(part["lastEntryId"])
    return None if low is None or high is None else (low, high)


def sensitive_entries(plan: dict | None, context: Context) -> set[str]:
    """Entries that a plan keeps personal for good."""
    found = set(plan["sensitive"]) if plan else set()
    for part in plan["parts"] if plan else ():
        if part["sensitive"] and (r := _range_of(part, context)):
            found |= set(context.ids(*r))
    return found


class _Judge:
    def __init__(self, proposal: dict, context: Context):
        self.p, self.c = proposal, context
        self.issues: list[str] = []
        self.notes: list[str] = []
        prior = context.prior or {}
        self.prior_parts = prior.get("parts", [])
        self.redactions = list(prior.get("redactions", []))
        self.sensitive = set(context.sensitive) | sensitive_entries(context.prior, context)
        self.on_hold = set(context.held) | set(prior.get("heldForReview", []))
        self.why_held: dict[int, str] = {}

    def shown(self, k: int) -> bool:
        return self.c.start <= k <= self.c.through

    def holder(self, entry: int) -> int | None:
        return next((k for k, part in enumerate(self.p["parts"]) if part["from"] <= entry <= part["to"]), None)

    def redaction(self, r: dict) -> None:
        """A bad redaction holds the part that it stands in, and still removes its text wherever that echoes."""
        at, text, reason = r["entry"], r.get("text") or "", r.get("reason")
        if not self.shown(at) or at >= len(self.c.entries):
            self.issues.append(f"redaction in E{at} is outside the entries planned")
            return
        id, whole = self.c.entries[at]
        part = self.holder(at)
        if reason not in REASONS:
            problem = f"its redaction in E{at} has no listed reason ({reason})"
        elif not text or len(text) > MAX_SPAN or text not in whole:
            problem = f"its redaction in E{at} does not match the entry text byte for byte"
        else:
            self.redactions.append({"entryId": id, "text": text, "reason": reason})
            if self.c.hold_personal_talk and reason in PERSONAL_ONLY and part is not None and _work(self.p["parts"][part]["organizations"]):
                self.why_held.setdefault(part, f"it holds {reason} talk (E{at}), personal for every organization")
            return
        if text and len(text) <= MAX_SPAN:
            self.redactions.append({"entryId": id, "text": text, "reason": reason if reason in REASONS else "other", "echoOnly": True})
        if part is None:
            self.notes.append(f"{problem}, in no part: kept as an echo-only redaction")
        else:
            self.why_held.setdefault(part, problem)

    def part(self, k: int, part: dict, end: int) -> dict | None:
        low, high, label = part["from"], part["to"], f"part E{part['from']}-E{part['to']}"
        if low > high or not self.shown(low) or not self.shown(high):
            self.issues.append(f"{label} is outside the entries planned (E{self.c.start}-E{self.c.through})")
            return None
        if low <= end:
            self.issues.append(f"{label} overlaps the part before it")
        if k in self.why_held:
            self.notes.append(f"held {label}: {self.why_held[k]}")
        asked = [PERSONAL] if k in self.why_held else list(dict.fromkeys(part["organizations"])) or [PERSONAL]
        if strange := _work(asked) - self.c.organizations:
            self.issues.append(f"{label} names unknown organizations: {', '.join(o for o in asked if o in strange)}")
        for o in asked:
            if o in self.c.organizations and o not in self.c.allowed(low, high) and o != PERSONAL:
                self.issues.append(f"{label}: no evidence for {o} in its entries")
        unsure = PERSONAL in asked or bool(part.get("sensitive"))
        if unsure and _work(asked):
            self.notes.append(f"{label}: personal or sensitive beside an organization, kept personal")
        going = [PERSONAL] if unsure else [o for o in asked if o in self.c.organizations]
        if _work(going) and (over := [id for id in self.c.ids(low, high) if id in self.sensitive | self.on_hold]):
            self.issues.append(f"{label} covers entries kept personal as sensitive ({', '.join(over)})")
        return {
            "firstEntryId": self.c.entries[low][0], "lastEntryId": self.c.entries[high][0], "organizations": going,
            "sensitive": bool(part.get("sensitive")) or part.get("held") == PERSONAL, "confidence": part.get("confidence", 0.5), "rationale": (part.get("why") or "")[:MAX_REASON],
        }

    def continues(self, k: int, part: dict, stored: dict) -> bool:
        """The first part goes on with the prior plan's last, from its very next entry and to the same organizations."""
        if k or not part.get("continues"):
            return False
        if part["from"] != self.c.start:
            self.issues.append(f"part E{part['from']}-E{part['to']} continues the last part but does not start at E{self.c.start}")
            return False
        last, through = (self.prior_parts or [None])[-1], (self.c.prior or {}).get("throughEntryId")
        return k not in self.why_held and last is not None and self.c.start > 0 and self.c.entries[self.c.start - 1][0] == through == last["lastEntryId"] and sorted(last["organizations"]) == sorted(stored["organizations"])

    def narrow(self, part: dict) -> dict:
        """A part held to today's organizations, evidence, decisions and the parent's reach."""
        where = _range_of(part, self.c)
        allowed = self.c.allowed(*where) & self.c.organizations if where else set()
        going = [o for o in part["organizations"] if o == PERSONAL or o in allowed]
        if len(going) < len(part["organizations"]):
            self.notes.append(f"{part['firstEntryId']}: narrowed to what its evidence allows today")
        if self.c.decided_personal and _work(going):
            self.notes.append(f"{part['lastEntryId']}: personal by a person's decision")
            going = [PERSONAL]
        if self.c.parent_reach is not None and (outside := [o for o in going if o != PERSONAL and o not in self.c.parent_reach]):
            self.notes.append(f"{part['firstEntryId']}: {', '.join(outside)} is beyond the parent's reach")
            going = [o for o in going if o not in outside]
        return part | {"organizations": going or [PERSONAL]}

    def hold_talk(self, plan: dict) -> None:
        """Work parts with talk that is personal everywhere go personal, and their entries to review."""
        talk = {self.c.at.get(r["entryId"]): r["reason"] for r in reversed(plan["redactions"]) if r["reason"] in PERSONAL_ONLY}
        for part in plan["parts"] if self.c.hold_personal_talk else ():
            where = _range_of(part, self.c)
            found = where and _work(part["organizations"]) and next((talk[k] for k in range(where[0], where[1] + 1) if k in talk), None)
            if found:
                self.notes.append(f"held part {part['firstEntryId']}-{part['lastEntryId']}: it holds {found} talk, personal for every organization")
                part["organizations"] = [PERSONAL]
                plan["heldForReview"] += [id for id in self.c.ids(*where) if id not in plan["heldForReview"]]

    def run(self) -> Verdict:
        for r in self.p.get("redactions", []):
            self.redaction(r)
        said = {PERSONAL: "the sensitivity pass held it as personal", "unreadable": "the sensitivity pass could not check it"}
        for k, part in enumerate(self.p["parts"]):
            if part.get("held"):
                self.why_held.setdefault(k, said[part["held"]])
        parts, continued, end = [], None, self.c.start - 1
        for k, part in enumerate(self.p["parts"]):
            stored = self.part(k, part, end)
            if stored is None:
                continue
            end = max(end, part["to"])
            if self.continues(k, part, stored):
                continued = self.prior_parts[-1] | {"lastEntryId": stored["lastEntryId"]}
            else:
                parts.append(stored)
        pruned = {self.c.entries[p["entry"]][0]: (p.get("why") or "")[:MAX_REASON] for p in self.p.get("prune", []) if p["entry"] < len(self.c.entries)}
        for part in [continued, *parts] if continued else parts:
            if _work(part["organizations"]) and (where := _range_of(part, self.c)):
                self.issues += [f"part E{where[0]}-E{where[1]}: {id} was not shown whole to the planner" for id in self.c.ids(*where) if id in self.c.clipped and id not in pruned]
        if self.issues:
            return Verdict("held", None, self.issues, self.notes)
        prior = self.c.prior or {}
        prune = {p["entryId"]: p["reason"] for p in prior.get("prune", [])}
        prune |= {id: why for id, why in pruned.items() if self.shown(self.c.at[id])}
        every = [*self.prior_parts[:-1], continued, *parts] if continued else [*self.prior_parts, *parts]
        plan = {
            "parts": [self.narrow(p) for p in every],
            "prune": [{"entryId": id, "reason": why} for id, why in prune.items()],
            "redactions": [*{(r["entryId"], r["text"]): r for r in self.redactions}.values()],
            "rationale": (self.p.get("rationale") or prior.get("rationale") or "")[:MAX_RATIONALE],
            "throughEntryId": self.c.entries[self.c.through][0],
            "sensitive": [],
        }
        plan["sensitive"] = sorted(self.sensitive | sensitive_entries(plan, self.c), key=self.c.at.get)
        held = self.on_hold | {id for k in self.why_held for id in self.c.ids(self.p["parts"][k]["from"], self.p["parts"][k]["to"])}
        plan["heldForReview"] = sorted(held, key=lambda id: self.c.at.get(id, -1))
        self.hold_talk(plan)
        if self.c.checked and (not self.c.prior or prior.get("checked") == self.c.checked):
            plan["checked"] = self.c.checked
        return Verdict("valid", plan, [], self.notes)


def validate(proposal: dict, context: Context) -> Verdict:
    return _Judge(proposal, context).run()


def parse_answer(text: str) -> dict | None:
    """The JSON object of a model's answer, from its first brace to its last; None if that is no plan."""
    low, high = text.find("{"), text.rfind("}")
    try:
        found = json.loads(text[low : high + 1]) if 0 <= low < high else None
    except ValueError:
        return None
    parts = found.get("parts") if isinstance(found, dict) else None
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= 0
    if not isinstance(parts, list) or not all(isinstance(p, dict) and whole(p.get("from")) and whole(p.get("to")) and isinstance(p.get("organizations"), list) for p in parts):
        return None
    return {"prune": [], "redactions": [], "rationale": ""} | found
