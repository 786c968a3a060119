"""Redaction: exact spans, their echoes, and the clauses around names, merged and replaced."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REASONS = ("coworker", "career", "personal-life", "investor", "secret", "other")
#: Talk that is personal whatever the organization.
PERSONAL_ONLY = ("career", "investor", "coworker")
#: Words of a run that counts as an echo.
ECHO = 4

Span = tuple[int, int, str]


def _folded(text: str) -> tuple[str, list[int]]:
    """Lower case with white space collapsed, and where each of its characters stood."""
    out, at = [], []
    for m in re.finditer(r"\s+|\S", text):
        c = m[0]
        low = " " if c.isspace() else c.lower()
        out.append(low if len(low) == 1 else c)
        at.append(m.start())
    return "".join(out), at


def _places(text: str, needle: str) -> Iterator[int]:
    """Where the needle begins, overlapping places included."""
    at = text.find(needle)
    while at >= 0:
        yield at
        at = text.find(needle, at + 1)


def _clauses(text: str, name: str) -> Iterator[tuple[int, int]]:
    """The clause around each place of a name: between the sentence marks before and after it."""
    edges = [0, *(m.end() for m in re.finditer(r"[.!?;\n]", text)), len(text) + 1]
    for m in re.finditer(rf"\b{re.escape(name)}\b", text, re.I):
        low, high = next((a, b) for a, b in pairwise(edges) if a <= m.start() < b)
        yield low + len(text[low : m.start()]) - len(text[low : m.start()].lstrip()), min(high - 1, len(text))


def _spans(text: str, redactions: Sequence[dict], roster: Sequence[str]) -> Iterator[Span]:
    folded, at = _folded(text)
    for r in redactions:
        wanted, reason = r.get("text"), r.get("reason")
        if not wanted:
            continue
        if not r.get("echoOnly"):
            yield from ((k, k + len(wanted), reason) for k in _places(text, wanted))
        echo = _folded(wanted)[0].strip()
        run = echo.split()
        for needle in {echo, *(" ".join(run[k : k + ECHO]) for k in range(len(run) - ECHO + 1))} - {""}:
            yield from ((at[k], at[k + len(needle) - 1] + 1, reason) for k in _places(folded, needle))
        for name in roster if reason == "coworker" else ():
            if re.search(rf"\b{re.escape(name)}\b", wanted, re.I):
                yield from ((low, high, reason) for low, high in _clauses(text, name))


def redact(text: str | None, redactions: Sequence[dict], roster: Sequence[str] = ()) -> str | None:
    """The text with every span replaced; spans that overlap or touch merge, and name each reason once."""
    if text is None:
        return None
    order = {r.get("reason"): -k for k, r in reversed([*enumerate(redactions)])}
    merged: list[list] = []
    for low, high, reason in sorted(_spans(text, redactions, roster), key=lambda s: (s[0], -order[s[2]])):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
            merged[-1][2].setdefault(reason)
        else:
            merged.append([low, high, {reason: None}])
    out, at = [], 0
    for low, high, reasons in merged:
        out += [text[at:low], f"[redacted: {', '.join(reasons)}]"]
        at = high
    return "".join(out) + text[at:]


def redacted(text: Column, redactions: Column, roster: Column) -> Column:
    """Arrow UDF over (text, array<struct<text, reason, echoOnly>>, array<string>)."""
    return _redacted(text, redactions, roster)


@F.pandas_udf(T.StringType())
def _redacted(texts: pd.Series, redactions: pd.Series, rosters: pd.Series) -> pd.Series:
    rows = lambda v: [] if v is None else [x if isinstance(x, dict) else x.asDict() for x in v]
    return pd.Series([redact(t, rows(r), list(n) if n is not None else []) for t, r, n in zip(texts, redactions, rosters, strict=True)])
