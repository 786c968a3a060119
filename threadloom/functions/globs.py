"""Folder globs: which working directories are collected."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def folder_glob(entry: str, home: str) -> str:
    """A glob in normal form: home expanded, no leading ``./`` or trailing ``/**``; a relative one matches at any depth."""
    glob = entry.strip()
    if glob == "~" or glob.startswith("~/"):
        glob = re.sub(r"([*?\[\]{}\\!])", r"\\\1", home) + glob[1:]
    glob = re.sub(r"(?:/+|/\*\*)+$", "", re.sub(r"^(?:\./)+", "", glob))
    if glob in ("", "."):
        raise ValueError(f"folder glob {entry!r} is empty or names every folder")
    if ".." in glob.split("/"):
        raise ValueError(f"folder glob {entry!r} has a .. segment")
    return glob if glob.startswith(("/", "**")) else f"**/{glob}"


def pattern(glob: str) -> str:
    """A regular expression for the folder itself or anything below it, in the dialect that Python and Java share."""
    out, at = "", 0
    for m in re.finditer(r"\*\*/|\*\*|\*|\?|\[[^\]]*\]|\{[^}]*\}|\\.", glob):
        out += re.escape(glob[at : m.start()])
        token, at = m[0], m.end()
        if token == "**/":
            out += "(?:.*/)?"
        elif token == "**":
            out += ".*"
        elif token in "*?":
            out += "[^/]" + ("*" if token == "*" else "")
        elif token[0] == "[":
            out += "[" + ("^" if token[1:2] in ("!", "^") else "") + token[1:-1].lstrip("!^").replace("\\", "\\\\") + "]"
        elif token[0] == "{":
            out += "(?:" + "|".join(map(re.escape, token[1:-1].split(","))) + ")"
        else:
            out += re.escape(token[1])
    return f"^{out}{re.escape(glob[at:])}(?:/.*)?$"


def exclude_glob(entry: str, home: str) -> str:
    """A glob that leaves folders out; one that covers home or everything is refused."""
    glob = folder_glob(entry, home)
    if any(re.match(pattern(glob), p) for p in (home, "/")):
        raise ValueError(f"exclude glob {entry!r} covers every session")
    return glob


def allowed(cwd: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a directory is collected: exclusion wins, and without inclusions all others are."""
    any_of = lambda globs: F.regexp_like(cwd, F.lit("|".join(map(pattern, globs)))) if globs else F.lit(False)
    return ~any_of(exclude) & (any_of(include) if include else F.lit(True))
