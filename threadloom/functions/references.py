"""Links to items of integrations, repositories and provenance, as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Integration:
    """An integration's key; one that isn't known natively says the link prefix of its items."""

    key: str
    prefix: str | None = None


INTEGRATIONS = (Integration("github"), Integration("linear"))

# How the sites form addresses. Host, then segments of the path.
GITHUB, ITEMS, COMMIT = "github.com/", ("pull", "issues"), "commit"
LINEAR, ISSUE = "linear.app/", "issue"
#: What stands before owner/name in a remote or an address.
ORIGINS = tuple(f"{scheme}{www}github.com{mark}" for scheme in ("https://", "http://", "ssh://git@", "git@", "") for www in ("www.", "") for mark in (":", "/"))
_NAME = r"^[A-Za-z0-9_.-]+$"


def _addresses(text: Column, host: str, segments: int) -> Column:
    """Path segments that follow each mention of a host; the last holds all that is left."""
    after = F.split(text, rf"\Q{host}\E", -1)
    return F.transform(F.slice(after, 2, F.greatest(F.size(after) - 1, F.lit(0))), lambda path: F.split(path, "/", segments))


def _leading(segment: Column, characters: str) -> Column:
    """What a segment begins with of the given characters; empty if it is null."""
    return F.coalesce(F.regexp_extract(segment, f"^[{characters}]*", 0), F.lit(""))


def _known(refs: Column) -> Column:
    return F.filter(refs, lambda r: r.isNotNull())


def _links(text: Column, integration: Integration) -> Column:
    """Canonical refs of one integration, one for each mention: items, then commits, each in order of place."""
    at = lambda path, k: F.get(path, F.lit(k))
    if integration.prefix:
        tails = F.transform(_addresses(text, integration.prefix, 1), lambda path: F.rtrim(F.left(_leading(at(path, 0), r"\w.~#/-"), F.lit(300)), F.lit("./")))
        return F.filter(tails, lambda m: m != "")
    if integration.key == "github":
        paths = _addresses(text, GITHUB, 5)
        named = lambda path: at(path, 0).rlike(_NAME) & at(path, 1).rlike(_NAME)
        slug = lambda path: F.lower(F.concat(at(path, 0), F.lit("/"), at(path, 1)))

        def item(path: Column) -> Column:
            number = _leading(at(path, 3), "0-9")
            return F.when(named(path) & at(path, 2).isin(*ITEMS) & (number != ""), F.concat(slug(path), F.lit("#"), number))

        def commit(path: Column) -> Column:
            whole = _leading(at(path, 3), r"\w")  # longer or other than a hash, it is none
            return F.when(named(path) & (at(path, 2) == COMMIT) & F.length(whole).between(7, 40) & (_leading(whole, "0-9a-f") == whole), F.concat(slug(path), F.lit("@"), F.left(whole, F.lit(7))))

        return F.concat(_known(F.transform(paths, item)), _known(F.transform(paths, commit)))
    if integration.key == "linear":

        def issue(path: Column) -> Column:
            team, number = F.substring_index(at(path, 2), "-", 1), _leading(F.get(F.split(at(path, 2), "-", 2), F.lit(1)), "0-9")
            fits = at(path, 0).rlike("^[A-Za-z0-9_-]+$") & (at(path, 1) == ISSUE) & team.rlike("^[A-Za-z][A-Za-z0-9]*$") & (number != "")
            return F.when(fits, F.upper(F.concat(team, F.lit("-"), number)))

        return _known(F.transform(_addresses(text, LINEAR, 4), issue))
    return F.array().cast("array<string>")


def references(text: Column, integrations: tuple[Integration, ...] = INTEGRATIONS) -> Column:
    """array<struct<integration, ref>>: every mention in the text, integration by integration."""
    named = lambda i: F.transform(_links(text, i), lambda r: F.struct(F.lit(i.key).alias("integration"), r.alias("ref")))
    lists = [named(i) for i in integrations]
    return F.concat(*lists) if lists else F.array().cast("array<struct<integration:string,ref:string>>")


def repository_slug(value: Column) -> Column:
    """owner/name in lower case, of a URL, a remote, a slug or an item in the repository; null if it is none."""
    rest = F.coalesce(*[F.when(F.startswith(value, F.lit(o)), F.substr(value, F.lit(len(o) + 1))) for o in ORIGINS], value)
    segments = F.split(rest, "/", 3)
    owner, name = F.get(segments, F.lit(0)), F.get(F.split(F.get(segments, F.lit(1)), "[#@?]", 2), F.lit(0))
    bare = F.when(F.endswith(name, F.lit(".git")) & (F.length(name) > 4), F.left(name, F.length(name) - 4)).otherwise(name)
    return F.when(owner.rlike(_NAME) & name.rlike(_NAME), F.lower(F.concat(owner, F.lit("/"), bare)))


def repository_of(value: str) -> str | None:
    """``repository_slug`` of one string."""
    rest = next((value[len(o) :] for o in ORIGINS if value.startswith(o)), value)
    owner, _, path = rest.partition("/")
    name = re.split("[#@?/]", path, maxsplit=1)[0]
    if not (re.match(_NAME, owner) and re.match(_NAME, name)):
        return None
    return f"{owner}/{name.removesuffix('.git') or name}".lower()


def provenance(repository: Column, branch: Column) -> Column:
    """References to a session's repository and, unless detached, to its branch."""
    slug = F.when(F.contains(repository, F.lit("github.com")), repository_slug(repository))
    tree = F.when(branch.isNotNull() & (branch != "HEAD"), F.concat(slug, F.lit("/tree/"), branch))
    refs = F.filter(F.array_compact(F.array(slug, tree)), lambda r: F.length(r) <= 300)
    return F.transform(refs, lambda r: F.struct(F.lit("github").alias("integration"), r.alias("ref")))
