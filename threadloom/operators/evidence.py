"""Evidence of where a session worked: paths to projects, projects to organizations, anchored to kept entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.references import references, repository_slug
from ..functions.shell import tool_access

PERSONAL = "personal"
FIELDS = ("writes", "reads", "repositories", "references")
#: Rows and bytes of a project's roots or repositories up to which they are broadcast.
BROADCAST, BROADCAST_BYTES = 50_000, 32 << 20


def small(dimension: DataFrame) -> DataFrame:
    """A dimension with a broadcast hint if it is small, in rows and in bytes; else as it is, so that the join shuffles."""
    sizes = dimension.limit(BROADCAST + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).first()
    return F.broadcast(dimension) if sizes["rows"] <= BROADCAST and sizes["bytes"] <= BROADCAST_BYTES else dimension


def prefixes(path: Column) -> Column:
    """A path and all folders above it, but the root."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))).otherwise(F.array().cast("array<string>"))


def to_project(paths: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """Adds projectId and root of the longest root (projectId, root) that holds each path; null outside all roots.

    A containment join without a loop over pairs: a path's folders are exploded and joined with roots by
    equality. Paths are judged once however often they occur.
    """
    places = paths.select(path).distinct().select(path, F.explode(prefixes(F.col(path))).alias("root"))
    held = small(roots.where(F.col("root") != "/").groupBy("root").agg(F.min("projectId").alias("projectId")))
    longest = places.join(held, "root").groupBy(path).agg(F.max_by(F.struct("projectId", "root"), F.length("root")).alias("o")).select(path, "o.*")
    return paths.join(longest, path, "left")


def containers(roots: DataFrame) -> DataFrame:
    """Roots that hold another project's root."""
    inner = roots.select(F.col("projectId").alias("other"), F.col("root").alias("inner"), F.explode(prefixes(F.col("root"))).alias("root")).where(F.col("inner") != F.col("root"))
    return roots.join(inner, "root").where(F.col("projectId") != F.col("other")).select("root").distinct()


def anchors(entries: DataFrame, kept: DataFrame, *keys: str) -> DataFrame:
    """Adds ``anchor``: the kept entry at or before each entry, or the first kept one for entries before it."""
    flagged = entries.join(kept.select(*keys, F.col("id")).withColumn("kept", F.lit(True)), [*keys, "id"], "left")
    mark = F.when(F.col("kept"), F.col("id"))
    session = Window.partitionBy(*keys)
    before = F.last(mark, ignorenulls=True).over(session.orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.min_by(mark, F.when(F.col("kept"), F.col("position"))).over(session)
    return flagged.withColumn("anchor", F.coalesce(before, first)).drop("kept")


def collect(entries: DataFrame, kept: DataFrame, roots: DataFrame, repositories: DataFrame, *keys: str) -> DataFrame:
    """(keys, anchor, field, key, n): how often each project is written or read, and repositories changed or linked.

    ``entries`` has a cwd; ``repositories`` is (projectId, repository). A path counts once a call; reads leave out
    what the call writes and bare container roots. A repository that a project pushes to counts as a write there.
    Writes outside all projects have the field ``unattributed``.
    """
    at = anchors(entries, kept, *keys)
    spoken = at.select(*keys, "anchor", F.explode(references(F.col("text"))).alias("r")).where(F.col("r.integration") == "github")
    linked = spoken.select(*keys, "anchor", F.lit("references").alias("field"), repository_slug(F.col("r.ref")).alias("key")).where("key is not null")
    calls = at.where(F.col("kind") == "tool-call").select(*keys, "anchor", "id", tool_access(F.col("text"), F.col("cwd")).alias("a"))
    touched = lambda field, column: calls.select(*keys, "anchor", "id", F.lit(field).alias("field"), F.explode(F.array_distinct(column)).alias("path"))
    paths = touched("writes", F.col("a.writes")).unionByName(touched("reads", F.array_except("a.paths", "a.writes")))
    bare = small(containers(roots)).select(F.col("root").alias("path"), F.lit("reads").alias("field"))
    owned = to_project(paths.join(bare, ["path", "field"], "left_anti"), roots)
    by_path = owned.where((F.col("projectId").isNotNull()) | (F.col("field") == "writes")).select(*keys, "anchor", F.when(F.col("projectId").isNull(), F.lit("unattributed")).otherwise(F.col("field")).alias("field"), F.coalesce("projectId", F.lit("")).alias("key"))
    pushed = small(repositories.groupBy("repository").agg(F.max("projectId").alias("projectId")))
    remote = calls.select(*keys, "anchor", "id", F.explode(F.array_distinct("a.repositories")).alias("repository")).join(pushed, "repository", "left")
    by_repository = remote.select(*keys, "anchor", F.when(F.col("projectId").isNull(), F.lit("repositories")).otherwise(F.lit("writes")).alias("field"), F.coalesce("projectId", "repository").alias("key"))
    return linked.unionByName(by_path).unionByName(by_repository).groupBy(*keys, "anchor", "field", "key").agg(F.count(F.lit(1)).alias("n"))


def by_organization(evidence: DataFrame, organizations: DataFrame, repositories: DataFrame, *keys: str, entries: DataFrame | None = None) -> DataFrame:
    """(keys, organization, writes, reads, references), of the anchors in ``entries`` (keys, id) if given.

    ``organizations`` is (projectId, organization); what belongs to none is personal.
    """
    some = evidence if entries is None else evidence.join(entries.select(*keys, F.col("id").alias("anchor")), [*keys, "anchor"], "left_semi")
    some = some.where(F.col("field").isin(*FIELDS))
    pushed = small(repositories.groupBy("repository").agg(F.max("projectId").alias("pushedBy")))
    project = F.when(F.col("field").isin("writes", "reads"), F.col("key")).otherwise(F.col("pushedBy"))
    owned = some.join(pushed, some["key"] == pushed["repository"], "left").withColumn("projectId", project)
    named = owned.join(small(organizations.groupBy("projectId").agg(F.min("organization").alias("organization"))), "projectId", "left")
    of = lambda *fields: F.sum(F.when(F.col("field").isin(*fields), F.col("n")).otherwise(0)).alias(fields[0])
    return named.groupBy(*keys, F.coalesce("organization", F.lit(PERSONAL)).alias("organization")).agg(of("writes", "repositories"), of("reads"), of("references"))


def evidenced(organizations: DataFrame, starts: DataFrame, *keys: str) -> DataFrame:
    """(keys, organizations): those with any evidence, or in whose project the session started; never personal."""
    some = organizations.where((F.col("writes") > 0) | (F.col("reads") > 0) | (F.col("references") > 0)).select(*keys, "organization")
    return some.unionByName(starts.select(*keys, "organization")).where(F.col("organization") != PERSONAL).groupBy(*keys).agg(F.array_sort(F.collect_set("organization")).alias("organizations"))


def project_tags(evidence: DataFrame, starts: DataFrame, *keys: str, limit: int = 20) -> DataFrame:
    """(keys, tag, n, rank): ``project:`` tags by how much the session wrote and read there; its start counts once."""
    touched = evidence.where(F.col("field").isin("writes", "reads")).select(*keys, F.col("key").alias("projectId"), "n")
    counted = touched.unionByName(starts.select(*keys, "projectId", F.lit(1).cast("long").alias("n"))).groupBy(*keys, "projectId").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "projectId"))).where(F.col("rank") <= limit)
    return ranked.select(*keys, F.concat(F.lit("project:"), "projectId").alias("tag"), "n", "rank").where(F.length("tag") <= 120)


def concepts(entries: DataFrame, dimension: DataFrame, roots: DataFrame, *keys: str, limit: int = 20, prefix: str = "concept:") -> DataFrame:
    """(keys, tag, n, rank): concepts (path, concept) of the files that tool calls name, most named first."""
    named = entries.where(F.col("kind") == "tool-call").select(*keys, "position", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\w@.~/-]+\.[A-Za-z]{1,6}\b"), F.lit(0))).alias("k", "path"))
    owned = to_project(named, roots)
    inside = F.when(F.col("root").isNotNull(), F.substr("path", F.length("root") + 2)).otherwise(F.col("path"))
    counted = owned.withColumn("path", inside).join(small(dimension), "path").groupBy(*keys, "concept").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("position", "k")).alias("first"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first", "concept"))).where(F.col("rank") <= limit)
    return ranked.select(*keys, F.concat(F.lit(prefix), "concept").alias("tag"), "n", "rank").where(F.length("tag") <= 120)


def collector_of(sessions: DataFrame, collectors: DataFrame, key: str = "id") -> DataFrame:
    """Adds ``collector``: whose root holds the session's cwd, the longest first, then the first declared; else the first catch-all.

    ``collectors`` is (collector, declared, root); a catch-all has no root.
    """
    places = sessions.select(key, "cwd", F.explode_outer(prefixes(F.col("cwd"))).alias("root"))
    matched = places.join(small(collectors.where("root is not null")), "root").groupBy(key).agg(F.min_by("collector", F.struct(-F.length("root"), F.col("declared"))).alias("own"))
    rest = collectors.where("root is null").groupBy().agg(F.min_by("collector", "declared").alias("rest")).first()["rest"]
    return sessions.join(matched, key, "left").withColumn("collector", F.coalesce("own", F.lit(rest))).drop("own")
