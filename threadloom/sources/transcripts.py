"""Transcript files as tables of lines and records, and the ledger of files already read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.references import repository_slug

#: Larger files, and longer records, are rejected.
MAX_FILE, MAX_RECORD = 1 << 30, 64 << 20
#: Only so much of a file is looked at for its metadata.
HEAD = 1 << 20


def scan(spark: SparkSession, paths: str | list[str], source: str = "claude-code") -> DataFrame:
    """(file, size, modified, content) of every transcript below the paths; files that vanish meanwhile are skipped.

    Muse keeps each session in a ``session.jsonl``. Size is filtered by the source, before content is read.
    """
    name = "session.jsonl" if source == "muse" else "*.jsonl"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).option("ignoreMissingFiles", True).load(paths)
    return files.where(F.col("length") <= MAX_FILE).select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def unread(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that the ledger (file, size, modified) doesn't have just as they are."""
    return files.join(ledger.select("file", "size", "modified"), ["file", "size", "modified"], "left_anti")


#: Milliseconds after which a cached outcome is looked at again.
REVALIDATE = 600_000


def cached(files: DataFrame, cache: DataFrame, routing: Column, now: int, revalidate: int = REVALIDATE) -> tuple[DataFrame, DataFrame]:
    """(files to read, outcomes still good). ``cache`` has file, size, modified, routing, outcome and at (milliseconds).

    An outcome holds while a file's size, time and routing are as they were, and its last look is recent.
    """
    now_is = files.withColumn("routing", routing)
    good = cache.where(F.col("at") > now - revalidate)
    same = ["file", "size", "modified", "routing"]
    return now_is.join(good.select(*same), same, "left_anti"), good.join(now_is.select(*same), same, "left_semi")


def scan_totals(results: DataFrame) -> DataFrame:
    """One row: sums over all collectors of what a scan did; results has a row a collector."""
    return results.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("imported", "unchanged", "held", "dropped", "failed")])


def collection_groups(collectors: DataFrame) -> DataFrame:
    """(source, directory, collectors, first): collectors (id, source, directory, seq) that scan the same place, in the order declared."""
    grouped = collectors.groupBy("source", "directory").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda c: c["id"]).alias("collectors"), F.min("seq").alias("first"))
    return grouped.orderBy("first")


def project_map(roots: DataFrame, worktrees: DataFrame, former: DataFrame, remotes: DataFrame) -> DataFrame:
    """(projectId, roots, worktrees, formerRoots, repositories) of the projects of one machine, each list sorted.

    ``roots``, ``worktrees`` and ``former`` are (projectId, root) of the collectors that aren't for everything;
    ``remotes`` is (root, url), of which repositories of the known host count. Worktrees that are roots are left out.
    """
    listed = lambda df, name: df.groupBy("projectId").agg(F.array_sort(F.collect_set("root")).alias(name))
    slug = F.when(F.contains(F.col("url"), F.lit("github.com")), repository_slug(F.col("url")))
    of = roots.join(remotes.select("root", slug.alias("repository")), "root").groupBy("projectId").agg(F.array_sort(F.collect_set("repository")).alias("repositories"))
    extra = worktrees.join(roots, ["projectId", "root"], "left_anti")
    out = listed(roots, "roots").join(listed(extra, "worktrees"), "projectId", "left").join(listed(former, "formerRoots"), "projectId", "left").join(of, "projectId", "left")
    return out.select("projectId", "roots", "worktrees", "formerRoots", F.coalesce("repositories", F.array().cast("array<string>")).alias("repositories")).orderBy("projectId")


def lines(files: DataFrame) -> DataFrame:
    """(file, line, text): lines from 1, the last one with or without a line end. Files that aren't UTF-8 are left out."""
    text = F.col("content").cast("string")
    whole = files.where(F.is_valid_utf8(text))
    return whole.select("file", F.posexplode(F.split(text, "\n", -1)).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), F.trim(F.regexp_replace("text", r"\r$", "")).alias("text"))


def not_utf8(files: DataFrame) -> DataFrame:
    return files.where(~F.is_valid_utf8(F.col("content").cast("string"))).select("file", F.lit("The transcript is not UTF-8").alias("error"))


def records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, line, text, v) of non-blank lines, and (file, error) of files that have a malformed one.

    One bad line rejects its whole file: the flag is a window over the file, so a file is read once.
    """
    parsed = rows.where(F.col("text") != "").withColumn("v", F.try_parse_json("text"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
    bad = F.when(F.col("v").isNull(), F.concat(F.lit("Invalid transcript JSON at line "), F.col("line"))).when(~is_object, F.concat(F.lit("Invalid transcript record at line "), F.col("line"))).when(
        F.length("text") > MAX_RECORD, F.concat(F.lit("Record too long at line "), F.col("line"))
    )
    marked = parsed.withColumn("bad", bad).withColumn("first_bad", F.min_by("bad", F.when(F.col("bad").isNotNull(), F.col("line"))).over(Window.partitionBy("file")))
    rejected = marked.where((F.col("bad") == F.col("first_bad"))).select("file", F.col("first_bad").alias("error"))
    return marked.where("first_bad is null").select("file", "line", "text", "v"), rejected


def at(path: str, kind: str = "string") -> Column:
    """A field of the record in column v; null where it is absent or of another kind."""
    return F.try_variant_get(F.col("v"), path, kind)


def text_at(path: str) -> Column:
    """A string field; numbers and other kinds, and the empty string, count as absent."""
    value = at(path)
    return F.when(kind_at(path).eqNullSafe("STRING") & (value != ""), value)


def kind_at(path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.col("v"), path, "variant"))


def head_metadata(rows: DataFrame) -> DataFrame:
    """(file, cwd, branch, repository, session): from the first record with an absolute working directory, within the head of each file."""
    so_far = F.sum(F.length("text") + 1).over(Window.partitionBy("file").orderBy("line"))
    parsed = rows.withColumn("so_far", so_far).where(F.col("so_far") <= HEAD).withColumn("v", F.try_parse_json("text"))
    cwd = F.coalesce(text_at("$.cwd"), text_at("$.payload.cwd"), text_at("$.payload.record.cwd"))
    fields = F.struct(
        cwd.alias("cwd"),
        F.coalesce(text_at("$.gitBranch"), text_at("$.payload.git.branch")).alias("branch"),
        text_at("$.payload.git.repository_url").alias("repository"),
        F.coalesce(text_at("$.sessionId"), text_at("$.payload.id")).alias("session"),
    )
    return parsed.where(F.startswith(cwd, F.lit("/"))).groupBy("file").agg(F.min_by(fields, "line").alias("m")).select("file", "m.*")


def ancestors(file: Column) -> Column:
    """Session directories above a nested ``…/<session>/subagent/<child>/session.jsonl``, nearest first."""
    parts = F.split(file, "/")
    n = F.size(parts)
    # Parents stand at every second place from the end, for as long as 'subagent' stands between.
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(n / 2).cast("int")))
    nested = lambda k: F.get(parts, n - 1 - 2 * k) == "subagent"
    unbroken = F.filter(steps, lambda k: F.forall(F.sequence(F.lit(1), k), lambda j: F.coalesce(nested(j), F.lit(False))))
    return F.transform(unbroken, lambda k: F.get(parts, n - 2 - 2 * k))


def with_sidecars(sessions: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Lineage of subagents overlaid with their ``agent-<id>.meta.json`` (file, meta as a variant in v).

    A nested subagent's parent is the agent that started it, below the tree's root.
    """
    stem = lambda c, ending: F.regexp_replace(c, ending, "")
    meta = sidecars.select(
        stem(F.col("file"), r"\.meta\.json$").alias("stem"),
        F.when(at("$.isFork", "boolean"), F.lit("fork")).alias("kind"),
        text_at("$.parentAgentId").alias("parent_agent"),
        *[F.left(text_at(f"$.{k}"), F.lit(n)).alias(a) for k, a, n in (("agentType", "agentType", 200), ("name", "agentName", 200), ("description", "description", 500), ("toolUseId", "toolUseId", 256))],
        at("$.spawnDepth", "int").alias("depth"),
    )
    joined = sessions.withColumn("stem", stem(F.col("file"), r"\.jsonl$")).alias("s").join(meta.alias("m"), "stem", "left")
    lineage = F.col("s.lineage")
    root = F.coalesce(lineage["rootSessionId"], lineage["parentSessionId"])
    parent = F.when(F.col("m.parent_agent").isNotNull(), F.concat(root, F.lit("/agent-"), F.col("m.parent_agent")))
    overlaid = lineage
    for name, value in (("kind", F.col("m.kind")), ("parentSessionId", parent), *((k, F.col(f"m.{k}")) for k in ("agentType", "agentName", "description", "toolUseId", "depth"))):
        overlaid = overlaid.withField(name, F.coalesce(value, lineage[name]))
    kept = [c for c in sessions.columns if c != "lineage"]
    return joined.select(*[F.col(f"s.{c}") for c in kept], F.when(lineage.isNotNull(), overlaid).alias("lineage"))
