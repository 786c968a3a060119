"""The versioned store: captures, tombstones, compaction, retention, deletes, tag edits, parts, maintenance.

State is tables; changes are logs of rows. Each function takes the tables as they are and returns tables as they
will be, so a caller writes them (see ``streaming.ingest``). ``now`` is always given: results can be repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .listing import RUN_TAGS

DAY = 86_400_000
SESSION = "id string, digest string, storedDigest string, transcriptDigest string, revision int, capturedAt double, supersededBy string, partOf string, routedTo array<string>"
_STATE = ("digest", "storedDigest", "transcriptDigest", "revision", "capturedAt")
#: What a capture can come to, in the order in which it is decided.
OUTCOMES = ("dropped", "unchanged", "deleted", "conflict", "stale", "touched", "stored")


FOLDED = "id string, arrival long, outcome string, revision int, digest string, storedDigest string, transcriptDigest string, capturedAt double, tombstone string, tombstoneTranscript string"
#: How often a capture that was judged on an older state is tried again.
ATTEMPTS = 4


class _Session:
    """One session's row and tombstone, as captures come in."""

    def __init__(self, id: str):
        self.id, self.row, self.tomb = id, None, None

    def take(self, c: dict) -> dict:
        digest, transcript = c["digest"], c["transcriptDigest"]
        outcome = self.judge(c, digest, c["storedDigest"] or digest, transcript)
        if outcome == "dropped":
            if self.row:
                self.tomb, self.row = {"digest": self.row["digest"], "transcriptDigest": self.row["transcriptDigest"]}, None
        elif outcome == "deleted":
            self.tomb = self.tomb | {"digest": digest}
        elif outcome == "touched":
            self.row = self.row | {"digest": digest, "transcriptDigest": transcript, "capturedAt": c["capturedAt"]}
        elif outcome == "stored":
            revision = (self.row["revision"] if self.row else 0) + 1
            self.row, self.tomb = {"digest": digest, "storedDigest": c["storedDigest"] or digest, "transcriptDigest": transcript, "capturedAt": c["capturedAt"], "revision": revision}, None
        return {"id": self.id, "arrival": c["arrival"], "outcome": outcome, "revision": self.row["revision"] if self.row else 0, "digest": digest}

    def judge(self, c: dict, digest: str, stored: str, transcript: str | None) -> str:
        row, tomb = self.row, self.tomb
        if c["drop"]:
            return "dropped"
        if row and row["digest"] == digest:
            return "unchanged"
        if not row and tomb and not c["restore"] and (tomb["digest"] == digest or (transcript and tomb["transcriptDigest"] == transcript)):
            return "deleted"
        if c["checked"] and not tomb and (row["digest"] if row else None) != c["previousDigest"]:
            return "conflict"
        if row and row["capturedAt"] > c["capturedAt"]:
            return "stale"
        return "touched" if row and row["storedDigest"] == stored else "stored"

    def state(self) -> dict:
        dead = self.tomb if not self.row else None
        gone = {"tombstone": dead["digest"], "tombstoneTranscript": dead["transcriptDigest"]} if dead else {}
        return {"id": self.id, "arrival": -1, "outcome": "state", "revision": 0, **(self.row or {}), **gone}


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by session, then its row and tombstone, then captures by arrival. One session's state is held at a time."""
    now, out = None, []
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[k]) for n, k in (f.split() for f in FOLDED.split(", "))])
    for batch in batches:
        for r in batch.to_pylist():
            if now is None or now.id != r["id"]:
                if now:
                    out.append(now.state())
                now = _Session(r["id"])
            if r["side"] == 0:
                now.row = {k: r[k] for k in _STATE}
            elif r["side"] == 1:
                now.tomb = {k: r[k] for k in ("digest", "transcriptDigest")}
            else:
                out.append(now.take(r))
        yield pa.RecordBatch.from_pylist(out, schema)
        out = []
    if now:
        yield pa.RecordBatch.from_pylist([now.state()], schema)


def capture(captures: DataFrame, sessions: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Judges captures in order of arrival, session by session.

    ``captures`` has id, arrival, digest, storedDigest, transcriptDigest, capturedAt, previousDigest, checked (whether
    previousDigest is to hold), restore and drop. Each session's are read in order, from a sort that may spill, and
    judged as they pass: no session's captures are ever held together, however many there are. Returns a row a capture
    (``outcome``), and one a session (outcome ``state``): its row, or its tombstone, as they are now.
    """
    touched = captures.select("id").distinct()
    held = sessions.select("id", *_STATE).join(touched, "id", "left_semi").withColumn("side", F.lit(0))
    tombs = tombstones.select("id", "digest", "transcriptDigest").join(touched, "id", "left_semi").withColumn("side", F.lit(1))
    given = captures.select("id", F.col("arrival").cast("long").alias("arrival"), "digest", "storedDigest", "transcriptDigest", "capturedAt", "previousDigest", "checked", "restore", "drop").withColumn("side", F.lit(2))
    every = given.unionByName(held, allowMissingColumns=True).unionByName(tombs, allowMissingColumns=True)
    return every.repartition("id").sortWithinPartitions("id", "side", "arrival").mapInArrow(_fold, FOLDED)


def capture_again(captures: DataFrame, sessions: DataFrame, tombstones: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """``capture`` as a client that reads the current digest after each conflict and tries again, so many times in all.

    A batch is judged in one pass, so a capture that is tried again sees the state that the one before it left.
    """
    folded = capture(captures, sessions, tombstones)
    for _ in range(attempts - 1):
        refused = folded.where(F.col("outcome") == "conflict").select("id", "arrival")
        if refused.isEmpty():
            break
        before = Window.partitionBy("id").orderBy("arrival")
        seen = folded.where(F.col("outcome") != "state").join(sessions.select("id", F.col("digest").alias("held")), "id", "left")
        left = F.when(F.col("outcome").isin("stored", "touched", "unchanged"), F.col("digest"))
        current = seen.withColumn("current", F.coalesce(F.last(left, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)), "held"))
        fixed = captures.join(current.where(F.col("outcome") == "conflict").select("id", "arrival", "current"), ["id", "arrival"], "left").join(refused.withColumn("again", F.lit(True)), ["id", "arrival"], "left")
        captures = fixed.withColumn("previousDigest", F.when(F.col("again"), F.col("current")).otherwise(F.col("previousDigest"))).drop("current", "again")
        folded = capture(captures, sessions, tombstones)
    return folded


def after(folded: DataFrame, sessions: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions, tombstones) with the states of a fold in place of the rows it touched."""
    state = folded.where(F.col("outcome") == "state")
    rest = sessions.join(state.select("id"), "id", "left_anti")
    extra = sessions.join(state.where("digest is not null").select("id"), "id", "right").select("id", *[c for c in sessions.columns if c not in ("id", *_STATE)])
    changed = state.where("digest is not null").select("id", *_STATE).join(extra, "id")
    kept = tombstones.join(state.select("id"), "id", "left_anti")
    fresh = state.where("tombstone is not null").select("id", F.col("tombstone").alias("digest"), F.col("tombstoneTranscript").alias("transcriptDigest"))
    return rest.unionByName(changed.select(*sessions.columns)), kept.unionByName(fresh, allowMissingColumns=True)


def latest(revisions: DataFrame, key: str = "id", version: str = "revision") -> DataFrame:
    """Each session's current revision: one aggregate, no window sort."""
    others = [c for c in revisions.columns if c not in (key, version)]
    return revisions.groupBy(key).agg(F.max_by(F.struct(version, *others), version).alias("r")).select(key, "r.*")


def head(ids: DataFrame, sessions: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Current digest and revision of each id; a deleted session answers with its tombstone, an unknown one not at all."""
    row = sessions.select("id", F.struct("digest", "storedDigest", "revision").alias("s"))
    tomb = tombstones.select("id", F.struct("digest", F.col("digest").alias("storedDigest"), F.lit(0).alias("revision")).alias("t"))
    found = ids.select("id").join(row, "id", "left").join(tomb, "id", "left")
    return found.select("id", F.coalesce("s", "t").alias("h"), F.col("s").isNull().alias("deleted")).where("h is not null").select("id", "h.*", "deleted")


def read(revisions: DataFrame, sessions: DataFrame, session: str, revision: int | None = None) -> DataFrame:
    """The wanted revision of a session, and ``status``: found, compacted or missing."""
    current = sessions.where(F.col("id") == session).select("id", F.col("revision").alias("current"))
    wanted = current.withColumn("revision", F.lit(revision).cast("int") if revision is not None else F.col("current"))
    found = wanted.join(revisions, ["id", "revision"], "left")
    status = F.when(F.col("digest").isNotNull(), F.lit("found")).when(F.col("revision") < F.col("current"), F.lit("compacted")).otherwise(F.lit("missing"))
    return found.withColumn("status", status).drop("current")


def compact(revisions: DataFrame, sessions: DataFrame, outbox: DataFrame) -> DataFrame:
    """Revisions that stay: current ones, and older ones that the outbox names."""
    current = sessions.select("id", F.col("revision").alias("current"))
    older = revisions.join(current, "id", "left").where(F.col("revision") < F.col("current")).drop("current")
    return revisions.join(older.join(outbox.select("id", "revision"), ["id", "revision"], "left_anti").select("id", "revision"), ["id", "revision"], "left_anti")


def superseded(revisions: DataFrame, sessions: DataFrame, outbox: DataFrame) -> DataFrame:
    """(compactable, held): older revisions that compaction drops, and that the outbox holds."""
    older = revisions.select("id", "revision").join(sessions.select("id", F.col("revision").alias("current")), "id").where(F.col("revision") < F.col("current"))
    marked = older.join(outbox.select("id", "revision").distinct().withColumn("queued", F.lit(True)), ["id", "revision"], "left")
    return marked.agg(F.count_if(F.col("queued").isNull()).alias("compactable"), F.count_if(F.col("queued")).alias("held"))


def expired(sessions: DataFrame, now: float, days: int) -> DataFrame:
    """Sessions (no parts) captured more than so many days before ``now``."""
    return sessions.where(F.col("partOf").isNull() & (F.col("capturedAt") < F.lit(now - days * DAY)))


def delete(sessions: DataFrame, tombstones: DataFrame, receipts: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, tombstones, receipts) without the ids and their parts; what destinations hold of them is pending."""
    direct = sessions.join(ids.select("id"), "id", "left_semi")
    parts = sessions.where("partOf is not null").join(ids.select(F.col("id").alias("partOf")), "partOf", "left_semi")
    gone = direct.select("id", "digest", "transcriptDigest").unionByName(parts.select("id", "digest", "transcriptDigest")).distinct()
    owed = receipts.join(gone.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("destination")).alias("pending"))
    fresh = gone.join(owed, "id", "left").withColumn("pending", F.coalesce("pending", F.array().cast("array<string>")))
    kept = tombstones.join(gone.select("id"), "id", "left_anti")
    without = lambda df: df.join(gone.select("id"), "id", "left_anti")
    return without(sessions), kept.unionByName(fresh, allowMissingColumns=True), without(receipts)


def edit_tags(log: DataFrame, edits: DataFrame, captured: DataFrame) -> DataFrame:
    """The log with new edits (id, tag, added, seq); adding a tag that was captured just lifts an edit (added is null)."""
    base = captured.select("id", F.explode("capturedTags").alias("tag")).distinct().withColumn("had", F.lit(True))
    judged = edits.join(base, ["id", "tag"], "left").withColumn("added", F.when(F.col("added") & F.col("had"), F.lit(None).cast("boolean")).otherwise(F.col("added")))
    return log.unionByName(judged.select(*log.columns))


def lift(snapshots: DataFrame, edits: DataFrame) -> DataFrame:
    """Snapshots without the run tags that a person removed, so that a copy sent onward is no run."""
    runs = list(RUN_TAGS.values())
    gone = edits.where(~F.col("added") & F.col("tag").isin(runs)).groupBy("id").agg(F.collect_set("tag").alias("lifted"))
    return snapshots.join(gone, "id", "left").withColumn("tags", F.array_except("tags", F.coalesce("lifted", F.array().cast("array<string>")))).drop("lifted")


def store_lifted(sessions: DataFrame, revisions: DataFrame, chunks: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, revisions, chunks) after lifting: each session whose current revision has a run tag that a person removed
    gets a new revision without it, with the chunks of the old one, which goes.

    ``revisions`` has id, revision, digest and tags, of which the digest here is over the tags; ``chunks`` has id and revision.
    """
    current = revisions.join(sessions.select("id", "revision"), ["id", "revision"], "left_semi")
    without = lift(current.withColumnRenamed("tags", "was").withColumn("tags", F.col("was")), edits).where(F.size("tags") < F.size("was")).drop("was")
    lifted = without.select("id", F.col("revision").alias("old"), (F.col("revision") + 1).alias("revision"), F.sha2(F.concat_ws("\n", "digest", F.array_join("tags", ",")), 256).alias("digest"), *[c for c in revisions.columns if c not in ("id", "revision", "digest")])
    moved = lifted.select("id", F.col("old").alias("revision"), F.col("revision").alias("to"), F.col("digest").alias("liftedDigest"))
    old = moved.select("id", "revision")
    out_revisions = revisions.join(old, ["id", "revision"], "left_anti").unionByName(lifted.select(*revisions.columns))
    to = F.coalesce("to", "revision")
    out_chunks = chunks.join(moved, ["id", "revision"], "left").select(*[to.alias(c) if c == "revision" else F.col(c) for c in chunks.columns])
    change = {"revision": to, "storedDigest": F.coalesce("liftedDigest", "storedDigest")}
    out_sessions = sessions.join(moved, ["id", "revision"], "left").select(*[change.get(c, F.col(c)).alias(c) for c in sessions.columns])
    return out_sessions, out_revisions, out_chunks


def sweep(sessions: DataFrame, wanted: Column, after_seq: int, batch: int, failed: list[str] | None = None) -> DataFrame:
    """The next batch of a resumable sweep in order of seq; ids that failed before come once more at the front."""
    retry = F.col("id").isin(failed or [])
    return sessions.where(wanted & ((F.col("seq") > after_seq) | retry)).orderBy(F.desc(retry), "seq").limit(batch)


def first_wins(queue: DataFrame, more: DataFrame, *keys: str) -> DataFrame:
    """A queue with new rows for keys it doesn't have; of new rows that share a key the first by revision."""
    fresh = more.groupBy(*keys).agg(F.min("revision").alias("revision"))
    return queue.unionByName(fresh.join(queue.select(*keys), [*keys], "left_anti").select(*queue.columns))


def last_wins(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """One row a key: the values of the last, at the place of the first."""
    others = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(F.min(order).alias("place"), F.max_by(F.struct(*others), order).alias("v")).select(*keys, "place", "v.*")


def apply_parts(kept: DataFrame, existing: DataFrame, tombstones: DataFrame, receipts: DataFrame) -> DataFrame:
    """(id, action): upsert, skip (tombstoned), conflict (the id is no part), retire (still held elsewhere) or delete."""
    tomb = tombstones.select("id").withColumn("dead", F.lit(True))
    held = receipts.select("id").distinct().withColumn("sent", F.lit(True))
    both = kept.select("id").withColumn("kept", F.lit(True)).join(existing.select("id", "partOf").withColumn("there", F.lit(True)), "id", "full").join(tomb, "id", "left").join(held, "id", "left")
    there, wanted = F.coalesce("there", F.lit(False)), F.coalesce("kept", F.lit(False))
    action = (
        F.when(wanted & there & F.col("partOf").isNull(), "conflict")
        .when(wanted & ~there & F.coalesce("dead", F.lit(False)), "skip")
        .when(wanted, "upsert")
        .when(F.col("partOf").isNull(), None)
        .when(F.coalesce("sent", F.lit(False)), "retire")
        .otherwise("delete")
    )
    return both.select("id", action.alias("action")).where("action is not null")


def forget(receipts: DataFrame, tombstones: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(receipts, tombstones) after deliveries (id, destination) are gone at the destination."""
    left = receipts.join(done, ["id", "destination"], "left_anti")
    by_id = done.groupBy("id").agg(F.collect_set("destination").alias("gone"))
    return left, tombstones.join(by_id, "id", "left").withColumn("pending", F.array_except("pending", F.coalesce("gone", F.array().cast("array<string>")))).drop("gone")


def pending_deletes(tombstones: DataFrame) -> DataFrame:
    return tombstones.select("id", F.explode(F.array_distinct("pending")).alias("destination"))


def defaults(settings: DataFrame, stored: DataFrame) -> DataFrame:
    """Settings (key, value) with stored values over the defaults."""
    return settings.join(stored.select("key", F.col("value").alias("own")), "key", "full").select("key", F.coalesce("own", "value").alias("value"))


def collided(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Sessions whose stored and incoming entry ids have none in common."""
    both = old.select(*keys, F.transform("entries", lambda e: e["id"]).alias("a")).join(new.select(*keys, F.transform("entries", lambda e: e["id"]).alias("b")), [*keys])
    return both.where(~F.arrays_overlap("a", "b")).select(*keys)


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, files) of each table: what maintenance reports."""
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.input_file_name()).alias("files")).select(F.lit(name).alias("name"), "rows", "files")
    parts: Iterator[DataFrame] = (one(n, t) for n, t in sorted(tables.items()))
    out = next(parts)
    for p in parts:
        out = out.unionByName(p)
    return out


def reclaim(table: DataFrame, path: str, files: int) -> None:
    """Rewrites a table to so many files in another folder: the space that dropped rows took is free when the old one goes."""
    table.repartition(files).write.mode("errorifexists").parquet(path)
