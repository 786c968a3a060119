"""Transcripts as a stream: every new file is imported once, judged against the store, and stored.

The store is a log of segments in one folder. A batch appends a segment with what it changed: the states of the sessions
that it touched, and the entries of those that it stored. It reads states of touched sessions only, from the hash
buckets that hold them, and no entries; so what it costs doesn't grow with the store. When ``FAN`` segments of one
level have come together, they are merged into one of the next level, in which superseded states and entries are left
out; so a row is rewritten once a level, and segments grow in number with the logarithm of the batches.

A manifest names the live segments and the last batch. It is the commit: segments that no manifest names don't count, and
a batch that is repeated after a failure finds its commit and does nothing, or writes the same segment again. Segments
that a merge replaced are deleted at the next merge, so that readers of the manifest before can end.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions import digests
from ..operators import store
from ..sources import sessions as importer
from ..sources import transcripts
from ..sources.dialects import DIALECTS

#: Segments of a level that are merged, and hash buckets of a segment.
FAN, BUCKETS = 8, 64
SCHEMAS = {
    "sessions": store.SESSION,
    "tombstones": "id string, digest string, transcriptDigest string",
    "entries": "id string, sessionId string, position int, entryId string, kind string, text string, timestamp double, model string, effort string",
    "outcomes": "id string, arrival long, outcome string, revision int, digest string",
}
#: A state is a session's row or its tombstone, and the batch that wrote its entries.
STATES = f"id string, batch long, entriesOf long, session struct<{store.SESSION.replace(' ', ':').replace(',:', ',')}>, tombstone struct<digest:string,transcriptDigest:string>, bucket int"
ENTRIES = f"{SCHEMAS['entries']}, batch long, bucket int"


def _columns(ddl: str) -> list[str]:
    return [f.name for f in T._parse_datatype_string(ddl).fields]


def _bucket(id: Column) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(BUCKETS)).cast("int")


@dataclass
class Tables:
    spark: SparkSession
    folder: str
    fan: int = FAN

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        path, files = self._path(name)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def _delete(self, name: str) -> None:
        path, files = self._path(name)
        files.delete(path, True)

    def manifest(self) -> dict:
        """The last manifest: its number, the last batch, and live segments as [level, name], oldest first."""
        whole = [n for n in self._names("manifests") if "_SUCCESS" in self._names(f"manifests/{n}")]
        if not whole:
            return {"number": -1, "batch": -1, "segments": [], "replaced": []}
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{whole[-1]}").first()["value"])

    def _commit(self, manifest: dict) -> None:
        manifest["number"] += 1
        row = self.spark.createDataFrame([(json.dumps(manifest),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifests/{manifest['number']:012d}")
        for old in self._names("manifests")[:-4]:
            self._delete(f"manifests/{old}")

    def version(self) -> int:
        """The last committed batch; -1 before the first."""
        return self.manifest()["batch"]

    def _rows(self, what: str, ddl: str, segments: list) -> DataFrame:
        base = f"{self.folder}/segments/{what}"
        paths = [f"{base}/segment={name}" for _, name in segments]
        return self.spark.read.schema(f"{ddl}, segment string").option("basePath", base).parquet(*paths).drop("segment") if paths else self.spark.createDataFrame([], ddl)

    def _write(self, name: str, states: DataFrame, entries: DataFrame) -> None:
        for what, df, ddl in (("states", states, STATES), ("entries", entries, ENTRIES)):
            df.select(*_columns(ddl)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/segments/{what}/segment={name}")

    def states(self, segments: list | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The last state of each session, of some buckets only if asked so."""
        rows = self._rows("states", STATES, self.manifest()["segments"] if segments is None else segments)
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        last = rows.groupBy("id").agg(F.max_by(F.struct("batch", "entriesOf", "session", "tombstone", "bucket"), "batch").alias("s"))
        return last.select("id", "s.*")

    def read(self, name: str) -> DataFrame:
        """``sessions``, ``tombstones`` or ``entries`` as they are, or the ``outcomes`` of the last batch."""
        now = self.manifest()
        if name == "outcomes":
            done = f"{self.folder}/outcomes/{now['batch']:012d}"
            return self.spark.read.schema(SCHEMAS[name]).parquet(done) if now["batch"] >= 0 else self.spark.createDataFrame([], SCHEMAS[name])
        return self._view(name, self.states(now["segments"]), now["segments"])

    def _view(self, name: str, states: DataFrame, segments: list) -> DataFrame:
        if name == "sessions":
            return states.where("session is not null").select("session.*")
        if name == "tombstones":
            return states.where("tombstone is not null").select("id", "tombstone.*")
        live = states.where("session is not null").select("id", F.col("entriesOf").alias("batch"))
        return self._rows("entries", ENTRIES, segments).join(live, ["id", "batch"], "left_semi").select(*_columns(SCHEMAS["entries"]))

    def append(self, batch: int, states: DataFrame, entries: DataFrame, outcomes: DataFrame) -> None:
        """Writes a batch's segment and commits it, then merges what has come together."""
        name = f"{batch:012d}"
        self._write(name, states, entries)
        outcomes.select(*_columns(SCHEMAS["outcomes"])).write.mode("overwrite").parquet(f"{self.folder}/outcomes/{name}")
        now = self.manifest()
        self._commit(now | {"batch": batch, "segments": [*now["segments"], [0, name]]})
        self._merge()

    def _merge(self) -> None:
        while True:
            now = self.manifest()
            levels = [level for level, _ in now["segments"]]
            full = next((level for level in sorted(set(levels)) if levels.count(level) >= self.fan), None)
            if full is None:
                return
            # Levels fall from the oldest segment to the newest, so those of one level follow each other.
            some = [s for s in now["segments"] if s[0] == full]
            name = f"{some[0][1].split('-')[0]}-{some[-1][1].split('-')[-1]}"
            states = self.states(some)
            live = states.where("session is not null").select("id", F.col("entriesOf").alias("batch"))
            entries = self._rows("entries", ENTRIES, some).join(live, ["id", "batch"], "left_semi")
            self._write(name, states, entries)
            for old in now["replaced"]:
                for what in ("states", "entries"):
                    self._delete(f"segments/{what}/segment={old}")
            at = now["segments"].index(some[0])
            rest = [s for s in now["segments"] if s not in some]
            self._commit(now | {"segments": [*rest[:at], [full + 1, name], *rest[at:]], "replaced": [n for _, n in some]})


def captures(found: importer.Imported, modified: DataFrame | None = None) -> DataFrame:
    """Captures of imported sessions, digests being over whole transcripts. A session's files arrive in the order of
    their modification (``modified``: file, modified), then of their names."""
    whole = found.entries.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.struct("id", "callId", "kind", "text", "timestamp", "sourceRef", "model", "effort").alias("e")))), lambda x: x["e"]).alias("list"))
    joined = found.sessions.join(whole, "file")
    joined = joined.join(modified, "file", "left") if modified is not None else joined.withColumn("modified", F.lit(None).cast("timestamp"))
    transcript = digests.transcript_digest(F.col("source"), F.col("sessionId"), F.col("list"))
    rows = joined.select("file", "modified", digests.session_key(F.col("sourceId"), F.col("source"), F.col("sessionId")).alias("id"), "sessionId", transcript.alias("transcriptDigest"), "capturedAt", "title")
    order = Window.partitionBy("id").orderBy("modified", "file")
    return rows.select(
        "file", "id", "sessionId", F.row_number().over(order).cast("long").alias("arrival"), F.sha2(F.concat_ws("\n", "transcriptDigest", "title"), 256).alias("digest"),
        F.lit(None).cast("string").alias("storedDigest"), "transcriptDigest", "capturedAt", F.lit(None).cast("string").alias("previousDigest"),
        F.lit(False).alias("checked"), F.lit(False).alias("restore"), F.lit(False).alias("drop"),
    )


def store_batch(tables: Tables, found: importer.Imported, batch: int, modified: DataFrame | None = None) -> None:
    """Judges a batch of imported sessions and appends what it changes."""
    if batch <= tables.version():
        return
    spark, work = tables.spark, f"{tables.folder}/work/{batch:012d}"

    def written(df: DataFrame, name: str) -> DataFrame:
        """Cut off from its inputs, which move on; a lost executor finds it in the shared folder."""
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    wanted = written(captures(found, modified), "wanted")
    buckets = [r["b"] for r in wanted.select(_bucket(F.col("id")).alias("b")).distinct().collect()]  # ``BUCKETS`` rows at most
    segments = tables.manifest()["segments"]
    touched = wanted.select("id").distinct()
    before = written(tables.states(segments, buckets).join(touched, "id", "left_semi"), "before")
    held, tombs = tables._view("sessions", before, segments), tables._view("tombstones", before, segments)
    folded = written(store.capture(wanted.drop("file", "sessionId"), held, tombs), "folded")
    sessions, tombstones = store.after(folded, held, tombs)
    # Entries of sessions that got a new revision are in this batch's segment; others stay where they are.
    stored = folded.where(F.col("outcome") == "stored").groupBy("id").agg(F.max("arrival").alias("arrival"))
    rows = touched.join(sessions.select("id", F.struct(*_columns(store.SESSION)).alias("session")), "id", "left").join(tombstones.select("id", F.struct("digest", "transcriptDigest").alias("tombstone")), "id", "left")
    now = F.lit(batch).cast("long")
    kept = rows.join(stored.select("id", now.alias("new")), "id", "left").join(before.select("id", F.col("entriesOf").alias("old")), "id", "left")
    states = kept.select("id", now.alias("batch"), F.coalesce("new", "old").alias("entriesOf"), "session", "tombstone", _bucket(F.col("id")).alias("bucket"))
    fresh = found.entries.join(wanted.select("file", F.col("id").alias("key"), "arrival").join(stored.withColumnRenamed("id", "key"), ["key", "arrival"]), "file")
    entries = fresh.select(F.col("key").alias("id"), "sessionId", "position", F.col("id").alias("entryId"), "kind", "text", "timestamp", "model", "effort", now.alias("batch"), _bucket(F.col("key")).alias("bucket"))
    tables.append(batch, states, entries, folded.where(F.col("outcome") != "state"))
    tables._delete(f"work/{batch:012d}")


def ingest(spark: SparkSession, path: str, folder: str, checkpoint: str, source: str, source_id: str, captured_at: float, **trigger) -> StreamingQuery:
    """Starts the stream; ``trigger`` is ``availableNow=True`` (the default) or ``processingTime="30 seconds"``."""
    tables = Tables(spark, folder)
    shape = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(shape).option("recursiveFileLookup", True).option("pathGlobFilter", "session.jsonl" if source == "muse" else "*.jsonl").load(path)
    whole = files.where(F.col("length") <= transcripts.MAX_FILE).select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), "content")

    def each(batch: DataFrame, number: int) -> None:
        parsed, malformed = transcripts.records(transcripts.lines(batch))
        found = importer.assemble(DIALECTS[source](parsed), source, source_id, captured_at)
        store_batch(tables, importer.Imported(found.sessions, found.entries, found.rejected.unionByName(malformed)), number, batch.select("file", "modified"))

    return whole.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def activity(stream: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """An extra: bursts of activity as session windows, with a watermark for late rows; batch or stream."""
    return stream.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("burst")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("burst.start").alias("began"), F.col("burst.end").alias("ended"), "n")
