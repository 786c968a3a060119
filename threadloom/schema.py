"""Types of sessions, entries and what is derived from them, and the checks that a snapshot must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)  # type: ignore[return-value]


ENTRY_DDL = "id string, turnId string, callId string, kind string, text string, timestamp double, sourceRef string, model string, effort string"
REFERENCE_DDL = "integration string, ref string"
ACTOR_DDL = "kind string, id string, name string, integrationId string"
RUNTIME_DDL = "provider string, accessPath string, evidence string"
LINEAGE_DDL = "kind string, firstEntryId string, lastEntryId string, parentSessionId string, rootSessionId string, parentEntryId string, agentType string, agentName string, description string, toolUseId string, depth int"
COVERAGE_DDL = "reasoning string, completeness string, omissions array<string>"
SNAPSHOT_DDL = (
    "schemaVersion int, sourceId string, source string, sessionId string, title string, projectId string, "
    f"actor struct<{ACTOR_DDL}>, runtime struct<{RUNTIME_DDL}>, lineage struct<{LINEAGE_DDL}>, "
    f"references array<struct<{REFERENCE_DDL}>>, tags array<string>, goalIds array<string>, runIds array<string>, "
    f"capturedAt double, coverage struct<{COVERAGE_DDL}>, entries array<struct<{ENTRY_DDL}>>"
)

#: Kinds of entries; the last two of the middle row are tool activity.
KINDS = ("user", "assistant", "tool-call", "tool-result", "reasoning-summary", "event")
TOOL_KINDS = ("tool-call", "tool-result")
#: Limits of a session: entries, characters of an entry, bytes of all.
MAX_ENTRIES, MAX_TEXT, MAX_BYTES = 50_000, 2_000_000, 64_000_000


def snapshot_issues() -> F.Column:
    """Array of what is wrong with a snapshot (columns of ``SNAPSHOT_DDL``); empty if it is valid.

    Duplicate ids are counted on the array itself, sizes summed in place: no explode, no shuffle.
    """
    c = F.col
    sizes = F.aggregate("entries", F.lit(0).cast("long"), lambda a, e: a + F.coalesce(F.octet_length(e["text"]), F.lit(0)))
    checks = [
        (c("schemaVersion").eqNullSafe(1), "schemaVersion"),
        (F.regexp_like(c("sourceId"), F.lit("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")), "sourceId"),
        (F.length("sessionId").between(1, 256), "sessionId"),
        (F.length("title").between(1, 500), "title"),
        (c("capturedAt") >= 0, "capturedAt"),
        (F.size("tags") <= 100, "tags"),
        (~F.exists("tags", lambda t: ~F.length(t).between(1, 120)), "tag length"),
        (F.coalesce(F.size("references"), F.lit(0)) <= 100, "references"),
        (F.size("entries") <= MAX_ENTRIES, "entries"),
        (F.size(F.array_distinct(F.transform("entries", lambda e: e["id"]))) == F.size("entries"), "duplicate entry ids"),
        (~F.exists("entries", lambda e: ~e["kind"].isin(*KINDS)), "entry kind"),
        (~F.exists("entries", lambda e: F.length(e["text"]) > MAX_TEXT), "entry text"),
        (sizes <= MAX_BYTES, "size"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for ok, name in checks]))


def validated(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid snapshots, rejected snapshots with their issues)."""
    checked = snapshots.withColumn("issues", snapshot_issues())
    return checked.where(F.size("issues") == 0).drop("issues"), checked.where(F.size("issues") > 0)


def entries_of(snapshots: DataFrame, *keys: str) -> DataFrame:
    """One row for each entry: the keys, its position and its fields."""
    return snapshots.select(*keys, F.posexplode("entries").alias("position", "e")).select(*keys, "position", "e.*")
