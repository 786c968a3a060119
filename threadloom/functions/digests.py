"""Content addresses: SHA-256 over canonical JSON, whose keys stand in the order of the schema."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that are written even when they are null.
NULLABLE = frozenset({"timestamp"})


def _plain(value: Any) -> Any:
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if v is not None or k in NULLABLE}
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist"):
        return [_plain(v) for v in value]
    if isinstance(value, float) and value.is_integer():
        return int(value)  # whole numbers have no fraction
    return value


def canonical_json(value: Any) -> str:
    """Keys in order, absent keys left out, no white space, non-ASCII characters as they are."""
    return json.dumps(_plain(value), ensure_ascii=False, separators=(",", ":"))


def digest(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode("utf-8", "surrogatepass")).hexdigest()


def quoted(text: Column) -> Column:
    """A string as JSON. Spark writes control characters in upper-case hex; others are equal."""
    body = F.to_json(F.struct(text.alias("s")))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.regexp_replace(body, r'(?s)\A\{"s":(.*)\}\z', "$1"))


def session_key(source_id: Column, source: Column, session_id: Column) -> Column:
    """Id of a session in the store, made in the JVM: three short strings without control characters."""
    return F.sha2(F.concat(F.lit("["), quoted(source_id), F.lit(","), quoted(source), F.lit(","), quoted(session_id), F.lit("]")), 256)


@F.pandas_udf(T.StringType())
def transcript_digest(source: pd.Series, session_id: pd.Series, entries: pd.Series) -> pd.Series:
    """Digest of what was imported: source, session and entries, without what collectors add around them."""
    return pd.Series([digest([a, b, list(c)]) for a, b, c in zip(source, session_id, entries, strict=True)])


@F.pandas_udf(T.StringType())
def snapshot_digest(snapshot: pd.DataFrame) -> pd.Series:
    """Digest of a whole snapshot but its capture time."""
    rows = snapshot.drop(columns=["capturedAt"], errors="ignore").to_dict("records")
    return pd.Series([digest(r) for r in rows])


def chunk_id(entry_id: Column, start: Column, end: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.lit("["), quoted(entry_id), F.lit(","), start.cast("string"), F.lit(","), end.cast("string"), F.lit(","), quoted(text), F.lit("]")), 256)


def part_session_id(session_id: Column, first_entry_id: Column) -> Column:
    """A part's session id, hashed past 256 characters."""
    plain = F.concat(session_id, F.lit("#part-"), first_entry_id)
    return F.when(F.length(plain) <= 256, plain).otherwise(F.concat(F.left(session_id, F.lit(180)), F.lit("#part-"), F.left(F.sha2(plain, 256), F.lit(32))))


def stagger(session: Column, span: int) -> Column:
    """A steady offset in [0, span] by a session's id."""
    return F.pmod(F.conv(F.left(F.sha2(session.cast("string"), 256), F.lit(8)), 16, 10).cast("long"), F.lit(span + 1))
