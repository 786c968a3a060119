"""WARC files: one gzip member for each record, written by executors and read back as a stream.

The writer makes a WARC/1.1 record of each row: a response with an HTTP header and the payload, or, for a payload
that another record holds, a revisit of the identical-payload-digest profile, whose block is the HTTP header alone.
The reader never holds a file: it inflates one member after the other as bytes arrive, parses the record's header,
takes as many bytes as its Content-Length says, and compares block and payload digests.

Files are written below the shared folder through the file system that its path names. A task writes to a name of
its own and renames at the end, so a repeated task leaves one whole file with the same records.

Edge cases: a null payload is empty; payloads below the least size are always responses; rows that repeat the
smallest id of a payload are all responses, and are the only records whose URNs repeat; null ids are written without
id, and never referred to; an empty table gives files without records; other columns take no part.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LEAST = 100
#: Bytes read, and bytes inflated, at once.
READ = 1 << 20
# Fixed values of the format: the profile's name as the WARC 1.1 specification has it, and the record separator.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


class BadRecord(ValueError):
    """A record that is cut off, misframed, or doesn't have the digest that it says."""


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record_id(page_id: int | None, place: str = "") -> str:
    """A URN for each record: the page's id, and the record's place among the files where others may share the id."""
    return f"<urn:page:{'none' if page_id is None else page_id}{place and ':' + place}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, place: str = "") -> bytes:
    """The gzip member of a record. A revisit says the payload's size in its HTTP header, and its digest in its own.

    What a revisit may refer to, a response of the least size or more with an id, has that id alone as its URN, so that
    it can be named without having been seen. All other URNs hold the record's place.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "") or "urn:none"
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, "" if page_id is not None and not revisit and len(payload) >= LEAST else place)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", _digest(payload)),
        ("WARC-Block-Digest", _digest(block)),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(head.encode("utf-8")) + deflate.compress(block) + deflate.compress(END) + deflate.flush()


class _Member:
    """The inflated bytes of one gzip member, taken piece by piece from a stream."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.inflate, self.buffer, self.fed = stream, zlib.decompressobj(31), bytearray(), rest

    def _more(self) -> bool:
        """Inflates up to READ bytes more; False at the member's end."""
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail or self.fed
        self.fed = b"" if not self.inflate.unconsumed_tail else self.fed
        if not data:
            data = self.stream.read(READ)
            if not data:
                raise BadRecord("the file ends within a member")
        try:
            self.buffer += self.inflate.decompress(data, READ)
        except zlib.error as e:
            raise BadRecord(str(e)) from e
        return True

    def line(self) -> bytes:
        while (at := self.buffer.find(b"\r\n")) < 0:
            if len(self.buffer) > READ or not self._more():
                raise BadRecord("a header line doesn't end")
        out = bytes(self.buffer[:at])
        del self.buffer[: at + 2]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.buffer and not self._more():
                raise BadRecord("a block is shorter than its Content-Length")
            piece = bytes(self.buffer[:n])
            del self.buffer[: len(piece)]
            n -= len(piece)
            if piece:
                yield piece

    def close(self) -> bytes:
        """Checks that the separator is all that is left; returns what the next member begins with."""
        while self._more():
            if len(self.buffer) > len(END):
                break
        if bytes(self.buffer) != END or not self.inflate.eof:
            raise BadRecord("a block is longer than its Content-Length")
        return self.inflate.unused_data + self.fed


def _headers(member: _Member) -> dict[str, str]:
    found: dict[str, str] = {}
    while line := member.line():
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadRecord(f"not a header line: {line[:80]!r}")
        found[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return found


def _number(fields: dict[str, str], name: str) -> int:
    if not (value := fields.get(name, "")).isdigit():
        raise BadRecord(f"{name} is {value or 'missing'}")
    return int(value)


def read_records(stream) -> Iterator[dict]:
    """The records of a WARC file: type, id, refers_to, payload size and digest, each verified; memory is bounded."""
    rest = stream.read(READ)
    while rest:
        member = _Member(stream, rest)
        if not member.line().startswith(b"WARC/"):
            raise BadRecord("a member doesn't begin with a WARC version")
        fields = _headers(member)
        left = _number(fields, "content-length")
        block, payload, size, http, head = hashlib.sha256(), hashlib.sha256(), 0, b"", None
        for piece in member.take(left):
            block.update(piece)
            if head is None:
                http += piece
                at = http.find(END)
                if at < 0:
                    if len(http) > READ:
                        raise BadRecord("an HTTP header doesn't end")
                    continue
                head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http[:at].decode("latin-1").split("\r\n")[1:])}
                piece = http[at + 4 :]
            payload.update(piece)
            size += len(piece)
        rest = member.close() or stream.read(READ)
        if head is None:
            raise BadRecord("a block has no HTTP header")
        if fields.get("warc-block-digest") != "sha256:" + block.hexdigest():
            raise BadRecord(f"block digest of {fields.get('warc-record-id')}")
        revisit = fields.get("warc-type") == "revisit"
        said = fields.get("warc-payload-digest", "").removeprefix("sha256:")
        if revisit:
            size = _number(head, "content-length")
        elif said != payload.hexdigest() or size != _number(head, "content-length"):
            raise BadRecord(f"payload digest of {fields.get('warc-record-id')}")
        yield {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id", ""), "refers_to": fields.get("warc-refers-to"), "payload_bytes": size, "payload_digest": said}


def _id(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">").partition(":")[0]
    return int(number) if number.lstrip("-").isdigit() else None


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, base = shared.open_folder(folder)
        part = TaskContext.get().partitionId()
        name = f"pages-{part:06d}.warc.gz"
        mine, n, size = f"{base}/{name}.{uuid.uuid4().hex}.tmp", 0, 0
        with files.open_output_stream(mine, compression=None) as out:
            for batch in batches:
                for page_id, url, html, refers_to, revisit in zip(*batch.columns, strict=True):
                    payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                    size += out.write(make_record(page_id.as_py(), url.as_py(), payload, refers_to.as_py(), revisit.as_py(), f"{part}.{n}"))
                    n += 1
        files.move(mine, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [size]})

    return run


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """(page_id, url, html, refers_to, revisit), in one join of the pages with digests that several records have.

    Payloads are shuffled once, by digest; AQE splits a digest that many pages share. Small payloads never match,
    and get keys of their own, so they spread.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    large = F.octet_length("html") >= least
    keyed = rows.withColumn("__d", F.when(large, F.sha2("html", 256)).otherwise(F.concat(F.lit("small"), F.xxhash64("page_id", "url"))))
    firsts = rows.where(large).select("page_id", F.sha2("html", 256).alias("__d")).groupBy("__d").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1").select("__d", "first")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return keyed.join(firsts, "__d", "left").select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), F.coalesce(revisit, F.lit(False)).alias("revisit"))


def write(pages: DataFrame, folder: str, **names) -> list[str]:
    """Writes a WARC file for each partition of the planned records and returns the files' names."""
    files, base = shared.open_folder(folder)
    files.create_dir(base, recursive=True)
    done = plan_records(pages, **names).mapInArrow(_writer(folder), "file string, records long, bytes long").collect()  # a row for each file
    return sorted(r["file"] for r in done)


def read(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the named files."""
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                files, base = shared.open_folder(folder)
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    some: list[dict] = []
                    for r in read_records(stream):
                        some.append(r | {"page_id": _id(r["record_id"]), "refers_to": _id(r["refers_to"])})
                        if len(some) == 10_000:
                            yield pa.RecordBatch.from_pylist([{k: x[k] for k in fields} for x in some], schema)
                            some = []
                    yield pa.RecordBatch.from_pylist([{k: x[k] for k in fields} for x in some], schema)

    listed = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names)), "name")
    return listed.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def unanswered(records: DataFrame) -> DataFrame:
    """Revisits that don't refer to a response with the payload size and digest that they say themselves."""
    answers = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    return records.where("record_type = 'revisit'").join(answers, ["refers_to", "payload_bytes", "payload_digest"], "left_anti")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    folder = shared.work_dir(pages.sparkSession) + "/warc"
    return read(pages.sparkSession, folder, write(pages, folder, key=key, url=url, html=html))


def op9_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(shared.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
