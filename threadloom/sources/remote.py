"""Listings and searches of remote stores, over HTTP with JSON, as tables.

``RemoteListing`` is a data source: a partition a store, each paged by its cursor. ``search`` asks many stores and keeps
a store's failure in its own row.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a page and pages of a store at most, and seconds to wait.
PAGE, PAGES, WAIT = 100, 1000, 30
SCHEMA = "store string, id string, digest string, revision int"


def post(url: str, action: str, body: dict, token: str | None = None, wait: float = WAIT) -> dict:
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    request = urllib.request.Request(f"{url.rstrip('/')}/{action}", json.dumps(body).encode(), head)
    with urllib.request.urlopen(request, timeout=wait) as answer:
        return json.load(answer)


def pages(url: str, body: dict, token: str | None = None) -> Iterator[dict]:
    """Items of a listing, page after page; a store that never ends is an error, not a short listing."""
    cursor = None
    for _ in range(PAGES):
        answer = post(url, "list", body | {"limit": PAGE} | ({"cursor": cursor} if cursor else {}), token)
        yield from answer["items"]
        cursor = answer.get("nextCursor")
        if not cursor:
            return
    raise RuntimeError(f"{url} lists more than {PAGES} pages")


class _Store(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Store(u) for u in json.loads(self.options["stores"])]

    def read(self, partition: _Store) -> Iterator[tuple]:
        body = {"sourceId": self.options["sourceid"]} if self.options.get("sourceid") else {}
        for item in pages(partition.url, body, self.options.get("token")):
            yield partition.url, item["id"], item.get("digest"), item.get("revision")


class RemoteListing(DataSource):
    """``spark.dataSource.register(RemoteListing)``, then ``spark.read.format("remote_listing").option("stores", '["https://…"]').load()``."""

    @classmethod
    def name(cls) -> str:
        return "remote_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def search(stores: DataFrame, query: str, limit: int = 20, token: str | None = None, wait: float = WAIT) -> DataFrame:
    """(store, id, title, error) for each row (store) of ``stores``: its hits, or one row that says why it has none."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in ("store", "id", "title", "error")])
        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                try:
                    rows += [{"store": url, "id": i["id"], "title": i.get("title")} for i in post(url, "search", {"query": query, "limit": limit}, token, wait)["items"]]
                except (OSError, ValueError, KeyError) as e:
                    rows.append({"store": url, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return stores.select("store").mapInArrow(ask, "store string, id string, title string, error string")
