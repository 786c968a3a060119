"""Every query with SQL gives the rows that DuckDB gives."""

import pytest
from compare import connect, same

from threadloom import queries


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_equal(name, spark, sf, con):
    same(queries.QUERIES[name](spark, sf), con, queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(name, spark, sf):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "title", "used", "matching", "chunks"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_query_terms_of_every_turn(spark, sf):
    import regex

    want = []
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        found = list(dict.fromkeys(regex.findall(r"[\p{L}\p{N}_-]+", r["text"].lower()))) if r["text"] is not None else None
        want.append((r["conv_id"], r["turn"], None if found is None else " ".join(sorted(found[:64])), len(found or [])))
    assert max(n for *_, n in want) > 64
    out = [tuple(r) for r in queries.QUERIES["query_terms"](spark, sf).select("conv_id", "turn", "terms").collect()]
    assert sorted(out, key=repr) == sorted((w[:3] for w in want), key=repr)
