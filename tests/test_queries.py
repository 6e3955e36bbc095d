"""Every registered query with SQL gives DuckDB's rows; the others run."""

from __future__ import annotations

import duckdb
import pytest

from assaywright.plans import detection, kept, records, registry, scores  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    if name not in registry.SQL:
        assert rows
        return
    rel = duck.sql(registry.SQL[name])
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert rows == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
