"""Every catalogue query against its DuckDB SQL."""

import functools
import math

import duckdb
import pytest

from pointweave.plans import queries
from pointweave.plans.oracles import ORACLE_SQL
from pointweave.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
#: A library's sizes: no SQL.
WITHOUT = {"q34_zstd_chunk_size"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


def test_names():
    assert set(QUERIES) - set(ORACLE_SQL) == WITHOUT and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=str)
    found = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=str)
    assert got == want and got


@pytest.mark.parametrize("name", sorted(WITHOUT))
def test_others_give_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


#: Queries whose points have the event's id among their columns.
WITH_ID = ["q33_blob_roundtrip", "q34_zstd_chunk_size", "q51_stage1_size", "q55_blob_headers"]


@pytest.mark.parametrize("name", WITH_ID)
def test_over_range_partitions(spark, sf_dir, duck, name, monkeypatch):
    """Tables of more rows than a range partition has give the same results."""
    few = sorted(map(str, QUERIES[name](spark, sf_dir).collect())) if name in WITHOUT else None
    monkeypatch.setattr(queries, "indexed", functools.partial(queries.indexed, range_rows=300))
    if few is None:
        test_query(spark, sf_dir, duck, name)
    else:
        assert sorted(map(str, QUERIES[name](spark, sf_dir).collect())) == few and few
