"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import decimal

import duckdb
import pytest

from kgloom import monitor_queries, pipeline_queries, plan_queries, queries as q, ranking_queries, store_queries  # noqa: F401 (their queries register themselves)

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, sf, duck, name):
    found = q.queries()[name](spark, sf)
    cols = sorted(found.columns)
    rel = duck.sql(q.oracle_sql()[name])
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(_plain(r[c]) for c in cols) for r in found.collect()) == sorted(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
