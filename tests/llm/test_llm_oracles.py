"""The training-data queries with SQL give DuckDB's rows; all queries run over their tables."""

import duckdb
import pytest

from kgloom.llm import queries as q

TABLES = "documents pages benchmark labels".split()


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = q.queries()[name](spark, sf)
    cols = sorted(found.columns)
    rel = con.sql(q.oracle_sql()[name])
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(str(r[c]) for c in cols) for r in found.collect()) == sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["op1_token_file", "op3_pii_transducers", "op4_randomness_battery", "op6_page_differencing", "op9_subsequence_svm", "op11_chunked_records"])
def test_a_row_for_each_row(spark, sf, name):
    tables = "pages" if name.startswith(("op6", "op11")) else "documents"
    assert q.queries()[name](spark, sf).count() == spark.read.parquet(f"{sf}/{tables}.parquet").count()
