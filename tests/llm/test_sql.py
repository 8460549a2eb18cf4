"""The queries of operators that SQL can express, against that SQL."""

import os

import duckdb
import pytest

from quillmat.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import SF, TABLES, plain


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not here")
@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    order = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(repr([plain(r[c]) for c in sorted(got.columns)]) for r in got.collect())
    assert rows == sorted(repr([plain(r[i]) for i in order]) for r in want.fetchall())
