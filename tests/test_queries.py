import math
import os

import duckdb
import pytest

import __spark_entry__
from quillmat.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    f = float(v)
    return None if math.isnan(f) else round(f, 5) + 0.0


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not here")
@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_query_agrees_with_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    order = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(repr([plain(r[c]) for c in sorted(got.columns)]) for r in got.collect())
    assert rows == sorted(repr([plain(r[i]) for i in order]) for r in want.fetchall())


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["id", "r_name", "total", "nonzero", "small_fraction"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
