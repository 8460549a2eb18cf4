"""Products made by whole rows against joined pairs and dense products."""

import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmat.plans import expressions as ex
from quillmat.plans import stripes


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def cells(spark, array, kind="long"):
    return spark.createDataFrame([(int(i), int(j), v.item()) for (i, j), v in np.ndenumerate(array) if v], f"i long, j long, value {kind}").repartition(3)


@pytest.mark.parametrize("fill", [0.1, 0.9])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_whole_rows_against_pairs(spark, fill, kind, monkeypatch):
    """Stripes, pieces, columns in parts and long rows change nothing; cells that add up to 0 stay."""
    rng = np.random.default_rng(int(10 * fill))
    a, b = (np.where(rng.random(s) < fill, rng.integers(-3, 4, s), 0) for s in ((30, 20), (20, 25)))
    a[3], b[:, 2] = 1, 1
    if kind == "double":
        a, b = a * 0.5, b * 0.25
    x, y = cells(spark, a, kind), cells(spark, b, kind)
    want = rows(ex.multiply(x, y))
    assert any(v == 0 for *_, v in want)
    for at_once in (7, 10_000):
        monkeypatch.setattr(stripes, "AT_ONCE", at_once)
        assert rows(ex.multiply(x, y, many=0)) == want
    ids, value = stripes.kinds(x, y)
    for stripe, most, held in ((5, 1000, 1000), (40, 1000, 30)):
        cut = stripes.striped(x, ids, value, stripe, most)
        assert cut.count() > 1 and rows(stripes.multiply(cut, y, ids, value, held)) == want
    monkeypatch.setattr(stripes.striped, "__defaults__", (5, 15))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        long = {r.i for r in stripes.striped(x, ids, value).filter("s is null").select(F.explode("rows").alias("i")).collect()}
        assert 3 in long and all((a[i] != 0).sum() > 15 for i in long)
        assert rows(ex.multiply(x, y, many=0)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_cells(spark):
    """Nulls, cells that stand twice, texts, infinities, sums beyond doubles and beyond longs."""
    x = spark.createDataFrame([("a", "k", 1), ("a", "k", 2), (None, "k", 3), ("b", None, 4), ("c", "l", None), ("a", "l", None), ("d", "gone", 1)], "i string, j string, value int")
    y = spark.createDataFrame([("k", 1, 5), ("k", None, 7), ("l", 1, 2), ("l", 2, 2), (None, 3, 1)], "i string, j int, value short")
    assert rows(ex.multiply(x, y, many=0)) == rows(ex.multiply(x, y)) and ex.multiply(x, y, many=0).schema == ex.multiply(x, y).schema
    x = spark.createDataFrame([(0, 0, math.inf), (0, 1, 1.0), (1, 1, math.nan), (2, 1, 2.0)], "i long, j long, value double")
    y = spark.createDataFrame([(0, 0, 1.0), (1, 1, 0.5), (1, 0, 1e-300)], "i long, j long, value double")
    assert repr(rows(ex.multiply(x, y, many=0))) == repr(rows(ex.multiply(x, y)))
    large = spark.createDataFrame([(0, 0, 2**31 + 1), (0, 1, 1)], "i long, j long, value long")
    right = spark.createDataFrame([(0, 0, 2**31 - 1), (1, 0, 3)], "i long, j long, value long")
    assert rows(ex.multiply(large, right, many=0)) == [(0, 0, (2**31 + 1) * (2**31 - 1) + 3)]
    with pytest.raises(Exception, match="range of a long"):
        ex.multiply(large, spark.createDataFrame([(0, 0, 2**33)], "i long, j long, value long"), many=0).collect()
    exact = spark.createDataFrame([(0, 0, Decimal("0.1"))], "i long, j long, value decimal(5,1)")
    assert rows(ex.multiply(exact, exact, many=0)) == [(0, 0, Decimal("0.01"))]


def test_pairs_are_not_shuffled(spark):
    """Ten rows of one stripe share what they ask for: fewer rows move than there are cells of the result."""
    from tests.test_tiles import moved

    n = 60
    x = spark.range(n * n).select((F.col("id") % n).alias("i"), F.floor(F.col("id") / n).alias("j"), F.lit(1).alias("value")).persist()
    assert x.count() == n * n
    out = ex.multiply(x, x, many=0)
    assert out.count() == n * n and out.filter(F.col("value") != n).count() == 0
    assert moved(ex.multiply(x, x, many=0)) < moved(ex.multiply(x, x)) / 2


def test_a_matrix_added_to_itself_is_worked_out_once(spark):
    from quillmat.datamatrix import DataMatrix
    from quillmat.operators import arithmetic

    mat = spark.createDataFrame([(0, 1, 2), (1, 1, 3), (1, 1, 4)], "var_id long, obs_id long, value long")
    ids = spark.range(2).select("id", F.col("id").alias("ord"))
    data = DataMatrix(mat, ids, ids)
    other = DataMatrix(mat.filter("value > 2"), ids, ids)
    out = arithmetic.matrix_sum(data, other, data, data).mat
    assert rows(out) == [(0, 1, 6), (1, 1, 28)] and out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2


def test_a_product_added_to_itself_is_not_shuffled(spark):
    """Cells of a product stand once; those of a matrix whose cells were changed since needn't."""
    from dataclasses import replace

    from quillmat.datamatrix import DataMatrix
    from quillmat.operators import arithmetic

    mat = spark.createDataFrame([(0, 1, 2), (1, 1, 3), (1, 0, 4)], "var_id long, obs_id long, value long")
    ids = spark.range(2).select("id", F.col("id").alias("ord"))
    gram = arithmetic.matrix_product(DataMatrix(mat, ids, ids), DataMatrix(mat, ids, ids))
    out = arithmetic.matrix_sum(gram, gram).mat
    want = [(0, 0, 16), (0, 1, 12), (1, 0, 24), (1, 1, 34)]
    count = lambda t: t._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
    assert rows(out) == want and count(out) == count(gram.mat)
    twice = replace(gram, mat=gram.mat.union(gram.mat))
    assert gram.once is gram.mat and twice.once is None
    assert rows(arithmetic.matrix_sum(twice, twice).mat) == [(i, j, 2 * v) for i, j, v in want]


def test_stripes_grow_with_the_cells(spark, monkeypatch):
    """A row of the right side travels once for each stripe that asks for it, so many cells make few stripes."""
    n = 60
    x = spark.range(n * n).select((F.col("id") % n).alias("i"), F.floor(F.col("id") / n).alias("j"), F.lit(1).alias("value")).coalesce(1)
    for name, v in (("STRIPE", 60), ("TASKS", 2)):
        monkeypatch.setattr(stripes, name, v)
    monkeypatch.setattr(stripes.striped, "__defaults__", (60, stripes.LONG))
    asked = []
    monkeypatch.setattr(stripes, "multiply", lambda cut, *a, f=stripes.multiply, **k: (asked.append(cut.count()), f(cut, *a, **k))[1])
    assert ex.multiply(x, x, many=0).filter(F.col("value") == n).count() == n * n
    assert asked[0] < n / 3
