from pyspark.sql import functions as F

from quillmat import datamatrix
from quillmat.datamatrix import DataMatrix, LowRank


def test_dense_in_squares(spark, monkeypatch):
    """Every cell as joins give it: stored ones that stand twice, identifiers that do, cells of unknown ones, and terms; result cells aren't shuffled."""
    monkeypatch.setattr(datamatrix, "SQUARE", 8)
    var = spark.createDataFrame([(f"v{i % 37}", i) for i in range(40)], "id string, ord long")
    obs = spark.createDataFrame([(i, i) for i in range(50)], "id long, ord long")
    cells = [(f"v{i * 7 % 41}", i * 11 % 53, i + 0.5) for i in range(300)] + [("v1", 3, 4.0), ("v1", 3, 5.0), ("v2", 2, None)]
    mat = spark.createDataFrame(cells, "var_id string, obs_id long, value double")
    left = spark.createDataFrame([(f"v{i}", [float(i), 2.0]) for i in range(30)], "var_id string, b array<double>")
    right = spark.createDataFrame([(i, [0.1, float(i)]) for i in range(45)], "obs_id long, x array<double>")
    for terms in ((), (LowRank(left, right, 2),), (LowRank(left, right, 2), LowRank(left, right, 1))):
        data = DataMatrix(mat, var, obs, terms=terms)
        want = var.select(F.col("id").alias("var_id")).crossJoin(obs.select(F.col("id").alias("obs_id"))).join(mat, ["var_id", "obs_id"], "left")
        total = F.coalesce("value", F.lit(0.0))
        for i, t in enumerate(terms):
            want = want.join(left.withColumnRenamed("b", f"b{i}"), "var_id").join(right.withColumnRenamed("x", f"x{i}"), "obs_id")
            total = total + datamatrix.dot(F.col(f"b{i}"), F.col(f"x{i}"), t.rank)
        got = data.dense()
        assert got.columns == ["var_id", "obs_id", "value"]
        rows = lambda t: sorted((r.var_id, r.obs_id, round(r.value, 9)) for r in t.collect())
        assert rows(got) == rows(want.select("var_id", "obs_id", total.alias("value")))
    plan = DataMatrix(mat, var, obs).dense()._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Exchange" not in above


def test_dense_shuffles_no_pairs_of_groups(spark, monkeypatch):
    """Squares meet identifiers by an exchange, not by a product of groups that is shuffled with all their terms; strips of a square change nothing."""
    for name, v in (("SQUARE", 4), ("WIDEST", 9), ("TASKS", 3), ("STRIP", 20), ("PASSED", 30)):
        monkeypatch.setattr(datamatrix, name, v)
    var = spark.range(50).select("id", F.col("id").alias("ord"))
    obs = spark.range(31).select(F.concat(F.lit("o"), "id").alias("id"), F.col("id").alias("ord"))
    mat = spark.range(200).select((F.col("id") * 7 % 50).alias("var_id"), F.concat(F.lit("o"), F.col("id") * 3 % 31).alias("obs_id"), (F.col("id") + 1).alias("value"))
    term = LowRank(var.select(F.col("id").alias("var_id"), F.array(F.col("id").cast("double")).alias("b")), obs.select(F.col("id").alias("obs_id"), F.array(F.col("ord") + 0.5).alias("x")), 1)
    data = DataMatrix(mat, var, obs, terms=(term,)).dense()
    want = {(i, f"o{j}"): i * (j + 0.5) for i in range(50) for j in range(31)}
    for k in range(200):
        want[k * 7 % 50, f"o{k * 3 % 31}"] += k + 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.var_id, r.obs_id): r.value for r in data.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and data.count() == 50 * 31
    plan = data._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_rounding_is_that_of_sql(spark):
    import duckdb
    import numpy as np

    from quillmat.queries import fast_round

    rng = np.random.default_rng(0)
    some = [*rng.normal(0, 100, 500).round(5).tolist(), *(rng.integers(-9999, 9999, 500) / 2e4).tolist(), 0.00005, -0.00005, 4.9999999999999996e-05, 1.00005, 2.5, 1e300, -1e17, 1e308, 0.0, -0.0, -1e-9]
    table = spark.createDataFrame([(float(v),) for v in some], "value double")
    for digits in (4, 6):
        got = sorted(r.value for r in table.select(fast_round("value", digits)).collect())
        want = [r[0] for r in duckdb.sql(f"SELECT round(v, {digits}) + 0.0 AS v FROM (SELECT unnest({[float(v) for v in some]}::DOUBLE[]) AS v) ORDER BY v").fetchall()]
        assert got == want
