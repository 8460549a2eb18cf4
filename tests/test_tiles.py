"""Tiles against numpy, with edges that fit nowhere, and against the product of cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmat import queries
from quillmat.datamatrix import DataMatrix
from quillmat.operators import tiles
from quillmat.plans import expressions
from tests.test_matrix import as_array, dense, matrix
from tests.test_queries import SF

VARS, OBS = [f"v{i}" for i in range(12)], [f"o{j}" for j in range(30)]


@pytest.mark.parametrize("edge", [1, 5, 12, 64])
def test_tiles_against_numpy(spark, edge):
    m, d = dense(), matrix(spark)
    a = tiles.blockify(d, edge)
    assert np.array_equal(as_array(tiles.unblockify(a)), m)
    flipped = tiles.transposed(a)
    assert np.array_equal(as_array(tiles.unblockify(flipped, "obs_id", "var_id")), m)
    gram = tiles.multiply(a, flipped)
    assert np.array_equal(as_array(tiles.unblockify(gram, "i", "j"), VARS, VARS, "i", "j"), m @ m.T)
    assert np.array_equal(as_array(tiles.unblockify(tiles.multiply(gram, a), "i", "j"), VARS, OBS, "i", "j"), m @ m.T @ m)
    assert np.array_equal(as_array(tiles.unblockify(tiles.add(a, a, a))), 3 * m)
    w = np.random.default_rng(0).normal(size=(30, 3))
    got = {r.pos: r.y for r in tiles.times_factor(a, w).collect()}
    assert np.allclose([got[i] for i in range(12)], m @ w)
    with pytest.raises(ValueError, match="size"):
        tiles.multiply(a, tiles.blockify(d, edge + 1))


def test_sparse_dense_and_empty_tiles(spark, monkeypatch):
    monkeypatch.setattr(tiles, "HELD", 2)
    rng = np.random.default_rng(1)
    m = np.where(rng.random((12, 30)) < 0.1, rng.integers(1, 9, (12, 30)), 0)
    m[:4, :4] = 7  # a full tile
    m[8:] = 0  # empty ones
    d = matrix(spark, m)
    forms = {(r.bi, r.bj): r.places is None for r in tiles.blockify(d, 4).table.collect()}
    assert forms[0, 0] and not all(forms.values()) and not any(bi == 2 for bi, _ in forms)
    a = tiles.blockify(d, 4)
    assert np.array_equal(as_array(tiles.unblockify(tiles.multiply(tiles.transposed(a), a), "i", "j"), OBS, OBS, "i", "j"), m.T @ m)
    twice = DataMatrix(d.mat.union(d.mat), d.var, d.obs)
    assert np.array_equal(as_array(tiles.unblockify(tiles.blockify(twice, 4))), 2 * m)
    none = tiles.blockify(DataMatrix(d.mat.limit(0), d.var, d.obs), 4)
    assert tiles.unblockify(tiles.multiply(tiles.transposed(none), none), "i", "j").count() == 0


def moved(df):
    """Rows written to shuffles by a query, as its plan's metrics say after it ran."""
    df._jdf.queryExecution().toRdd().count()
    plan, rows, stack = df._jdf.queryExecution().executedPlan(), 0, []
    stack.append(plan)
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if hasattr(node, "plan") and node.getClass().getSimpleName().endswith("StageExec"):
            stack.append(node.plan())
            continue
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            rows += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        stack += [children.apply(k) for k in range(children.size())]
    return rows


def test_a_product_of_tiles_moves_fewer_rows(spark):
    data = queries.ps(spark, SF)
    cut = DataMatrix(data.mat.persist(), data.var, data.obs)
    a = tiles.blockify(cut)
    held = tiles.Tiles(a.table.persist(), a.rows, a.cols, a.edge)
    assert held.table.count() > 1
    left = cut.mat.select(F.col("obs_id").alias("i"), F.col("var_id").alias("j"), "value")
    cells = moved(expressions.multiply(left, cut.mat.select(F.col("var_id").alias("i"), F.col("obs_id").alias("j"), "value")))
    assert moved(tiles.multiply(tiles.transposed(held), held).table) < cells / 20


def test_cells_of_tiles_are_not_shuffled(spark):
    """Identifiers meet whole tiles: cells are taken out of their tiles after the last exchange."""
    cells = spark.range(400).select(F.concat(F.lit("p"), F.col("id") % 21).alias("var_id"), (F.col("id") * 7 % 17).alias("obs_id"), (F.col("id") % 5).cast("double").alias("value")).dropDuplicates(["var_id", "obs_id"])
    var = spark.range(21).select(F.concat(F.lit("p"), "id").alias("id"), F.col("id").alias("ord"))
    obs = spark.range(17).select("id", F.col("id").alias("ord"))
    out = tiles.unblockify(tiles.blockify(DataMatrix(cells, var, obs), 4))
    assert sorted(map(tuple, out.collect())) == sorted(tuple(r) for r in cells.filter("value <> 0").collect())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("Generate")]


def test_tiles_are_cut_from_sorted_cells_not_group_by_group(spark):
    """Tiles go on from batch to batch, cells stand in several of them, and no Python call is made for each tile."""
    rng = np.random.default_rng(2)
    m = np.where(rng.random((12, 30)) < 0.4, rng.integers(-2, 9, (12, 30)), 0)
    d = matrix(spark, m)
    twice = DataMatrix(d.mat.union(d.mat).union(d.mat.filter("value > 6").selectExpr("var_id", "obs_id", "-2 * value AS value")), d.var, d.obs)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for edge in (1, 4, 7, 64):
            a = tiles.blockify(twice, edge)
            assert np.array_equal(as_array(tiles.unblockify(a)), np.where(m > 6, 0, 2 * m))
            assert a.table.count() == a.table.select("bi", "bj").distinct().count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in a.table._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("cheap", [0, 10**9])
def test_squares_of_a_product_with_its_inner_index_cut(spark, monkeypatch, cheap):
    """Squares, cuts, few inner tiles at once and both ways to multiply change nothing; infinities are never multiplied by cells that aren't there."""
    for name, v in (("SIDE", 2), ("TASKS", 200), ("LEAST", 2), ("INNER", 2), ("CELLS", 30), ("AT_ONCE", 20), ("CHEAP", cheap)):
        monkeypatch.setattr(tiles, name, v)
    rng = np.random.default_rng(3)
    m = np.where(rng.random((12, 30)) < 0.4, rng.integers(-2, 9, (12, 30)), 0).astype(float)
    d = matrix(spark, m)
    a = tiles.held(tiles.blockify(d, 4))
    assert np.array_equal(as_array(tiles.unblockify(tiles.multiply(tiles.transposed(a), a), "i", "j"), OBS, OBS, "i", "j"), m.T @ m)
    assert np.array_equal(as_array(tiles.unblockify(tiles.multiply(a, tiles.transposed(a)), "i", "j"), VARS, VARS, "i", "j"), m @ m.T)
    i, j = np.argwhere(m > 0)[0]
    m[i, j] = np.inf
    a = tiles.blockify(DataMatrix(d.mat.select("var_id", "obs_id", F.when((F.col("var_id") == VARS[i]) & (F.col("obs_id") == OBS[j]), float("inf")).otherwise(F.col("value")).alias("value")), d.var, d.obs), 4)
    got = as_array(tiles.unblockify(tiles.multiply(tiles.transposed(a), a), "i", "j"), OBS, OBS, "i", "j")
    with np.errstate(invalid="ignore"):
        want = np.nansum(m.T[:, :, None] * m[None], 1)
    assert np.array_equal(got, want)


def test_tiles_of_a_long_result_are_not_shuffled(spark):
    """Tiles of the factors travel to the squares of the result, not a tile for each pair that meets."""
    a = tiles.blockify(matrix(spark), 1)
    held = tiles.held(a)
    gram = tiles.held(tiles.multiply(tiles.transposed(held), held))
    out = tiles.multiply(held, gram).table
    assert moved(out) < 12 * 30 * 30 / 2
