import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmat.datamatrix import DataMatrix
from quillmat.operators import counts, tables, transforms
from tests.test_matrix import OBS, column, matrix


@pytest.mark.parametrize("clip", [1.0, 50.0])
def test_dense_residuals(spark, clip):
    r = transforms.sctransform(matrix(spark), min_cells=1, clip=clip)
    fit = {v[r.var_key]: v for v in r.var.collect()}
    totals = {o[r.obs_key]: o["_total"] for o in r.obs.collect()}
    counts_ = {(c.var_id, c.obs_id): c.value for c in matrix(spark).mat.collect()}
    rows, empty = r.dense().collect(), 0
    assert len(rows) == len(fit) * len(OBS) and len(set(totals.values())) > 3
    sums = dict.fromkeys(fit, 0.0)
    for c in rows:
        v, x = fit[c.var_id], counts_.get((c.var_id, c.obs_id), 0)
        mu = math.exp(v.beta0 + v.beta1 * math.log10(totals[c.obs_id]))
        z = (x - mu) / math.sqrt(mu + mu * mu / v.theta)
        empty += x == 0
        want = np.clip(z, -clip, clip) if x else z  # empty cells are never clipped
        assert abs(c.value - want) < 1e-6
        sums[c.var_id] += want
    assert empty > 10
    assert np.allclose(column(counts.row_sums(r), "var_id", "total", list(sums)), list(sums.values()), atol=1e-5)


def test_poisson_fit_meets_its_score_equations():
    rng = np.random.default_rng(2)
    t = rng.uniform(2, 4, 500)
    mu = np.exp(-4 + np.outer([0.5, 1.0, 1.6], t))
    x = rng.poisson(mu).astype(float)
    x = x[x.sum(1) > 0]
    b0, b1, total, squares = transforms.poisson_fit(x.sum(1), x @ t, np.ones(500), t)
    fitted = np.exp(b0[:, None] + b1[:, None] * t)
    assert np.allclose(fitted.sum(1), x.sum(1)) and np.allclose(fitted @ t, x @ t) and np.allclose(squares, (fitted**2).sum(1)) and np.allclose(total, x.sum(1))


def test_fit_recovers_slopes_and_marks_outliers(spark):
    rng = np.random.default_rng(7)
    n, p = 400, 60
    depth = rng.uniform(0.3, 3, n)
    theta = np.full(p, 5.0)
    slope = np.ones(p)
    slope[17] = -1.0  # falls with the total, unlike all others
    mean = rng.uniform(2, 8, p)[:, None] * depth[None] ** slope[:, None]
    x = rng.negative_binomial(theta[:, None], theta[:, None] / (theta[:, None] + mean))
    ids, obs = [f"g{i:02}" for i in range(p)], [f"c{j}" for j in range(n)]
    cells = [(ids[i], obs[j], int(v)) for (i, j), v in np.ndenumerate(x) if v]
    d = DataMatrix(spark.createDataFrame(cells, "var_id string, obs_id string, value long"), tables.create_table(spark, id=ids), tables.create_table(spark, id=obs))
    fit = {r.id: r for r in transforms.sctransform(d).var.collect()}
    assert [k for k, r in fit.items() if r.outlier] == ["g17"]
    others = [r for k, r in fit.items() if k != "g17"]
    assert all(abs(r.beta1 / math.log(10) - 1) < 0.15 for r in others)
    assert 3 < np.median([r.theta for r in others]) < 8
    smooth = transforms.regularize(spark.createDataFrame([("a", 0.0, 0.1, 2.3, 1.0)], "var_id string, log_mean double, beta0 double, beta1 double, theta double"))
    assert smooth.select(F.round("beta0", 6).alias("b")).first().b == 0.1  # alone, a variable keeps its own
