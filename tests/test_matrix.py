import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmat.datamatrix import DataMatrix, data_matrix
from quillmat.operators import counts, design, filters, reduce, stats, tables, transforms
from quillmat.functions import distributions

VARS, OBS = [f"v{i}" for i in range(12)], [f"o{j}" for j in range(30)]


def dense(seed=1):
    rng = np.random.default_rng(seed)
    m = rng.poisson(1.5, (len(VARS), len(OBS)))
    m[5] = 2
    m[3] = 0  # a variable, and an observation, without cells
    m[:, 7] = 0
    return m


def matrix(spark, m=None):
    m = dense() if m is None else m
    cells = [(VARS[i], OBS[j], int(v)) for (i, j), v in np.ndenumerate(m) if v]
    var = tables.create_table(spark, id=VARS, kind=["x" if i % 3 else "y" for i in range(len(VARS))])
    obs = tables.create_table(spark, id=OBS, group=["ABC"[j % 3] for j in range(len(OBS))], value=[math.sin(j) + 1 for j in range(len(OBS))], gap=[None if j % 4 == 0 else float(j) for j in range(len(OBS))])
    return DataMatrix(spark.createDataFrame(cells, "var_id string, obs_id string, value long"), var, obs)


def as_array(frame, rows=VARS, cols=OBS, i="var_id", j="obs_id"):
    out = np.zeros((len(rows), len(cols)))
    for r in frame.collect():
        out[rows.index(r[i]), cols.index(r[j])] = r["value"]
    return out


def column(frame, key, name, ids):
    got = {r[key]: r[name] for r in frame.collect()}
    return np.array([got[x] for x in ids], float)


def test_wrapper_checks(spark):
    d = matrix(spark)
    assert "12" not in repr(d) and "A" in repr(d)
    with pytest.raises(ValueError):
        data_matrix(d.mat, d.var.filter("id <> 'v0'"), d.obs)
    with pytest.raises(ValueError):
        data_matrix(d.mat, d.var.union(d.var), d.obs, duplicate_var="error")
    with pytest.warns(UserWarning):
        data_matrix(d.mat, d.var, d.obs.union(d.obs.limit(1)))
    assert d.same_as(matrix(spark)) and not d.same_as(filters.filter_var("id <> 'v1'", d))
    assert np.array_equal(as_array(d.transposed().mat, OBS, VARS), dense().T)


def test_filters(spark):
    d = matrix(spark)
    known = tables.create_table(spark, id=["o1", "o2", "nowhere"], mark=[1, 2, 3])
    kept = filters.filter_obs((known, lambda c: c.isNotNull()), d)
    assert sorted(r.id for r in kept.obs.collect()) == ["o1", "o2"] and kept.mat.select("obs_id").distinct().count() == 2
    assert [r.id for r in filters.filter_var(range(2, 9, 3), d).var.orderBy("ord").collect()] == ["v2", "v5", "v8"]
    assert filters.filter_matrix(("kind", lambda c: c == "y"), "value > 1", d).var.count() == 4
    both = filters.subset_matrix(d, tables.create_table(spark, id=["v9", "v2"]), tables.create_table(spark, id=["o5"]))
    assert tables.column_data(both.var) == ["v9", "v2"]
    with pytest.raises(KeyError):
        filters.subset_var(d, tables.create_table(spark, id=["nope"]))
    assert filters.without_missing(d, ["gap"]).obs.count() == 22
    assert column(filters.matrix_row(d, "v3"), "obs_id", "value", OBS).sum() == 0


def test_counts(spark):
    m, d = dense(), matrix(spark)
    assert np.array_equal(column(counts.var_counts_sum(d, "s").obs, "id", "s", OBS), m.sum(0))
    assert np.array_equal(column(counts.var_counts_sum(d, "s", "kind = 'y'", lambda c: c != 0).obs, "id", "s", OBS), (m[::3] != 0).sum(0))
    assert np.array_equal(column(counts.obs_counts_sum(d, "s").var, "id", "s", VARS), m.sum(1))
    with pytest.raises(ValueError):
        counts.var_counts_sum(d, "s", None, lambda c: c + 1)
    assert np.allclose(column(counts.var_counts_fraction(d, "f", "kind = 'y'").obs, "id", "f", OBS), m[::3].sum(0) / np.maximum(1, m.sum(0)))
    assert np.allclose(column(counts.obs_counts_fraction(d, "f", "group = 'A'", "group <> 'B'").var, "id", "f", VARS), m[:, ::3].sum(1) / np.maximum(1, m[:, [j for j in range(30) if j % 3 != 1]].sum(1)))
    c = m - m.mean(1, keepdims=True)
    got = reduce.centred(d)
    assert np.allclose(as_array(got.dense()), c)
    assert np.allclose(column(counts.sum_squared(got), "var_id", "ss", VARS), (c**2).sum(1))
    assert np.allclose(column(counts.sum_squared(got, "obs_id"), "obs_id", "ss", OBS), (c**2).sum(0))
    twice = design.normalize(got, "value")
    assert np.allclose(column(counts.sum_squared(twice), "var_id", "ss", VARS), (as_array(twice.dense()) ** 2).sum(1))
    assert np.allclose(column(counts.std(got, assume_centered=True).var, "id", "std", VARS), m.std(1, ddof=1))
    with pytest.raises(ValueError):
        counts.variance(d, assume_centered=False)
    assert np.allclose(column(counts.row_sums(design.normalize(d, "value", center=False)), "var_id", "total", VARS), as_array(design.normalize(d, "value", center=False).dense()).sum(1))
    assert np.array_equal(column(counts.column_sums(d, lambda c: c * c), "obs_id", "total", OBS), (m**2).sum(0))
    several = counts.var_counts(d, {"s": (None, None), "nz": ("kind = 'y'", lambda c: c != 0)}, {"f": ("kind = 'y'", None)}).obs
    assert np.array_equal(column(several, "id", "s", OBS), m.sum(0)) and np.array_equal(column(several, "id", "nz", OBS), (m[::3] != 0).sum(0))
    assert np.allclose(column(several, "id", "f", OBS), m[::3].sum(0) / np.maximum(1, m.sum(0)))


def test_pseudobulk(spark):
    m, d = dense(), matrix(spark)
    d = d.with_obs(d.obs.withColumn("half", F.when(F.col("ord") < 1, "lo").otherwise("hi")))
    bulk = counts.pseudobulk(d, "group", "half")
    assert tables.column_data(bulk.obs) == ["A_lo", "A_hi", "B_lo", "B_hi", "C_lo", "C_hi"]
    got = as_array(bulk.mat, VARS, tables.column_data(bulk.obs))
    assert np.allclose(got[:, 1], m[:, 3::3].mean(1)) and got[:, 2].sum() == 0
    with pytest.raises(ValueError):
        counts.pseudobulk(d, "gap")
    shares = counts.population_matrix(d.obs, "group", new_var="half")
    assert tables.column_data(shares.var) == ["lo", "hi"] and tables.column_data(shares.obs) == ["A", "B", "C"]
    assert np.allclose(as_array(shares.mat, ["lo", "hi"], list("ABC")), [[0.1, 0, 0], [0.9, 1, 1]])
    both = counts.population_matrix(d.obs, "half", new_var=("group", "half"))
    assert tables.column_data(both.var)[:3] == ["A_lo", "A_hi", "B_lo"] and as_array(both.mat, tables.column_data(both.var), ["lo", "hi"]).sum(0) == pytest.approx([1, 1])
    with pytest.raises(ValueError, match="unseen"):
        counts.population_matrix(d.obs, "half", new_var="group", extras=counts.new_categories(d.obs.filter("group <> 'C'"), ("group",)))


def test_transforms(spark):
    m, d = dense(), matrix(spark)
    t = np.maximum(1, m.sum(0))
    assert np.allclose(as_array(transforms.log_transform(d).mat), np.log2(1 + m * 10000 / t))
    idf = len(OBS) / np.maximum(1, m.sum(1))
    assert np.allclose(as_array(transforms.tf_idf_transform(d).mat), np.log(1 + 10000 * m / t * idf[:, None]))
    r = transforms.sctransform(d, min_cells=1)
    assert r.var.count() == 11 and {"beta0", "beta1", "theta", "outlier", "log_mean"} <= set(r.var.columns)
    for f in (transforms.rotx, transforms.roty, transforms.rotz):
        assert np.allclose(f(0.3) @ f(-0.3), np.eye(3))
    assert np.allclose(transforms.flip(1, 3), np.diag([1, -1, 1]))
    pts = spark.createDataFrame([(i, [float(i), float(i % 5)]) for i in range(20)], "obs_id long, x array<double>")
    q = transforms.optimal_transform(pts, spark.createDataFrame([(i, i // 10) for i in range(20)], "obs_id long, group int"), 2)
    assert np.allclose(q @ q.T, np.eye(2))


def design_array(frame, k):
    got = {r.obs_id: r.x for r in frame.collect()}
    return np.array([got[o] for o in OBS])


def test_designs_and_normalization(spark):
    m, d = dense(), matrix(spark)
    x = design_array(design.design_matrix(d, "value", "group"), 5)
    v = np.sin(np.arange(30)) + 1
    assert np.allclose(x[:, 1], (v - v.mean()) / abs(v - v.mean()).max()) and np.allclose(x[:, 2:].sum(1), 1)
    left = m - m @ np.linalg.pinv(x).T @ x.T
    assert np.allclose(as_array(design.normalize(d, "value", "group").dense()), left, atol=1e-8)
    with pytest.raises(ValueError):
        design.fit_design(d.obs, "group", max_categories=2)
    fitted = design.fit_design(d.obs.filter("group <> 'C'"), "group")
    with pytest.raises(ValueError):
        fitted.rows(d.obs, "id")
    outside = tables.create_table(spark, id=OBS, w=[float(j) for j in range(30)])
    assert np.allclose(design_array(design.design_matrix(d, outside), 2)[:, 1], (np.arange(30) - 14.5) / 14.5)


@pytest.mark.parametrize("most_bytes", [1 << 20, 12 * 8 * 17, 1])  # the variables' factor goes to all tasks, the observations', neither
def test_svd(spark, most_bytes):
    m, d = dense(), matrix(spark)
    c = m - m.mean(1, keepdims=True)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    x = reduce.centred(d)
    if most_bytes == 12 * 8 * 17:
        x, u, vt = x.transposed(), vt.T, u.T
    f = reduce.svd(x, nsv=4, niter=4, most_bytes=most_bytes)
    if most_bytes == 12 * 8 * 17:
        f, u, vt = reduce.Factors(f.v.select(F.col("obs_id").alias("var_id"), F.col("v").alias("u")), f.s, f.u.select(F.col("var_id").alias("obs_id"), F.col("u").alias("v"))), vt.T, u.T
    assert np.allclose(f.s, s[:4], rtol=1e-6)
    got_u = np.array([{r.var_id: r.u for r in f.u.collect()}[x] for x in VARS])
    got_v = np.array([{r.obs_id: r.v for r in f.v.collect()}[x] for x in OBS])
    assert np.allclose((got_u * f.s) @ got_v.T, (u[:, :4] * s[:4]) @ vt[:4], atol=1e-5)
    if most_bytes != 12 * 8 * 17:
        assert (np.sum(got_u * abs(got_u), 0) >= 0).all()
    again = {r.obs_id: r.x for r in reduce.project_scores(f, reduce.centred(d)).collect()}
    assert np.allclose(np.array([again[x] for x in OBS]), got_v * f.s, atol=1e-6)


def test_distributions():
    assert distributions.f_tail([1.0, 4.0, np.inf, np.nan], 2, 10)[:3] == pytest.approx([0.4019, 0.0529, 0.0], abs=1e-3)
    # closed forms: F(2, v) has tail (1 + 2f/v)^(-v/2); t with 1 and 2 degrees of freedom
    for f in (0.1, 1.0, 7.5, 300.0):
        for v in (1, 4, 57):
            assert distributions.f_tail([f], 2, v)[0] == pytest.approx((1 + 2 * f / v) ** (-v / 2), rel=1e-10)
    for t in (0.2, 1.5, 20.0):
        assert distributions.t_two_sided([t], 1)[0] == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-9)
        assert distributions.t_two_sided([t], 2)[0] == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-9)
    assert distributions.normal_tail([0.0, 1.959964])[1] == pytest.approx(0.025, rel=1e-5)


def test_ftest_and_ttest(spark):
    m, d = dense(), matrix(spark)
    v = np.sin(np.arange(30)) + 1
    x0 = np.column_stack([np.ones(30), v])
    g = np.array([[j % 3 == k for k in range(3)] for j in range(30)], float)
    q = lambda x: (lambda u, s, _: u[:, s > 1e-9])(*np.linalg.svd(x, full_matrices=False))
    full, null = q(np.column_stack([x0, g])), q(x0)
    ss = lambda b: ((m @ b) ** 2).sum(1)
    v1, v2 = full.shape[1] - null.shape[1], 30 - full.shape[1]
    rest = (m**2).sum(1) - ss(full)
    got = stats.ftest(d, ["group"], h0=("value",))
    f = column(got, "var_id", "F", VARS)
    with np.errstate(invalid="ignore", divide="ignore"):
        want = (ss(full) - ss(null)) / v1 / (rest / v2)
    ok = [i for i in range(len(VARS)) if i != 3]
    assert np.allclose(f[ok], want[ok], rtol=1e-6)
    assert np.allclose(column(got, "var_id", "pValue", VARS)[ok], distributions.f_tail(want[ok], v1, v2))
    assert [r.F for r in stats.ftest(d, ["value"], h0=("value",)).collect()] == [0.0] * 12
    t = stats.ttest(d, "value")
    slope = np.array([np.polyfit(v, y, 1)[0] for y in m])
    assert np.allclose(column(t, "var_id", "difference", VARS), slope, atol=1e-9)
    two = stats.ttest(filters.filter_obs("group <> 'C'", d), design.twogroup("group", "A", "B"))
    assert np.allclose(column(two, "var_id", "difference", VARS), m[:, ::3].mean(1) - m[:, 1::3].mean(1), atol=1e-9)
    with pytest.raises(ValueError):
        stats.ttest(d, "group")
    with pytest.raises(ValueError):
        stats.ftest(d, ["gap"], h1_missing="error")
    assert stats.ftest(d, ["gap"]).count() == 12
    plain = stats.ftest(d, ["group"], statistic_col="stat", pvalue_col=None, do_sort=False, var_columns=("kind",))
    assert plain.columns == ["var_id", "kind", "stat"] and [r.var_id for r in plain.collect()] == VARS
    ordered = [r.F for r in got.collect() if not math.isnan(r.F)]
    assert ordered == sorted(ordered, reverse=True)
    by_t = [abs(r.t) for r in t.collect() if not math.isnan(r.t)]
    assert by_t == sorted(by_t, reverse=True)


def test_mannwhitney(spark):
    m, d = dense(), matrix(spark)
    got = stats.mannwhitney(d, "group", "A", "B")
    u, p = column(got, "var_id", "U", VARS), column(got, "var_id", "pValue", VARS)
    for i in range(len(VARS)):
        a, b = m[i, ::3], m[i, 1::3]
        assert u[i] == sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert p[3] == 1 and (p <= 1).all() and got.columns == ["var_id", "U", "pValue"]
    z = [abs(r.z) for r in stats.mannwhitney(d, "group", "A", "B", z_col="z").collect()]
    assert z == sorted(z, reverse=True)
    with pytest.raises(ValueError):
        stats.mannwhitney(d, "group")
    with pytest.raises(ValueError):
        stats.mannwhitney(d, "group", "Z")
    bad = DataMatrix(d.mat.union(spark.createDataFrame([("v0", "o1", -1)], d.mat.schema)), d.var, d.obs)
    with pytest.raises(Exception, match="positive"):
        stats.mannwhitney(bad, "group", "A").collect()
