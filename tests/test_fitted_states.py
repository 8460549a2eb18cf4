"""Stored states, frozen arguments, single fields, and theta by maximum likelihood."""

import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmat.datamatrix import DataMatrix
from quillmat.operators import filters, transforms
from quillmat.plans import jobs, store
from quillmat.sources import readers
from tests.test_matrix import as_array, dense, matrix

VARS, OBS = [f"v{i}" for i in range(12)], [f"o{j}" for j in range(30)]


def table(spark, *values):
    return jobs.source(spark.createDataFrame(list(enumerate(map(float, values))), "id long, x double"))


def pairs(op):
    def f(_, a, b):
        b = b.select("id", F.col("x").alias("y"))
        return a.join(b, "id").select("id", op(F.col("x"), F.col("y")).alias("x"))

    return f


def values(job):
    return [r.x for r in job.fetch().orderBy("id").collect()]


add = jobs.step("add", pairs(lambda a, b: a + b))
div = jobs.step("div", pairs(lambda a, b: a / b), frozen=(0,))  # the dividend stays the base's


def test_frozen_arguments(spark):
    a, a2, b, b2, c, c2 = (table(spark, *x) for x in ((8, 6), (80, 60), (2, 3), (4, 6), (1, 2), (5, 10)))
    assert jobs.project(a, {a: a2}) is a2
    both = jobs.project(add(a, b), {a: a2, b: b2})
    assert values(both) == [84, 66] and both.fingerprint() == add(a2, b2).fingerprint()
    j = div(a, b)
    assert values(jobs.project(j, {a: a2, b: b2})) == [2, 1] and jobs.project(j, {a: a2, b: b2}).fingerprint() == div(a, b2).fingerprint()
    assert jobs.project(j, {a: a2}) is j and jobs.project(j, {j: b2}) is b2
    # a sum below a quotient: nothing below the frozen side is replaced, neither its parts nor itself
    sums = add(a, b)
    top = div(sums, c)
    assert values(jobs.project(top, {c: c2})) == [2, 0.9] and jobs.project(top, {c: c2}).fingerprint() == div(sums, c2).fingerprint()
    assert jobs.project(top, {b: b2}) is top and jobs.project(top, {sums: b2}) is top
    # a quotient below a sum: the quotient follows where it may, and can be replaced itself
    low = div(a, b)
    out = add(low, c)
    assert values(jobs.project(out, {c: c2})) == [9, 12] and values(jobs.project(out, {b: b2})) == [3, 3]
    assert jobs.project(out, {b: b2}).fingerprint() == add(div(a, b2), c).fingerprint()
    assert values(jobs.project(out, {low: b2})) == [5, 8] and jobs.project(out, {a: a2}) is out
    # once more: what was projected keeps what was frozen
    assert values(jobs.project(jobs.project(j, {b: b2}), {b2: c2, a: a2})) == [8 / 5, 6 / 10]


def test_frozen_parameters_and_own_steps(spark):
    a, a2 = table(spark, 1, 2), table(spark, 3, 4)
    times = lambda t, by, plus: t.select("id", (F.col("x") * by + plus).alias("x"))
    j = jobs.apply_job(times, a, by=10, plus=7, frozen=("plus",))
    assert values(j) == [17, 27] and values(jobs.project(j, {a: a2, 10: 100, 7: 0})) == [307, 407]
    fixed = jobs.apply_job(lambda t, u: t.join(u.select("id", F.col("x").alias("y")), "id").select("id", (F.col("x") < F.col("y")).alias("x")), a, a2, frozen=(1,))
    assert values(fixed) == [True, True] and values(jobs.project(fixed, {a: a2, a2: a})) == [False, False]


def counted(spark, name):
    """A matrix whose cells can't be had."""

    def forbidden():
        raise AssertionError("cells were asked for")

    d = matrix(spark)
    return jobs.fields_source(name, mat=forbidden, var=lambda: d.var, obs=lambda: d.obs), d


def test_single_fields_ask_for_no_cells(spark):
    leaf, d = counted(spark, "one")
    other, _ = counted(spark, "two")
    chain = jobs.tf_idf_transform(jobs.log_transform(leaf), annotate=False)
    few = jobs.filter_obs(jobs.filter_var(chain, where="kind = 'y'"), where="value > 0")
    counted_on = jobs.var_counts_sum(few, name="n")
    assert sorted(r.id for r in jobs.get_obs(few).fetch().collect()) == sorted(r.id for r in d.obs.filter("value > 0").collect())
    assert sorted(r.id for r in jobs.get_var(counted_on).fetch().collect()) == sorted(r.id for r in d.var.filter("kind = 'y'").collect())
    assert jobs.get_var(jobs.transpose(few)).fetch().count() == d.obs.filter("value > 0").count()
    normal = jobs.normalize_matrix(jobs.subset_obs(leaf, ids=d.obs.limit(3).select("id", "ord")))
    assert jobs.get_obs(normal).fetch().count() == 3
    # under projection, too: the base's variables are kept, the new observations are chosen anew
    again = jobs.project(jobs.get_var(counted_on), {leaf: other})
    assert again.fetch().count() == d.var.filter("kind = 'y'").count()
    with pytest.raises(AssertionError, match="cells"):
        jobs.get_matrix(few).fetch()


def test_fields_agree_with_the_whole(spark):
    d = matrix(spark)
    base = jobs.source(d)
    steps = [
        jobs.filter_var(base, where="kind = 'y'"), jobs.filter_var(base, where="kind = 'y'", project_ids="no"), jobs.filter_obs(base, where="value > 0"), jobs.transpose(base), jobs.log_transform(base),
        jobs.tf_idf_transform(base, annotate=True), jobs.var_counts_sum(base, name="n"), jobs.obs_counts_sum(base, name="n"), jobs.subset_var(base, ids=d.var.filter("ord < 4").select("id", "ord")),
    ]
    for j in steps:
        for name in ("mat", "var", "obs"):
            apart, whole = jobs.Field(f"get_{name}", (j,)).fetch(), getattr(jobs.Job.fetch(j), name)
            assert sorted(map(repr, apart.select(sorted(apart.columns)).collect())) == sorted(map(repr, whole.select(sorted(whole.columns)).collect())), (j, name)


def test_store_round_trip(spark, tmp_path):
    from quillmat.operators import design

    d = matrix(spark)
    s = store.Store(spark, str(tmp_path / "store"))
    centred = design.normalize(d, "value", "group")
    labels = d.obs.select("id", "group", "ord")
    fitted = design.fit_design(d.obs, design.categorical(labels), "value")
    value = (centred, fitted, np.arange(6.0).reshape(2, 3), [1, 2.5, None, "x", True, float("inf")], {"k": np.float64(0.1)}, labels, labels)
    calls = []
    got = s.keep("ab01", lambda: calls.append(1) or value, "all sorts")
    assert np.allclose(as_array(got[0].dense(), VARS, OBS), as_array(centred.dense(), VARS, OBS)) and isinstance(got[0], DataMatrix)
    assert np.array_equal(got[2], value[2]) and got[3] == value[3] and got[4] == value[4] and got[5] is got[6]
    rows = lambda f: sorted((r.obs_id, tuple(r.x)) for r in f.rows(d.obs, "id").collect())
    assert rows(got[1]) == rows(fitted)
    assert s.keep("ab01", lambda: calls.append(1), "again")[3] == value[3] and calls == [1] and (s.writes, s.hits) == (1, 1)
    (entry,) = s.entries()
    assert entry["address"] == "ab01" and entry["name"] == "all sorts" and entry["bytes"] > 0
    assert s.keep("cd02", lambda: (lambda: 1), "a function can't be stored")() == 1 and len(s.entries()) == 1
    assert s.remove() == 1 and s.entries() == []
    with pytest.raises(KeyError):
        s.get("ab01")


SESSION = """
import sys
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.quillmat.store.dir", sys.argv[1]).config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from quillmat.plans import jobs, store
base, new = (jobs.matrix_source(spark, f"{sys.argv[2]}/{n}") for n in ("even", "odd"))
job = jobs.sctransform(base, min_cells=1)
out = jobs.project(job, {base: new}).fetch()
rows = sorted((r.id, r.beta0.hex(), r.theta.hex()) for r in out.var.select("id", "beta0", "theta").collect())
total = jobs.stored(jobs.var_counts_sum(jobs.log_transform(base), name="t"))
n = sorted((r.id, float(r.t).hex()) for r in total.fetch().obs.collect())
held = store.default_store(spark, True)
print("RESULT", held.writes, held.hits, hash(str(rows + n)))
"""


def test_another_session_finds_the_fit(spark, tmp_path):
    d = matrix(spark)
    for k, name in enumerate(("even", "odd")):
        readers.save(filters.filter_obs(f"ord % 2 = {k}", d), str(tmp_path / name))
    (tmp_path / "run.py").write_text(SESSION)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = []
    for _ in range(2):
        env = os.environ | {"PYTHONPATH": root, "PYTHONHASHSEED": "0"}
        out = subprocess.run([sys.executable, str(tmp_path / "run.py"), str(tmp_path / "store"), str(tmp_path)], env=env, capture_output=True, text=True, timeout=600, check=True).stdout
        said.append(next(x for x in out.splitlines() if x.startswith("RESULT")).split()[1:])
    assert said[0][:2] == ["2", "0"] and said[1][:2] == ["0", "2"] and said[0][2] == said[1][2]


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Scan ")


def test_projection_reads_no_base_table(spark, tmp_path):
    d = matrix(spark)
    for k, name in enumerate(("even", "odd")):
        readers.save(filters.filter_obs(f"ord % 2 = {k}", d), str(tmp_path / name))
    base, new = (jobs.matrix_source(spark, str(tmp_path / n)) for n in ("even", "odd"))
    for make in (jobs.sctransform(base, min_cells=1), jobs.tf_idf_transform(base), jobs.normalize_matrix(base, covariates=("value",)), jobs.filter_var(jobs.obs_counts_sum(base, name="n"), where="n > 20"), jobs.svd(base, nsv=2)):
        out = jobs.project(make, {base: new}).fetch()
        for name in ("mat", "var", "obs", "u", "v"):
            if hasattr(out, name):
                plan = getattr(out, name)._jdf.queryExecution().optimizedPlan()
                assert not any(f"{tmp_path}/even" in f for f in getattr(out, name).inputFiles()), (make, name)
                assert scans(getattr(out, name)) < 12, (make, name, plan.toString())
    # the fit is one value: base and projection have the same bits
    one = jobs.sctransform(base, min_cells=1)
    bits = lambda t: {r.id: (r.beta0, r.beta1, r.theta) for r in t.collect()}
    assert bits(one.fetch().var) == bits(jobs.project(one, {base: new}).fetch().var)
    assert jobs.forget(one) == 1


def likelihood(theta, x, mu):
    up = np.array([math.lgamma(v + theta) for v in x]) - math.lgamma(theta)
    return (up + theta * np.log(theta / (theta + mu)) + x * np.log(mu / (mu + theta))).sum()


def test_theta_is_the_maximum(spark):
    """Against a golden section over the whole likelihood, every cell on its own; and the truth for variables with enough counts."""
    rng = np.random.default_rng(0)
    n, theta = 3000, np.array([0.3, 1, 3, 10, 0.5, 2])
    totals = np.round(np.exp(rng.normal(8, 0.6, n)))
    share = np.array([2e-3, 2e-3, 5e-3, 2e-2, 2e-4, 5e-4])
    mu = share[:, None] * totals
    x = rng.poisson(mu * rng.gamma(theta[:, None], 1 / theta[:, None], mu.shape))
    flat = rng.poisson(mu[:1])  # no more spread than Poisson: theta at its upper end, or far up
    x = np.vstack([x, flat])
    i, j = np.nonzero(x)
    mat = spark.createDataFrame(list(zip(i.tolist(), j.tolist(), x[i, j].tolist(), strict=True)), "var_id long, obs_id long, value long")
    counts = spark.createDataFrame(list(enumerate(totals.tolist())), "obs_id long, total double")
    ids = lambda k: spark.range(k).select("id", F.col("id").alias("ord"))
    got = {r.var_id: r for r in transforms.fit_parameters(DataMatrix(mat, ids(len(x)), ids(n)), counts, 5).collect()}
    for v in range(len(theta)):
        m = np.exp(got[v].beta0 + got[v].beta1 * np.log10(totals))
        low, high = math.log(1e-3), math.log(1e3)
        for _ in range(60):
            a, b = low + 0.382 * (high - low), low + 0.618 * (high - low)
            low, high = (low, b) if likelihood(math.exp(a), x[v], m) > likelihood(math.exp(b), x[v], m) else (a, high)
        assert got[v].theta == pytest.approx(math.exp(low), rel=0.01)
        assert got[v].theta == pytest.approx(theta[v], rel=0.1 if share[v] >= 2e-3 else 0.25)
        assert m.sum() == pytest.approx(x[v].sum(), rel=1e-6)
    assert got[len(theta)].theta > 50
    # too few cells: not fitted
    assert transforms.fit_parameters(DataMatrix(mat, ids(len(x)), ids(n)), counts, n + 1).count() == 0


def test_digamma():
    first, second = transforms.digamma(np.array([1e-3, 0.5, 1.0, 7.9, 8.0, 1e6]))
    assert np.allclose(first[1:3], [-1.9635100260214235, -0.5772156649015329], atol=1e-13) and first[5] == pytest.approx(math.log(1e6) - 5e-7)
    assert np.allclose(second[1:3], [math.pi**2 / 2, math.pi**2 / 6], rtol=1e-12)
    h = 1e-5
    for x in (0.7, 7.95, 30.0):
        up, down = (math.lgamma(x + s * h) for s in (1, -1))
        assert transforms.digamma(np.array([x]))[0][0] == pytest.approx((up - down) / (2 * h), abs=1e-8)
