import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmat.operators import neighbors
from quillmat.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["g5_force_layout", "g7_umap", "g8_tsne"])
def test_layouts_place_every_vector(spark, tmp_path, name):
    x = np.random.default_rng(3).normal(size=(1100, 4))
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(os.path.join(tmp_path, "embeddings.parquet"))
    got = QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(r.obs_id for r in got) == list(range(1100))
    assert np.isfinite([list(r)[1:] for r in got]).all()


def test_laid_out_embeds_the_rest(spark):
    x = np.random.default_rng(4).normal(size=(60, 3))
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "obs_id long, x array<double>")
    base = [r.obs_id for r in points.orderBy(F.xxhash64("obs_id")).limit(20).collect()]
    got = {r.obs_id: r.x for r in neighbors.laid_out(points, lambda b: {r.obs_id: r.x[:2] for r in b.collect()}, 2, k=3, most_points=20).collect()}
    assert len(got) == 60
    for i in range(60):
        d = ((x[base] - x[i]) ** 2).sum(1)
        near = np.argsort(d)[:3]
        want = x[i, :2] if i in base else np.average(x[base][near, :2], axis=0, weights=1 / d[near])
        assert np.allclose(got[i], want)


def dense(spark):
    table = lambda n: spark.read.parquet(f"{SF}/{n}.parquet").toPandas()
    v, o, li = np.sort(table("part").p_partkey), table("supplier").sort_values("s_suppkey"), table("lineitem")
    a = np.zeros((len(v), len(o)))
    np.add.at(a, (np.searchsorted(v, li.l_partkey), np.searchsorted(o.s_suppkey, li.l_suppkey)), li.l_quantity.astype(int))
    return v, o.s_suppkey.to_numpy(), a, o.s_acctbal.to_numpy(float)


def matrix(rows, v, o):
    out = np.zeros((len(v), len(o)))
    t = rows.toPandas().to_numpy(float)
    out[np.searchsorted(v, t[:, 0]), np.searchsorted(o, t[:, 1])] = t[:, 2]
    return len(t), out


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not here")
def test_matrix_queries_over_all_parts(spark):
    v, o, a, x = dense(spark)
    n, got = matrix(QUERIES["m11_materialize"](spark, SF), v, o)
    assert n == a.size and np.array_equal(got, a)
    n, got = matrix(QUERIES["n8_normalize_one_covariate"](spark, SF), v, o)
    z = np.stack([np.ones(len(x)), x / 1e4], 1)
    assert n == a.size and np.allclose(got, a - (z @ np.linalg.lstsq(z, a.T, rcond=None)[0]).T, atol=1e-4)
    _, got = matrix(QUERIES["m4_chain_product"](spark, SF), v, o)
    assert np.array_equal(got, a @ a.T @ a)
    odd = o % 2 == 1
    n, got = matrix(QUERIES["project_normalize"](spark, SF), v, o[odd])
    assert n == got.size and np.allclose(got, a[:, odd] - a[:, ~odd].mean(1)[:, None], atol=1e-5)
