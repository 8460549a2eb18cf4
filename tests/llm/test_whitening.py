"""Whitening against numpy's decomposition of the centred matrix."""

import math

import numpy as np
import pytest

from quillmat.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x string, n int, whitened string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], 1, "i", "x", 2, "w") for i, v in rows], SCHEMA)


def check(spark, rows, most=32, tolerance=1e-8):
    sound = [(i, v) for i, v in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    width = max(((sum(len(v) == w for _, v in sound), w) for w in {len(v) for _, v in sound}))[1]
    sound = [(i, v) for i, v in sound if len(v) == width]
    x = np.floor(64 * np.array([v for _, v in sound], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, total, strict=True)) for r in x]
    y = x - total / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    found, model = whitening.whiten(table(spark, rows), most=most)
    got = found.collect()
    assert sorted(((r.vec_id, r.deviation) for r in got), key=repr) == sorted(((i, d) for (i, _), d in zip(sound, deviation, strict=True)), key=repr)
    assert all(r.n == n for r in got) and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6
    k, rank = min(most, width), model.rank
    assert np.allclose(got[0].explained, e[:k] / max(e.sum(), 1e-300), rtol=1e-6, atol=1e-12)
    want = (y @ v[:, : min(k, rank)]) / np.sqrt(e[: min(k, rank)])
    mine = np.array([r.whitened for r in sorted(got, key=lambda r: (repr(r.vec_id), r.deviation, r.whitened))])
    order = sorted(range(n), key=lambda i: (repr(sound[i][0]), deviation[i]))
    assert np.allclose(np.abs(mine[:, : min(k, rank)]), np.abs(want[order]), atol=tolerance) and (mine[:, rank:] == 0).all()
    return got, model


def test_whiten_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 12)) * np.linspace(0.3, 4, 12)
    rows = list(enumerate(x.tolist()))
    rows += [(5000, None), (5001, []), (5002, [None] * 12), (5003, [float("nan")] + [1.0] * 11), (5004, [float("inf")] * 12), (5005, [1.0, 2.0]), (None, x[0].tolist())]
    check(spark, rows)
    check(spark, rows, most=5)


def test_rank_and_width(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)) @ np.diag([3, 2, 1])
    flat = np.hstack([x, np.full((200, 2), 0.5)])  # two dimensions that don't vary
    _, model = check(spark, list(enumerate(flat.tolist())))
    assert model.rank == 3
    _, model = check(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert model.rank == 0
    check(spark, [(7, [3.0])])
    empty, model = whitening.whiten(table(spark, [(1, None)]))
    assert model is None and empty.collect() == []


def test_copies_and_long_sums(spark):
    """A third of the rows alike; an exact length that no long holds is null."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    x[:100] = x[0]
    check(spark, [(k // 2, v) for k, v in enumerate(x.tolist())])
    far = [(k, [1e9 if k == 0 else 0.0, float(k % 2)]) for k in range(100)]
    got = {r.vec_id: r for r in whitening.whiten(table(spark, far))[0].collect()}
    s = sum(math.floor(64 * np.float32(v[0])) + 1_000_000 for _, v in far)
    exact = (100 * (64 * 10**9 + 1_000_000) - s) ** 2 + 2500 * 64**2
    assert exact >= 1 << 63 and got[0].deviation is None and got[1].deviation == ((100 * 1_000_000 - s) ** 2 + 2500 * 64**2 if (100 * 1_000_000 - s) ** 2 < 1 << 63 else None)


@pytest.mark.parametrize("d", [1, 2, 5, 33])
def test_jacobi(d):
    rng = np.random.default_rng(d)
    r = np.linalg.qr(rng.normal(size=(200, d)) * 10.0 ** -np.arange(d).clip(0, 9), mode="r")
    v, s = whitening.jacobi(r)
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-13) and np.allclose(s, np.linalg.svd(r)[1], rtol=1e-12)
    assert np.allclose(np.linalg.norm(r @ v, axis=0), s) and whitening.jacobi(np.zeros((d, d)))[1].sum() == 0


def test_small_deviations_keep_their_digits():
    """Columns of very unequal scale: a covariance would lose the small ones."""
    rng = np.random.default_rng(9)
    q = np.linalg.qr(rng.normal(size=(500, 4)))[0]
    scale = np.array([1.0, 1e-5, 1e-10, 1e-14])
    s = whitening.jacobi(np.linalg.qr(q * scale, mode="r"))[1]
    assert np.allclose(s, scale, rtol=1e-10)
