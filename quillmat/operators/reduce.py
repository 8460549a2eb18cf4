"""Singular value decomposition, principal components and signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmat.datamatrix import DataMatrix, LowRank
from quillmat.operators.design import normalize
from quillmat.operators.filters import Where, filter_var


@dataclass(frozen=True)
class Factors:
    """A ≈ U diag(s) Vᵗ: ``u(var_id, u)`` and ``v(obs_id, v)`` hold an array each, ``s`` is on the driver."""

    u: DataFrame
    s: np.ndarray
    v: DataFrame


def _combine(c: str, m: np.ndarray) -> Column:
    """xᵗM for an array column and a small matrix; as SQL text, since building so many nodes one by one takes longer than the query."""
    sums = [" + ".join(f"({float(m[i, j])!r}D * {c}[{i}])" for i in range(m.shape[0]) if m[i, j]) or "0D" for j in range(m.shape[1])]
    return F.expr(f"array({', '.join(sums)})")


def _gram(t: DataFrame, c: str, k: int) -> np.ndarray:
    cells = ", ".join(f"sum({c}[{i}] * {c}[{j}])" for i in range(k) for j in range(i, k))
    row, out, at = t.agg(F.expr(f"array({cells})").alias("g")).first()["g"], np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = float(row[at] or 0.0)
            at += 1
    return out


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """W with (YW)ᵗ(YW) = 1 for YᵗY = gram; directions lost to rounding are dropped."""
    values, vectors = np.linalg.eigh(gram)
    good = values > max(values.max(), 0) * 1e-13
    return vectors[:, good] / np.sqrt(values[good])


def times(data: DataMatrix, right: DataFrame, c: str, k: int) -> DataFrame:
    """(var_id, y): the whole matrix, symbolic terms included, times ``right(obs_id, c)``."""
    sums = data.mat.join(right, "obs_id").groupBy("var_id").agg(F.expr("array(" + ", ".join(f"sum(value * {c}[{i}])" for i in range(k)) + ")").alias("y"))
    none = F.array_repeat(F.lit(0.0), k)
    out = data.var_ids().join(sums, "var_id", "left").select("var_id", F.coalesce("y", none).alias("y"))
    for t in data.terms:
        cells = ", ".join(f"sum(x[{p}] * {c}[{i}])" for p in range(t.rank) for i in range(k))
        row = t.right.join(right, "obs_id").agg(F.expr(f"array({cells})").alias("g")).first()["g"]
        m = np.array([float(v or 0.0) for v in row]).reshape(t.rank, k)
        part = t.left.select("var_id", _combine("b", m).alias("_t"))
        out = out.join(part, "var_id").select("var_id", F.zip_with("y", "_t", lambda a, b: a + b).alias("y"))
    return out


def _flipped_times(data: DataMatrix, left: DataFrame, c: str, k: int) -> DataFrame:
    return times(data.transposed(), left.withColumnRenamed("var_id", "obs_id"), c, k).withColumnRenamed("var_id", "obs_id")


def _settled(t: DataFrame) -> DataFrame:
    """Lineage cut after every pass; without a checkpoint folder the rows stay in Spark's storage instead."""
    return t.checkpoint() if t.sparkSession.sparkContext.getCheckpointDir() else t.persist()


#: Bytes of a factor (variables or observations times subspace) up to which it is sent to all tasks.
MOST_BYTES = 64 << 20


def _packed(data: DataMatrix, places: DataFrame) -> DataFrame:
    """(obs_id, at, value, x): each observation's cells as arrays of variable numbers and values, and its side of the symbolic terms."""
    cells = data.mat.join(F.broadcast(places), "var_id").groupBy("obs_id").agg(F.collect_list(F.struct(F.col("_n").alias("n"), F.col("value").cast("double").alias("v"))).alias("_c"))
    out = data.obs_ids().join(cells, "obs_id", "left")
    x = F.array().cast("array<double>")
    for i, t in enumerate(data.terms):
        out = out.join(t.right.select("obs_id", F.col("x").alias(f"_x{i}")), "obs_id")
        x = F.concat(x, F.col(f"_x{i}").cast("array<double>"))
    got = lambda c: F.coalesce(F.col(f"_c.{c}"), F.array().cast("array<int>" if c == "n" else "array<double>"))
    return out.select("obs_id", got("n").alias("at"), got("v").alias("value"), x.alias("x"))


def _rows_times(batch: pa.RecordBatch, q: np.ndarray, bq: np.ndarray) -> Iterator[tuple]:
    """For some rows at a time: (rows' numbers, cells' rows, places, values, x, rows times the factor)."""
    ends = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())])
    at, value = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
    x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + (1 << 22) // q.shape[1], "right")) - 1)
        i, v = at[ends[a] : ends[b]], value[ends[a] : ends[b]]
        row = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
        z = x[a:b] @ bq
        for c in range(q.shape[1]):
            z[:, c] += np.bincount(row, v * q[i, c], b - a)
        yield slice(a, b), row, i, v, x[a:b], z
        a = b


def _svd_of_few_variables(data: DataMatrix, nsv: int, k: int, seed: int, niter: int, stabilize_sign: bool) -> Factors:
    """Subspace iteration with the variables' side of the factors sent to all tasks: each pass over the observations is one narrow stage.

    A task adds up A(AᵗQ) over its observations; these sums, of a checked size, are added by blocks of rows and orthonormalized on the driver.
    """
    spark = data.mat.sparkSession
    u = lambda i, s: (F.pmod(F.xxhash64("var_id", F.lit(i), F.lit(s), F.lit(seed)), F.lit(1 << 40)) + 1) / float(1 << 40)
    start = data.var_ids().select("var_id", *[(F.sqrt(-2 * F.log(u(i, 0))) * F.cos(2 * math.pi * u(i, 1))).alias(f"_{i}") for i in range(k)]).toArrow()
    ids, q = start.column(0).to_pylist(), np.column_stack([start.column(i + 1).to_numpy() for i in range(k)])
    kind = data.var_ids().schema["var_id"].dataType.simpleString()
    rows = _settled(_packed(data, spark.createDataFrame([(x, i) for i, x in enumerate(ids)], f"var_id {kind}, _n int")))
    number, sides = {x: i for i, x in enumerate(ids)}, []
    for t in data.terms:
        side = np.zeros((len(ids), t.rank))
        for r in t.left.select("var_id", "b").toLocalIterator():
            side[number[r["var_id"]]] = r["b"]
        sides.append(side)
    b_all = np.concatenate([np.zeros((len(ids), 0)), *sides], 1)
    step = max(1, (4 << 20) // (8 * k))

    def summed(q: np.ndarray) -> np.ndarray:
        """A(AᵗQ) and, below it, (AᵗQ)ᵗ(AᵗQ)."""
        held = spark.sparkContext.broadcast((q, b_all, b_all.T @ q))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, b_all, bq = held.value
            y, xz, gram, any_row = np.zeros_like(q), np.zeros_like(bq), np.zeros((q.shape[1], q.shape[1])), False
            for batch in batches:
                for _, row, i, v, x, z in _rows_times(batch, q, bq):
                    any_row = True
                    for c in range(q.shape[1]):
                        y[:, c] += np.bincount(i, v * z[row, c], len(y))
                    xz += x.T @ z
                    gram += z.T @ z
            if any_row:
                whole = np.concatenate([y + b_all @ xz, gram])
                for n, at in enumerate(range(0, len(whole), step)):
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([whole[at : at + step].tobytes()], pa.binary())], ["block", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for n, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    sums[n] = sums.get(n, 0.0) + np.frombuffer(s)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "sums"])

        kinds = "block int, sums binary"
        got = rows.mapInArrow(part, kinds).repartition("block").mapInArrow(add, kinds).orderBy("block").collect()
        return np.concatenate([np.frombuffer(r["sums"]) for r in got] or [np.zeros((len(q) + q.shape[1]) * q.shape[1])]).reshape(-1, q.shape[1])

    for _ in range(niter + 1):
        left, s, _ = np.linalg.svd(summed(q)[: len(ids)], full_matrices=False)
        q = left[:, s > max(s.max(initial=0.0), 0) * 1e-13]
    values, vectors = np.linalg.eigh(summed(q)[len(ids) :]) if q.shape[1] else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values)[:nsv]
    s, m = np.sqrt(np.maximum(values[order], 0)), vectors[:, order]
    if stabilize_sign:
        own = q @ m
        m = m * np.where((own * np.abs(own)).sum(0) < 0, -1.0, 1.0)
    held = spark.sparkContext.broadcast((q, b_all.T @ q, m / np.maximum(s, 1e-100)))

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, bq, w = held.value
        for batch in batches:
            for some, _, _, _, _, z in _rows_times(batch, q, bq):
                v = z @ w
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(some.start, len(v)), lists], ["obs_id", "v"])

    v_t = rows.mapInArrow(right, f"obs_id {rows.schema['obs_id'].dataType.simpleString()}, v array<double>")
    return Factors(spark.createDataFrame(list(zip(ids, (q @ m).tolist(), strict=True)), f"var_id {kind}, u array<double>"), s, v_t)


def svd(data: DataMatrix, *, nsv: int, seed: int = 1234, subspace: int | None = None, niter: int = 3, stabilize_sign: bool = True, most_bytes: int = MOST_BYTES) -> Factors:
    """Randomized subspace iteration; only matrices of the subspace's size and factors of at most ``most_bytes`` reach the driver.

    Starting vectors are Gaussian numbers hashed from identifiers, so a seed means the same on any cluster.  Where neither side's
    factor is small, every pass is one join and aggregate.
    """
    n, p = data.obs.count(), data.var.count()
    width = min(subspace or 4 * nsv, n, p) + sum(t.rank for t in data.terms)
    if 0 < 8 * p * width <= most_bytes:
        return _svd_of_few_variables(data, min(nsv, n, p), min(subspace or 4 * nsv, n, p), seed, niter, stabilize_sign)
    if 0 < 8 * n * width <= most_bytes:
        f = _svd_of_few_variables(data.transposed(), min(nsv, n, p), min(subspace or 4 * nsv, n, p), seed, niter, False)
        u, v, k = f.v.select(F.col("obs_id").alias("var_id"), F.col("v").alias("u")), f.u.select(F.col("var_id").alias("obs_id"), F.col("u").alias("v")), len(f.s)
        if stabilize_sign and k:
            row = u.agg(*[F.sum(F.col("u")[i] * F.abs(F.col("u")[i])) for i in range(k)]).first()
            turn = np.diag(np.where(np.array([float(x or 0) for x in row]) < 0, -1.0, 1.0))
            u, v = u.select("var_id", _combine("u", turn).alias("u")), v.select("obs_id", _combine("v", turn).alias("v"))
        return Factors(u, f.s, v)
    # every pass reads the cells and the terms, so what they come from is worked out once
    data = replace(data, mat=_settled(data.mat), terms=tuple(LowRank(_settled(t.left), _settled(t.right), t.rank) for t in data.terms))
    nsv = min(nsv, n, p)
    k = min(subspace or 4 * nsv, n, p)
    u = lambda i, s: (F.pmod(F.xxhash64("obs_id", F.lit(i), F.lit(s), F.lit(seed)), F.lit(1 << 40)) + 1) / float(1 << 40)
    gauss = [F.sqrt(-2 * F.log(u(i, 0))) * F.cos(2 * math.pi * u(i, 1)) for i in range(k)]
    omega, kk = data.obs_ids().select("obs_id", F.array(*gauss).alias("z")), k
    for it in range(niter + 1):
        if it:
            w = _orthonormal(_gram(omega, "z", kk))
            omega, kk = omega.select("obs_id", _combine("z", w).alias("z")), w.shape[1]
        y = _settled(times(data, omega, "z", kk))
        w = _orthonormal(_gram(y, "y", kk))
        q, kk = y.select("var_id", _combine("y", w).alias("q")), w.shape[1]
        omega = _settled(_flipped_times(data, q, "q", kk).select("obs_id", F.col("y").alias("z")))
    values, vectors = np.linalg.eigh(_gram(omega, "z", kk))
    order = np.argsort(-values)[: min(nsv, kk)]
    s, m = np.sqrt(np.maximum(values[order], 0)), vectors[:, order]
    u_t = q.select("var_id", _combine("q", m).alias("u"))
    if stabilize_sign:
        row = u_t.agg(*[F.sum(F.col("u")[i] * F.abs(F.col("u")[i])) for i in range(len(order))]).first()
        m = m * np.where(np.array([float(v or 0) for v in row]) < 0, -1.0, 1.0)
        u_t = q.select("var_id", _combine("q", m).alias("u"))
    v_t = omega.select("obs_id", _combine("z", m / np.maximum(s, 1e-100)).alias("v"))
    return Factors(u_t, s, v_t)


def pca(data: DataMatrix, *, nsv: int, **options) -> DataFrame:
    """(obs_id, x): scores diag(s)Vᵗ."""
    f = svd(data, nsv=nsv, **options)
    return f.v.select("obs_id", _combine("v", np.diag(f.s)).alias("x"))


def loadings(data: DataMatrix, *, nsv: int, **options) -> DataFrame:
    return svd(data, nsv=nsv, **options).u


def project_scores(f: Factors, new: DataMatrix) -> DataFrame:
    """(obs_id, x): UᵗX for new observations; variables that either side lacks count as 0."""
    k = len(f.s)
    return _flipped_times(new, f.u.select("var_id", F.col("u").alias("q")).join(new.var_ids(), "var_id", "left_semi"), "q", k).select("obs_id", F.col("y").alias("x"))


def signature(data: DataMatrix, where: Where, *, as_loadings: bool = False, nsv: int = 1, subspace: int = 10, **options) -> DataFrame:
    """First component of some variables, centred: a score per observation, or a loading per variable."""
    centred = normalize(filter_var(where, data))
    return loadings(centred, nsv=nsv, subspace=subspace, **options) if as_loadings else pca(centred, nsv=nsv, subspace=subspace, **options)


def as_matrix(scores: DataFrame, k: int, obs: DataFrame, obs_key: str, prefix: str = "PC") -> DataMatrix:
    """Scores as a matrix whose variables are the components."""
    mat = scores.select("obs_id", F.posexplode("x").alias("i", "value")).select(F.concat(F.lit(prefix), (F.col("i") + 1).cast("string")).alias("var_id"), "obs_id", "value")
    var = scores.sparkSession.range(k).select(F.concat(F.lit(prefix), (F.col("id") + 1).cast("string")).alias("id"), F.col("id").alias("ord"))
    return DataMatrix(mat, var, obs, "id", obs_key)


def centred(data: DataMatrix) -> DataMatrix:
    return normalize(replace(data))
