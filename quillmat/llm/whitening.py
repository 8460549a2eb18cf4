"""Embedding whitening by a one-sided Jacobi decomposition of a blockwise TSQR.

Blocks of exactly centred rows are reduced to triangles, triangles of several tasks to one, and plane rotations make
the columns of the last one orthogonal.  The covariance is never formed, so small deviations keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of larger magnitude can't be told apart in double precision once they are quantized; they count as not finite.
LARGEST = float(1 << 30)
BLOCK = 4096
#: Tasks whose triangles one task stacks.
FAN_IN = 8


@dataclass
class Whitening:
    """``n`` vectors with exact sums per dimension; ``components`` are columns by falling ``deviations`` (standard deviations along them)."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        e = self.deviations**2
        return e / max(e.sum(), np.finfo(float).tiny)

    @property
    def rank(self) -> int:
        """Components whose deviation is more than rounding."""
        return int((self.deviations > len(self.sums) * np.finfo(float).eps * self.deviations.max(initial=0)).sum())


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (columns) and singular values of ``r``, largest first.

    Disjoint pairs of columns are rotated at once, by the rounds of a tournament, until no pair's cosine is more than rounding.
    """
    d = r.shape[1]
    order = np.argsort(-np.linalg.norm(r, axis=0), kind="stable")
    a, v = r[:, order].copy(), np.eye(d)[:, order]
    seats = list(range(d + d % 2))
    tolerance = max(1, d) * np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(min(p), max(p)) for p in zip(seats[:half], seats[: half - 1 : -1], strict=True) if max(p) < d]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            i, j = np.array(pairs).T
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(xy) > tolerance * np.sqrt(xx * yy)
            if not turn.any():
                continue
            turned = True
            zeta = np.where(turn, (yy - xx) / np.where(turn, 2 * xy, 1), 0)
            t = np.where(turn, np.where(zeta < 0, -1, 1) / (np.abs(zeta) + np.hypot(1, zeta)), 0)
            c = 1 / np.hypot(1, t)
            s = c * t
            a[:, i], a[:, j] = c * x - s * y, s * x + c * y
            x, y = v[:, i], v[:, j]
            v[:, i], v[:, j] = c * x - s * y, s * x + c * y
        if not turned:
            break
    values = np.linalg.norm(a, axis=0)
    order = np.argsort(-values, kind="stable")
    return v[:, order], values[order]


def quantized(vectors: DataFrame, id: str, column: str, scale: int, shift: int) -> DataFrame:  # noqa: A002
    """(id, x): vectors of finite entries as long integers; the others go."""
    sound = F.forall("c", lambda e: F.coalesce(F.abs(e) < LARGEST, F.lit(False)))  # a nan is larger than any number
    rows = vectors.select(F.col(id).alias("id"), F.col(column).cast("array<double>").alias("c")).filter((F.size("c") > 0) & sound)
    return rows.select("id", F.transform("c", lambda e: F.floor(e * scale).cast("long") + shift).alias("x"))


def _table(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(width, rows, sums) of a task's vectors, by their width."""
    held: dict[int, list] = {}
    for batch in batches:
        widths = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
        for w in np.unique(widths).tolist():
            x = _table(batch.column(0).filter(pa.array(widths == w)))
            n, s = held.get(w, (0, np.zeros(w, object)))
            held[w] = [n + len(x), s + x.sum(0).astype(object)]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([h[0] for h in held.values()], pa.int64()), pa.array([list(h[1]) for h in held.values()], pa.list_(pa.int64()))], ["width", "rows", "sums"])


def moments(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of the vectors of the most frequent width (of several the largest), and their exact sums."""
    part = rows.select("x").mapInArrow(_sums, "width int, rows long, sums array<long>")
    each = part.select("width", "rows", F.posexplode("sums").alias("pos", "v")).groupBy("width", "pos").agg(F.sum("rows").alias("rows"), F.sum("v").alias("v"))
    wide = each.groupBy("width").agg(F.max("rows").alias("rows"), F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("sums"))
    best = wide.orderBy(F.desc("rows"), F.desc("width")).first()
    return (best["rows"], [s["v"] for s in best["sums"]]) if best else (0, [])


class Centre:
    """n x - S, exact, and the same divided by n."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.low = n, np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        away = x - self.low
        if len(x) and (int(np.abs(away).max()) + 1) * self.n >= 1 << 62:
            return away.astype(object) * self.n - self.rest.astype(object)
        return away * self.n - self.rest

    def rows(self, batches: Iterator[pa.RecordBatch], at: int) -> Iterator[np.ndarray]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                yield self(_table(batch.column(at).slice(k, BLOCK))).astype(float) / self.n


def _triangle(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The triangle that all blocks of a task reduce to, as rows."""
    r, waiting, rows = None, [], 0
    for b in blocks:
        waiting.append(b)
        rows += len(b)
        if rows >= BLOCK:
            r, waiting, rows = np.linalg.qr(np.vstack(([r] if r is not None else []) + waiting), mode="r"), [], 0
    if waiting:
        r = np.linalg.qr(np.vstack(([r] if r is not None else []) + waiting), mode="r")
    if r is not None:
        for k in range(0, len(r), 256):
            part = r[k : k + 256]
            offsets = pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(part.ravel(), pa.float64()))], ["r"])


def tsqr(rows: DataFrame, centre: Centre) -> np.ndarray:
    """The triangle R of the centred vectors.  Every task leaves at most as many rows as there are dimensions; ``FAN_IN`` tasks' are stacked by the next one."""

    def leaves(batches):
        return _triangle(centre.rows(batches, 0))

    def stack(batches):
        return _triangle(_table(b.column(0)) for b in batches if b.num_rows)

    out, tasks = rows.select("x").mapInArrow(leaves, "r array<double>"), rows.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        out = out.repartition(tasks).mapInArrow(stack, "r array<double>")
    return np.array([r["r"] for r in out.collect()], float).reshape(-1, len(centre.low))


def fit(rows: DataFrame) -> Whitening | None:
    """The whitening of ``rows(x)``, or None without rows.  The driver gets one triangle, as large as the dimensions squared."""
    n, sums = moments(rows)
    if not n:
        return None
    rows = rows.filter(F.size("x") == len(sums))
    components, values = jacobi(tsqr(rows, Centre(n, sums)))
    return Whitening(n, sums, components, values / np.sqrt(n))


def project(rows: DataFrame, model: Whitening, most: int) -> DataFrame:
    """(id, deviation, whitened) of ``rows(id, x)``: the exact squared length of n x - S (null if it is no long), and the leading coordinates."""
    centre = Centre(model.n, model.sums)
    basis = np.zeros((len(model.sums), min(most, len(model.sums))))
    kept = min(most, model.rank)
    basis[:, :kept] = model.components[:, :kept] / model.deviations[:kept]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                b = batch.slice(k, BLOCK)
                q = centre(_table(b.column(1)))
                if q.dtype == object or int(np.abs(q).max(initial=0)) ** 2 * q.shape[1] >= 1 << 63:
                    exact = [int(s) if s < 1 << 63 else None for s in (q.astype(object) ** 2).sum(1)]
                else:
                    exact = (q * q).sum(1)
                w = q.astype(float) / centre.n @ basis
                offsets = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(exact, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel(), pa.float64()))], ["id", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.filter(F.size("x") == len(model.sums)).select("id", "x").mapInArrow(place, f"id {kind}, deviation long, whitened array<double>")


def identity_error(projected: DataFrame, rank: int) -> float:
    """Largest absolute entry of the whitened coordinates' covariance minus the identity, over the first ``rank`` of them."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # counts, means and centred products of the blocks, merged pair by pair
        n, mean, cov = 0, np.zeros(0), np.zeros((0, 0))
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                w = _table(batch.column(0).slice(k, BLOCK))[:, :rank]
                m = w.mean(0)
                c = (w - m).T @ (w - m)
                if n:
                    off = m - mean
                    c, m = cov + c + np.outer(off, off) * (n * len(w) / (n + len(w))), mean + off * len(w) / (n + len(w))
                n, mean, cov = n + len(w), m, c
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([cov.ravel().tolist()], pa.list_(pa.float64()))], ["n", "mean", "cov"])

    part = projected.select("whitened").mapInArrow(gram, "n long, mean array<double>, cov array<double>")
    # sums over tasks: rows, means times rows, and products about zero of each task, which is as good as the mean here
    k = F.size("mean")
    entry = lambda i: F.get("cov", i) + F.col("n") * F.get("mean", F.floor(i / k).cast("int")) * F.get("mean", (i % k).cast("int"))
    values = F.concat(F.array(F.col("n").cast("double")), F.transform("mean", lambda m: m * F.col("n")), F.transform(F.sequence(F.lit(0), k * k - 1), entry))
    rows = part.select(F.posexplode(values).alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v")).orderBy("pos").collect()
    if not rows or not rank:
        return 0.0
    v = np.array([r["v"] for r in rows])
    mean = v[1 : 1 + rank] / v[0]
    return float(np.abs(v[1 + rank :].reshape(rank, rank) / v[0] - np.outer(mean, mean) - np.eye(rank)).max())


def whiten(vectors: DataFrame, *, id: str = "vec_id", column: str = "embedding", scale: int = 64, shift: int = 1_000_000, most: int = 32) -> tuple[DataFrame, Whitening | None]:  # noqa: A002
    """(``id``, deviation, whitened, n, explained, identity_error) of each sound vector, and the model.

    Entries become x = floor(scale * c) + shift; whitened holds up to ``most`` coordinates: x less the mean, along the components, in standard
    deviations; explained their shares of the variance.  Components have either sign, the same for all rows.

    Vectors that are null or empty, or hold a null, a number that isn't finite or one beyond 2^30, go.  Of several widths the most
    frequent is kept (ties: the largest), since others have no common covariance.  Null or repeated ids, equal vectors: a row each.
    Dimensions that don't vary: components beyond the rank have coordinates 0 and don't count for the identity error.
    Equal variances: any basis of their plane.  Empty table: empty result, no model.
    """
    rows = quantized(vectors, id, column, scale, shift)
    model = fit(rows)
    out = f"{id} {rows.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>, n long, explained array<double>, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], out), None
    found = project(rows, model, most)
    error = identity_error(found, min(most, model.rank))
    shares = F.array(*[F.lit(float(e)) for e in model.explained[:most]])
    return found.select(F.col("id").alias(id), "deviation", "whitened", F.lit(model.n).cast("long").alias("n"), shares.alias("explained"), F.lit(error).alias("identity_error")), model
