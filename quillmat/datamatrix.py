"""The annotated matrix: three lazy tables that share identifiers."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmat.order import numbered


#: Rows and columns, on average, of a square of cells that a task makes: at least, and at most; squares there should be; cells of a square that are worked out, and passed on, at once.
SQUARE, WIDEST, TASKS, STRIP, PASSED = 512, 8192, 64, 524_288, 131_072


@dataclass(frozen=True)
class LowRank:
    """A term B Xᵗ of a matrix: ``left(var_id, b)`` and ``right(obs_id, x)`` hold arrays of ``rank`` numbers."""

    left: DataFrame
    right: DataFrame
    rank: int


@dataclass(frozen=True)
class DataMatrix:
    """``mat(var_id, obs_id, value)`` in coordinate form (an absent cell is 0), plus ``terms`` kept symbolic.

    ``var`` and ``obs`` have their identifier in the column ``var_key`` / ``obs_key`` and their order in ``ord``.
    """

    mat: DataFrame
    var: DataFrame
    obs: DataFrame
    var_key: str = "id"
    obs_key: str = "id"
    terms: tuple[LowRank, ...] = field(default=())
    #: ``mat`` if it is known to have each cell once; a copy with other cells forgets it.
    once: DataFrame | None = field(default=None, repr=False, compare=False)

    def __post_init__(self) -> None:
        if self.once is not self.mat:
            object.__setattr__(self, "once", None)

    def __repr__(self) -> str:
        named = lambda t, k: f"{k} + {len([c for c in t.columns if c not in (k, 'ord')])} columns"
        form = "A" + "".join(f" + B{i}X{i}'" for i, _ in enumerate(self.terms, 1))
        return f"DataMatrix {form}; var: {named(self.var, self.var_key)}; obs: {named(self.obs, self.obs_key)}"

    def with_var(self, var: DataFrame) -> DataMatrix:
        return replace(self, var=var)

    def with_obs(self, obs: DataFrame) -> DataMatrix:
        return replace(self, obs=obs)

    def var_ids(self) -> DataFrame:
        return self.var.select(F.col(self.var_key).alias("var_id"))

    def obs_ids(self) -> DataFrame:
        return self.obs.select(F.col(self.obs_key).alias("obs_id"))

    def dense(self) -> DataFrame:
        """Every cell, zeros and symbolic terms included; as large as the product of both tables.

        The result is cut into squares by hashes of the identifiers. A variable goes to the squares beside it, an observation to those below it, a stored cell to
        its own; a task holds the observations of a square and makes its cells a strip of variables at a time.  So what is shuffled are stored cells and some copies of
        identifiers, never the cells of the result or all pairs of groups.  Starts jobs that count both tables.
        """
        rows, cols = self.var_ids(), self.obs_ids()
        for i, t in enumerate(self.terms):
            rows = rows.join(t.left.select("var_id", F.col("b").cast("array<double>").alias(f"_{i}")), "var_id")
            cols = cols.join(t.right.select("obs_id", F.col("x").cast("array<double>").alias(f"_{i}")), "obs_id")
        tall, broad = rows.count(), cols.count()
        side = int(min(max(SQUARE, math.sqrt(tall * broad / TASKS)), WIDEST))
        high, wide = max(1, -(-tall // side)), max(1, -(-broad // side))
        strips = max(1, -(-side // max(1, STRIP // side)))
        strip, column = F.pmod(F.xxhash64("var_id"), F.lit(high * strips)).cast("int"), F.pmod(F.xxhash64("obs_id"), F.lit(wide)).cast("int")
        square = lambda i, j: (i * wide + j).cast("long").alias("square")
        terms = [f"_{i}" for i in range(len(self.terms))]
        above = F.floor(F.col("strip") / strips)
        var = rows.select("*", strip.alias("strip"), F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("_j")).select(square(above, F.col("_j")), "strip", F.lit(1).alias("kind"), "var_id", *terms)
        obs = cols.select("*", column.alias("_j"), F.explode(F.sequence(F.lit(0), F.lit(high - 1))).alias("_i")).select(square(F.col("_i"), F.col("_j")), F.lit(-1).alias("strip"), F.lit(0).alias("kind"), "obs_id", *terms)
        mat = self.mat.select("var_id", "obs_id", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
        stored = mat.select("*", strip.alias("strip"), column.alias("_j")).select(square(above, F.col("_j")), "strip", F.lit(2).alias("kind"), "var_id", "obs_id", "value")
        met = stored.unionByName(var, allowMissingColumns=True).unionByName(obs, allowMissingColumns=True).repartition(min(2 * high * wide, 4000), "square").sortWithinPartitions("square", "strip", "kind")
        kinds = [self.var.schema[self.var_key].dataType.simpleString(), self.obs.schema[self.obs_key].dataType.simpleString()]
        ranks = [t.rank for t in self.terms]
        return met.select("square", "strip", "kind", "var_id", "obs_id", "value", *terms).mapInArrow(lambda batches: _squares(batches, ranks), f"var_id {kinds[0]}, obs_id {kinds[1]}, value double")

    def same_as(self, other: DataMatrix) -> bool:
        """Whether all three tables, and the tables of the symbolic terms one by one, hold the same rows; runs jobs."""
        if (self.var_key, self.obs_key) != (other.var_key, other.obs_key) or [t.rank for t in self.terms] != [t.rank for t in other.terms]:
            return False
        pairs = [(self.mat, other.mat), (self.var, other.var), (self.obs, other.obs)]
        for a, b in zip(self.terms, other.terms, strict=True):
            pairs += [(a.left, b.left), (a.right, b.right)]
        return all(a.columns == b.columns and not a.exceptAll(b).head(1) and not b.exceptAll(a).head(1) for a, b in pairs)

    def transposed(self) -> DataMatrix:
        """Variables become observations and the other way round."""
        mat = self.mat.select(F.col("obs_id").alias("var_id"), F.col("var_id").alias("obs_id"), "value")
        flip = lambda t: LowRank(t.right.select(F.col("obs_id").alias("var_id"), F.col("x").alias("b")), t.left.select(F.col("var_id").alias("obs_id"), F.col("b").alias("x")), t.rank)
        return DataMatrix(mat, self.obs, self.var, self.obs_key, self.var_key, tuple(map(flip, self.terms)))


class _Ids:
    """Identifiers of rows or columns, what their terms are multiplied with, and where each stands."""

    def __init__(self, ids: list[pa.Array], terms: list[list[pa.Array]]):
        self.ids = pa.concat_arrays(ids)
        self.factors = [np.array([x for a in t for x in a.to_pylist()], float).reshape(len(self.ids), -1) for t in zip(*terms, strict=True)]
        self.known = pc.unique(self.ids.drop_null())
        there = self.codes(self.ids)
        self.order = np.argsort(there, kind="stable")
        self.starts = np.searchsorted(there[self.order], np.arange(len(self.known) + 1))
        self.numbers = self.ids.to_numpy() if pa.types.is_integer(self.ids.type) and not self.ids.null_count else None

    def codes(self, ids: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(ids, self.known), -1).to_numpy(zero_copy_only=False)

    def taken(self, places: np.ndarray) -> pa.Array:
        return self.ids.take(pa.array(places))

    def repeated(self, first: int, last: int, times: int) -> pa.Array:
        """Each of some identifiers so many times."""
        return pa.array(np.repeat(self.numbers[first:last], times), self.ids.type) if self.numbers is not None else self.taken(np.repeat(np.arange(first, last), times))


def _squares(batches: Iterator[pa.RecordBatch], ranks: list[int]) -> Iterator[pa.RecordBatch]:
    """All cells of squares, from rows in order of square, strip and kind: 0 for observations, 1 for variables, 2 for stored cells."""
    here, obs, cols, every = None, [], None, None
    strip, var, cells = None, [], []

    def made() -> Iterator[pa.RecordBatch]:
        nonlocal cols, every
        if var and obs:
            if cols is None:
                cols = _Ids([o[0] for o in obs], [o[1] for o in obs])
                every = cols.taken(np.tile(np.arange(len(cols.ids)), max(1, PASSED // len(cols.ids))))
            yield from _cells(_Ids([v[0] for v in var], [v[1] for v in var]), cols, [pa.concat_arrays(c) for c in zip(*cells, strict=True)], ranks, every)
        var.clear()
        cells.clear()

    for b in batches:
        if not b.num_rows:
            continue
        marks = [b.column(c).to_numpy() for c in range(3)]
        at = np.flatnonzero(np.any([np.diff(m) != 0 for m in marks], axis=0)) + 1
        for start, end in zip([0, *at.tolist()], [*at.tolist(), b.num_rows], strict=True):
            where, kind = (marks[0][start], marks[1][start]), marks[2][start]
            if where != strip:
                yield from made()
                strip = where
            if where[0] != here:
                here, cols = where[0], None
                obs.clear()
            part = b.slice(start, end - start)
            if kind == 2:
                cells.append([part.column(c) for c in (3, 4, 5)])
            else:
                (var if kind else obs).append((part.column(3 if kind else 4), [part.column(6 + i) for i in range(len(ranks))]))
    yield from made()


def _cells(rows: _Ids, cols: _Ids, cells: list[pa.Array], ranks: list[int], every: pa.Array) -> Iterator[pa.RecordBatch]:
    """All cells of the rows and columns, some rows at a time: the stored one (each, if there are more), or 0, plus the terms."""
    high, wide = len(rows.ids), len(cols.ids)
    square = np.zeros((high, wide))
    for i, (left, right, rank) in enumerate(zip(rows.factors, cols.factors, ranks, strict=True)):
        term = np.zeros_like(square) if i else square
        for r in range(rank):
            term += left[:, r, None] * right[None, :, r]
        if i:
            square += term
    places, values = np.zeros(0, np.int64), np.zeros(0)
    if cells:
        codes = [ids.codes(own) for ids, own in zip((rows, cols), cells, strict=False)]
        pick = np.flatnonzero((codes[0] >= 0) & (codes[1] >= 0))
        place = [pick, pick]
        for k, ids in enumerate((rows, cols)):  # an identifier that stands twice has its cells twice
            c = codes[k][pick]
            n = ids.starts[c + 1] - ids.starts[c]
            own = np.repeat(np.arange(len(pick)), n)
            spot = ids.order[np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ids.starts[c], n)]
            pick, place = pick[own], [p[own] for p in place]
            place[k] = spot
        places, values = place[0] * wide + place[1], cells[2].to_numpy(zero_copy_only=False)[pick]
    _, first = np.unique(places, return_index=True)
    again = np.setdiff1d(np.arange(len(places)), first)
    flat = square.ravel()
    more = values[again] + flat[places[again]]
    flat[places[first]] = values[first] + flat[places[first]]
    names = ["var_id", "obs_id", "value"]
    step = max(1, PASSED // wide)
    for at in range(0, high, step):
        n = min(step, high - at)
        yield pa.RecordBatch.from_arrays([rows.repeated(at, at + n, wide), every.slice(0, n * wide), pa.array(flat[at * wide : (at + n) * wide])], names)
    if len(again):
        yield pa.RecordBatch.from_arrays([rows.taken(places[again] // wide), cols.taken(places[again] % wide), pa.array(more)], names)


def dot(a: Column, b: Column, rank: int) -> Column:
    out = F.lit(0.0)
    for i in range(rank):
        out = out + a[i] * b[i]
    return out


def data_matrix(mat: DataFrame, var: DataFrame, obs: DataFrame, *, var_key: str | None = None, obs_key: str | None = None, duplicate_var: str = "warn", duplicate_obs: str = "warn") -> DataMatrix:
    """Check and wrap tables: identifiers (by default the first columns) should be unique, cells must name known ones.

    ``duplicate_*`` is ``ignore``, ``warn`` or ``error``.  Tables without ``ord`` are numbered by identifier.
    """
    keys = []
    for table, key, mode, what in ((var, var_key, duplicate_var, "variable"), (obs, obs_key, duplicate_obs, "observation")):
        key = key or table.columns[0]
        keys.append(key)
        if mode not in ("ignore", "warn", "error"):
            raise ValueError(f"unknown mode {mode!r}")
        if mode != "ignore" and (twice := table.groupBy(key).count().filter("count > 1").head(1)):
            message = f"duplicate {what} identifier: {twice[0][0]}"
            if mode == "error":
                raise ValueError(message)
            warnings.warn(message, stacklevel=2)
    for table, key, column in ((var, keys[0], "var_id"), (obs, keys[1], "obs_id")):
        if lost := mat.join(table, mat[column].eqNullSafe(table[key]), "left_anti").head(1):
            raise ValueError(f"a cell's {column} is in no row: {lost[0][column]}")
    var, obs = (t if "ord" in t.columns else numbered(t, k) for t, k in zip((var, obs), keys, strict=True))
    return DataMatrix(mat, var, obs, *keys)


Predicate = Callable[[Column], Column]
