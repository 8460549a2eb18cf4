"""Sums, fractions, variances and group averages of annotated matrices.

Cells that aren't stored are 0, so sums run over stored cells and then every variable or observation is attached again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmat.datamatrix import DataMatrix, dot
from quillmat.operators.filters import Where, select_rows
from quillmat.operators.tables import distinct_values
from quillmat.order import numbered


def _attach(table: DataFrame, key: str, sums: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Columns of ``sums`` on every row of ``table``, 0 where it has none."""
    joined = table.join(sums, table[key].eqNullSafe(sums[on]), "left").drop(on)
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in columns}).select(*[c for c in table.columns if c != "ord"], *columns, "ord")


def _zero_stays(f: Callable[[Column], Column], spark) -> None:
    # a plan of constants, which Spark folds without a job
    if spark.sql("SELECT 0 AS zero").select(f(F.col("zero")).cast("double")).first()[0] != 0:
        raise ValueError("f(0) must be 0, since zeros aren't stored")


def _sums(data: DataMatrix, side: str, where: Where, f: Callable[[Column], Column] | None) -> tuple[DataFrame, Column]:
    """Cells in the selected variables (or observations), and what is summed."""
    other, key = (data.var, data.var_key) if side == "obs_id" else (data.obs, data.obs_key)
    on = "var_id" if side == "obs_id" else "obs_id"
    mat = data.mat if where is None else data.mat.join(select_rows(other, where).select(F.col(key).alias(on)), on, "left_semi")
    value = F.col("value")
    if f is not None:
        _zero_stays(f, data.mat.sparkSession)
        value = f(value)
        if dict(data.mat.select(value.alias("v")).dtypes)["v"] == "boolean":
            value = value.cast("long")
    return mat, value


def var_counts_sum(data: DataMatrix, name: str, where: Where = None, f: Callable[[Column], Column] | None = None) -> DataMatrix:
    """Per observation: the sum over selected variables of ``f(value)``."""
    mat, value = _sums(data, "obs_id", where, f)
    return data.with_obs(_attach(data.obs, data.obs_key, mat.groupBy("obs_id").agg(F.sum(value).alias(name)), "obs_id", [name]))


def var_counts(data: DataMatrix, sums: dict[str, tuple[Where, Callable[[Column], Column] | None]], fractions: dict[str, tuple[Where, Where]] | None = None) -> DataMatrix:
    """Several columns per observation from one pass over the cells: sums as in ``var_counts_sum``, then fractions as in ``var_counts_fraction``.

    ``sums`` gives for each name which variables count and a function of their values (or None).
    """
    fractions = fractions or {}
    wheres = [*[("w_" + n, w) for n, (w, _) in sums.items()], *[(k + n, w) for n, pair in fractions.items() for k, w in zip(("p_", "t_"), pair, strict=True)]]
    marks = data.var_ids()
    for name, where in wheres:
        if where is not None:
            marks = marks.join(select_rows(data.var, where).select(F.col(data.var_key).alias("var_id"), F.lit(True).alias(name)), "var_id", "left")
    marked = any(w is not None for _, w in wheres)
    cells = data.mat.join(marks, "var_id") if marked else data.mat
    chosen = {n for n, w in wheres if w is not None}
    when = lambda name, value: F.sum(F.when(F.col(name), value) if name in chosen else value)
    out = [when("w_" + n, F.col("value") if f is None else _sums(data, "obs_id", None, f)[1]).alias(n) for n, (_, f) in sums.items()]
    out += [when(k + n, F.col("value")).alias(f"_{k}{n}") for n in fractions for k in ("p_", "t_")]
    share = lambda n: (F.coalesce(f"_p_{n}", F.lit(0)) / F.greatest(F.lit(1), F.coalesce(f"_t_{n}", F.lit(0)))).alias(n)
    per = cells.groupBy("obs_id").agg(*out).select("obs_id", *sums, *map(share, fractions))
    return data.with_obs(_attach(data.obs, data.obs_key, per, "obs_id", [*sums, *fractions]))


def obs_counts_sum(data: DataMatrix, name: str, where: Where = None, f: Callable[[Column], Column] | None = None) -> DataMatrix:
    mat, value = _sums(data, "var_id", where, f)
    return data.with_var(_attach(data.var, data.var_key, mat.groupBy("var_id").agg(F.sum(value).alias(name)), "var_id", [name]))


def _fraction(data: DataMatrix, side: str, name: str, part: Where, total: Where) -> DataFrame:
    """The share of a selection in another, both summed in one pass; a zero total counts as 1."""
    on = "var_id" if side == "obs_id" else "obs_id"
    table, key = (data.var, data.var_key) if side == "obs_id" else (data.obs, data.obs_key)
    mark = lambda where, c: select_rows(table, where).select(F.col(key).alias(on), F.lit(True).alias(c))
    marks = table.select(F.col(key).alias(on)).join(mark(part, "_part"), on, "left").join(mark(total, "_total"), on, "left")
    cells = data.mat.join(marks, on)
    sums = cells.groupBy(side).agg(F.sum(F.when(F.col("_part"), F.col("value"))).alias("_p"), F.sum(F.when(F.col("_total"), F.col("value"))).alias("_t"))
    return sums.select(side, (F.coalesce("_p", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("_t", F.lit(0)))).alias(name))


def var_counts_fraction(data: DataMatrix, name: str, part: Where, total: Where = None) -> DataMatrix:
    return data.with_obs(_attach(data.obs, data.obs_key, _fraction(data, "obs_id", name, part, total), "obs_id", [name]))


def obs_counts_fraction(data: DataMatrix, name: str, part: Where, total: Where = None) -> DataMatrix:
    return data.with_var(_attach(data.var, data.var_key, _fraction(data, "var_id", name, part, total), "var_id", [name]))


def stored_size(mat: DataFrame) -> tuple[int, int]:
    """How many variables and observations have stored cells, where no table says more."""
    row = mat.agg(F.count_distinct("var_id"), F.count_distinct("obs_id")).first()
    return int(row[0]), int(row[1])


def row_sums(data: DataMatrix, f: Callable[[Column], Column] | None = None) -> DataFrame:
    """(var_id, total): each variable's sum of ``f(value)`` over all observations, for f(0) = 0; without f symbolic terms count, too."""
    if f is not None and data.terms:
        raise ValueError("a function of cells needs a plain sparse matrix")
    mat, value = _sums(data, "var_id", None, f)
    out = data.var_ids().join(mat.groupBy("var_id").agg(F.sum(value).alias("total")), "var_id", "left")
    total = F.coalesce("total", F.lit(0))
    for i, t in enumerate(data.terms):
        sums = t.right.agg(*[F.sum(F.col("x")[k]) for k in range(t.rank)]).first()
        out = out.join(t.left.select("var_id", F.col("b").alias(f"_b{i}")), "var_id")
        total = total + sum((F.lit(float(sums[k] or 0.0)) * F.col(f"_b{i}")[k] for k in range(t.rank)), F.lit(0.0))
    return out.select("var_id", total.alias("total"))


def column_sums(data: DataMatrix, f: Callable[[Column], Column] | None = None) -> DataFrame:
    """(obs_id, total): the same over all variables."""
    return row_sums(data.transposed(), f).withColumnRenamed("var_id", "obs_id")


def sum_squared(data: DataMatrix, side: str = "var_id") -> DataFrame:
    """(side, ss): sums of squares per variable or observation, symbolic terms included.

    With A sparse and a term BXᵗ, a row's sum is Σa² + 2 b·(AX) + bᵗ(XᵗX)b, so only A·X and the small XᵗX are formed.
    """
    if side == "obs_id":
        flipped = sum_squared(data.transposed())
        return flipped.select(F.col("var_id").alias("obs_id"), "ss")
    own = data.var_ids().join(data.mat.groupBy("var_id").agg(F.sum(F.col("value").cast("double") * F.col("value")).alias("_a")), "var_id", "left")
    total = F.coalesce("_a", F.lit(0.0))
    for i, t in enumerate(data.terms):
        own = own.join(t.left.select("var_id", F.col("b").alias(f"_b{i}")), "var_id")
        cross = times_right(data, t.right, t.rank).select("var_id", F.col("y").alias(f"_ax{i}"))
        own = own.join(cross, "var_id")
        total = total + 2 * dot(F.col(f"_b{i}"), F.col(f"_ax{i}"), t.rank)
        for j, u in enumerate(data.terms[: i + 1]):
            gram, twice = gram_of(t.right, u.right, t.rank, u.rank), 1.0 if i == j else 2.0
            for p in range(t.rank):
                for q in range(u.rank):
                    total = total + F.lit(twice * gram[p][q]) * F.col(f"_b{i}")[p] * F.col(f"_b{j}")[q]
    return own.select("var_id", F.greatest(F.lit(0.0), total).alias("ss"))


def times_right(data: DataMatrix, right: DataFrame, rank: int) -> DataFrame:
    """(var_id, y): the sparse part A times X for ``right(obs_id, x)``; variables without cells get zeros."""
    sums = data.mat.join(right, "obs_id").groupBy("var_id").agg(*[F.sum(F.col("value") * F.col("x")[i]).alias(f"_{i}") for i in range(rank)])
    return data.var_ids().join(sums, "var_id", "left").select("var_id", F.array(*[F.coalesce(F.col(f"_{i}"), F.lit(0.0)) for i in range(rank)]).alias("y"))


def gram_of(a: DataFrame, b: DataFrame, p: int, q: int) -> list[list[float]]:
    """XᵗY of two tables (obs_id, x): a small matrix, on the driver."""
    if a is b:  # one pass, no join
        same = a.select(F.col("x").alias("_a"), F.col("x").alias("_b"))
    else:
        same = a.select("obs_id", F.col("x").alias("_a")).join(b.select("obs_id", F.col("x").alias("_b")), "obs_id")
    row = same.agg(*[F.sum(F.col("_a")[i] * F.col("_b")[j]) for i in range(p) for j in range(q)]).first()
    return [[float(row[i * q + j] or 0.0) for j in range(q)] for i in range(p)]


def variance(data: DataMatrix, *, assume_centered: bool, name: str = "variance") -> DataMatrix:
    """Per variable Σx²/(n-1), which is its variance if the caller knows its mean to be 0."""
    if not assume_centered:
        raise ValueError("centre the matrix first and say so")
    n = data.obs.count()
    ss = sum_squared(data).select("var_id", (F.col("ss") / max(n - 1, 1)).alias(name))
    return data.with_var(_attach(data.var, data.var_key, ss, "var_id", [name]))


def std(data: DataMatrix, *, assume_centered: bool, name: str = "std") -> DataMatrix:
    v = variance(data, assume_centered=assume_centered, name=name)
    return v.with_var(v.var.withColumn(name, F.sqrt(name)))


def relative_std(data: DataMatrix, *, assume_centered: bool, name: str = "relative_std") -> DataMatrix:
    s = std(data, assume_centered=assume_centered, name=name)
    top = s.var.agg(F.max(name).alias("_max"))  # one row
    return s.with_var(s.var.crossJoin(F.broadcast(top)).withColumn(name, F.when(F.col("_max") > 0, F.col(name) / F.col("_max")).otherwise(F.lit(float("nan")))).drop("_max"))


def log_mean(data: DataMatrix, name: str = "log_mean") -> DataMatrix:
    """Per variable log10(expm1(mean of log1p x)) over all observations; -inf where all are 0."""
    n = data.obs.count()
    sums = data.mat.groupBy("var_id").agg(F.sum(F.log1p("value")).alias("_s"))
    full = _attach(data.var, data.var_key, sums, "var_id", ["_s"])
    return data.with_var(full.withColumn(name, F.when(F.col("_s") > 0, F.log10(F.expm1(F.col("_s") / n))).otherwise(F.lit(float("-inf")))).drop("_s"))


def log_counts(data: DataMatrix, name: str = "log_counts", where: Where = None) -> DataMatrix:
    """Per observation log10(max(1, sum over selected variables))."""
    d = var_counts_sum(data, name, where)
    return d.with_obs(d.obs.withColumn(name, F.log10(F.greatest(F.lit(1), F.col(name)).cast("double"))))


def _combinations(table: DataFrame, by: list[str], delim: str) -> DataFrame:
    """All combinations of the covariates' categories, the last one running fastest; as many as the categories' product."""
    out = None
    for i, c in enumerate(by):
        own = distinct_values(table, c).select(F.col(c).alias(c), F.col("ord").alias(f"_o{i}"))
        out = own if out is None else out.crossJoin(own)
    order = [f"_o{i}" for i in range(len(by))]
    return out.withColumn("combo", F.concat_ws(delim, *[F.col(c).cast("string") for c in by])).select("combo", *by, F.struct(*order).alias("_order"))


def _complete(obs: DataFrame, by: list[str]) -> None:
    gap = obs.filter(" or ".join(f"`{c}` is null" for c in by)).limit(1).count()
    if gap:
        raise ValueError("an observation lacks a covariate")


def new_categories(obs: DataFrame, new_var: tuple[str, ...], delim: str = "_") -> DataFrame:
    """(extra, the covariates, _order): the combinations that become variables."""
    return _combinations(obs, list(new_var), delim).withColumnRenamed("combo", "extra")


def _known(own: DataFrame, extras: DataFrame) -> None:
    lost = own.join(extras.select("extra"), "extra", "left_anti").head(1)
    if lost:
        raise ValueError(f"unseen category {lost[0]['extra']!r}")


def pseudobulk(data: DataMatrix, *by: str, new_var: tuple[str, ...] = (), delim: str = "_", extras: DataFrame | None = None) -> DataMatrix:
    """Means of each variable over the observations of each combination of covariates; an empty combination is all 0.

    ``new_var`` covariates are unfolded into variables ``variable_category...`` instead; ``extras`` from other data
    (see ``new_categories``) keeps these as they are there.
    """
    _complete(data.obs, [*by, *new_var])
    key = lambda cs: F.concat_ws(delim, *[F.col(c).cast("string") for c in cs])
    combos = _combinations(data.obs, list(by), delim)
    ranked = combos.orderBy("_order")
    own = data.obs.select(F.col(data.obs_key).alias("obs_id"), key(by).alias("combo"), (key(new_var) if new_var else F.lit("")).alias("extra"))
    sizes = own.groupBy("combo", "extra").agg(F.count(F.lit(1)).alias("n"))
    sums = data.mat.join(own, "obs_id").groupBy("var_id", "combo", "extra").agg(F.sum("value").alias("s")).join(sizes, ["combo", "extra"])
    var_id = F.concat_ws(delim, F.col("var_id").cast("string"), F.col("extra")) if new_var else F.col("var_id")
    mat = sums.select(var_id.alias("var_id"), F.col("combo").alias("obs_id"), (F.col("s") / F.col("n")).alias("value"))
    obs = ranked.select("combo", *[c for c in by if len(by) > 1], "_order")
    obs = _dense(obs)
    var = data.var
    if new_var:
        if extras is None:
            extras = new_categories(data.obs, new_var, delim)
        else:
            _known(own, extras)
        var = data.var.withColumnRenamed("ord", "_var").crossJoin(extras.withColumnRenamed("_order", "_extra"))
        var = var.withColumn("id", F.concat_ws(delim, F.col(data.var_key).cast("string"), "extra"))
        var = numbered(var, "_var", "_extra").select("id", *[c for c in data.var.columns if c not in ("id", "ord")], *new_var, "ord")
    return DataMatrix(mat, var, obs, "id" if new_var else data.var_key, "combo")


def _dense(combos: DataFrame) -> DataFrame:
    return numbered(combos, "_order").drop("_order")


def population_matrix(obs: DataFrame, *by: str, new_var: str | tuple[str, ...], delim: str = "_", extras: DataFrame | None = None) -> DataMatrix:
    """How the observations of each combination of ``by`` divide among the combinations of ``new_var``: a matrix of shares.

    Variables are the latter (named ``extra``), observations the former (``combo``); an empty combination is all 0.
    ``extras`` from other data keeps the variables as they are there.
    """
    new_var = (new_var,) if isinstance(new_var, str) else tuple(new_var)
    _complete(obs, [*by, *new_var])
    key = lambda cs: F.concat_ws(delim, *[F.col(c).cast("string") for c in cs])
    own = obs.select(key(new_var).alias("extra"), key(by).alias("combo"))
    if extras is None:
        extras = new_categories(obs, new_var, delim)
    else:
        _known(own, extras)
    counts = own.groupBy("extra", "combo").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("combo").agg(F.greatest(F.lit(1), F.sum("n")).alias("t"))
    mat = counts.join(totals, "combo").select(F.col("extra").alias("var_id"), F.col("combo").alias("obs_id"), (F.col("n") / F.col("t")).alias("value"))
    var = _dense(extras.select("extra", *[c for c in new_var if len(new_var) > 1], "_order"))
    columns = _dense(_combinations(obs, list(by), delim).select("combo", *[c for c in by if len(by) > 1], "_order"))
    return DataMatrix(mat, var, columns, "extra", "combo")


def scaled(data: DataMatrix, factor: float) -> DataMatrix:
    return replace(data, mat=data.mat.withColumn("value", F.col("value") * factor))
