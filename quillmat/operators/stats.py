"""Tests of every variable against covariates: F, t and rank-sum."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmat.datamatrix import DataMatrix
from quillmat.functions.distributions import f_pvalue, rank_pvalue, t_pvalue
from quillmat.operators.counts import gram_of, sum_squared
from quillmat.operators.design import Covariate, Design, fit_design
from quillmat.operators.filters import without_missing
from quillmat.operators.reduce import times


def ready(data: DataMatrix, covariates: list, missing: str) -> DataMatrix:
    named = [c.source if isinstance(c, Covariate) else c for c in covariates]
    columns = [c for c in named if isinstance(c, str)]
    if missing == "skip":
        return without_missing(data, columns) if columns else data
    if missing != "error":
        raise ValueError(f"unknown mode {missing!r}")
    if columns and data.obs.filter(" or ".join(f"`{c}` is null" for c in columns)).head(1):
        raise ValueError("an observation lacks a covariate")
    return data


def _bases(obs: DataFrame, key: str, h0: Design | None, h1: Design) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(obs_id, x) of both designs side by side, and matrices that turn x into orthonormal bases of h0 and of h1 beyond it.

    Both come from the joint Gram matrix, so observations stay where they are.
    """
    columns = (*(h0.columns if h0 else ()), *h1.columns)
    x = Design(columns).rows(obs, key)
    k, k0 = len(columns), len(h0.columns) if h0 else 0
    g = np.array(gram_of(x, x, k, k))

    def basis(m: np.ndarray) -> np.ndarray:
        inner = m.T @ g @ m
        values, vectors = np.linalg.eigh(inner) if m.shape[1] else (np.zeros(0), np.zeros((0, 0)))
        own = np.sqrt(np.maximum(values, 0)) > np.sqrt(np.finfo(float).eps) * max(1.0, np.sqrt(g.max() if g.size else 1))
        return m @ (vectors[:, own] / np.sqrt(values[own]))

    q0 = basis(np.eye(k)[:, :k0])
    rest = np.eye(k)[:, k0:]
    rest = rest - q0 @ (q0.T @ g @ rest)
    return x, q0, basis(rest)


def _explained(data: DataMatrix, x: DataFrame, q0: np.ndarray, q1: np.ndarray) -> DataFrame:
    """(var_id, ss, _e0, _e1, _first): each variable's squared length, those of its projections onto both bases, and the coordinate along the first vector of the second.

    Of a plain sparse matrix all come from one join of its cells with the design and one sum.
    """
    k = q0.shape[0]
    if data.terms:
        y = times(data, x, "x", k).join(sum_squared(data), "var_id")
    else:
        value = F.col("value").cast("double")
        sums = data.mat.join(x, "obs_id").groupBy("var_id").agg(F.sum(value * value).alias("ss"), *[F.sum(value * F.col("x")[i]).alias(f"_{i}") for i in range(k)])
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        y = data.var_ids().join(sums, "var_id", "left").select("var_id", F.array(*[zero(f"_{i}") for i in range(k)]).alias("y"), zero("ss").alias("ss"))
    along = lambda q: [sum((F.lit(float(q[i, j])) * F.col("y")[i] for i in range(k)), F.lit(0.0)) for j in range(q.shape[1])]
    square = lambda parts: sum((p * p for p in parts), F.lit(0.0))
    first, second = along(q0), along(q1)
    return y.select("var_id", "ss", square(first).alias("_e0"), square(second).alias("_e1"), (second[0] if second else F.lit(0.0)).alias("_first"))


def _safe_ratio(a, b):
    """IEEE division: 0/0 is nan, x/0 infinite."""
    return F.when(b != 0, a / F.when(b != 0, b)).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


def _with_var_columns(data: DataMatrix, result: DataFrame, var_columns: tuple[str, ...]) -> DataFrame:
    own = data.var.select(F.col(data.var_key).alias("var_id"), *var_columns, "ord")
    return own.join(result, "var_id")


def _shown(out: DataFrame, var_columns: tuple[str, ...], by: str, names: dict[str, str | None], do_sort: bool) -> DataFrame:
    """Result columns under their names (None: left out), most significant variables first or as the variables are."""
    out = out.orderBy(F.abs(by).desc(), "ord") if do_sort else out.orderBy("ord")
    return out.select("var_id", *var_columns, *[F.col(c).alias(n) for c, n in names.items() if n is not None])


@dataclass(frozen=True)
class Tested:
    """The designs of a test as fitted on some observations: of the null hypothesis, and what is tested beyond it."""

    null: Design | None
    alt: Design


def ftest_designs(obs: DataFrame, h1: list, *, h0: tuple = (), center: bool = True, max_categories: int = 100) -> Tested:
    null = fit_design(obs, *h0, center=center, max_categories=max_categories) if h0 or center else None
    return Tested(null, fit_design(obs, *h1, center=False, max_categories=max_categories))


def ftest(
    data: DataMatrix, h1: list, *, h0: tuple = (), center: bool = True, h1_missing: str = "skip", var_columns: tuple[str, ...] = (), max_categories: int = 100,
    designs: Tested | None = None, statistic_col: str | None = "F", pvalue_col: str | None = "pValue", do_sort: bool = True,
) -> DataFrame:
    """var_id, F, pValue for h1 beyond h0 (and the mean), sorted by F; a model without freedom gives F 0, p 1.

    ``designs`` fitted on other observations keep their means, scales and categories.
    """
    data = ready(data, [*h0, *h1], h1_missing)
    designs = designs or ftest_designs(data.obs, h1, h0=h0, center=center, max_categories=max_categories)
    x, q0, q1 = _bases(data.obs, data.obs_key, designs.null, designs.alt)
    v1, v2 = q1.shape[1], data.obs.count() - q0.shape[1] - q1.shape[1]
    if v1 <= 0 or v2 <= 0:
        out = data.var_ids().select("var_id", F.lit(0.0).alias("F"), F.lit(1.0).alias("pValue"))
    else:
        e = _explained(data, x, q0, q1)
        left = F.greatest(F.lit(0.0), F.col("ss") - F.col("_e0") - F.col("_e1"))
        out = e.select("var_id", (F.lit(v2 / v1) * _safe_ratio(F.col("_e1"), left)).alias("F"))
        out = out.withColumn("pValue", f_pvalue(v1, v2)("F"))
    return _shown(_with_var_columns(data, out, var_columns), var_columns, "F", {"F": statistic_col, "pValue": pvalue_col}, do_sort)


def ttest_designs(obs: DataFrame, h1, *, h0: tuple = (), center: bool = True) -> Tested:
    c = h1 if isinstance(h1, Covariate) else Covariate(h1)
    if c.kind == "categorical":
        raise ValueError("a t-test needs a numerical or two-group covariate")
    center = center or c.kind == "twogroup"
    alt = fit_design(obs, c, center=center)
    alt = Design(tuple(x for x in alt.columns if x.kind != "intercept"))
    if alt.columns[0].kind == "category":
        raise ValueError("a t-test needs a numerical or two-group covariate")
    return Tested(fit_design(obs, *h0, center=center) if h0 or center else None, alt)


def ttest(
    data: DataMatrix, h1, *, h0: tuple = (), center: bool = True, h1_missing: str = "skip", var_columns: tuple[str, ...] = (), designs: Tested | None = None,
    statistic_col: str | None = "t", pvalue_col: str | None = "pValue", difference_col: str | None = "difference", do_sort: bool = True,
) -> DataFrame:
    """var_id, t, pValue, difference for one numerical or two-group covariate, sorted by |t|; ``designs`` as in :func:`ftest`."""
    data = ready(data, [*h0, h1], h1_missing)
    designs = designs or ttest_designs(data.obs, h1, h0=h0, center=center)
    null, alt = designs.null, designs.alt
    x, q0, q1 = _bases(data.obs, data.obs_key, null, alt)
    v2 = data.obs.count() - q0.shape[1] - q1.shape[1]
    if q1.shape[1] != 1 or v2 <= 0:
        out = data.var_ids().select("var_id", F.lit(0.0).alias("t"), F.lit(1.0).alias("pValue"), F.lit(0.0).alias("difference"))
    else:
        k0 = len(null.columns) if null else 0
        if q1[k0, 0] < 0:
            q1 = -q1
        e = _explained(data, x, q0, q1)
        left = F.greatest(F.lit(0.0), F.col("ss") - F.col("_e0") - F.col("_e1"))
        # q1 is h1 beyond h0 over its length, and q1[k0] is one over that length
        out = e.select("var_id", _safe_ratio(F.col("_first"), F.sqrt(left / v2)).alias("t"), (F.col("_first") * F.lit(float(q1[k0, 0]) / alt.columns[0].scale)).alias("difference"))
        out = out.select("var_id", "t", t_pvalue(v2)("t").alias("pValue"), "difference")
    return _shown(_with_var_columns(data, out, var_columns), var_columns, "t", {"t": statistic_col, "pValue": pvalue_col, "difference": difference_col}, do_sort)


def two_groups(obs: DataFrame, column: str, a=None, b=None) -> tuple:
    """The labels to compare: those given, which must occur, or the only two there are."""
    if a is None:
        values = sorted(r[0] for r in obs.filter(F.col(column).isNotNull()).select(column).distinct().limit(3).collect())
        if len(values) != 2:
            raise ValueError(f"{column} must have exactly two values")
        return values[0], values[1]
    for g in (a, b):
        if g is not None and not obs.filter(F.col(column) == F.lit(g)).head(1):
            raise ValueError(f"no observation in group {g!r}")
    return a, b


def mannwhitney(
    data: DataMatrix, column: str, a=None, b=None, *, h1_missing: str = "skip", var_columns: tuple[str, ...] = (), groups: tuple | None = None,
    statistic_col: str | None = "U", pvalue_col: str | None = "pValue", z_col: str | None = None, do_sort: bool = True,
) -> DataFrame:
    """var_id, U, pValue (and z if it has a name) of group ``a`` against ``b`` (or all others), sorted by |z|; stored values must be positive.

    ``groups`` resolved on other data (see ``two_groups``) are taken as they are, whether they occur or not.

    Ranks are windows over each variable's stored cells; the zeros are one tied block below them, counted not listed.
    """
    if data.terms:
        raise ValueError("ranks need a plain sparse matrix")
    data = ready(data, [column], h1_missing)
    a, b = groups or two_groups(data.obs, column, a, b)
    group = F.when(F.col(column).eqNullSafe(F.lit(a)), 1)
    group = group.when(F.col(column).eqNullSafe(F.lit(b)), 2) if b is not None else group.otherwise(2)
    members = data.obs.select(F.col(data.obs_key).alias("obs_id"), group.alias("g")).filter("g is not null")
    sizes = members.agg(F.sum((F.col("g") == 1).cast("long")), F.sum((F.col("g") == 2).cast("long"))).first()
    n1, n2 = int(sizes[0] or 0), int(sizes[1] or 0)
    n = n1 + n2
    value = F.when(F.col("value") > 0, F.col("value")).otherwise(F.raise_error(F.lit("a stored value isn't positive")))
    # equal values of a variable are first counted, so a window runs over distinct values only
    per = data.mat.join(members, "obs_id").groupBy("var_id", value.alias("value")).agg(F.count(F.lit(1)).alias("t"), F.sum((F.col("g") == 1).cast("long")).alias("t1"))
    below = F.coalesce(F.sum("t").over(Window.partitionBy("var_id").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = per.withColumn("twice", 2 * below + F.col("t") + 1)  # twice the average rank among stored cells
    t = F.col("t").cast("double")
    sums = ranked.groupBy("var_id").agg(F.sum("t").alias("m"), F.sum("t1").alias("m1"), F.sum(F.col("twice") * F.col("t1")).alias("r"), F.sum(t * t * t - t).alias("ties"))
    full = data.var_ids().join(sums, "var_id", "left").fillna(0, ["m", "m1", "r", "ties"])
    zeros, zeros1 = F.lit(n) - F.col("m"), F.lit(n1) - F.col("m1")
    u = (F.col("r") + 2 * F.col("m1") * zeros + (zeros + 1) * zeros1 - F.lit(n1 * (n1 + 1))) / 2
    z = zeros.cast("double")
    ties = F.col("ties") + z * z * z - z
    sigma2 = F.lit(n1 * n2 / 12) * (F.lit(float(n + 1)) - ties / max(n * (n - 1), 1))
    out = full.select("var_id", u.cast("double").alias("U"), F.sqrt(F.greatest(F.lit(0.0), sigma2)).alias("_sigma"))
    # a wholly tied variable has no spread, but for rounding
    out = out.withColumn("_sigma", F.when(F.col("_sigma") > 1e-9, F.col("_sigma")).otherwise(0.0)).withColumn("_d", F.col("U") - n1 * n2 / 2)
    out = out.select("var_id", "U", F.when(F.col("_sigma") > 0, F.col("_d") / F.when(F.col("_sigma") > 0, F.col("_sigma"))).otherwise(0.0).alias("z"), rank_pvalue()("_d", "_sigma").alias("pValue"))
    return _shown(_with_var_columns(data, out, var_columns), var_columns, "z", {"U": statistic_col, "z": z_col, "pValue": pvalue_col}, do_sort)
