"""Design matrices of covariates, and regression of a matrix on them."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmat.datamatrix import DataMatrix, LowRank
from quillmat.operators import tables
from quillmat.operators.counts import gram_of, relative_std, std, times_right, variance


@dataclass(frozen=True)
class Covariate:
    """A column of obs, or an annotation table joined by identifier; ``kind`` None is inferred."""

    source: str | DataFrame
    kind: str | None = None  # numerical, categorical, twogroup
    a: object = None
    b: object = None


def numerical(source) -> Covariate:
    return Covariate(source, "numerical")


def categorical(source) -> Covariate:
    return Covariate(source, "categorical")


def twogroup(source, a, b=None) -> Covariate:
    return Covariate(source, "twogroup", a, b)


@dataclass(frozen=True)
class Column:
    """A fitted design column: a category's indicator or (value - shift) / scale."""

    name: str
    source: str | DataFrame | None
    kind: str
    category: object = None
    a: object = None
    b: object = None
    shift: float = 0.0
    scale: float = 1.0


@dataclass(frozen=True)
class Design:
    """Fitted columns; ``rows`` applies them to a table of observations, frozen as they are."""

    columns: tuple[Column, ...]
    categories: tuple = ()

    def rows(self, obs: DataFrame, key: str) -> DataFrame:
        """(obs_id, x): the design as arrays; null covariates, unseen categories and other groups are errors."""
        t, values = _with_sources(obs, [c.source for c in self.columns if c.source is not None])
        seen: dict = {}
        for c in self.columns:
            if c.kind == "category":
                seen.setdefault(values[_id(c.source)], []).append(c.category)
        for name, known in seen.items():
            if bad := t.filter(F.col(name).isNull() | ~F.col(name).isin(known)).limit(1).collect():
                raise ValueError(f"unknown category: {bad[0][name]}")
        out = []
        for c in self.columns:
            v = F.col(values[_id(c.source)]) if c.source is not None else None
            if c.kind == "intercept":
                out.append(F.lit(1.0))
            elif c.kind == "category":
                out.append(F.when(v == F.lit(c.category), 1.0).otherwise(0.0))
            else:
                out.append((_number(c, v) - c.shift) / c.scale)
        x = F.array(*out)
        return t.select(F.col(key).alias("obs_id"), x.alias("x"))


def _id(source) -> object:
    return source if isinstance(source, str) else id(source)


def _number(c, v):
    if c.kind != "twogroup":
        return v.cast("double")
    other = F.lit(1.0) if c.b is None else F.when(v == F.lit(c.b), 1.0).otherwise(F.raise_error(F.lit("a value is in neither group")))
    return F.when(v == F.lit(c.a), 2.0).otherwise(other)


def _with_sources(obs: DataFrame, sources: list) -> tuple[DataFrame, dict]:
    t, values = obs, {}
    for s in sources:
        if isinstance(s, str):
            values[s] = s
        elif id(s) not in values:
            name = f"_cov{len(values)}"
            t = tables.left_join(t, tables.get_columns(s, 0, 1).withColumnRenamed(tables.value_name(s), name))
            values[id(s)] = name
    return t, values


def fit_design(obs: DataFrame, *covariates: Covariate | str | DataFrame, center: bool = True, max_categories: int = 100) -> Design:
    """Column means, scales and category lists, from one aggregate per covariate; categories force the intercept."""
    covs = [c if isinstance(c, Covariate) else Covariate(c) for c in covariates]
    t, values = _with_sources(obs, [c.source for c in covs])
    columns: list[Column] = []
    kinds = []
    for c in covs:
        dtype = t.schema[values[_id(c.source)]].dataType
        numeric = isinstance(dtype, T.NumericType | T.BooleanType)
        kinds.append(c.kind or ("numerical" if numeric else "categorical"))
    if center or any(k != "numerical" for k in kinds):
        columns.append(Column("intercept", None, "intercept"))
        center = True
    for c, kind in zip(covs, kinds, strict=True):
        name = values[_id(c.source)]
        if kind == "categorical":
            found = [r[0] for r in tables.distinct_values(t, name).orderBy("ord").limit(max_categories + 1).collect()]
            if len(found) > max_categories:
                raise ValueError(f"{name} has more than {max_categories} categories")
            columns += [Column(f"{name}_{x}", c.source, "category", category=x) for x in found]
            continue
        v = _number(replace(c, kind=kind), F.col(name))
        shift = float(t.agg(F.avg(v)).first()[0] or 0.0) if center else 0.0
        scale = max(1e-6, float(t.agg(F.max(F.abs(v - shift))).first()[0] or 0.0))
        columns.append(Column(name, c.source, kind, a=c.a, b=c.b, shift=shift, scale=scale))
    return Design(tuple(columns))


def design_matrix(data: DataMatrix, *covariates, **options) -> DataFrame:
    return fit_design(data.obs, *covariates, **options).rows(data.obs, data.obs_key)


def negative_regression(data: DataMatrix, design: Design, *, rtol: float | None = None) -> DataFrame:
    """(var_id, b): -A X⁺ᵗ, from A·X and the small XᵗX; directions below the cutoff are left out."""
    rank = len(design.columns)
    x = design.rows(data.obs, data.obs_key)
    gram = np.array(gram_of(x, x, rank, rank))
    values, vectors = np.linalg.eigh(gram)
    # eigenvalues are squares of singular values, so rounding hides those below the root of the precision
    good = np.sqrt(np.maximum(values, 0)) > max(rtol or 0.0, np.sqrt(np.finfo(float).eps)) * max(1.0, float(np.sqrt(values.max())) if len(values) else 1.0)
    inverse = (vectors[:, good] / values[good]) @ vectors[:, good].T
    y = times_right(data, x, rank)
    beta = [sum((F.lit(float(-inverse[j, i])) * F.col("y")[j] for j in range(rank)), F.lit(0.0)) for i in range(rank)]
    return y.select("var_id", F.array(*beta).alias("b"))


def normalize(data: DataMatrix, *covariates, center: bool = True, rtol: float | None = None, design: Design | None = None, beta: DataFrame | None = None, annotate: tuple[str, ...] = ()) -> DataMatrix:
    """The matrix less its regression on covariates, as A + (-β)Xᵗ; nothing is densified.

    ``design`` and ``beta`` from another matrix keep its fit.  ``annotate`` adds variance, std or relative_std of the result to var.
    """
    if annotate and not center:
        raise ValueError("annotations need a centred matrix")
    design = design or fit_design(data.obs, *covariates, center=center)
    beta = negative_regression(data, design, rtol=rtol) if beta is None else beta
    out = replace(data, terms=(*data.terms, LowRank(beta, design.rows(data.obs, data.obs_key), len(design.columns))))
    for a in annotate:
        f = {"variance": variance, "std": std, "relative_std": relative_std}[a]
        out = out.with_var(f(out, assume_centered=True).var)
    return out
