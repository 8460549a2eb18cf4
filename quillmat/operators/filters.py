"""Selecting variables and observations by predicates and identifiers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmat.datamatrix import DataMatrix, LowRank
from quillmat.operators import tables

#: None (all), a Column or SQL string over the table, a range of positions, (annotation table, function of
#: its value), or (column name or names, function of them).
Where = Column | str | range | tuple | None


def select_rows(t: DataFrame, where: Where) -> DataFrame:
    """The rows of a table that a predicate admits; a null outcome admits nothing."""
    if where is None:
        return t
    if isinstance(where, range):
        position = F.col("ord")
        return t.filter((position >= where.start) & (position < where.stop) & ((position - where.start) % where.step == 0))
    if isinstance(where, str | Column):
        return t.filter(where)
    what, f = where
    if isinstance(what, DataFrame):
        return tables.left_join(t.select(tables.id_name(t), "ord"), tables.get_columns(what, 0, 1)).filter(f(F.col(tables.value_name(what)))).select(tables.id_name(t)).join(t, tables.id_name(t)).select(t.columns)
    return t.filter(f(*[F.col(c) for c in ([what] if isinstance(what, str) else what)]))


def keep(data: DataMatrix, var: DataFrame | None = None, obs: DataFrame | None = None) -> DataMatrix:
    """The matrix over some of its variables and observations; cells follow by semi-joins on identifiers."""
    mat, terms = data.mat, data.terms
    if var is not None:
        ids = var.select(F.col(data.var_key).alias("var_id"))
        mat = mat.join(ids, "var_id", "left_semi")
        terms = tuple(LowRank(t.left.join(ids, "var_id", "left_semi"), t.right, t.rank) for t in terms)
    if obs is not None:
        ids = obs.select(F.col(data.obs_key).alias("obs_id"))
        mat = mat.join(ids, "obs_id", "left_semi")
        terms = tuple(LowRank(t.left, t.right.join(ids, "obs_id", "left_semi"), t.rank) for t in terms)
    return replace(data, mat=mat, terms=terms, var=data.var if var is None else var, obs=data.obs if obs is None else obs)


def filter_var(where: Where, data: DataMatrix) -> DataMatrix:
    return keep(data, var=select_rows(data.var, where))


def filter_obs(where: Where, data: DataMatrix) -> DataMatrix:
    return keep(data, obs=select_rows(data.obs, where))


def filter_matrix(var_where: Where, obs_where: Where, data: DataMatrix) -> DataMatrix:
    return keep(data, select_rows(data.var, var_where), select_rows(data.obs, obs_where))


def subset_var(data: DataMatrix, ids: DataFrame, *, missing: str = "error") -> DataMatrix:
    """The variables named in ``ids``, in its order."""
    return keep(data, var=tables.lookup(ids, data.var, missing=missing))


def subset_obs(data: DataMatrix, ids: DataFrame, *, missing: str = "error") -> DataMatrix:
    return keep(data, obs=tables.lookup(ids, data.obs, missing=missing))


def subset_matrix(data: DataMatrix, var_ids: DataFrame, obs_ids: DataFrame) -> DataMatrix:
    return subset_obs(subset_var(data, var_ids), obs_ids)


def without_missing(data: DataMatrix, columns: list[str]) -> DataMatrix:
    """Observations that have all these covariates."""
    return keep(data, obs=data.obs.dropna(subset=columns))


def matrix_row(data: DataMatrix, var_id) -> DataFrame:
    """One variable's values over all observations, zeros included."""
    row = data.mat.filter(F.col("var_id") == F.lit(var_id)).select("obs_id", "value")
    return data.obs_ids().join(row, "obs_id", "left").withColumn("value", F.coalesce("value", F.lit(0)))


def matrix_column(data: DataMatrix, obs_id) -> DataFrame:
    column = data.mat.filter(F.col("obs_id") == F.lit(obs_id)).select("var_id", "value")
    return data.var_ids().join(column, "var_id", "left").withColumn("value", F.coalesce("value", F.lit(0)))


Function = Callable[[Column], Column]
