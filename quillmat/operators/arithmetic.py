"""Products and sums of annotated matrices."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmat.datamatrix import DataMatrix, LowRank
from quillmat.operators.counts import times_right
from quillmat.plans.expressions import multiply


def _same_ids(a: DataFrame, b: DataFrame, what: str) -> None:
    a, b = a.toDF("_id"), b.toDF("_id")
    lost = a.join(b, a["_id"].eqNullSafe(b["_id"]), "left_anti").union(b.join(a, b["_id"].eqNullSafe(a["_id"]), "left_anti")).head(1)
    if lost:
        raise ValueError(f"{what} differ, by {lost[0]['_id']!r} for one")


def _product(a: DataMatrix, b: DataMatrix) -> DataMatrix:
    _same_ids(a.obs_ids(), b.var_ids(), "the observations of the first and the variables of the second matrix")
    if a.terms and b.terms:
        raise ValueError("materialize one of the matrices first")
    left = a.mat.select(F.col("var_id").alias("i"), F.col("obs_id").alias("j"), "value")
    right = b.mat.select(F.col("var_id").alias("i"), F.col("obs_id").alias("j"), "value")
    mat = multiply(left, right).select(F.col("i").alias("var_id"), F.col("j").alias("obs_id"), "value")
    # (A + BXᵗ)C = AC + B(CᵗX)ᵗ and A(C + BXᵗ) = AC + (AB)Xᵗ
    terms = [LowRank(t.left, times_right(b.transposed(), t.right, t.rank).select(F.col("var_id").alias("obs_id"), F.col("y").alias("x")), t.rank) for t in a.terms]
    terms += [LowRank(times_right(a, t.left.select(F.col("var_id").alias("obs_id"), F.col("b").alias("x")), t.rank).select("var_id", F.col("y").alias("b")), t.right, t.rank) for t in b.terms]
    return DataMatrix(mat, a.var, b.obs, a.var_key, b.obs_key, tuple(terms), once=mat)


def matrix_product(first: DataMatrix, *others: DataMatrix) -> DataMatrix:
    """The product: variables of the first, observations of the last; identifiers in between must agree, whatever their order."""
    for other in others:
        first = _product(first, other)
    return first


def matrix_sum(first: DataMatrix, *others: DataMatrix) -> DataMatrix:
    """The sum of matrices with the same identifiers; both tables are the first one's.  A matrix that is given again is worked out once and multiplied;
    cells of a product stand once, so they needn't meet."""
    again = [o for o in others if o.mat is first.mat and o.var is first.var and o.obs is first.obs]
    mat, terms = first.mat.select("var_id", "obs_id", "value"), first.terms
    if again:
        mat = mat.withColumn("value", F.col("value") * F.lit(1 + len(again)))
        terms = (*terms, *[t for o in again for t in o.terms])
    for other in (o for o in others if not any(o is a for a in again)):
        _same_ids(first.var_ids(), other.var_ids(), "variables")
        _same_ids(first.obs_ids(), other.obs_ids(), "observations")
        mat, terms = mat.union(other.mat.select("var_id", "obs_id", "value")), (*terms, *other.terms)
    if len(again) == len(others) and first.once is first.mat and isinstance(first.mat.schema["value"].dataType, T.LongType | T.DoubleType):
        return replace(first, mat=mat, terms=terms, once=mat)
    return replace(first, mat=mat.groupBy("var_id", "obs_id").agg(F.sum("value").alias("value")), terms=terms)
