"""Counts kept up to date over streams of cells.

Sums per observation or variable are algebraic, so they run on a streaming table of cells as on a stored one;
everything else works on complete matrices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def running_sums(cells: DataFrame, side: str = "obs_id", f: Callable[[Column], Column] | None = None, *, name: str = "total") -> DataFrame:
    """Sums of ``f(value)`` per observation (or ``var_id``) of streaming ``cells(var_id, obs_id, value)``; write it in update or complete mode."""
    return cells.groupBy(side).agg(F.sum(f(F.col("value")) if f else F.col("value")).alias(name))
