"""Column operations, lookups by identifier and set operations on tables.

A table's first column is its identifier and ``ord`` its order, which every operation keeps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmat.order import numbered

#: Pairs of positions that a task of ``match_columns`` makes (beyond MOST_TASKS tasks they make more), and equal rows of one side that meet at once.
PAIRS, SIDE, MOST_TASKS = 16_000_000, 1024, 20_000


def create_table(spark: SparkSession, **columns: list) -> DataFrame:
    """A literal table; all columns must be equally long."""
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("columns differ in length")
    rows = [(*r, i) for i, r in enumerate(zip(*columns.values(), strict=True))]
    return spark.createDataFrame(rows, [*columns, "ord"]) if rows else spark.createDataFrame([], ", ".join(f"{c} string" for c in columns) + ", ord long")


def names(t: DataFrame) -> list[str]:
    return [c for c in t.columns if c != "ord"]


def id_name(t: DataFrame) -> str:
    return names(t)[0]


def value_name(t: DataFrame) -> str:
    if len(names(t)) != 2:
        raise ValueError(f"expected two columns, got {names(t)}")
    return names(t)[1]


def get_columns(t: DataFrame, *which: str | int) -> DataFrame:
    own = names(t)
    chosen = [own[w] if isinstance(w, int) else w for w in which]
    if unknown := [c for c in chosen if c not in own]:
        raise KeyError(f"no such columns: {unknown}")
    return t.select(*chosen, "ord")


def id_column(t: DataFrame) -> DataFrame:
    return get_columns(t, 0)


def value_column(t: DataFrame) -> DataFrame:
    return get_columns(t, value_name(t))


def annotation(t: DataFrame, column: str) -> DataFrame:
    return get_columns(t, 0, column)


def column_data(t: DataFrame, column: str | int = 0) -> list:
    """A column's values in order, on the driver; for tables that fit there."""
    return [r[0] for r in get_columns(t, column).orderBy("ord").collect()]


def shape(t: DataFrame) -> tuple[int, int]:
    return t.count(), len(names(t))


def add_column(t: DataFrame, name: str, values: Column | DataFrame) -> DataFrame:
    """A new column from an expression, or from a table with ``ord`` and one more column, matched by position."""
    if name in t.columns:
        raise ValueError(f"column exists: {name}")
    if isinstance(values, Column):
        return t.withColumn(name, values)
    own = values.select("ord", F.col(value_name(values) if len(names(values)) == 2 else id_name(values)).alias(name))
    if t.count() != own.count():
        raise ValueError("lengths differ")
    return t.join(own, "ord").select(*names(t), name, "ord")


def hcat(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Columns side by side, matched by position; equally long tables with distinct names."""
    out = first
    for o in others:
        if set(names(out)) & set(names(o)):
            raise ValueError(f"columns occur twice: {set(names(out)) & set(names(o))}")
        if out.count() != o.count():
            raise ValueError("lengths differ")
        out = out.join(o, "ord").select(*names(out), *names(o), "ord")
    return out


def transform_annotation(f: Callable[[Column], Column], t: DataFrame, *, new_name: str | None = None) -> DataFrame:
    value = value_name(t)
    return t.select(id_name(t), f(F.col(value)).alias(new_name or value), "ord")


def combine_columns(t: DataFrame, to: str, delim: str = "_") -> DataFrame:
    """All columns as one string column."""
    return t.select(F.concat_ws(delim, *[F.col(c).cast("string") for c in names(t)]).alias(to), "ord")


def repeat_rows(t: DataFrame, inner: int = 1, outer: int = 1) -> DataFrame:
    """Each row ``inner`` times in a row, and all that ``outer`` times; ``t`` must be numbered densely."""
    n = t.count()
    times = t.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(outer - 1)))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(inner - 1))))
    return times.withColumn("ord", (F.col("_o") * (n * inner) + F.col("ord") * inner + F.col("_i")).cast("long")).drop("_o", "_i")


def prefixed_ids(spark: SparkSession, prefix: str, n: int, name: str = "id") -> DataFrame:
    return spark.range(n).select(F.concat(F.lit(prefix), (F.col("id") + 1).cast("string")).alias(name), F.col("id").alias("ord"))


def first_of_each(t: DataFrame, key: str) -> DataFrame:
    """One row per key, the one of least ``ord``; null is a key like others."""
    rest = [c for c in t.columns if c != key]
    best = t.groupBy(key).agg(F.min_by(F.struct(*rest), "ord").alias("_r"))
    return best.select(key, *[F.col("_r")[c].alias(c) for c in rest])


def left_join(left: DataFrame, right: DataFrame, *, key: str | None = None) -> DataFrame:
    """Columns of the first row of ``right`` with the same identifier; rows and order of ``left``, null where none matches."""
    key = key or id_name(left)
    if id_name(right) != key:
        raise ValueError(f"identifiers differ: {key}, {id_name(right)}")
    if clash := set(names(left)) & set(names(right)) - {key}:
        raise ValueError(f"columns occur twice: {clash}")
    once = first_of_each(right, key).drop("ord").withColumnRenamed(key, "_key")
    return left.join(once, left[key].eqNullSafe(once["_key"]), "left").drop("_key").select(*names(left), *[c for c in names(right) if c != key], "ord")


def lookup(wanted: DataFrame, t: DataFrame, *, missing: str = "error") -> DataFrame:
    """The first row of ``t`` for each identifier in ``wanted``, in that table's order.

    ``missing``: ``error`` raises and quotes some, ``skip`` drops them, ``nothing`` leaves nulls.
    """
    key, own = id_name(wanted), id_name(t)
    if key != own:
        raise ValueError(f"identifiers differ: {key}, {own}")
    once = first_of_each(t, own).drop("ord")
    if missing == "error" and (lost := wanted.join(once, wanted[key].eqNullSafe(once[own]), "left_anti").limit(3).collect()):
        raise KeyError(f"unknown identifiers, such as {[r[0] for r in lost]}")
    once = once.withColumnRenamed(own, "_key")
    joined = wanted.select(key, "ord").join(once, wanted[key].eqNullSafe(once["_key"]), "left" if missing == "nothing" else "inner")
    return joined.drop("_key").select(key, *[c for c in names(t) if c != own], "ord")


def match_columns(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Positions of rows that agree in several columns, nulls included: left_ord, right_ord.

    Pairs are counted when this is called.  Of more than PAIRS every task makes about that many, whatever the size of the tables that they come from:
    rows are dealt out by what they agree in, and by blocks of about SIDE times SIDE pairs where more rows of a side agree.
    """
    l, r = (t.select(F.struct(*on).alias("_key"), F.col("ord").alias(to)) for t, to in ((left, "left_ord"), (right, "right_ord")))  # noqa: E741
    count = lambda t, to: t.groupBy("_key").agg(F.count(F.lit(1)).alias(to))
    n = count(l, "_n").join(count(r, "_m"), "_key", "full").select("_key", F.coalesce("_n", F.lit(0)).alias("_n"), F.coalesce("_m", F.lit(0)).alias("_m"))
    made = n.agg(F.sum(F.col("_n").cast("double") * F.col("_m")).alias("pairs"), F.max(F.greatest("_n", "_m")).alias("most")).first()
    if (made["pairs"] or 0) <= PAIRS:
        return l.join(r, "_key").select("left_ord", "right_ord")
    keys = ["_key"]
    if made["most"] > SIDE:
        blocks = lambda c: F.ceil(F.greatest(F.lit(1), F.col(c)) / SIDE).cast("int")
        crowded = n.filter(F.greatest("_n", "_m") > SIDE).select("_key", blocks("_n").alias("_ns"), blocks("_m").alias("_ms"))

        def dealt(t: DataFrame, at: str, own: str, others: str, block: str, copy: str) -> DataFrame:
            """Each row in a block of its side, once for each block of the other."""
            t = t.join(crowded, "_key", "left").withColumn(block, F.coalesce(F.pmod(F.xxhash64(at), own), F.lit(0)).cast("int"))
            return t.withColumn(copy, F.explode(F.sequence(F.lit(0), F.coalesce(others, F.lit(1)) - 1))).drop("_ns", "_ms")

        l, r = dealt(l, "left_ord", "_ns", "_ms", "_a", "_b"), dealt(r, "right_ord", "_ms", "_ns", "_b", "_a")  # noqa: E741
        keys += ["_a", "_b"]
    tasks = min(MOST_TASKS, max(math.ceil(made["pairs"] / PAIRS), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return l.repartition(tasks, *keys).join(r.repartition(tasks, *keys), keys).select("left_ord", "right_ord")


def single(t: DataFrame, condition: Column) -> DataFrame:
    """The one row that meets a condition; anything else is an error."""
    found = t.filter(condition)
    if (n := found.limit(2).count()) != 1:
        raise ValueError(f"{'no' if n == 0 else 'more than one'} row meets the condition")
    return found


def at_positions(t: DataFrame, positions: Iterable[int]) -> DataFrame:
    """Rows at positions, in the order given; ``t`` must be numbered densely."""
    spark = t.sparkSession
    want = spark.createDataFrame([(int(p), i) for i, p in enumerate(positions)], "_p long, _o long")
    return t.join(want, t["ord"] == want["_p"]).withColumn("ord", F.col("_o")).drop("_p", "_o")


def concat(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows one below the other; columns are united, missing ones null."""
    out = first.withColumn("_t", F.lit(0))
    for i, o in enumerate(others, 1):
        out = out.unionByName(o.withColumn("_t", F.lit(i)), allowMissingColumns=True)
    return numbered(out, "_t", "ord", to="_n").drop("ord", "_t").withColumnRenamed("_n", "ord")


def id_intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` whose identifier ``right`` has."""
    return left.join(right, left[id_name(left)].eqNullSafe(right[id_name(right)]), "left_semi")


def distinct_values(t: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values in order of first appearance."""
    return t.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min("ord").alias("ord"))


def all_equal(t: DataFrame, column: str) -> bool:
    """Whether all values of a column are one, nulls equal to nulls; so of an empty one."""
    return t.select(column).distinct().limit(2).count() < 2


def largest(t: DataFrame, column: str):
    """The largest value that isn't null, or None."""
    return t.agg(F.max(column)).first()[0]


def product_of(t: DataFrame, column: str) -> float:
    """The product of the values that aren't null; 1 of none."""
    return float(t.agg(F.coalesce(F.product(column), F.lit(1.0))).first()[0])
