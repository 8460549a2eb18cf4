"""Dense row numbers without a single-task window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _offsets(at: DataFrame) -> DataFrame:
    """(_part, _offset): how many rows lie in earlier partitions; as many rows as partitions, so safely broadcast."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = at.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    return parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))


def _with_offsets(at: DataFrame, to: str) -> DataFrame:
    out = at.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(_offsets(at)), "_part")
    return out.withColumn(to, (F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_part", "_at", "_offset")


def positioned(df: DataFrame, to: str = "ord") -> DataFrame:
    """``df`` as read from files, with ``to`` = 0, 1, ... in the order of the files' paths, then of their rows.

    Spark deals out pieces of files as it likes, large ones first, but reads each piece in order; so pieces are counted, ordered by path and place in
    the file (as many rows as pieces, so safely broadcast), and added up.
    """
    columns = df.columns
    at = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")).withColumn("_at", F.monotonically_increasing_id())
    pieces = at.groupBy("_path", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_least"))
    before = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_path", "_start", "_least", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    out = at.join(F.broadcast(pieces), ["_path", "_start"])
    return out.select(*columns, (F.col("_offset") + F.col("_at") - F.col("_least")).cast("long").alias(to))


def numbered(df: DataFrame, *by: Column | str, to: str = "ord") -> DataFrame:
    """``df`` with ``to`` = 0, 1, ... in the order of ``by`` (which should leave no ties).

    A range sort orders the rows, a position inside each partition and the partitions' offsets (as many rows as
    partitions, so safely broadcast) make the numbers.  The sorted rows are cached in Spark's storage, since a range
    sort that ran twice could cut its ranges elsewhere.
    """
    at = df.orderBy(*by).withColumn("_at", F.monotonically_increasing_id()).persist()
    return _with_offsets(at, to)


def settled(df: DataFrame) -> DataFrame:
    """A narrow table worked out now, once, by a reliable checkpoint below spark.checkpoint.dir, so that all its readers see the same rows."""
    _shared(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As ``settled``, as Parquet, which is smaller; for large tables that are read several times.  It stays below spark.checkpoint.dir."""
    path = f"{_shared(df).rstrip('/')}/cells-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shared(df: DataFrame) -> str:
    """The folder of checkpoints."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir() and not context.getConf().get("spark.checkpoint.dir", None):
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillmat-"))
    return context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
