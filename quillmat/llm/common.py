"""Helpers that several operators share: stable tables, hash keys, guarded broadcasts, prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word contract as a Java / RE2 class, and the words between.
WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 48


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session that names none (tests, notebooks) gets a temporary one; on a cluster that is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.getCheckpointDir() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillmat-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint; for narrow tables."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again; for wide tables."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quillmat_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` that nothing will read again."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df._quillmat_path)
    path.getFileSystem(conf).delete(path, True)


def hash_key(*parts: Column | str) -> Column:
    """A uniform integer of 48 bits from the parts' text (null: the word null), equal in any engine with md5."""
    text = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def digest() -> Column:
    """Sixteen bytes that only rows of equal text share; null for a null text."""
    return F.unhex(F.md5(F.col("text").cast("string").cast("binary")))


def same_row(docs: DataFrame, keys: DataFrame) -> Column:
    """Whether a row of ``docs`` has the doc_id (null included) and text of a row of ``keys(_id, _digest)``."""
    text = docs["text"].cast("string").cast("binary")
    return docs["doc_id"].cast("long").eqNullSafe(keys["_id"]) & (F.unhex(F.md5(text)) == keys["_digest"])


def bounded(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if a count proves it small, else as it is, so that Spark shuffles it."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def bucket_bits(rows: int, per_bucket: int = 1 << 16, least: int = 6) -> int:
    """Bits of a hash key so that a group of ``rows`` rows falls into buckets of about ``per_bucket``."""
    return max(least, (max(rows, 1) // per_bucket).bit_length())


def exclusive_sums(rows: DataFrame, group: str, key: str, ties: list[str], values: dict[str, str], bits: int) -> DataFrame:
    """Add ``values[v]``: the sum of ``v`` over the rows of the same group with a smaller (key, ties).

    The uniform key is cut into ranges, so a group that holds most rows is sorted by many tasks:
    one pass sums each range, a running sum over the ranges gives their offsets, and a window
    inside each range does the rest.  ``group`` must not be null.
    """
    rows = rows.withColumn("_range", F.shiftright(key, KEY_BITS - bits))
    each = rows.groupBy(group, "_range").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select(group, "_range", *[F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_at_{v}") for v in values])
    inside = Window.partitionBy(group, "_range").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{v}") for v in values])
    out = out.join(offsets, [group, "_range"])
    return out.withColumns({to: F.col(f"_in_{v}") + F.col(f"_at_{v}") for v, to in values.items()}).drop("_range", *[f"{p}{v}" for v in values for p in ("_in_", "_at_")])
