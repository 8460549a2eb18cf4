"""Mixing sources to target weights.

Every document gets a hash-random key; within each source the documents are sorted by that
key in ranges, distributed prefix sums of their sizes follow, and the source is cut where its
budget ends.  Budgets above a source's size repeat whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmat.llm.common import WORD, bounded, bucket_bits, cut, exclusive_sums, hash_key


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Each source's number, size and target from ``sizes(source, source_size)``, one row per source.

    Sources take ``weights`` in turn, in the order of their names, null last.  The whole is shared
    by weight; a target stops at ``max_epochs`` times its source's size and what it can't take is
    reshared.  The level at which the rest share is the largest of the levels met while the
    sources that fill up first are taken out one after the other.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("source_no", (F.row_number().over(by_name) - 1).cast("int"))
    s = s.withColumn("weight", F.element_at(cycle, (F.col("source_no") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * max_epochs)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    s = s.withColumn("level", level)
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(everything) * F.col("weight")))
    return s.select("source", "source_no", "source_size", "target")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", whole: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_no, source_size, target, taken, copies, text_key.

    ``docs`` needs doc_id, source and text; other columns, whatever their names, are ignored.
    ``taken`` counts the words that the mix takes of the row.  Within the last epoch the document
    at the budget's end is taken in part, so each source's words meet its target exactly (rounded
    down); with ``whole`` it is taken as a whole if at least half of it is inside.

    Null or empty text: size 0, taken 0, and ``copies`` as if it had its place in the order.  Null
    source: a source of its own, last.  The key is hashed from doc_id and text, so rows without doc_id spread too.
    Very long texts: counted whole.  Ties of the key follow doc_id, size and text.  Repeated rows: each has its own place.  Empty table: empty result.
    """
    slim = cut(
        docs.select(
            F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"),
            F.md5(F.coalesce("text", F.lit(""))).alias("text_key"),
        ).withColumn("key", hash_key("doc_id", "text_key", F.lit(seed)))
    )
    rows = slim.count()
    per_source = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    per_source = cut(per_source)
    s = bounded(per_source.withColumnRenamed("source", "_source"))
    placed = slim.join(s, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = exclusive_sums(placed, "source_no", "key", ["doc_id", "size", "text_key"], {"size": "before"}, bucket_bits(rows))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1))).cast("long")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    inside = F.greatest(F.lit(0), F.least(rest - F.col("before"), F.col("size"))).cast("long")
    if whole:
        inside = F.when(inside * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0)).cast("long")
    again = F.when((F.col("before") < rest) & (inside >= F.col("size")), 1).otherwise(0)
    return placed.select(
        "doc_id", "size", "source", "source_no", "source_size", "target",
        (epochs * F.col("size") + inside).cast("long").alias("taken"),
        (epochs + again).cast("int").alias("copies"), "text_key",
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` repeated as often as the mix, in whole documents, takes them.

    Rows without words (null, empty or blank texts) are kept once, since they cost nothing and no budget speaks of them.  Repeated rows are taken
    together as often as the mix takes them in all: one of each is gathered in parts, so that many copies don't meet in one task, and
    their number dealt among those that differ in other columns.  Null doc_id or source: as any other.  Ties and very long texts as in :func:`mix`.
    Empty table: empty result.
    """
    taken = mix(docs, whole=True, **options)
    digest = lambda parts: F.unhex(F.md5(F.concat_ws("|", *parts)))
    same_row = lambda text_key: digest([*[F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in ("doc_id", "source")], text_key])
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    plan = taken.select(same_row(F.col("text_key")).alias("_row"), copies.cast("long").alias("_copies"))
    plan = cut(plan.groupBy("_row").agg(F.sum("_copies").alias("_copies"), F.count(F.lit(1)).alias("_same")))
    rest = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    keyed = docs.select(same_row(F.md5(F.coalesce("text", F.lit("")))).alias("_row"), digest([F.lit("x"), F.to_json(F.struct(*rest))] if rest else [F.lit("x")]).alias("_other"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    repeated = lambda t, times: t.select("doc", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select("doc.*")
    out = repeated(keyed.join(plan.filter("_copies > 0 and _same = 1").drop("_same"), "_row"), F.col("_copies"))
    alike = plan.filter("_copies > 0 and _same > 1")
    if alike.head(1):
        one = keyed.join(alike.select("_row"), "_row", "left_semi").dropDuplicates(["_row", "_other"]).join(alike, "_row")
        kinds = cut(one.select("_row", "_other"))
        number = kinds.select("_row", "_other", (F.row_number().over(Window.partitionBy("_row").orderBy("_other")) - 1).alias("_n")).join(kinds.groupBy("_row").agg(F.count(F.lit(1)).alias("_k")), "_row")
        one = one.join(number, ["_row", "_other"])
        out = out.union(repeated(one, F.floor(F.col("_copies") / F.col("_k")) + F.when(F.col("_n") < F.col("_copies") % F.col("_k"), 1).otherwise(0)))
    return out
