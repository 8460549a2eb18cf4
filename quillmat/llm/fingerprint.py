"""Document fingerprints by threshold-scaled sketches, in DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash space.  So sketches of a
phrase and of a book are cut at the same height: unions are merges, and overlaps of the kept
hashes estimate resemblance and containment between texts of very unequal lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmat.llm.common import bounded, cut

#: The hash space: 32 bits, so that of two texts of n shingles about n / 2^32 of the kept ones agree by accident.
BITS = 32
LOWEST, HIGHEST = -(1 << BITS - 1), (1 << BITS - 1) - 1


#: The fraction of the hash space that is kept is one of this many.
FRACTION = 4


def with_sketch(df: DataFrame, text: str, to: str, *, shingle: int = 5, fraction: int = FRACTION) -> DataFrame:
    """Add the struct ``to``: ``hashes`` (sorted, all below the fraction), ``total``, the number of distinct shingles, and ``digest``, which
    tells sets of which no hash is kept apart (null if one is kept).

    Words are the runs between ASCII white space, lower-cased; a text of fewer than ``shingle`` words is one shingle, a blank or null one has none.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w)))
    w = F.col("_w")
    narrow = lambda h: F.shiftright(h, 64 - BITS).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: narrow(F.xxhash64(*[F.get(w, i + j) for j in range(shingle)])))
    every = F.when(F.size(w) >= shingle, runs).when(F.size(w) > 0, F.array(narrow(F.xxhash64(w)))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_h", F.array_distinct(every))
    kept = F.sort_array(F.filter("_h", lambda h: h < LOWEST + (1 << BITS) // fraction))
    df = df.withColumn("_k", kept)
    digest = F.when(F.size("_k") == 0, F.xxhash64(F.sort_array("_h")))
    return df.withColumn(to, F.struct(F.col("_k").alias("hashes"), F.size("_h").alias("total"), digest.alias("digest"))).drop("_w", "_h", "_k")


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of two sketches of one fraction, 0 to 1.

    Where neither keeps a hash, it is 1 if their digests say that the sets are equal, else 0.
    """
    both, of = F.size(F.array_intersect(a["hashes"], b["hashes"])), F.size(a["hashes"]) + F.size(b["hashes"])
    return F.when(of > 0, both / F.greatest(of - both, F.lit(1))).otherwise(F.coalesce((a["total"] == b["total"]) & (a["digest"] == b["digest"]), F.lit(False)).cast("double"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has.  Of an a without hashes it is 1 if a has no shingles or both are equal, else unknown (null)."""
    both, of = F.size(F.array_intersect(a["hashes"], b["hashes"])), F.size(a["hashes"])
    same = (a["total"] == 0) | F.coalesce((a["total"] == b["total"]) & (a["digest"] == b["digest"]), F.lit(False))
    return F.when(of > 0, both / F.greatest(of, F.lit(1))).when(same, F.lit(1.0))


def merge(a: Column, b: Column, fraction: int = FRACTION) -> Column:
    """The sketch of both texts' shingles together; its ``total`` is an estimate, and without kept hashes its ``digest`` is known (not null) only of equal sets."""
    kept = F.sort_array(F.array_union(a["hashes"], b["hashes"]))
    return F.struct(kept.alias("hashes"), F.greatest(F.size(kept) * fraction, a["total"], b["total"]).cast("int").alias("total"), F.when(a["digest"] == b["digest"], a["digest"]).alias("digest"))


def text_form(sketch: Column) -> Column:
    """``total:`` and the kept hashes in hexadecimal, or ``total:=`` and the digest."""
    kept = F.array_join(F.transform(sketch["hashes"], lambda h: F.hex(h.cast("long") - LOWEST)), ",")
    return F.concat_ws(":", sketch["total"].cast("string"), F.when(F.size(sketch["hashes"]) > 0, kept).otherwise(F.concat(F.lit("="), F.coalesce(F.hex(sketch["digest"]), F.lit("")))))


def _order(ids: DataFrame, bucket_chars: int) -> tuple[DataFrame, int]:
    """(key, doc_id, copies, bucket, head) of every distinct document in ``ids(key, doc_id, n)``, and the number of buckets.

    The order is that of doc_id, then key.  It comes from a range sort of these narrow rows; ranks are positions in a partition plus the partitions'
    offsets.  Buckets hold equal numbers of documents, about ``bucket_chars`` characters; ``head`` marks the first one of each.
    """
    rows = ids.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    rows = cut(rows.orderBy(F.col("doc_id").asc_nulls_first(), "key").select("key", "doc_id", "n", "copies", F.monotonically_increasing_id().alias("at")))
    count, chars = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    per = max(1, -(-count // max(1, (chars or 0) // bucket_chars)))
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    offsets = sizes.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    # the offsets are as many rows as the sort had partitions
    ranked = rows.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + within)
    return ranked.select("key", "doc_id", "copies", F.floor(F.col("rank") / per).cast("long").alias("bucket"), (F.col("rank") % per == 0).alias("head")), -(-count // per)


def edited_fingerprints(docs: DataFrame, *, bucket_chars: int = 16_000_000, most_literals: int = 2_000, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_chars, edited_sha256, sketch,
    edited_sketch, near_edited, near_next.

    The edited text is the text with its last half (rounded down, in code points) replaced by as many from the start of
    the next document, or by all of it.  Null text: empty.  Null doc_ids come first in the order; equal doc_ids are
    ordered by a digest; rows with equal doc_id and text count as one document of the order, and each gets its row.
    A lone document follows itself.  Very long texts: sketched whole.  Ties need no further rule.  Empty table: empty result.

    Texts are dealt into buckets of neighbours of about ``bucket_chars`` characters; each finds its successor there by a window, and the last
    one in the next bucket's first document.  Where up to ``most_literals`` buckets do, their first doc_ids and keys stand in the plan, and texts move once; of more buckets
    each text learns its own by a join on its key, and moves twice.  Of rows alike one is gathered in parts before.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("key", F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5("text")))))
    order, buckets = _order(own.select("key", "doc_id", F.char_length("text").cast("long").alias("n")), bucket_chars)
    again = order.filter("copies > 1")
    one = own.withColumn("copies", F.lit(1).cast("long"))
    if again.head(1):
        again = bounded(again.select(F.col("key").alias("_key"), F.col("copies").alias("_copies")))
        alike = own.join(again, own["key"] == again["_key"], "left_semi").dropDuplicates(["key"]).join(again, F.col("key") == F.col("_key"))
        one = one.join(again, one["key"] == again["_key"], "left_anti").union(alike.select("doc_id", "text", "key", F.col("_copies").alias("copies")))
    heads = order.filter("head").select("key", "doc_id", "bucket")
    if buckets <= 1:
        dealt = one.withColumn("bucket", F.lit(0).cast("long")).repartition("bucket")
    elif buckets <= most_literals:
        starts = [(r["doc_id"], bytes(r["key"])) for r in heads.orderBy("bucket").collect()]
        starts = F.array(*[F.struct(F.lit(d).cast("long").alias("doc_id"), F.lit(k).alias("key")) for d, k in starts[1:]])
        dealt = one.withColumn("bucket", F.size(F.filter(starts, lambda s: s <= F.struct("doc_id", "key"))).cast("long")).repartition("bucket")
    else:
        dealt = one.join(order.select("key", "bucket"), "key").repartition("bucket")
    dealt = with_sketch(dealt.withColumn("n", F.char_length("text")), "text", "sketch", **options)
    after = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "key")
    dealt = dealt.withColumns({"next_text": F.lead("text").over(after), "next_sketch": F.lead("sketch").over(after)})
    # the first document of each bucket follows the last one of the bucket before
    first = heads.select("key", F.pmod(F.col("bucket") - 1, F.lit(max(1, buckets))).alias("before"))
    first = own.join(bounded(first), "key").dropDuplicates(["key"])
    first = with_sketch(first, "text", "_first_sketch", **options).select("before", F.col("text").alias("_first_text"), "_first_sketch")
    met = dealt.join(first, (F.col("bucket") == F.col("before")) & F.col("next_text").isNull(), "left")
    met = met.withColumns({"next_text": F.coalesce("next_text", "_first_text"), "next_sketch": F.coalesce("next_sketch", "_first_sketch")})
    half = F.floor(F.col("n") / 2).cast("int")
    met = met.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - half), F.substring("next_text", F.lit(1), half)))
    met = with_sketch(met, "edited", "edited_sketch", **options)
    out = met.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), "sketch", "edited_sketch",
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"),
    )
    return out.drop("_copy")
