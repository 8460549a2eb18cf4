"""Resolving not-modified revisits in a crawl.

A revisit (status 304) has headers but no body.  It stands for the latest earlier full response
of the same canonical URL, if that response's validators agree with the revisit's; the resolved
record takes the stored headers, updated by those that a 304 is permitted to change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Header fields that a not-modified answer may not change in what is stored
# (they describe the stored body or one connection only), and query parameters that track visits.
NOT_UPDATED = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|ref|sessionid|sid|phpsessid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Key of a URL: no scheme, user, leading ``www.``, default port, fragment, tracking parameters,
    index page or closing slashes; host in lower case; parameters sorted.  Null stays null."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/index\.(html?|php)$", "/"), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def as_of(rows: DataFrame, key: str, time: str, is_source: Column, source: Column, buckets: tuple[int, int]) -> DataFrame:
    """Add ``found``: the largest ``source`` struct (its first field the time) of an earlier source row with the same key.

    Time is cut into long buckets and these into short ones.  Sources are first reduced to the last one of each (key, short bucket); running maxima
    carry it over the short buckets of a long one and over the long ones, and a window inside each short bucket does
    the rest, so a key that holds most rows is spread however dense its captures are.  Rows with a null key or time find nothing and take no part.
    """
    usable = F.col(key).isNotNull() & F.col(time).isNotNull()
    kind = rows.select(source.alias("s")).schema["s"].dataType
    lost = rows.filter(~usable).withColumn("found", F.lit(None).cast(kind))
    rows = rows.filter(usable).withColumns({"_source": F.when(is_source, source), "_long": F.floor(F.col(time) / buckets[0]), "_short": F.floor(F.col(time) / buckets[1])})
    up_to_now = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy(key, "_long", "_short").agg(F.max("_source").alias("_last"))
    of_short = last.select(F.col(key).alias("_key"), F.col("_long").alias("_l"), F.col("_short").alias("_s"), F.max("_last").over(up_to_now(Window.partitionBy(key, "_long").orderBy("_short"))).alias("_near"))
    of_long = last.groupBy(key, "_long").agg(F.max("_last").alias("_last"))
    of_long = of_long.select(F.col(key).alias("_key"), F.col("_long").alias("_l"), F.max("_last").over(up_to_now(Window.partitionBy(key).orderBy("_long"))).alias("_far"))
    carried = of_short.join(of_long, ["_key", "_l"]).select("_key", "_l", "_s", F.coalesce("_near", "_far").alias("_carried"))
    inside = Window.partitionBy(key, "_long", "_short").orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.max("_source").over(inside))
    rows = rows.join(carried, (F.col(key) == F.col("_key")) & (F.col("_long") == F.col("_l")) & (F.col("_short") == F.col("_s")), "left")
    found = rows.withColumn("found", F.coalesce("_inside", "_carried")).drop("_source", "_long", "_short", "_inside", "_carried", "_key", "_l", "_s")
    return found.unionByName(lost)


def _same(stored: Column, said: Column, name: str) -> tuple[Column, Column]:
    """Whether both have the validator, and whether it is equal; entity tags compare weakly."""
    a, b = stored[name], said[name]
    if name == "etag":
        a, b = F.regexp_replace(a, "^W/", ""), F.regexp_replace(b, "^W/", "")
    return a.isNotNull() & b.isNotNull(), a == b


def resolve_revisits(captures: DataFrame, *, buckets: tuple[int, int] = (21_600, 60)) -> DataFrame:
    """One row per revisit in ``captures``: record_id, url_key, ts, outcome, source_id, headers.

    ``captures`` has record_id long, url string, ts long (seconds), status int, headers
    map<string, string> with names in lower case; other columns are ignored, and bodies never move: fetch
    them by ``source_id``.  Status 200 is a full response, 304 a revisit, others are ignored.

    outcome: ``resolved``, ``orphan`` (no earlier full response of the key; null source_id and the revisit's
    own headers) or ``changed`` (a validator that both have disagrees, the entity tag before
    the date, or they have none in common; the source is named, but headers are the revisit's own).
    Equal times are not earlier; of responses with one time the largest record_id counts.  Rows with a null
    url, ts or both are orphans.  Null headers: none; fields without a value are dropped.  Null, empty and very long bodies are never read.
    Repeated revisits resolve each.  Empty table: empty result.
    """
    said = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    rows = captures.filter(F.col("status").isin(200, 304)).select("record_id", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), "status", said.alias("headers"))
    validators = ("etag", "last-modified")
    rows = rows.select("*", *[F.col("headers")[n].alias(n) for n in validators])
    # headers travel with their response through the as-of join, as text since maps have no order
    source = F.struct("ts", F.col("record_id").alias("id"), *validators, F.to_json("headers").alias("headers"))
    found = as_of(rows, "url_key", "ts", F.col("status") == 200, source, buckets).filter("status = 304")
    stored, own = F.col("found"), F.struct(*validators)
    both_tag, equal_tag = _same(stored, own, "etag")
    both_date, equal_date = _same(stored, own, "last-modified")
    agree = F.when(both_tag, equal_tag).when(both_date, equal_date).otherwise(False)
    outcome = F.when(stored.isNull(), "orphan").when(agree, "resolved").otherwise("changed")
    permitted = F.map_filter("headers", lambda k, v: ~k.isin(*NOT_UPDATED))
    kept = F.map_filter(F.from_json(stored["headers"], "map<string,string>"), lambda k, v: ~F.map_contains_key(permitted, k))
    merged = F.when(outcome == "resolved", F.map_concat(kept, permitted)).otherwise(F.col("headers"))
    return found.select("record_id", "url_key", "ts", outcome.alias("outcome"), stored["id"].alias("source_id"), merged.alias("headers"))


def headers_text(headers: Column) -> Column:
    """The header fields as lines, sorted by name."""
    lines = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(lines, "\n")
