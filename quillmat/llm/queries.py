"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmat.llm import chat, decontaminate, fingerprint, infill, language, mixing, mixmodel, neardup, packing, quality, sharding, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crawl_log(pages: DataFrame) -> DataFrame:
    """Captures of every page, as a crawler would log them.

    A page is fetched in full at minute page_id.  It is visited again some hours or days later, when its server says
    not modified; one in sixteen of those visits lies a day before the fetch.  Most name the page's entity
    tag, some (by a digest of the URL) its date only, an outdated tag, or nothing.
    """
    digest, url_md5 = F.md5(F.coalesce("html", F.lit(""))), F.md5(F.coalesce("url", F.lit("")))
    kind, wait = F.substring(url_md5, 1, 1), F.conv(F.substring(url_md5, 2, 4), 16, 10).cast("long")
    p = pages.select("page_id", "url", (F.col("page_id") * 60).alias("at"), digest.alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string").alias("length"), kind.alias("kind"), wait.alias("wait"))
    date = F.concat(F.lit("day "), F.floor(F.col("at") / 86_400).cast("string"))
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    full = F.array(pair("cache-control", F.lit("max-age=60")), pair("content-length", F.col("length")), pair("content-type", F.lit("text/html")), pair("etag", F.concat(F.lit('"'), "digest", F.lit('"'))), pair("last-modified", date))
    tag = (
        F.when(F.col("kind") == "0", F.lit(None).cast("string")).when(F.col("kind") == "1", F.lit('"outdated"')).when(F.col("kind") == "2", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit('W/"'), "digest", F.lit('"')))
    )
    seen = F.array(pair("cache-control", F.lit("max-age=3600")), pair("content-length", F.lit("0")), pair("date", F.concat(F.lit("second "), F.col("seen_at").cast("string"))), pair("etag", tag), pair("last-modified", F.when(F.col("kind") != "2", date)))
    as_map = lambda entries: F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    p = p.withColumn("seen_at", F.col("at") + F.when(F.col("kind") == "3", F.lit(-86_400)).otherwise(3_600 + F.col("wait") * 40))
    return p.select("page_id", "url", F.explode(F.array(
        F.struct((F.col("page_id") * 2).alias("record_id"), F.col("at").alias("ts"), F.lit(200).alias("status"), as_map(full).alias("headers")),
        F.struct((F.col("page_id") * 2 + 1).alias("record_id"), F.col("seen_at").alias("ts"), F.lit(304).alias("status"), as_map(seen).alias("headers")),
    )).alias("r")).select("page_id", "url", "r.*")


def op1_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(crawl_log(table(spark, sf_dir, "pages")))
    page = lambda c: F.floor(F.col(c) / 2).cast("long")
    return found.select(page("record_id").alias("page_id"), "url_key", "ts", "outcome", page("source_id").alias("source_page_id"), warc.headers_text(F.col("headers")).alias("headers"))


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, url, page_id * 60 AS fetched, md5(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS VARCHAR) AS length,
         substr(md5(coalesce(url, '')), 1, 1) AS kind, CAST('0x' || substr(md5(coalesce(url, '')), 2, 4) AS BIGINT) AS wait,
         'day ' || CAST(page_id * 60 // 86400 AS VARCHAR) AS date,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages),
u AS (
  SELECT *, fetched + CASE WHEN kind = '3' THEN -86400 ELSE 3600 + wait * 40 END AS seen_at,
         regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^[^@]*@', ''), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/index\.(html?|php)$', '/'), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|fbclid|gclid|ref|sessionid|sid|phpsessid)(=|$)'))) AS params
  FROM p),
c AS (
  SELECT *, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key,
         CASE kind WHEN '0' THEN NULL WHEN '1' THEN '"outdated"' WHEN '2' THEN NULL ELSE 'W/"' || digest || '"' END AS tag,
         CASE WHEN kind <> '2' THEN date END AS said_date
  FROM u),
j AS (
  SELECT r.page_id, r.url_key, r.seen_at AS ts, r.tag, r.said_date, f.page_id AS source, f.fetched AS source_at, f.digest AS source_digest, f.length AS source_length, f.date AS source_date,
         row_number() OVER (PARTITION BY r.page_id ORDER BY f.fetched DESC NULLS LAST, f.page_id DESC) AS n
  FROM c r LEFT JOIN c f ON r.url_key = f.url_key AND f.fetched < r.seen_at),
o AS (
  SELECT *, CASE WHEN source IS NULL THEN 'orphan' WHEN tag IS NOT NULL THEN CASE WHEN regexp_replace(tag, '^W/', '') = '"' || source_digest || '"' THEN 'resolved' ELSE 'changed' END
                 WHEN said_date IS NOT NULL THEN CASE WHEN said_date = source_date THEN 'resolved' ELSE 'changed' END ELSE 'changed' END AS outcome
  FROM j WHERE n = 1)
SELECT page_id, url_key, ts, outcome, source AS source_page_id,
       'cache-control: max-age=3600' || chr(10) || 'content-length: ' || CASE WHEN outcome = 'resolved' THEN source_length ELSE '0' END ||
       CASE WHEN outcome = 'resolved' THEN chr(10) || 'content-type: text/html' ELSE '' END || chr(10) || 'date: second ' || CAST(ts AS VARCHAR) ||
       coalesce(chr(10) || 'etag: ' || CASE WHEN outcome = 'resolved' THEN coalesce(tag, '"' || source_digest || '"') ELSE tag END, '') ||
       coalesce(chr(10) || 'last-modified: ' || CASE WHEN outcome = 'resolved' THEN coalesce(said_date, source_date) ELSE said_date END, '') AS headers
FROM o
"""


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
l AS (
  SELECT *, source_size * 3 AS cap,
         (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER before, 0)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
  FROM s WINDOW before AS (ORDER BY source_size * 3 / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target FROM l),
b AS (
  SELECT source, source_size, target, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
r AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), 'null'), text_key, 'mix')), 1, 12), doc_id, d.size, text_key
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(rest - before, size)) AS BIGINT) AS taken FROM r
"""


def op4_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op5_scaled_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))
    printed = lambda c: fingerprint.text_form(F.col(c))
    return found.select("doc_id", "n_chars", "edited_sha256", printed("sketch").alias("fingerprint"), printed("edited_sketch").alias("edited_fingerprint"), "near_edited", "near_next")


def op6_chosen_path_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
                                    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 80 * (na + nb - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY 1) c ON c.a = s.doc_id
"""


def op7_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def _sql_descend(tree: sharding.Tree, path: str = "") -> str:
    """``sharding.descend`` as SQL over a column ``doc_id``."""
    children = [(f"{path}/{k}", k, v) for k, v in tree.items() if sharding.weight(v) > 0]
    inner = [_sql_descend(v, p) if isinstance(v, dict) else str(int(k)) for p, k, v in children]
    if len(children) == 1:
        return inner[0]
    draw = [f"-ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|{p}'), 1, 12) AS BIGINT) + 1) / 281474976710656.0) / {sharding.weight(v)}" for p, _, v in children]
    return f"CASE list_position([{', '.join(draw)}], least({', '.join(draw)})) " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(inner, 1)) + " END"


# crc32 by its table of remainders, a byte after the other
OP8_SQL = f"""
WITH t AS (SELECT list(list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS remainders FROM range(256) r(k)),
d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS bytes FROM documents),
c AS (
  SELECT d.*, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(bytes), 2), lambda i: CAST('0x' || substr(bytes, i, 2) AS BIGINT))),
         lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1]))) AS text_crc32 FROM d, t),
s AS (SELECT *, {_sql_descend(sharding.topology(8))} AS shard, {_sql_descend(sharding.topology(9))} AS grown_shard,
             substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), 'null'), CAST(text_crc32 AS VARCHAR), 'slot')), 1, 12) AS place FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard FROM s
"""


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixmodel.score_texts(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(turns.unionByName(extra)))


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, * FROM (VALUES (0, 'user', '\### Assistant: </turn> ok'), (1, 'assistant', '\### Assistant: </turn> ok'))),
e AS (SELECT *, length(role) + len(regexp_extract_all(role, '\\|</?turn>|### |<\|[a-z_]+\|>')) + length(text) + len(regexp_extract_all(text, '\\|</?turn>|### |<\|[a-z_]+\|>')) AS escaped FROM c),
l AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
       sha256(string_agg(loss, '' ORDER BY turn)) AS loss_sha256, CAST(sum(escaped + length('<turn>### : </turn>') + 1) AS BIGINT) AS formatted_chars
FROM l GROUP BY 1
"""


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = found.select("vec_id", "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("pos", "whitened"))
    return each.select("vec_id", (F.col("pos") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("pos")).alias("explained"), "identity_error")


def op12_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
r AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS made, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS kind FROM d),
f AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR made >= 90 THEN 'plain' WHEN kind < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(units[greatest(a, b) + 1:], '') AS suffix FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
"""

QUERIES = {
    "op1_bm25_decontamination": op1_bm25_decontamination,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_source_mixing": op3_source_mixing,
    "op4_crf_language": op4_crf_language,
    "op5_scaled_fingerprints": op5_scaled_fingerprints,
    "op6_chosen_path_near_dups": op6_chosen_path_near_dups,
    "op7_boosted_quality": op7_boosted_quality,
    "op8_hash_tree_shards": op8_hash_tree_shards,
    "op9_context_mixing": op9_context_mixing,
    "op10_chat_format": op10_chat_format,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_differencing_packing": op12_differencing_packing,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL = {"op2_warc_revisits": OP2_SQL, "op3_source_mixing": OP3_SQL, "op6_chosen_path_near_dups": OP6_SQL, "op8_hash_tree_shards": OP8_SQL, "op10_chat_format": OP10_SQL, "op13_fill_in_middle": OP13_SQL}
