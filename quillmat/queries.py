"""Registered queries: every operator on matrices derived from the star-schema tables, with the SQL that must agree.

``PS`` is parts x suppliers with summed quantities, ``EV`` event types x users with counts, ``EMB`` the embeddings'
64 dimensions x vectors.  Doubles are rounded to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmat.datamatrix import DataMatrix
from quillmat.operators import arithmetic, counts, design, filters, layouts, neighbors, reduce, stats, tables, tiles, transforms
from quillmat.order import numbered, written
from quillmat.plans import expressions, jobs
from quillmat.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.select(F.col("s_suppkey").alias("id"), "s_name", "s_acctbal", "n_name", "r_name", F.col("s_suppkey").alias("ord"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice", F.col("p_partkey").alias("ord"))


def ps(spark: SparkSession, d: str) -> DataMatrix:
    mat = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("var_id"), F.col("l_suppkey").alias("obs_id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("value"))
    return DataMatrix(mat, parts(spark, d), suppliers(spark, d))


def ev(spark: SparkSession, d: str) -> DataMatrix:
    e = table(spark, d, "events")
    mat = e.groupBy(F.col("event_type").alias("var_id"), F.col("user_id").alias("obs_id")).agg(F.count(F.lit(1)).alias("value"))
    var = numbered(e.select(F.col("event_type").alias("id")).distinct(), "id")
    obs = e.select(F.col("user_id").alias("id")).distinct().select("id", (F.col("id") % 3).alias("band"), F.col("id").alias("ord"))
    return DataMatrix(mat, var, obs)


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("obs_id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label")


def emb(spark: SparkSession, d: str) -> DataMatrix:
    p = points(spark, d)
    mat = p.select(F.posexplode("x").alias("var_id", "value"), "obs_id").select(F.col("var_id").cast("long").alias("var_id"), "obs_id", "value")
    var = spark.range(64).select("id", F.col("id").alias("ord"))
    return DataMatrix(mat, var, p.select(F.col("obs_id").alias("id"), "label", F.col("obs_id").alias("ord")))


def r6(c, name: str | None = None):
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), 6)
    out = F.when(out == 0, F.lit(0.0)).otherwise(out)
    return out.alias(name or c) if name or isinstance(c, str) else out


def fast_round(c: str, digits: int):
    """``round(c, digits)`` in double precision, as SQL rounds doubles: scaled, halves away from zero, and scaled back; no decimal number for each of many cells."""
    col = F.col(c).cast("double")
    scaled = col * F.lit(10.0**digits)
    near = F.rint(scaled)
    out = F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(near) / F.lit(10.0**digits)
    out = F.when(F.abs(scaled) == float("inf"), col).otherwise(out)
    return F.when(out == 0, F.lit(0.0)).otherwise(out).alias(c)


PS = """WITH mat AS (SELECT l_partkey AS var_id, l_suppkey AS obs_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2),
var AS (SELECT p_partkey AS id, p_name, p_brand, p_type, p_size, p_retailprice FROM part),
obs AS (SELECT s_suppkey AS id, s_name, s_acctbal, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
EV = """WITH mat AS (SELECT event_type AS var_id, user_id AS obs_id, count(*) AS value FROM events GROUP BY 1, 2),
var AS (SELECT DISTINCT event_type AS id FROM events), obs AS (SELECT DISTINCT user_id AS id, user_id % 3 AS band FROM events)"""
# embeddings by dimension
EMB = """WITH pt AS (SELECT vec_id AS id, label, embedding AS x FROM embeddings),
mat AS (SELECT d - 1 AS var_id, id AS obs_id, CAST(x[d] AS DOUBLE) AS value FROM pt, range(1, 65) t(d))"""
#: Squared distance of two rows of pt, in double precision.
D2 = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])))"


def Z(x: str) -> str:
    """Rounded, and without a negative zero."""
    return f"(round({x}, 6) + 0.0)"


# --- sources


def two_samples(spark: SparkSession, d: str) -> dict[str, DataMatrix]:
    out = {}
    for k, name in enumerate(("even", "odd")):
        half = filters.filter_obs(F.col("id") % 2 == k, ps(spark, d))
        used = half.mat.select("var_id").distinct()
        var = half.var.join(used, half.var["id"] == used["var_id"], "left_semi")
        if k:
            var = var.withColumn("p_brand", F.when(F.col("p_size") > 40, "other").otherwise(F.col("p_brand")))
        out[name] = half.with_var(var.select("id", "p_brand", "p_type", "ord"))
    return out


SAMPLES = PS + """, s0 AS (SELECT DISTINCT var_id FROM mat WHERE obs_id % 2 = 0), s1 AS (SELECT DISTINCT var_id FROM mat WHERE obs_id % 2 = 1)"""


@query("s2_merge_variables", SAMPLES + """, v AS (SELECT id, p_brand, p_type FROM var WHERE id IN (SELECT var_id FROM s0) UNION ALL
SELECT id, CASE WHEN p_size > 40 THEN 'other' ELSE p_brand END, p_type FROM var WHERE id IN (SELECT var_id FROM s1))
SELECT id, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) ELSE 'ambiguous' END AS p_brand, min(p_type) AS p_type FROM v GROUP BY id""")  # fmt: skip
def s2(spark, d):
    return readers.load_counts(two_samples(spark, d), keys=("id",)).var.drop("ord")


@query("s3_s4_concat_samples", PS + " SELECT CASE obs_id % 2 WHEN 0 THEN 'even_' ELSE 'odd_' END || CAST(obs_id AS VARCHAR) AS obs_id, sum(value) AS total, count(*) AS cells FROM mat GROUP BY 1")
def s3(spark, d):
    return readers.load_counts(two_samples(spark, d), keys=("id",)).mat.groupBy("obs_id").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("cells"))


@query("s5_concat_observations", PS + " SELECT s || '_' || b AS cell_id, s AS sample_name, b AS barcode, row_number() OVER (ORDER BY s, CAST(b AS BIGINT)) - 1 AS position FROM (SELECT CASE id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS s, CAST(id AS VARCHAR) AS b FROM obs)")
def s5(spark, d):
    return readers.load_counts(two_samples(spark, d), keys=("id",)).obs.withColumnRenamed("ord", "position")


@query("s9_create_table", "SELECT * FROM (VALUES ('id_1', 1), ('id_2', 4), ('id_3', 9)) t(id, x)")
def s9(spark, d):
    return tables.create_table(spark, id=["id_1", "id_2", "id_3"], x=[1, 4, 9]).select("id", F.col("x").cast("int"))


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share (local sessions without one: a temporary folder)."""
    import tempfile
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp()
    return f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def write_sample(data: DataMatrix, path: str, features: list) -> None:
    """Matrix Market files of a matrix of counts, each a folder of parts in the order of their names, which several tasks write."""
    var, obs = numbered(data.var, "ord", data.var_key, to="i"), numbered(data.obs, "ord", data.obs_key, to="j")
    cells = data.mat.join(var.select(F.col(data.var_key).alias("var_id"), "i"), "var_id").join(obs.select(F.col(data.obs_key).alias("obs_id"), "j"), "obs_id")
    size = var.agg(F.count(F.lit(1)).alias("p")).crossJoin(obs.agg(F.count(F.lit(1)).alias("n"))).crossJoin(cells.agg(F.count(F.lit(1)).alias("c")))
    head = size.sparkSession.createDataFrame([(-2, "%%MatrixMarket matrix coordinate integer general")], "j long, value string")
    lines = head.union(size.select(F.lit(-1).cast("long"), F.concat_ws(" ", "p", "n", "c"))).union(cells.select("j", F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, "value")))
    lines.orderBy("j", "value").select("value").write.text(f"{path}/matrix.mtx")
    var.orderBy("i").select(F.concat_ws("\t", *features)).write.text(f"{path}/features.tsv")
    obs.orderBy("j").select(F.col(data.obs_key).cast("string")).write.text(f"{path}/barcodes.tsv")


KIND = "CASE WHEN id % 4 = 0 THEN 'Antibody' ELSE 'Gene Expression' END"


def sample_files(spark: SparkSession, d: str) -> dict[str, str]:
    """Files of the even and the odd suppliers.  The odd sample calls every eighth part by the identifier of the one before it."""
    path, out = scratch(spark), {}
    for k, name in enumerate(("even", "odd")):
        half = filters.filter_obs(F.col("id") % 2 == k, ps(spark, d))
        same = F.when(F.lit(k == 1) & (F.col("id") % 8 == 0), F.col("id") - 1).otherwise(F.col("id"))
        write_sample(half, f"{path}/{name}", [same.cast("string"), F.col("p_name"), F.expr(KIND)])
        out[name] = f"{path}/{name}/matrix.mtx"
    return out


@query("s1_load_files", PS + f""", k AS (SELECT id, {KIND} AS kind FROM var) SELECT s || '_' || CAST(obs.id AS VARCHAR) AS cell_id, coalesce(sum(value) FILTER (kind = 'Gene Expression'), 0) AS genes
FROM (SELECT id, CASE id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS s FROM obs) obs LEFT JOIN mat ON obs_id = obs.id LEFT JOIN k ON k.id = var_id GROUP BY 1""")  # fmt: skip
def s1(spark, d):
    files = sample_files(spark, d)
    return counts.var_counts_sum(readers.load_files(spark, list(files.values()), sample_names=list(files)), "genes").obs.select("cell_id", "genes")


@query("s1_s2_matched_by_both_keys", PS + f""", k AS (SELECT obs_id % 2 AS s, CASE WHEN obs_id % 2 = 1 AND var_id % 8 = 0 THEN var_id - 1 ELSE var_id END AS id, CASE WHEN var_id % 4 = 0 THEN 'Antibody' ELSE 'Gene Expression' END AS kind, value FROM mat),
v AS (SELECT CAST(id AS VARCHAR) AS id, {KIND} AS kind FROM var UNION SELECT CAST(CASE WHEN id % 8 = 0 THEN id - 1 ELSE id END AS VARCHAR), {KIND} FROM var)
SELECT v.id, v.kind, CAST(coalesce(sum(value), 0) AS BIGINT) AS total FROM v LEFT JOIN k ON CAST(k.id AS VARCHAR) = v.id AND k.kind = v.kind GROUP BY 1, 2""")  # fmt: skip
def s1_keys(spark, d):
    files = sample_files(spark, d)
    data = readers.load_files(spark, list(files.values()), sample_names=list(files), prefilter=None)
    return counts.obs_counts_sum(data, "total").var.select("id", F.col("feature_type").alias("kind"), "total")


@query("s1b_load_matrix_market", PS + " SELECT CAST(var_id AS VARCHAR) AS var_id, 'one_' || CAST(obs_id AS VARCHAR) AS obs_id, value FROM mat")
def s1b(spark, d):
    path = scratch(spark)
    write_sample(ps(spark, d), path, [F.col("id").cast("string"), F.col("p_name"), F.lit("Gene Expression")])
    return readers.load_mtx(spark, f"{path}/matrix.mtx", f"{path}/features.tsv", f"{path}/barcodes.tsv", sample="one").mat


@query("s6_load_csv", "SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1 AS position FROM customer")
def s6(spark, d):
    path = scratch(spark)
    table(spark, d, "customer").select("c_custkey", "c_mktsegment").repartition(1).sortWithinPartitions("c_mktsegment", "c_custkey").write.csv(path, header=True)
    return readers.load_csv(spark, path, schema="c_custkey long, c_mktsegment string").withColumnRenamed("ord", "position")


@query("s12_save_and_load", PS + " SELECT count(*) AS cells, sum(value) AS total FROM mat")
def s12(spark, d):
    path = scratch(spark)
    readers.save(ps(spark, d), path)
    return readers.load(spark, path).mat.agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total"))


# --- columns


@query("p2_get_columns", "SELECT p_size, p_partkey AS id FROM part")
def p2(spark, d):
    return tables.get_columns(parts(spark, d), "p_size", "id").drop("ord")


@query("p3_id_column", "SELECT p_partkey AS id FROM part")
def p3(spark, d):
    return tables.id_column(parts(spark, d)).drop("ord")


@query("p4_annotation", "SELECT p_partkey AS id, p_brand FROM part")
def p4(spark, d):
    return tables.annotation(parts(spark, d), "p_brand").drop("ord")


@query("p6_shape", "SELECT (SELECT count(*) FROM part) AS n_var, (SELECT count(*) FROM supplier) AS n_obs")
def p6(spark, d):
    data = ps(spark, d)
    sizes = [tables.shape(t)[0] for t in (data.var, data.obs)]
    return spark.createDataFrame([tuple(sizes)], "n_var long, n_obs long")


@query("p16_stored_size", PS + " SELECT count(DISTINCT var_id) AS n_var, count(DISTINCT obs_id) AS n_obs FROM mat")
def p16(spark, d):
    return spark.createDataFrame([counts.stored_size(ps(spark, d).mat)], "n_var long, n_obs long")


@query("p7_add_column", "SELECT p_partkey AS id, p_size * 2 AS twice FROM part")
def p7(spark, d):
    return tables.add_column(parts(spark, d), "twice", F.col("p_size") * 2).select("id", "twice")


@query("p8_add_obs_column", "SELECT s_suppkey AS id, s_acctbal > 0 AS solvent FROM supplier")
def p8(spark, d):
    data = ps(spark, d)
    return data.with_obs(tables.add_column(data.obs, "solvent", F.col("s_acctbal") > 0)).obs.select("id", "solvent")


@query("p9_hcat", "SELECT p_partkey AS id, p_brand, p_size, p_type FROM part")
def p9(spark, d):
    p = parts(spark, d)
    return tables.hcat(p.select("id", "p_brand", "ord"), p.select("p_size", "p_type", "ord")).drop("ord")


@query("p10_transform_annotation", "SELECT s_suppkey AS id, s_acctbal > 5000 AS rich FROM supplier")
def p10(spark, d):
    return tables.transform_annotation(lambda c: c > 5000, tables.annotation(suppliers(spark, d), "s_acctbal"), new_name="rich").drop("ord")


@query("p11_combine_columns", "SELECT CAST(n_nationkey AS VARCHAR) || '/' || n_name AS combined FROM nation")
def p11(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_nationkey").alias("ord"))
    return tables.combine_columns(n, "combined", "/").drop("ord")


@query("p12_repeat_rows", "SELECT r_name, (o * 10 + r_regionkey * 2 + i) AS position FROM region, range(0, 3) a(o), range(0, 2) b(i)")
def p12(spark, d):
    r = table(spark, d, "region").select("r_name", F.col("r_regionkey").cast("long").alias("ord"))
    return tables.repeat_rows(r, inner=2, outer=3).withColumnRenamed("ord", "position")


@query("p14_prefixed_ids", "SELECT 'PC' || CAST(i AS VARCHAR) AS id FROM range(1, 11) t(i)")
def p14(spark, d):
    return tables.prefixed_ids(spark, "PC", 10).drop("ord")


@query("p15_matrix_row", PS + " SELECT id AS obs_id, coalesce(value, 0) AS value FROM obs LEFT JOIN mat ON obs.id = mat.obs_id AND var_id = 7")
def p15(spark, d):
    return filters.matrix_row(ps(spark, d), 7)


@query("p15_matrix_column", PS + " SELECT id AS var_id, coalesce(value, 0) AS value FROM var LEFT JOIN mat ON var.id = mat.var_id AND obs_id = 3")
def p15b(spark, d):
    return filters.matrix_column(ps(spark, d), 3)


# --- filters


def summary(data: DataMatrix) -> DataFrame:
    cells = data.mat.agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total"))
    return cells.crossJoin(data.var.agg(F.count(F.lit(1)).alias("n_var"))).crossJoin(data.obs.agg(F.count(F.lit(1)).alias("n_obs")))


def summary_sql(var: str = "true", obs: str = "true") -> str:
    return PS + f""", fv AS (SELECT id FROM var WHERE {var}), fo AS (SELECT id FROM obs WHERE {obs})
    SELECT (SELECT count(*) FROM mat WHERE var_id IN (SELECT id FROM fv) AND obs_id IN (SELECT id FROM fo)) AS cells,
    (SELECT sum(value) FROM mat WHERE var_id IN (SELECT id FROM fv) AND obs_id IN (SELECT id FROM fo)) AS total, (SELECT count(*) FROM fv) AS n_var, (SELECT count(*) FROM fo) AS n_obs"""


@query("f1_filter_var", summary_sql("p_size > 25"))
def f1(spark, d):
    return summary(filters.filter_var(("p_size", lambda c: c > 25), ps(spark, d)))


@query("f2_filter_obs", summary_sql("true", "r_name = 'ASIA'"))
def f2(spark, d):
    return summary(filters.filter_obs("r_name = 'ASIA'", ps(spark, d)))


@query("f3_filter_matrix", summary_sql("p_brand = 'Brand#11' OR p_size < 10", "s_acctbal >= 1000"))
def f3(spark, d):
    return summary(filters.filter_matrix((("p_brand", "p_size"), lambda b, s: (b == "Brand#11") | (s < 10)), F.col("s_acctbal") >= 1000, ps(spark, d)))


def id_list(spark: SparkSession, ids: list[int]) -> DataFrame:
    return spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id long, ord long")


@query("f4_subset_var", PS + ", w AS (SELECT * FROM (VALUES (30, 0), (5, 1), (17, 2), (100, 3)) t(id, position)) SELECT w.id, w.position, p_brand, coalesce(sum(value), 0) AS total FROM w JOIN var USING (id) LEFT JOIN mat ON var_id = w.id GROUP BY 1, 2, 3")
def f4(spark, d):
    data = counts.obs_counts_sum(filters.subset_var(ps(spark, d), id_list(spark, [30, 5, 17, 100])), "total")
    return data.var.select("id", F.col("ord").alias("position"), "p_brand", "total")


@query("f5_subset_obs", PS + ", w AS (SELECT * FROM (VALUES (9, 0), (2, 1), (4, 2)) t(id, position)) SELECT w.id, w.position, s_name, coalesce(sum(value), 0) AS total FROM w JOIN obs USING (id) LEFT JOIN mat ON obs_id = w.id GROUP BY 1, 2, 3")
def f5(spark, d):
    data = counts.var_counts_sum(filters.subset_obs(ps(spark, d), id_list(spark, [9, 2, 4])), "total")
    return data.obs.select("id", F.col("ord").alias("position"), "s_name", "total")


@query("f6_subset_matrix", PS + " SELECT var_id, obs_id, value FROM mat WHERE var_id IN (30, 5, 17, 100) AND obs_id IN (9, 2, 4)")
def f6(spark, d):
    return filters.subset_matrix(ps(spark, d), id_list(spark, [30, 5, 17, 100]), id_list(spark, [9, 2, 4])).mat


@query("f7_filter_range", summary_sql("id BETWEEN 10 AND 99 AND (id - 10) % 3 = 0"))
def f7(spark, d):
    return summary(filters.filter_var(range(10, 100, 3), ps(spark, d)))


@query("f8_annotation_not_missing", summary_sql("true", "id % 4 = 1"))
def f8(spark, d):
    data = ps(spark, d)
    known = data.obs.filter("id % 4 = 1").select("id", F.lit(1).alias("mark"), "ord")
    return summary(filters.filter_obs((known, lambda c: c.isNotNull()), data))


@query("f9_positions", "SELECT r_name, position FROM region JOIN (VALUES (4, 0), (0, 1), (2, 2)) t(k, position) ON r_regionkey = k")
def f9(spark, d):
    r = table(spark, d, "region").select("r_name", F.col("r_regionkey").cast("long").alias("ord"))
    return tables.at_positions(r, [4, 0, 2]).withColumnRenamed("ord", "position")


@query("f10_single_match", "SELECT r_regionkey, r_name FROM region WHERE r_name = 'EUROPE'")
def f10(spark, d):
    return tables.single(table(spark, d, "region"), F.col("r_name") == "EUROPE")


@query("f11_without_missing", "SELECT count(*) AS n_obs, sum(quality) AS good FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def f11(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    obs = tables.left_join(docs.select("doc_id", F.col("doc_id").alias("ord")), labels.select("doc_id", "quality", F.col("doc_id").alias("ord")))
    mat = docs.select(F.lit("chars").alias("var_id"), F.col("doc_id").alias("obs_id"), F.col("n_chars").alias("value"))
    data = DataMatrix(mat, tables.create_table(spark, id=["chars"]), obs, "id", "doc_id")
    return filters.without_missing(data, ["quality"]).obs.agg(F.count(F.lit(1)).alias("n_obs"), F.sum("quality").alias("good"))


# --- joins


@query("j1_left_join_first_match", "SELECT n_nationkey, n_name, s.s_suppkey FROM nation LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier WHERE s_acctbal > 0 GROUP BY 1) s ON n_nationkey = s_nationkey")
def j1(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_nationkey").alias("ord"))
    s = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", F.col("s_suppkey").alias("ord"))
    return tables.left_join(n, s).drop("ord")


@query("j2_annotate_obs", "SELECT s_suppkey AS id, s_name, n FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON s_suppkey = l_suppkey")
def j2(spark, d):
    n = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("n")).withColumn("ord", F.col("id"))
    data = ps(spark, d)
    return data.with_obs(tables.left_join(data.obs, n)).obs.select("id", "s_name", "n")


@query("j3_lookup_skip", "SELECT p_partkey AS id, p_brand, position FROM part JOIN (VALUES (3, 0), (-1, 1), (2, 2)) t(k, position) ON p_partkey = k")
def j3(spark, d):
    return tables.lookup(id_list(spark, [3, -1, 2]), parts(spark, d), missing="skip").select("id", "p_brand", F.col("ord").alias("position"))


@query("j4_lookup_or_missing", "SELECT k AS id, p_brand, position FROM (VALUES (3, 0), (-1, 1), (2, 2)) t(k, position) LEFT JOIN part ON p_partkey = k")
def j4(spark, d):
    return tables.lookup(id_list(spark, [3, -1, 2]), parts(spark, d), missing="nothing").select("id", "p_brand", F.col("ord").alias("position"))


@query("j5_match_columns", "SELECT a.p_partkey AS left_ord, b.p_partkey AS right_ord FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size")
def j5(spark, d):
    p = parts(spark, d)
    return tables.match_columns(p, p.select("*"), ["p_brand", "p_type", "p_size"])


@query("j8_sparse_product", PS + " SELECT a.obs_id AS i, b.obs_id AS j, CAST(sum(a.value * b.value) AS BIGINT) AS value FROM mat a JOIN mat b USING (var_id) GROUP BY 1, 2")
def j8(spark, d):
    m = written(ps(spark, d).mat)
    left = m.select(F.col("obs_id").alias("i"), F.col("var_id").alias("j"), "value")
    return expressions.multiply(left, m.select(F.col("var_id").alias("i"), F.col("obs_id").alias("j"), "value"))


@query("t8_blockify", PS + """, r AS (SELECT id AS var_id, row_number() OVER (ORDER BY id) - 1 AS i FROM var), c AS (SELECT id AS obs_id, row_number() OVER (ORDER BY id) - 1 AS j FROM obs),
t AS (SELECT i // 128 AS bi, j // 128 AS bj, count(*) AS n, sum(value) AS total, sum(value * (i % 128 * 128 + j % 128)) AS placed FROM mat JOIN r USING (var_id) JOIN c USING (obs_id) GROUP BY 1, 2)
SELECT CAST(bi AS INTEGER) AS bi, CAST(bj AS INTEGER) AS bj, n AS cells, CAST(total AS DOUBLE) AS total, CAST(placed AS DOUBLE) AS placed FROM t""")  # fmt: skip
def t8(spark, d):
    """Every tile: its stored cells, their sum, and the sum weighted by their places."""
    t = tiles.blockify(ps(spark, d)).table
    places = F.coalesce("places", F.sequence(F.lit(0), F.lit(tiles.EDGE**2 - 1)))
    cells = t.select("bi", "bj", F.inline(F.arrays_zip(places.alias("p"), F.col("vals").alias("v"))))
    return cells.groupBy("bi", "bj").agg(F.count(F.when(F.col("v") != 0, 1)).alias("cells"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("p")).alias("placed"))


@query("t8_unblockify", PS + " SELECT var_id, obs_id, value FROM mat")
def t8_back(spark, d):
    return tiles.unblockify(tiles.blockify(ps(spark, d))).select("var_id", "obs_id", F.col("value").cast("long").alias("value"))


@query("m6_tile_product", ORACLE_SQL["j8_sparse_product"])
def m6_tiles(spark, d):
    """As j8, on tiles."""
    a = tiles.held(tiles.blockify(ps(spark, d)))
    out = tiles.unblockify(tiles.multiply(tiles.transposed(a), a), "i", "j")
    return out.select("i", "j", F.col("value").cast("long").alias("value"))


@query("m6_tile_chain", PS + """, g AS (SELECT a.obs_id AS i, b.obs_id AS j, sum(a.value * b.value) AS value FROM mat a JOIN mat b USING (var_id) GROUP BY 1, 2)
SELECT m.var_id AS i, g.j, CAST(sum(g.value * m.value) AS BIGINT) AS value FROM mat m JOIN g ON g.i = m.obs_id GROUP BY 1, 2""")  # fmt: skip
def m6_chain(spark, d):
    """As m4, on tiles: the narrow product first."""
    a = tiles.held(tiles.blockify(ps(spark, d)))
    out = tiles.unblockify(tiles.multiply(a, tiles.held(tiles.multiply(tiles.transposed(a), a))), "i", "j")
    return out.select("i", "j", F.col("value").cast("long").alias("value"))


# --- aggregates


@query("a1_var_counts_sum", PS + " SELECT id, coalesce(sum(value), 0) AS total, count(value) AS nonzero FROM obs LEFT JOIN mat ON id = obs_id AND var_id IN (SELECT id FROM var WHERE p_size > 10) GROUP BY id")
def a1(spark, d):
    data = counts.var_counts_sum(ps(spark, d), "total", "p_size > 10")
    return counts.var_counts_sum(data, "nonzero", "p_size > 10", lambda c: c != 0).obs.select("id", "total", "nonzero")


@query("a1_several_counts_at_once", PS + " SELECT o.id, coalesce(sum(value), 0) AS total, coalesce(sum(value * value) FILTER (p_size > 10), 0) AS squares, " + Z("coalesce(sum(value) FILTER (p_brand = 'Brand#11'), 0) / CAST(greatest(1, coalesce(sum(value), 0)) AS DOUBLE)") + " AS fraction FROM obs o LEFT JOIN mat ON o.id = obs_id LEFT JOIN var v ON v.id = var_id GROUP BY 1")
def a1_several(spark, d):
    data = counts.var_counts(ps(spark, d), {"total": (None, None), "squares": ("p_size > 10", lambda c: c * c)}, {"fraction": ("p_brand = 'Brand#11'", None)})
    return data.obs.select("id", "total", "squares", r6("fraction"))


@query("a2_var_counts_fraction", PS + " SELECT o.id, " + Z("coalesce(sum(CASE WHEN v.p_brand = 'Brand#11' THEN value END), 0) / CAST(greatest(1, coalesce(sum(value), 0)) AS DOUBLE)") + " AS fraction FROM obs o LEFT JOIN mat ON o.id = obs_id LEFT JOIN var v ON v.id = var_id GROUP BY o.id")
def a2(spark, d):
    return counts.var_counts_fraction(ps(spark, d), "fraction", "p_brand = 'Brand#11'").obs.select("id", r6("fraction"))


@query("a3_obs_counts_sum", PS + " SELECT id, coalesce(sum(value), 0) AS total FROM var LEFT JOIN mat ON id = var_id AND obs_id IN (SELECT id FROM obs WHERE r_name = 'EUROPE') GROUP BY id")
def a3(spark, d):
    return counts.obs_counts_sum(ps(spark, d), "total", "r_name = 'EUROPE'").var.select("id", "total")


@query("a4_obs_counts_fraction", PS + " SELECT v.id, " + Z("coalesce(sum(CASE WHEN o.r_name = 'ASIA' THEN value END), 0) / CAST(greatest(1, coalesce(sum(value), 0)) AS DOUBLE)") + " AS fraction FROM var v LEFT JOIN mat ON v.id = var_id LEFT JOIN obs o ON o.id = obs_id GROUP BY v.id")
def a4(spark, d):
    return counts.obs_counts_fraction(ps(spark, d), "fraction", "r_name = 'ASIA'").var.select("id", r6("fraction"))


@query("a5_counts_over_samples", PS + " SELECT CASE obs_id % 2 WHEN 0 THEN 'even_' ELSE 'odd_' END || CAST(obs_id AS VARCHAR) AS cell_id, sum(value) AS total FROM mat GROUP BY 1")
def a5(spark, d):
    return counts.var_counts_sum(readers.load_counts(two_samples(spark, d), keys=("id",)), "total").obs.filter("total > 0").select("cell_id", "total")


CENTRED_ROWS = PS + """, f AS (SELECT v.id AS var_id, coalesce(sum(value * s_acctbal), 0) / (SELECT sum(s_acctbal * s_acctbal) FROM obs) AS b, coalesce(sum(value), 0) AS s FROM var v LEFT JOIN mat ON v.id = var_id LEFT JOIN obs o ON o.id = obs_id GROUP BY 1)
SELECT var_id, round(s - b * (SELECT sum(s_acctbal) FROM obs), 3) + 0.0 AS total FROM f"""


@query("a6_column_sums", EV + " SELECT obs_id, CAST(sum(value * value) AS BIGINT) AS squares FROM mat GROUP BY 1")
def a6(spark, d):
    return counts.column_sums(ev(spark, d), lambda c: c * c).select("obs_id", F.col("total").alias("squares"))


@query("a6_row_sums", CENTRED_ROWS)
def a6_rows(spark, d):
    data = design.normalize(ps(spark, d), "s_acctbal", center=False)
    return counts.row_sums(data).select("var_id", F.round("total", 3).alias("total"))


@query("a7_sum_squared", PS + " SELECT id AS var_id, " + Z("CAST(coalesce(sum(value * value), 0) AS DOUBLE)") + " AS ss FROM var LEFT JOIN mat ON id = var_id GROUP BY id")
def a7(spark, d):
    return counts.sum_squared(ps(spark, d)).select("var_id", r6("ss"))


CENTRED = PS + """, n AS (SELECT count(*) AS n FROM obs), m AS (SELECT v.id, coalesce(sum(value), 0) / CAST(max(n.n) AS DOUBLE) AS mean, coalesce(sum(value * value), 0) AS sq, max(n.n) AS n FROM var v CROSS JOIN n LEFT JOIN mat ON v.id = var_id GROUP BY v.id),
vr AS (SELECT id, mean, greatest(0, sq - n * mean * mean) / (n - 1) AS variance FROM m)"""


@query("a8_variance", CENTRED + f" SELECT id, {Z('variance')} AS variance FROM vr")
def a8(spark, d):
    return counts.variance(reduce.centred(ps(spark, d)), assume_centered=True).var.select("id", r6("variance"))


@query("a9_std", CENTRED + f" SELECT id, {Z('sqrt(variance)')} AS std FROM vr")
def a9(spark, d):
    return counts.std(reduce.centred(ps(spark, d)), assume_centered=True).var.select("id", r6("std"))


@query("a10_relative_std", CENTRED + f" SELECT id, {Z('sqrt(variance) / max(sqrt(variance)) OVER ()')} AS relative_std FROM vr")
def a10(spark, d):
    return counts.relative_std(reduce.centred(ps(spark, d)), assume_centered=True).var.select("id", r6("relative_std"))


@query("a11_pseudobulk", PS + ", g AS (SELECT r_name, count(*) AS n FROM obs GROUP BY 1) SELECT var_id, g.r_name AS combo, " + Z("sum(value) / CAST(max(g.n) AS DOUBLE)") + " AS mean FROM mat JOIN obs ON obs.id = obs_id JOIN g USING (r_name) GROUP BY 1, 2")
def a11(spark, d):
    return counts.pseudobulk(ps(spark, d), "r_name").mat.select("var_id", F.col("obs_id").alias("combo"), r6("value", "mean"))


@query("a11_pseudobulk_columns", PS + """, c AS (SELECT r_name, min(id) AS o FROM obs GROUP BY 1), b AS (SELECT s_acctbal > 0 AS rich, min(id) AS o FROM obs GROUP BY 1)
SELECT c.r_name || '_' || CAST(b.rich AS VARCHAR) AS combo, row_number() OVER (ORDER BY c.o, b.o) - 1 AS position FROM c, b""")  # fmt: skip
def a11b(spark, d):
    data = ps(spark, d)
    data = data.with_obs(data.obs.withColumn("rich", F.col("s_acctbal") > 0))
    return counts.pseudobulk(data, "r_name", "rich").obs.select("combo", F.col("ord").alias("position"))


@query("a12_pseudobulk_new_var", PS + """, o AS (SELECT id, r_name, CASE WHEN s_acctbal > 0 THEN 'rich' ELSE 'poor' END AS w FROM obs), g AS (SELECT r_name, w, count(*) AS n FROM o GROUP BY 1, 2)
SELECT CAST(var_id AS VARCHAR) || '_' || o.w AS var_id, o.r_name AS combo, """ + Z("sum(value) / CAST(max(g.n) AS DOUBLE)") + " AS mean FROM mat JOIN o ON o.id = obs_id JOIN g ON g.r_name = o.r_name AND g.w = o.w GROUP BY 1, 2")  # fmt: skip
def a12(spark, d):
    data = ps(spark, d)
    data = data.with_obs(data.obs.withColumn("w", F.when(F.col("s_acctbal") > 0, "rich").otherwise("poor")))
    return counts.pseudobulk(data, "r_name", new_var=("w",)).mat.select("var_id", F.col("obs_id").alias("combo"), r6("value", "mean"))


@query("a13_population_matrix", PS + """, o AS (SELECT r_name, n_name, CASE WHEN s_acctbal > 0 THEN 'rich' ELSE 'poor' END AS w FROM obs), r AS (SELECT DISTINCT n.n_name, w.w FROM (SELECT n_name FROM o) n, (SELECT w FROM o) w), c AS (SELECT DISTINCT r_name FROM o)
SELECT r.n_name || '_' || r.w AS "row", c.r_name AS combo, """ + Z("(SELECT count(*) FROM o WHERE o.n_name = r.n_name AND o.w = r.w AND o.r_name = c.r_name) / CAST(greatest(1, (SELECT count(*) FROM o WHERE o.r_name = c.r_name)) AS DOUBLE)") + " AS fraction FROM r, c")  # fmt: skip
def a13(spark, d):
    obs = suppliers(spark, d).withColumn("w", F.when(F.col("s_acctbal") > 0, "rich").otherwise("poor"))
    shares = counts.population_matrix(obs, "r_name", new_var=("n_name", "w"))
    return shares.dense().select(F.col("var_id").alias("row"), F.col("obs_id").alias("combo"), r6("value", "fraction"))


@query("a14_log_mean", PS + ", n AS (SELECT count(*) AS n FROM obs) SELECT var_id AS id, " + Z("log10(exp(sum(ln(1 + value)) / CAST(max(n) AS DOUBLE)) - 1)") + " AS log_mean FROM mat CROSS JOIN n GROUP BY 1")
def a14(spark, d):
    return counts.log_mean(ps(spark, d)).var.filter("log_mean > -1e300").select("id", r6("log_mean"))


@query("a15_log_counts", PS + " SELECT id, " + Z("log10(greatest(1, coalesce(sum(value), 0)))") + " AS log_counts FROM obs LEFT JOIN mat ON id = obs_id GROUP BY id")
def a15(spark, d):
    return counts.log_counts(ps(spark, d)).obs.select("id", r6("log_counts"))


@query("a16_categories", PS + " SELECT r_name, row_number() OVER (ORDER BY min(id)) - 1 AS position FROM obs GROUP BY 1")
def a16(spark, d):
    return numbered(tables.distinct_values(suppliers(spark, d), "r_name"), "ord", to="position").drop("ord")


# --- transforms


@query("t1_log_transform", PS + ", t AS (SELECT obs_id, greatest(1, sum(value)) AS t FROM mat GROUP BY 1) SELECT var_id, obs_id, " + Z("log2(1 + value * 10000.0 / t)") + " AS value FROM mat JOIN t USING (obs_id)")
def t1(spark, d):
    return transforms.log_transform(ps(spark, d)).mat.select("var_id", "obs_id", r6("value"))


TFIDF = ", t AS (SELECT obs_id, greatest(1, sum(value)) AS t FROM mat GROUP BY 1), i AS (SELECT var_id, (SELECT count(*) FROM obs) / CAST(greatest(1, sum(value)) AS DOUBLE) AS idf FROM mat GROUP BY 1)"


@query("t2_tf_idf_transform", PS + TFIDF + " SELECT var_id, obs_id, " + Z("ln(1 + 10000.0 * value / t * idf)") + " AS value FROM mat JOIN t USING (obs_id) JOIN i USING (var_id)")
def t2(spark, d):
    return transforms.tf_idf_transform(ps(spark, d)).mat.select("var_id", "obs_id", r6("value"))


@query("t3_sctransform")
def t3(spark, d):
    return transforms.sctransform(ps(spark, d)).mat.select("var_id", "obs_id", r6("value"))


FROZEN = PS + """, t AS (SELECT id AS obs_id, greatest(1, coalesce(sum(value), 0)) AS total FROM obs LEFT JOIN mat ON id = obs_id GROUP BY 1),
v AS (SELECT id AS var_id, sum(value) / CAST((SELECT sum(total) FROM t) AS DOUBLE) AS share, 1.0 + id % 7 AS theta FROM var JOIN mat ON id = var_id GROUP BY 1),
z AS (SELECT v.var_id, t.obs_id, mat.value, share * total AS mu, sqrt(share * total + share * total * share * total / theta) AS sigma FROM v CROSS JOIN t LEFT JOIN mat ON mat.var_id = v.var_id AND mat.obs_id = t.obs_id),
r AS (SELECT var_id, obs_id, CASE WHEN value IS NULL THEN -mu / sigma ELSE greatest(-c, least(c, (value - mu) / sigma)) END AS z FROM z, (SELECT sqrt(count(*) / 30.0) AS c FROM obs))"""


def frozen_residuals(spark, d):
    """Residuals with parameters that SQL can say: each part's share of all cells, and a theta of its own."""
    data = ps(spark, d)
    total = data.mat.groupBy("obs_id").agg(F.sum("value").alias("t")).agg(F.sum("t")).first()[0]
    sums = data.mat.groupBy("var_id").agg(F.sum("value").alias("s"))
    params = sums.select("var_id", F.log(F.col("s") / F.lit(float(total))).alias("beta0"), F.lit(transforms.math.log(10)).alias("beta1"), (1.0 + F.col("var_id") % 7).cast("double").alias("theta"))
    return transforms.sctransform(data, params=params)


@query("t3_sctransform_residuals", FROZEN + " SELECT var_id, obs_id, round(z, 4) + 0.0 AS value FROM r")
def t3_residuals(spark, d):
    """Every residual, empty cells' too."""
    return frozen_residuals(spark, d).dense().select("var_id", "obs_id", fast_round("value", 4))


@query("t3_sctransform_row_sums", FROZEN + " SELECT var_id, round(sum(z), 3) + 0.0 AS total FROM r GROUP BY 1")
def t3_sums(spark, d):
    """Sums of residuals from the sparse and the low-rank part, which are never put together."""
    total = F.round("total", 3)
    sums = counts.row_sums(frozen_residuals(spark, d))
    known = frozen_residuals(spark, d).var.select(F.col("id").alias("var_id"))
    return sums.join(known, "var_id", "left_semi").select("var_id", F.when(total == 0, 0.0).otherwise(total).alias("total"))


@query("t4_transpose", PS + " SELECT obs_id AS var_id, var_id AS obs_id, value FROM mat")
def t4(spark, d):
    return ps(spark, d).transposed().mat.select("var_id", "obs_id", "value")


@query("t5_transform_coords", "SELECT vec_id AS obs_id, " + Z("-CAST(embedding[2] AS DOUBLE)") + " AS x0, " + Z("CAST(embedding[1] AS DOUBLE)") + " AS x1 FROM embeddings")
def t5(spark, d):
    two = points(spark, d).select("obs_id", F.slice("x", 1, 2).alias("x"))
    out = transforms.transform_coords(two, transforms.rot2d(transforms.math.pi / 2).round(12))
    return out.select("obs_id", r6(F.col("x")[0], "x0"), r6(F.col("x")[1], "x1"))


@query("t6_optimal_transform", """WITH p AS (SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
g AS (SELECT avg(x) AS x, avg(y) AS y FROM p), a AS (SELECT avg(p.x) - any_value(g.x) AS x, avg(p.y) - any_value(g.y) AS y FROM p, g WHERE label = 0), b AS (SELECT avg(p.x) - any_value(g.x) AS x, avg(p.y) - any_value(g.y) AS y FROM p, g WHERE label = 1),
u AS (SELECT x / sqrt(x * x + y * y) AS x, y / sqrt(x * x + y * y) AS y FROM a), w AS (SELECT b.x - u.x * (u.x * b.x + u.y * b.y) AS x, b.y - u.y * (u.x * b.x + u.y * b.y) AS y FROM b, u),
v AS (SELECT x / sqrt(x * x + y * y) AS x, y / sqrt(x * x + y * y) AS y FROM w) SELECT id AS obs_id, """ + Z("v.x * p.x + v.y * p.y") + " AS x0, " + Z("u.x * p.x + u.y * p.y") + " AS x1 FROM p, u, v")  # fmt: skip
def t6(spark, d):
    p = points(spark, d)
    two = p.select("obs_id", F.slice("x", 1, 2).alias("x"))
    m = transforms.optimal_transform(two, p.filter("label < 2").select("obs_id", F.col("label").alias("group")), 2)
    return transforms.transform_coords(two, m).select("obs_id", r6(F.col("x")[0], "x0"), r6(F.col("x")[1], "x1"))


# --- designs and regression


@query("n1_design_matrix", PS + ", m AS (SELECT avg(s_acctbal) AS m FROM obs), s AS (SELECT max(abs(s_acctbal - m)) AS s FROM obs, m) SELECT id AS obs_id, 1.0::DOUBLE AS x0, " + Z("(s_acctbal - m) / greatest(1e-6, s)") + " AS x1 FROM obs, m, s")
def n1(spark, d):
    return design.design_matrix(ps(spark, d), "s_acctbal").select("obs_id", F.col("x")[0].alias("x0"), r6(F.col("x")[1], "x1"))


@query("n3_categorical_design", PS + """, c AS (SELECT r_name, row_number() OVER (ORDER BY min(id)) AS k FROM obs GROUP BY 1) SELECT id AS obs_id, CAST(max(k) AS INTEGER) AS column_no FROM obs JOIN c USING (r_name) GROUP BY id""")
def n3(spark, d):
    rows = design.design_matrix(ps(spark, d), "r_name")
    return rows.select("obs_id", (F.array_position(F.slice("x", 2, 100), F.lit(1.0))).cast("int").alias("column_no"))


@query("n4_twogroup_design", PS + ", v AS (SELECT id, CASE WHEN r_name = 'ASIA' THEN 2.0 ELSE 1.0 END::DOUBLE AS v FROM obs), m AS (SELECT avg(v) AS m FROM v), s AS (SELECT max(abs(v - m)) AS s FROM v, m) SELECT id AS obs_id, " + Z("(v - m) / greatest(1e-6, s)") + " AS x1 FROM v, m, s")
def n4(spark, d):
    return design.design_matrix(ps(spark, d), design.twogroup("r_name", "ASIA")).select("obs_id", r6(F.col("x")[1], "x1"))


@query("n7_regression_intercept", PS + ", n AS (SELECT count(*) AS n FROM obs) SELECT v.id AS var_id, " + Z("-(coalesce(sum(value), 0) / CAST(max(n.n) AS DOUBLE))") + " AS b FROM var v CROSS JOIN n LEFT JOIN mat ON v.id = var_id GROUP BY v.id")
def n7(spark, d):
    data = ps(spark, d)
    return design.negative_regression(data, design.fit_design(data.obs)).select("var_id", r6(F.col("b")[0], "b"))


@query("n8_normalize_one_covariate", PS + """, z AS (SELECT v.id AS var_id, o.id AS obs_id, coalesce(m.value, 0) AS y, o.s_acctbal AS x FROM var v CROSS JOIN obs o LEFT JOIN mat m ON m.var_id = v.id AND m.obs_id = o.id),
f AS (SELECT var_id, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM z GROUP BY 1) SELECT var_id, obs_id, round(y - (i + s * x), 4) + 0.0 AS value FROM z JOIN f USING (var_id)""")  # fmt: skip
def n8(spark, d):
    return design.normalize(ps(spark, d), "s_acctbal").dense().select("var_id", "obs_id", fast_round("value", 4))


# --- expressions


def leaf(m: DataFrame, rows: int, cols: int, name: str) -> expressions.Leaf:
    """A factor whose fill nobody gives: chains of three measure it."""
    return expressions.Leaf(m.select(F.col("var_id").alias("i"), F.col("obs_id").alias("j"), "value"), rows, cols, None, name)


@query("m4_chain_product", PS + """, g AS (SELECT a.obs_id AS i, b.obs_id AS j, sum(a.value * b.value) AS value FROM mat a JOIN mat b USING (var_id) GROUP BY 1, 2)
SELECT m.var_id AS i, g.j, CAST(sum(g.value * m.value) AS BIGINT) AS value FROM mat m JOIN g ON g.i = m.obs_id GROUP BY 1, 2""")  # fmt: skip
def m4(spark, d):
    data = ps(spark, d)
    a = leaf(written(data.mat), data.var.count(), data.obs.count(), "A")
    return expressions.compute(expressions.product(a, expressions.transpose(a), a), spark)


@query("m5_sum", PS + " SELECT var_id AS i, obs_id AS j, CAST(sum(value) AS BIGINT) AS value FROM (SELECT * FROM mat UNION ALL SELECT var_id, obs_id, 1 FROM mat WHERE obs_id <= 3) GROUP BY 1, 2")
def m5(spark, d):
    m = ps(spark, d).mat
    one = m.filter("obs_id <= 3").withColumn("value", F.lit(1))
    return expressions.compute(expressions.total(leaf(m, 2000, 100, "A"), leaf(one, 2000, 100, "B")), spark)


@query("m7_diagonal_of_product", PS + " SELECT var_id AS i, CAST(sum(value * value) AS BIGINT) AS value FROM mat GROUP BY 1")
def m7(spark, d):
    m = ps(spark, d).mat.select(F.col("var_id").alias("i"), F.col("obs_id").alias("j"), "value")
    return expressions.diagonal_of_product(m, m.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))


@query("m8_diagonal_of_gram", PS + ", s AS (SELECT var_id, obs_id, sum(value) AS value FROM (SELECT * FROM mat UNION ALL SELECT var_id, obs_id, 1 FROM mat WHERE obs_id <= 3) GROUP BY 1, 2) SELECT obs_id AS j, CAST(sum(value * value) AS BIGINT) AS value FROM s GROUP BY 1")
def m8(spark, d):
    m = ps(spark, d).mat
    e = expressions.total(leaf(m, 2000, 100, "A"), leaf(m.filter("obs_id <= 3").withColumn("value", F.lit(1)), 2000, 100, "B"))
    return expressions.diagonal_of_gram(e, spark)


@query("m8_diagonal_of_gram_of_products", PS + """, g AS (SELECT a.obs_id AS i, b.obs_id AS j, sum(1) AS value FROM mat a JOIN mat b USING (var_id) GROUP BY 1, 2),
e AS (SELECT m.var_id AS i, g.j, sum(g.value) AS value FROM mat m JOIN g ON g.i = m.obs_id GROUP BY 1, 2), s AS (SELECT i, j, sum(value) AS value FROM (SELECT * FROM e UNION ALL SELECT var_id, obs_id, 1 FROM mat) GROUP BY 1, 2)
SELECT j, CAST(sum(CAST(value AS DOUBLE) * value) AS DOUBLE) AS value FROM s GROUP BY 1""")  # fmt: skip
def m8_products(spark, d):
    """diag(EᵗE) of A AᵗA + A for the matrix of which cells are filled; the long product is never formed."""
    data = ps(spark, d)
    a = leaf(written(data.mat).withColumn("value", F.lit(1.0)), data.var.count(), data.obs.count(), "A")
    return expressions.diagonal_of_gram(expressions.total(expressions.product(a, expressions.transpose(a), a), a), spark)


@query("m9_matrix_product_and_sum", PS + """, g AS (SELECT a.var_id AS i, b.var_id AS j, sum(a.value * b.value) AS value FROM (SELECT obs_id AS var_id, var_id AS k, value FROM mat) a JOIN (SELECT obs_id AS var_id, var_id AS k, value FROM mat) b USING (k) GROUP BY 1, 2)
SELECT i AS var_id, j AS obs_id, CAST(value * 2 AS BIGINT) AS value FROM g""")  # fmt: skip
def m9(spark, d):
    data = ps(spark, d)
    data = replace(data, mat=written(data.mat))
    gram = arithmetic.matrix_product(data.transposed(), data)
    return arithmetic.matrix_sum(gram, gram).mat


@query("m10_restricted_expression", PS + """, g AS (SELECT a.obs_id AS i, b.obs_id AS j, sum(a.value * b.value) AS value FROM mat a JOIN mat b USING (var_id) GROUP BY 1, 2)
SELECT i, j, CAST(value AS BIGINT) AS value FROM g WHERE i % 3 = 0 AND j IN (1, 2)""")  # fmt: skip
def m10(spark, d):
    """Some rows and columns of AᵗA, as a selection of identifiers pushed to the leaves."""
    data = ps(spark, d)
    a = leaf(data.mat, data.var.count(), data.obs.count(), "A")
    e = expressions.product(expressions.transpose(a), a)
    rows = data.obs.filter("id % 3 = 0").select(F.col("id").alias("i"))
    return expressions.compute(expressions.restrict(e, rows, spark.createDataFrame([(1,), (2,)], "j long")), spark)


@query("m11_materialize", PS + " SELECT v.id AS var_id, o.id AS obs_id, CAST(coalesce(value, 0) AS DOUBLE) AS value FROM var v CROSS JOIN obs o LEFT JOIN mat ON v.id = var_id AND o.id = obs_id")
def m11(spark, d):
    return ps(spark, d).dense()


# --- reduction


@query("r1_svd_singular_values")
def r1(spark, d):
    f = reduce.svd(reduce.centred(emb(spark, d)), nsv=5, niter=2)
    return spark.createDataFrame([(i, round(float(s), 6)) for i, s in enumerate(f.s)], "k int, s double")


CENTRED_EMB = EMB + """, n AS (SELECT count(*) AS n FROM pt), m AS (SELECT var_id, avg(value) AS mean FROM mat GROUP BY 1), c AS (SELECT var_id, obs_id, value - mean AS v FROM mat JOIN m USING (var_id))"""


@query("r1_svd_spectrum", CENTRED_EMB + """, g AS (SELECT a.var_id AS i, b.var_id AS j, sum(a.v * b.v) AS g FROM c a JOIN c b USING (obs_id) GROUP BY 1, 2)
SELECT round((SELECT sum(g) FROM g WHERE i = j), 4) AS squares, round((SELECT sum(g * g) FROM g) / (SELECT sum(g) FROM g WHERE i = j), 4) AS fourth""")  # fmt: skip
def r1_spectrum(spark, d):
    """All singular values: their squares add up to the trace of AAᵗ, their fourth powers to that of its square."""
    values = [float(x) for x in reduce.svd(reduce.centred(emb(spark, d)), nsv=64, niter=1).s]
    squares, fourth = sum(x**2 for x in values), sum(x**4 for x in values)
    return spark.createDataFrame([(round(squares, 4), round(fourth / squares, 4))], "squares double, fourth double")


@query("r2_pca_norms", CENTRED_EMB + " SELECT obs_id, round(sum(v * v), 5) + 0.0 AS squares FROM c GROUP BY 1")
def r2_norms(spark, d):
    """All scores of an observation have the length of its centred values."""
    scores = reduce.pca(reduce.centred(emb(spark, d)), nsv=64, niter=1)
    return scores.select("obs_id", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v), 5).alias("squares"))


@query("r5_projected_norms", EMB + """, m AS (SELECT var_id, avg(value) AS mean FROM mat WHERE obs_id % 2 = 0 GROUP BY 1)
SELECT obs_id, round(sum((value - mean) * (value - mean)), 5) + 0.0 AS squares FROM mat JOIN m USING (var_id) WHERE obs_id % 2 = 1 GROUP BY 1""")  # fmt: skip
def r5_norms(spark, d):
    """Scores of new observations on all of the base's components, centred by the base's means."""
    data = emb(spark, d)
    base, new = (jobs.source(filters.filter_obs(f"id % 2 = {k}", data)) for k in (0, 1))
    scores = jobs.project(jobs.pca(jobs.normalize_matrix(base), nsv=64, niter=1), {base: new}).fetch()
    return scores.select("obs_id", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v), 5).alias("squares"))


@query("r2_pca")
def r2(spark, d):
    return reduce.pca(reduce.centred(emb(spark, d)), nsv=3, niter=2).select("obs_id", *[r6(F.col("x")[i], f"pc{i + 1}") for i in range(3)])


@query("r3_loadings")
def r3(spark, d):
    return reduce.loadings(reduce.centred(emb(spark, d)), nsv=3, niter=2).select("var_id", *[r6(F.col("u")[i], f"u{i + 1}") for i in range(3)])


@query("r5_projected_pca")
def r5(spark, d):
    data = emb(spark, d)
    base = jobs.source(filters.filter_obs("id % 2 = 0", data))
    new = jobs.source(filters.filter_obs("id % 2 = 1", data))
    job = jobs.pca(jobs.normalize_matrix(base), nsv=3, niter=2)
    job.fetch()
    return jobs.project(job, {base: new}).fetch().select("obs_id", *[r6(F.col("x")[i], f"pc{i + 1}") for i in range(3)])


@query("r6_signature")
def r6_signature(spark, d):
    return reduce.signature(ps(spark, d), "p_brand = 'Brand#11'", niter=2).select("obs_id", r6(F.col("x")[0], "score"))


# --- neighbours

KNN = EMB + f""", e AS (SELECT obs_id, nbr_id, d2 FROM (SELECT a.id AS obs_id, b.id AS nbr_id, {D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS r FROM pt a JOIN pt b ON a.id <> b.id) WHERE r <= 5)"""
CROSS = EMB + f""", e AS (SELECT obs_id, nbr_id, d2 FROM (SELECT a.id AS obs_id, b.id AS nbr_id, {D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS r FROM pt a JOIN pt b ON a.id % 5 = 0 AND b.id % 5 <> 0) WHERE r <= 5)"""


def base_and_new(spark, d):
    p = points(spark, d)
    return p.filter("obs_id % 5 <> 0"), p.filter("obs_id % 5 = 0")


@query("g1_knn", KNN + f" SELECT obs_id, nbr_id, {Z('d2')} AS d2 FROM e")
def g1(spark, d):
    return neighbors.knn(points(spark, d), 5).select("obs_id", "nbr_id", r6("d2"))


@query("g2_j7_nearest_in_base", CROSS + f" SELECT obs_id, nbr_id, {Z('d2')} AS d2 FROM e")
def g2(spark, d):
    base, new = base_and_new(spark, d)
    return neighbors.nearest(new, base, 5).select("obs_id", "nbr_id", r6("d2"))


@query("g3_symmetric_adjacency", KNN + " SELECT obs_id AS src, nbr_id AS dst FROM e UNION SELECT nbr_id, obs_id FROM e")
def g3(spark, d):
    return neighbors.adjacency(neighbors.knn(points(spark, d), 5), symmetric=True)


@query("g4_weighted_adjacency", KNN + f" SELECT obs_id AS src, nbr_id AS dst, {Z('(1 / greatest(1e-12, d2)) / sum(1 / greatest(1e-12, d2)) OVER (PARTITION BY obs_id)')} AS w FROM e")
def g4(spark, d):
    return neighbors.weighted_adjacency(neighbors.knn(points(spark, d), 5)).select("src", "dst", r6("w"))


@query("g5_force_layout")
def g5(spark, d):
    p = points(spark, d)
    out = layouts.force_layout(p, neighbors.adjacency(neighbors.knn(p, 5)), niter=30)
    return out.select("obs_id", *[F.col("x")[i].alias(n) for i, n in enumerate("xyz")])


@query("g6_embed_new_points", CROSS + f" SELECT e.obs_id, {Z('sum(b.x[1]::DOUBLE / greatest(1e-12, d2)) / sum(1 / greatest(1e-12, d2))')} AS x0, {Z('sum(b.x[2]::DOUBLE / greatest(1e-12, d2)) / sum(1 / greatest(1e-12, d2))')} AS x1 FROM e JOIN pt b ON b.id = nbr_id GROUP BY 1")
def g6(spark, d):
    base, new = base_and_new(spark, d)
    out = neighbors.embed(neighbors.nearest(new, base, 5), base.select("obs_id", F.slice("x", 1, 2).alias("x")), 2)
    return out.select("obs_id", r6(F.col("x")[0], "x0"), r6(F.col("x")[1], "x1"))


def placed(spark, d, place):
    """Places of all vectors: a base laid out by ``place`` from its matrix, the others embedded in it."""

    def of_base(base):
        rows = base.orderBy("obs_id").collect()
        return dict(zip([r["obs_id"] for r in rows], place(neighbors.np.array([r["x"] for r in rows])), strict=True))

    return neighbors.laid_out(points(spark, d), of_base, 2).select("obs_id", F.col("x")[0].alias("x"), F.col("x")[1].alias("y"))


@query("g7_umap")
def g7(spark, d):
    return placed(spark, d, lambda x: neighbors.umap(x, epochs=60))


@query("g8_tsne")
def g8(spark, d):
    return layouts.tsne(points(spark, d), max_iter=150).select("obs_id", F.col("x")[0].alias("x"), F.col("x")[1].alias("y"))


LOF = """, kd AS (SELECT obs_id, max(sqrt(d2)) AS kdist FROM e GROUP BY 1), l AS (SELECT e.obs_id, count(*) / sum(greatest(kdist, sqrt(d2))) AS lrd FROM e JOIN kd ON kd.obs_id = nbr_id GROUP BY 1)
SELECT e.obs_id, """


@query("g9_local_outlier_factor", KNN + LOF + Z("avg(n.lrd) / max(o.lrd)") + """ AS "LOF" FROM e JOIN l n ON n.obs_id = nbr_id JOIN l o ON o.obs_id = e.obs_id GROUP BY 1""")
def g9(spark, d):
    p = points(spark, d)
    return neighbors.local_outlier_factor(p, p, k=5).select("obs_id", r6("LOF"))


@query("g11_transfer_annotation", CROSS + f""", w AS (SELECT e.obs_id, b.label, sum(1 / greatest(1e-12, d2)) AS w FROM e JOIN pt b ON b.id = nbr_id GROUP BY 1, 2)
SELECT obs_id, arg_max(label, (w, -label)) AS label, {Z('max(w) / sum(w)')} AS score FROM w GROUP BY 1""")  # fmt: skip
def g11(spark, d):
    base, new = base_and_new(spark, d)
    return neighbors.transfer_annotation(base, base.select("obs_id", "label"), new, k=5).select("obs_id", "label", r6("score"))


# --- tests


ANOVA = PS + """, z AS (SELECT v.id AS var_id, o.r_name AS g, coalesce(m.value, 0)::DOUBLE AS y FROM var v CROSS JOIN obs o LEFT JOIN mat m ON m.var_id = v.id AND m.obs_id = o.id),
g AS (SELECT var_id, g, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM z GROUP BY 1, 2),
t AS (SELECT var_id, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS e, count(*) AS k FROM g GROUP BY 1)"""


@query("q1_ftest_statistic", ANOVA + " SELECT var_id, round(((n - k) / CAST(k - 1 AS DOUBLE)) * (e - s * s / n) / (q - e), 5) + 0.0 AS f FROM t WHERE q > 0")
def q1(spark, d):
    return stats.ftest(ps(spark, d), ["r_name"]).filter("not isnan(F)").select("var_id", F.round("F", 5).alias("f"))


@query("o1_sorted_result", ANOVA + " SELECT var_id, row_number() OVER (ORDER BY round(((n - k) / CAST(k - 1 AS DOUBLE)) * (e - s * s / n) / (q - e), 5) DESC, var_id) AS position FROM t WHERE q > 0")
def o1(spark, d):
    """The order of the test's result: by F, then by the variables' order."""
    rows = stats.ftest(ps(spark, d), ["r_name"], statistic_col="f", pvalue_col=None).filter("not isnan(f)").withColumn("_at", F.monotonically_increasing_id())
    return numbered(rows.withColumn("f", F.round("f", 5)), F.col("f").desc(), "var_id", to="_n").select("var_id", (F.col("_n") + 1).alias("position"))


@query("q1_ftest_pvalue")
def q1p(spark, d):
    return stats.ftest(ps(spark, d), ["r_name"]).filter("not isnan(F)").select("var_id", r6("pValue"))


@query("q2_ttest_statistic", PS + """, z AS (SELECT v.id AS var_id, o.s_acctbal AS x, coalesce(m.value, 0)::DOUBLE AS y FROM var v CROSS JOIN obs o LEFT JOIN mat m ON m.var_id = v.id AND m.obs_id = o.id),
f AS (SELECT var_id, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM z GROUP BY 1)
SELECT var_id, round(b * sqrt(sxx) / sqrt((syy - b * b * sxx) / (n - 2)), 5) + 0.0 AS t, round(b * 1000, 5) + 0.0 AS slope FROM f WHERE syy > 0""")  # fmt: skip
def q2(spark, d):
    zero = lambda c: F.when(F.round(c, 5) == 0, 0.0).otherwise(F.round(c, 5))
    return stats.ttest(ps(spark, d), "s_acctbal").filter("not isnan(t)").select("var_id", zero(F.col("t")).alias("t"), zero(F.col("difference") * 1000).alias("slope"))


@query("q2_ttest_pvalue")
def q2p(spark, d):
    return stats.ttest(ps(spark, d), design.twogroup("r_name", "ASIA")).filter("not isnan(t)").select("var_id", r6("pValue"))


RANKS = PS + """, z AS (SELECT v.id AS var_id, o.r_name = 'ASIA' AS a, coalesce(m.value, 0) AS y FROM var v CROSS JOIN obs o LEFT JOIN mat m ON m.var_id = v.id AND m.obs_id = o.id),
c AS (SELECT var_id, y, count(*) AS t, count(*) FILTER (a) AS t1 FROM z GROUP BY 1, 2),
k AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY var_id ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS rank FROM c),
s AS (SELECT var_id, sum(t) AS n, sum(t1) AS n1, CAST(sum(rank * t1) AS DOUBLE) AS r, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM k GROUP BY 1),
u AS (SELECT var_id, r - n1 * (n1 + 1) / 2.0 AS "U", n1 * (n - n1) / 2.0 AS mean, sqrt(greatest(0, n1 * (n - n1) / 12.0 * (n + 1 - ties / (n * (n - 1))))) AS sigma FROM s)"""


@query("q3_mannwhitney_statistic", RANKS + """ SELECT var_id, round("U", 4) AS "U", CASE WHEN sigma > 1e-9 THEN round(("U" - mean) / sigma, 5) + 0.0 ELSE 0.0 END AS z FROM u""")
def q3(spark, d):
    z = F.round("z", 5)
    return stats.mannwhitney(ps(spark, d), "r_name", "ASIA", z_col="z").select("var_id", F.round("U", 4).alias("U"), F.when(z == 0, 0.0).otherwise(z).alias("z"))


@query("q3_mannwhitney_pvalue")
def q3p(spark, d):
    return stats.mannwhitney(ps(spark, d), "r_name", "ASIA").select("var_id", r6("pValue"))


# --- sets


@query("u1_concat_tables", "SELECT name, kind, position FROM (SELECT r_name AS name, NULL AS kind, r_regionkey AS position FROM region UNION ALL SELECT n_name, 'nation', n_nationkey + 5 FROM nation)")
def u1(spark, d):
    r = table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("ord"))
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("ord"))
    return tables.concat(r, n).select("name", "kind", F.col("ord").alias("position"))


@query("u2_id_intersection", "SELECT p_partkey AS id, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def u2(spark, d):
    ids = table(spark, d, "lineitem").filter("l_discount > 0.09").select(F.col("l_partkey").alias("id"), F.lit(0).alias("ord"))
    return tables.id_intersection(parts(spark, d), ids).select("id", "p_brand")


@query("u4_distinct", "SELECT DISTINCT p_type FROM part")
def u4(spark, d):
    return tables.distinct_values(parts(spark, d), "p_type").drop("ord")


# --- projection: fitted on suppliers of even number, applied to the others


def halves(spark, d):
    data = ps(spark, d)
    return jobs.source(filters.filter_obs("id % 2 = 0", data)), jobs.source(filters.filter_obs("id % 2 = 1", data))


HALVES = PS + ", base AS (SELECT * FROM mat WHERE obs_id % 2 = 0), fresh AS (SELECT * FROM mat WHERE obs_id % 2 = 1)"


@query("project_log_transform", HALVES + ", t AS (SELECT obs_id, greatest(1, sum(value)) AS t FROM fresh GROUP BY 1) SELECT var_id, obs_id, " + Z("log2(1 + value * 10000.0 / t)") + " AS value FROM fresh JOIN t USING (obs_id)")
def project_log(spark, d):
    base, new = halves(spark, d)
    return jobs.project(jobs.log_transform(base), {base: new}).fetch().mat.select("var_id", "obs_id", r6("value"))


@query("project_tf_idf", HALVES + ", t AS (SELECT obs_id, greatest(1, sum(value)) AS t FROM fresh GROUP BY 1), i AS (SELECT v.id AS var_id, (SELECT count(*) FROM obs WHERE id % 2 = 0) / CAST(greatest(1, coalesce(sum(value), 0)) AS DOUBLE) AS idf FROM var v LEFT JOIN base ON v.id = var_id GROUP BY 1) SELECT var_id, obs_id, " + Z("ln(1 + 10000.0 * value / t * idf)") + " AS value FROM fresh JOIN t USING (obs_id) JOIN i USING (var_id)")
def project_tfidf(spark, d):
    base, new = halves(spark, d)
    return jobs.project(jobs.tf_idf_transform(base), {base: new}).fetch().mat.select("var_id", "obs_id", r6("value"))


@query("project_filter_and_count", HALVES + """, k AS (SELECT var_id FROM base GROUP BY 1 HAVING sum(value) > 500) SELECT o.id, coalesce(sum(value), 0) AS total FROM obs o LEFT JOIN (SELECT * FROM fresh WHERE var_id IN (SELECT var_id FROM k)) f ON o.id = obs_id WHERE o.id % 2 = 1 GROUP BY 1""")
def project_filter(spark, d):
    base, new = halves(spark, d)
    counted = jobs.obs_counts_sum(base, name="n")
    job = jobs.var_counts_sum(jobs.filter_var(counted, where="n > 500"), name="total")
    return jobs.project(job, {base: new}).fetch().obs.select("id", "total")


@query("project_normalize", HALVES + """, m AS (SELECT v.id AS var_id, coalesce(sum(value), 0) / CAST((SELECT count(*) FROM obs WHERE id % 2 = 0) AS DOUBLE) AS mean FROM var v LEFT JOIN base ON v.id = var_id GROUP BY 1)
SELECT m.var_id, o.id AS obs_id, """ + Z("coalesce(value, 0) - mean") + " AS value FROM m CROSS JOIN obs o LEFT JOIN fresh f ON f.var_id = m.var_id AND f.obs_id = o.id WHERE o.id % 2 = 1")  # fmt: skip
def project_norm(spark, d):
    base, new = halves(spark, d)
    return jobs.project(jobs.normalize_matrix(base), {base: new}).fetch().dense().select("var_id", "obs_id", fast_round("value", 6))


def projected(spark, d, make):
    """A job on the even suppliers, applied to the odd ones."""
    base, new = halves(spark, d)
    return jobs.project(make(base), {base: new}).fetch()


@query("project_load", HALVES + " SELECT obs_id, CAST(sum(value) AS BIGINT) AS total FROM fresh GROUP BY 1")
def project_load(spark, d):
    """A leaf read from a file is replaced by another path."""
    path = scratch(spark)
    for k, name in enumerate(("even", "odd")):
        readers.save(filters.filter_obs(F.col("id") % 2 == k, ps(spark, d)), f"{path}/{name}")
    job = jobs.var_counts_sum(jobs.file_source(spark, f"{path}/even", readers.load), name="total")
    out = jobs.project(job, {f"{path}/even": f"{path}/odd"}).fetch()
    return out.obs.filter("total > 0").select(F.col("id").alias("obs_id"), "total")


@query("project_filter_obs", HALVES + " SELECT id FROM obs WHERE id % 2 = 1 AND s_acctbal > 0")
def project_filter_obs(spark, d):
    return projected(spark, d, lambda base: jobs.filter_obs(base, where="s_acctbal > 0")).obs.select("id")


@query("project_ids_skip", HALVES + " SELECT id FROM var WHERE id IN (SELECT var_id FROM base GROUP BY 1 HAVING sum(value) > 500) AND id % 3 <> 0")
def project_ids(spark, d):
    """Variables kept on the base, in a set that lacks every third."""
    base, new = halves(spark, d)
    fewer = jobs.source(filters.filter_var("id % 3 <> 0", new.fetch()))
    kept = jobs.filter_var(jobs.obs_counts_sum(base, name="n"), where="n > 500", project_ids="skip")
    return jobs.project(kept, {base: fewer}).fetch().var.select("id")


@query("project_subset", HALVES + " SELECT var_id, obs_id, value FROM fresh WHERE var_id IN (30, 5, 17)")
def project_subset(spark, d):
    return projected(spark, d, lambda base: jobs.subset_var(base, ids=id_list(spark, [30, 5, 17]))).mat


@query("project_design_matrix", HALVES + ", m AS (SELECT avg(s_acctbal) AS m FROM obs WHERE id % 2 = 0), s AS (SELECT max(abs(s_acctbal - m)) AS s FROM obs, m WHERE id % 2 = 0) SELECT id AS obs_id, " + Z("(s_acctbal - m) / greatest(1e-6, s)") + " AS x1 FROM obs, m, s WHERE id % 2 = 1")
def project_design(spark, d):
    return projected(spark, d, lambda base: jobs.design_matrix(base, covariates=("s_acctbal",))).select("obs_id", r6(F.col("x")[1], "x1"))


@query("project_negative_regression", HALVES + " SELECT v.id AS var_id, " + Z("-(coalesce(sum(value), 0) / CAST((SELECT count(*) FROM obs WHERE id % 2 = 0) AS DOUBLE))") + " AS b FROM var v LEFT JOIN base ON v.id = var_id GROUP BY 1")
def project_regression(spark, d):
    return projected(spark, d, lambda base: jobs.negative_regression(base)).select("var_id", r6(F.col("b")[0], "b"))


@query("project_variance", HALVES + """, n AS (SELECT count(*) AS n FROM obs WHERE id % 2 = 0), m AS (SELECT v.id, coalesce(sum(value), 0) / CAST(max(n.n) AS DOUBLE) AS mean, coalesce(sum(value * value), 0) AS sq, max(n.n) AS n FROM var v CROSS JOIN n LEFT JOIN base ON v.id = var_id GROUP BY v.id)
SELECT id, """ + Z("greatest(0, sq - n * mean * mean) / (n - 1)") + " AS variance FROM m")  # fmt: skip
def project_variance(spark, d):
    """Frozen unless asked otherwise."""
    return projected(spark, d, lambda base: jobs.variance(jobs.normalize_matrix(base), assume_centered=True)).var.select("id", r6("variance"))


@query("project_sctransform", HALVES + """, t AS (SELECT id AS obs_id, greatest(1, coalesce(sum(value), 0)) AS total FROM obs LEFT JOIN fresh ON id = obs_id WHERE id % 2 = 1 GROUP BY 1)
SELECT obs_id, CAST(total AS BIGINT) AS total FROM t""")  # fmt: skip
def project_sct(spark, d):
    """Totals are the new observations' own; the parameters, checked by pytest, are the base's."""
    out = projected(spark, d, lambda base: jobs.sctransform(base))
    return out.obs.select(F.col("id").alias("obs_id"), F.col("_total").alias("total"))


@query("project_pseudobulk", HALVES + """, o AS (SELECT id, r_name, CASE WHEN s_acctbal > 0 THEN 'rich' ELSE 'poor' END AS w FROM obs WHERE id % 2 = 1), g AS (SELECT r_name, w, count(*) AS n FROM o GROUP BY 1, 2)
SELECT CAST(var_id AS VARCHAR) || '_' || o.w AS var_id, o.r_name AS combo, """ + Z("sum(value) / CAST(max(g.n) AS DOUBLE)") + " AS mean FROM fresh JOIN o ON o.id = obs_id JOIN g ON g.r_name = o.r_name AND g.w = o.w GROUP BY 1, 2")  # fmt: skip
def project_bulk(spark, d):
    base, new = (jobs.source(j.fetch().with_obs(j.fetch().obs.withColumn("w", F.when(F.col("s_acctbal") > 0, "rich").otherwise("poor")))) for j in halves(spark, d))
    job = jobs.pseudobulk(base, by=("r_name",), new_var=("w",))
    return jobs.project(job, {base: new}).fetch().mat.select("var_id", F.col("obs_id").alias("combo"), r6("value", "mean"))


@query("project_population_matrix", HALVES + """, o AS (SELECT r_name, n_name FROM obs WHERE id % 2 = 1) SELECT n_name AS "row", r_name AS combo, """ + Z("count(*) / CAST(max(t) AS DOUBLE)") + " AS fraction FROM (SELECT *, count(*) OVER (PARTITION BY r_name) AS t FROM o) GROUP BY 1, 2")
def project_population(spark, d):
    """The rows are the nations of all suppliers, on the base."""
    base, new = jobs.source(ps(spark, d)), halves(spark, d)[1]
    out = jobs.project(jobs.population_matrix(base, by=("r_name",), new_var="n_name"), {base: new}).fetch()
    return out.mat.select(F.col("var_id").alias("row"), F.col("obs_id").alias("combo"), r6("value", "fraction"))


@query("project_ftest", HALVES + """, z AS (SELECT v.id AS var_id, o.r_name AS g, coalesce(m.value, 0)::DOUBLE AS y FROM var v CROSS JOIN (SELECT * FROM obs WHERE id % 2 = 1) o LEFT JOIN mat m ON m.var_id = v.id AND m.obs_id = o.id),
g AS (SELECT var_id, g, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM z GROUP BY 1, 2),
t AS (SELECT var_id, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS e, count(*) AS k FROM g GROUP BY 1)
SELECT var_id, round(pi() * ((n - k) / CAST(k - 1 AS DOUBLE)) * (e - s * s / n) / (q - e), 5) + 0.0 AS f FROM t WHERE q - e > 1e-6 AND (e - s * s / n) / (q - e) < 100""")  # fmt: skip
def project_ftest(spark, d):
    """F times pi, since ratios of small numbers end in a five too often to be rounded; without what is explained almost wholly, of which few digits are sure."""
    base, new = jobs.source(ps(spark, d)), halves(spark, d)[1]
    out = jobs.project(jobs.ftest(base, h1=["r_name"]), {base: new}).fetch()
    obs = new.fetch().obs
    free = obs.count() - obs.select("r_name").distinct().count()
    explained = F.col("F") * (obs.count() - free - 1) / free
    return out.filter(explained < 100).select("var_id", F.round(F.pi() * F.col("F"), 5).alias("f"))


@query("project_mannwhitney", HALVES + RANKS.replace(PS, "").replace("FROM var v CROSS JOIN obs o", "FROM var v CROSS JOIN (SELECT * FROM obs WHERE id % 2 = 1) o") + """ SELECT var_id, round("U", 4) AS "U" FROM u""")
def project_ranks(spark, d):
    base, new = jobs.source(ps(spark, d)), halves(spark, d)[1]
    return jobs.project(jobs.mannwhitney(base, column="r_name", a="ASIA"), {base: new}).fetch().select("var_id", F.round("U", 4).alias("U"))


@query("project_layout", EMB + f""", e AS (SELECT obs_id, nbr_id, d2 FROM (SELECT a.id AS obs_id, b.id AS nbr_id, {D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS r FROM pt a JOIN pt b ON a.id % 5 = 0 AND b.id % 5 <> 0) WHERE r <= 5) SELECT DISTINCT obs_id FROM e""")
def project_layout(spark, d):
    """New points among the base's neighbours (their places are checked by pytest)."""
    base, new = (jobs.source(p.select("obs_id", "x")) for p in base_and_new(spark, d))
    return jobs.project(jobs.tsne(base, k_projection=5, max_iter=50), {base: new}).fetch().select("obs_id")


@query("project_local_outlier_factor", EMB + f""", b AS (SELECT obs_id, nbr_id, d2 FROM (SELECT a.id AS obs_id, b.id AS nbr_id, {D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS r FROM pt a JOIN pt b ON a.id <> b.id AND a.id % 5 <> 0 AND b.id % 5 <> 0) WHERE r <= 5),
e AS (SELECT obs_id, nbr_id, d2 FROM (SELECT a.id AS obs_id, b.id AS nbr_id, {D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS r FROM pt a JOIN pt b ON a.id % 5 = 0 AND b.id % 5 <> 0) WHERE r <= 5),
kd AS (SELECT obs_id, max(sqrt(d2)) AS kdist FROM b GROUP BY 1), l AS (SELECT b.obs_id, count(*) / sum(greatest(kdist, sqrt(d2))) AS lrd FROM b JOIN kd ON kd.obs_id = nbr_id GROUP BY 1),
o AS (SELECT e.obs_id, count(*) / sum(greatest(kdist, sqrt(d2))) AS lrd FROM e JOIN kd ON kd.obs_id = nbr_id GROUP BY 1)
SELECT e.obs_id, """ + Z("avg(l.lrd) / max(o.lrd)") + """ AS "LOF" FROM e JOIN l ON l.obs_id = nbr_id JOIN o ON o.obs_id = e.obs_id GROUP BY 1""")  # fmt: skip
def project_lof(spark, d):
    base, new = (jobs.source(p.select("obs_id", "x")) for p in base_and_new(spark, d))
    return jobs.project(jobs.local_outlier_factor(base, base, k=5), {base: new}).fetch().select("obs_id", r6("LOF"))


@query("project_signature")
def project_signature(spark, d):
    return projected(spark, d, lambda base: jobs.signature(base, where="p_brand = 'Brand#11'", niter=2)).select("obs_id", r6(F.col("x")[0], "score"))


QC = PS + """ SELECT o.id, o.r_name, coalesce(sum(value), 0) AS total, count(value) AS nonzero, """ + Z("coalesce(sum(CASE WHEN v.p_size <= 10 THEN value END), 0) / CAST(greatest(1, coalesce(sum(value), 0)) AS DOUBLE)") + """ AS small_fraction
FROM obs o LEFT JOIN mat ON o.id = obs_id LEFT JOIN var v ON v.id = var_id GROUP BY 1, 2 HAVING coalesce(sum(value), 0) > 1000 AND coalesce(sum(CASE WHEN v.p_size <= 10 THEN value END), 0) / CAST(greatest(1, coalesce(sum(value), 0)) AS DOUBLE) < 0.3"""


@query("flagship_quality_control", QC)
def flagship(spark, d):
    """Totals, expressed variables and a fraction per observation, then a filter on them."""
    data = counts.var_counts(ps(spark, d), {"total": (None, None), "nonzero": (None, lambda c: c != 0)}, {"small_fraction": ("p_size <= 10", None)})
    data = filters.filter_obs("total > 1000 and small_fraction < 0.3", data)
    return data.obs.select("id", "r_name", "total", "nonzero", r6("small_fraction"))
