from pyspark.sql import functions as F

from quillmat import queries
from quillmat.datamatrix import DataMatrix
from quillmat.sources import readers


def test_samples_in_parts(spark, tmp_path):
    """A sample is written by several tasks and read back whole, though the part that holds its head isn't the largest."""
    var = spark.range(60).select(F.concat(F.lit("p"), "id").alias("id"), F.col("id").alias("ord"))
    obs = spark.range(90).select((F.col("id") + 500).alias("id"), F.col("id").alias("ord"))
    mat = spark.range(5400).filter("id % 7 < 5").select(F.concat(F.lit("p"), F.col("id") % 60).alias("var_id"), (F.floor(F.col("id") / 60) + 500).alias("obs_id"), (F.col("id") % 13 + 1).alias("value"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that small parts stay apart
    try:
        queries.write_sample(DataMatrix(mat, var, obs), str(tmp_path), [F.col("id"), F.col("id"), F.lit("Gene Expression")])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    parts = sorted((tmp_path / "matrix.mtx").glob("part-*"))
    assert len(parts) > 1
    lines = [line for p in parts for line in p.read_text().splitlines()]
    assert lines[0].startswith("%%MatrixMarket") and lines[1] == f"60 90 {mat.count()}" and len(lines) == mat.count() + 2
    back = readers.load_mtx(spark, *[f"{tmp_path}/{n}" for n in ("matrix.mtx", "features.tsv", "barcodes.tsv")], sample="one")
    assert sorted(map(tuple, back.mat.collect())) == sorted((r.var_id, f"one_{r.obs_id}", r.value) for r in mat.collect())
    assert [r.id for r in back.var.orderBy("ord").collect()] == [f"p{i}" for i in range(60)]
