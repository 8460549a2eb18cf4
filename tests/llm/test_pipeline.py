import os

import corpus_pipeline
from tests.llm.helpers import documents, mixed_rows


def test_stages_run_in_order(spark, tmp_path):
    leak = "a benchmark question that nobody should have seen before and the answer that goes with it today"
    rows = mixed_rows() + [(500, "intro words here " + leak + " and an end", "en", "src1"), (501, "12345 67", "en", "src1")]
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(os.path.join(tmp_path, "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(os.path.join(tmp_path, "benchmark.parquet"))
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "source_mixing", "sharding"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "sharding":
            assert out.columns == docs.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "language_id":
            assert 501 not in ids and 500 in ids
        if name == "near_dedup":
            assert 104 not in ids and 3 in ids  # a copy of 3
        if name == "decontamination":
            assert 500 not in ids
        out.write.parquet(os.path.join(tmp_path, name))
        now = spark.read.parquet(os.path.join(tmp_path, name))
    assert {"shard", "grown_shard"} <= set(now.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
