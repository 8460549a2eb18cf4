"""Removal of rows by doc_id and text together, on tables whose doc_ids are null or repeated."""

import random

from quillmat.llm import decontaminate, neardup
from tests.llm.helpers import documents, prose


def kept(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=repr)


def test_one_of_each_by_row(spark):
    rng = random.Random(7)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    rows = [(None, a)] * 4 + [(1, b)] * 5 + [(2, c), (3, c), (3, d), (None, d), (None, e), (None, None), (4, ""), (4, "")]
    got = kept(neardup.one_of_each(documents(spark, [(*r, "en", "s") for r in rows])))
    want = [(None, a), (1, b), (2, c), (3, d), (None, d), (None, e), (None, None), (4, ""), (4, "")]
    assert got == sorted(want, key=repr)


def test_decontaminated_by_row(spark):
    rng = random.Random(8)
    leak = "a benchmark question that nobody should have seen before and the answer that goes with it today"
    clean, bad = prose(rng, 80), prose(rng, 20) + " " + leak + " " + prose(rng, 20)
    rows = [(None, bad), (None, bad), (None, clean), (1, bad), (1, clean), (None, None), (2, None)]
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    got = kept(decontaminate.decontaminated(documents(spark, [(*r, "en", "s") for r in rows]), items))
    assert got == sorted([(None, clean), (1, clean), (None, None), (2, None)], key=repr)
