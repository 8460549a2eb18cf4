import collections
import zlib

from quillmat.llm import sharding
from tests.llm.helpers import documents, mixed_rows


def test_law_slots_and_growth(spark):
    rows = mixed_rows(n=400)
    got = sharding.assign(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id, slots = {}, collections.defaultdict(list)
    for r in got:
        assert by_id.setdefault(r.doc_id, r.shard) == r.shard  # doc_id decides
        assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8 and r.law == "key"
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    assert sorted(map(str, got)) == sorted(map(str, sharding.assign(documents(spark, rows).repartition(5)).collect()))


def test_shares_follow_weights(spark):
    ids = spark.range(40_000).withColumnRenamed("id", "doc_id")
    tree = {"r0": {"k0": {0: 1.0, 1: 3.0}}, "r1": {"k1": {2: 2.0}, "k2": {3: 2.0, 4: 0.0}}}
    n = collections.Counter(r[0] for r in ids.select(sharding.descend("doc_id", tree)).collect())
    assert 4 not in n
    for shard, share in {0: 1 / 8, 1: 3 / 8, 2: 2 / 8, 3: 2 / 8}.items():
        assert abs(n[shard] / 40_000 - share) < 0.01
    # a heavier shard only moves documents into its own branch at every level
    heavier = {"r0": {"k0": {0: 1.0, 1: 5.0}}, "r1": tree["r1"]}
    moved = ids.select(sharding.descend("doc_id", tree).alias("a"), sharding.descend("doc_id", heavier).alias("b")).filter("a <> b").collect()
    assert moved and all(m.b in (0, 1) for m in moved)
    grown = ids.select(sharding.descend("doc_id", sharding.topology(8)).alias("a"), sharding.descend("doc_id", sharding.topology(9)).alias("b")).collect()
    assert all(r.b in (r.a, 8) for r in grown) and abs(sum(r.b == 8 for r in grown) / 40_000 - 1 / 9) < 0.01


def test_empty_and_carried(spark):
    none = documents(spark, [(1, "a", "en", "s")]).limit(0)
    assert sharding.assign(none).count() == 0
    out = sharding.sharded_documents(documents(spark, mixed_rows()))
    assert out.columns[-2:] == ["shard", "grown_shard"] and out.count() == len(mixed_rows())
