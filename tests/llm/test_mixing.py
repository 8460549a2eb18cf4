import collections
import re

import pytest

from quillmat.llm import mixing
from tests.llm.helpers import documents, mixed_rows, prose
import random


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, rest, out = set(names), float(sum(sizes.values())), {}
    while open_:
        level = rest / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            rest -= out[s]
        open_ -= full
    return out


def test_targets_and_taken(spark):
    rows = mixed_rows() + [(1000 + i, "tiny words", "en", "aa_small") for i in range(3)]
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = brute_targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] == int(want[s])
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(documents(spark, rows).repartition(3)).collect()))


def test_whole_documents(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 20), "en", "a" if i % 3 else "b") for i in range(90)] + [(7, None, None, "a")] + [(200, "twin text", "en", "b")] * 4
    out = mixing.mixed_documents(documents(spark, rows))
    assert out.columns == documents(spark, rows[:1]).columns
    counted = collections.Counter(r.doc_id for r in out.collect())
    plan = collections.Counter()
    for r in mixing.mix(documents(spark, rows), whole=True).collect():
        plan[r.doc_id] += 1 if r["size"] == 0 else r.copies
    assert counted == +plan


def test_empty(spark):
    none = documents(spark, [(1, "a", "en", "s")]).limit(0)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    blank = mixing.mix(documents(spark, [(1, None, None, None), (2, "", None, None)])).collect()
    assert [r.taken for r in blank] == [0, 0]
