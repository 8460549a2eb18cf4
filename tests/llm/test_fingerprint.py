import hashlib
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from quillmat.llm import fingerprint
from tests.llm.helpers import documents, mixed_rows, prose


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def sketch(text, k=5):
    """(kept hashes, all distinct hashes) by plain loops."""
    words = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text).lower().split(" ") if w]
    every = set()
    for run in [words[i : i + k] for i in range(len(words) - k + 1)] if len(words) >= k else [words] if words else []:
        h = 42
        for w in run:
            h = xxhash.xxh64(struct.pack("<q", w), seed=h).intdigest()
        every.add(signed(h) >> 32)
    height = -(1 << 31) + (1 << 32) // fingerprint.FRACTION
    return {h for h in every if h < height}, every


def likeness(a, b):
    if a[0] | b[0]:
        return len(a[0] & b[0]) / len(a[0] | b[0])
    return float(a[1] == b[1])  # the whole sets


@pytest.mark.parametrize("how", [{}, {"bucket_chars": 2_000}, {"bucket_chars": 2_000, "most_literals": 3}])  # one bucket; many; more than the plan holds
def test_edited_texts_against_brute_force(spark, how):
    rows = [r for r in mixed_rows() if r[0] is not None and r[0] != 105]  # letters beyond ASCII in capitals have rules of their own
    rows += [(500 + k, t, "en", "s") for k, t in enumerate(["beta", "gamma", "delta", "omega one two", "beta", "beta", "one two three four five", "one two three four six", "", " "])]
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(documents(spark, rows), **how).collect()}
    distinct = sorted({(r[0], r[1] or "") for r in rows})
    checked = 0
    for (i, t), (_, after) in zip(distinct, distinct[1:] + distinct[:1], strict=True):
        n = len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = sketch(t), sketch(edited), sketch(after)
        for want, have in ((a, r.sketch), (b, r.edited_sketch)):
            assert (sorted(want[0]), len(want[1]), have.digest is None) == (list(have.hashes), have.total, bool(want[0]))
        assert r.near_edited == pytest.approx(likeness(a, b)) and r.near_next == pytest.approx(likeness(a, c))
        checked += 1
    assert checked > 50 and [got[500 + k].near_next for k in (0, 1, 2, 4, 8)] == [0, 0, 0, 1, 1]


def test_unlike_short_texts_have_unlike_fingerprints(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega", "one two", "three four", "five six seven", ""]
    df = documents(spark, [(k, t, "en", "s") for k, t in enumerate(words * 2)])
    rows = fingerprint.with_sketch(df, "text", "sk").select("text", fingerprint.text_form(F.col("sk")).alias("form"), "sk").collect()
    assert len({r.form for r in rows}) == len({(r.text, r.form) for r in rows}) == len(words)
    empty = [r for r in rows if not r.sk.hashes]
    assert len(empty) > 6 and all(r.sk.digest is not None for r in empty)
    a = fingerprint.with_sketch(df.filter("doc_id < 9"), "text", "a").select(F.col("doc_id").alias("i"), "a")
    b = fingerprint.with_sketch(df.filter("doc_id < 9"), "text", "b").select(F.col("doc_id").alias("j"), "b")
    for r in a.crossJoin(b).select("i", "j", fingerprint.likeness(F.col("a"), F.col("b")).alias("n"), fingerprint.merge(F.col("a"), F.col("b")).alias("m"), fingerprint.containment(F.col("a"), F.col("b")).alias("c"), F.size("a.hashes").alias("k")).collect():
        assert r.n == float(r.i == r.j) and (r.m.digest is None or r.i == r.j)
        assert r.c == (1 if r.i == r.j or words[r.i] == "" else None if r.k == 0 else 0)


def test_estimates_are_near(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [(i, prose(rng, rng.randint(150, 600), vocabulary), "en", "s") for i in range(40)]
    runs = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(documents(spark, rows)).collect()}
    off = []
    for (i, t, *_), (_, after, *_) in zip(rows, rows[1:] + rows[:1], strict=True):
        a, b = runs(t), runs(t[: len(t) - len(t) // 2] + after[: len(t) // 2])
        off.append(abs(got[i].near_edited - len(a & b) / len(a | b)))
    assert max(off) < 0.2 and sum(off) / len(off) < 0.05


def test_rows_come_back(spark):
    rows = mixed_rows()
    for how in ({}, {"bucket_chars": 500}, {"bucket_chars": 500, "most_literals": 1}):
        assert fingerprint.edited_fingerprints(documents(spark, rows), **how).count() == len(rows)
    assert fingerprint.edited_fingerprints(documents(spark, rows).limit(0)).count() == 0
    alone = fingerprint.edited_fingerprints(documents(spark, [(1, "a b c d e f", "en", "s")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"a b c a b c").hexdigest() and alone.near_next == 1


def test_equal_texts_and_merging(spark):
    rng = random.Random(2)
    book = prose(rng, 20_000)
    chapter = " ".join(book.split()[4000:6000])
    other = prose(rng, 2000, ["alpha", "beta", "gamma", "delta", "epsilon"])
    df = documents(spark, [(1, book, "en", "s"), (2, chapter, "en", "s"), (3, other, "en", "s"), (4, chapter, "en", "s")])
    s = {r.doc_id: r for r in fingerprint.with_sketch(df, "text", "sk").select("doc_id", "sk", fingerprint.text_form(F.col("sk")).alias("form")).collect()}
    assert s[2].form == s[4].form != s[3].form
    pairs = fingerprint.with_sketch(df, "text", "sk").select("doc_id", "sk")
    a, b = pairs.filter("doc_id = 2").select(F.col("sk").alias("a")), pairs.filter("doc_id = 1").select(F.col("sk").alias("b"))
    row = a.crossJoin(b).select(fingerprint.containment(F.col("a"), F.col("b")).alias("c"), fingerprint.merge(F.col("a"), F.col("b")).alias("m")).first()
    assert row.c > 0.97
    assert set(row.m.hashes) == {*s[1].sk.hashes, *s[2].sk.hashes}
    assert abs(len(s[1].sk.hashes) / s[1].sk.total - 1 / fingerprint.FRACTION) < 0.02
