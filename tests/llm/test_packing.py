"""Packing: ids of whole texts, exact cover, capacity, and differencing against a slow version."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillmat.llm import packing
from tests.llm.helpers import documents, mixed_rows, prose


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(packing.VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_encoder_gives_the_ids_of_whole_texts(tokenizer):
    rng = random.Random(0)
    parts = ["word", "don't", "'s", " ", "  ", "\n", "\n\n", "\t", " ", " ", "　", "\x85", "\x1c", "é", "12", ",", "...", "<|endoftext|>", "\U0001f600", "日本", "ß", "x" * 60, "\r\n", "_", "àÿ×÷", "²½", "ªº", "ſǅɏ", "ɐ", "\x7f\x00", "¿¡", "\xa0", "\xad", "naïve", "жук"]
    texts = ["", " ", "  a", "a ", "a  b", " a b", "a b ", "a 's b"] + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    code = packing.Encoder(open(packing.VOCABULARY, encoding="utf-8").read())
    for part in (texts, texts[::-1], ["a b c"] * 5):
        got = [np.frombuffer(b, "<u4").tolist() for b in code.encode(part)]
        assert got == [e.ids for e in tokenizer.encode_batch(part, add_special_tokens=False)]


def slow_difference(sizes, windows):
    """Partitions as sorted lists of (sum, items)."""
    parts = [(sorted([(int(s), [i])] + [(0, [])] * (windows - 1), key=lambda x: -x[0])) for i, s in enumerate(sizes)]
    ages = list(range(len(parts)))
    while len(parts) > 1:
        rank = sorted(range(len(parts)), key=lambda p: (-(parts[p][0][0] - parts[p][-1][0]), ages[p]))
        a, b = rank[0], rank[1]
        both = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(parts[a], parts[b][::-1], strict=True)]
        both.sort(key=lambda x: -x[0])
        least = both[-1][0]
        parts = [p for k, p in enumerate(parts) if k not in (a, b)] + [[(s - least, items) for s, items in both]]
        ages = [g for k, g in enumerate(ages) if k not in (a, b)] + [max(ages) + 1]
    return sorted(sum(int(sizes[i]) for i in items) for _, items in parts[0]) if parts else []


def test_difference_against_lists():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, k = int(rng.integers(1, 40)), int(rng.integers(1, 9))
        sizes = rng.integers(1, 100, n)
        window = packing.difference(sizes, k)
        assert sorted(np.bincount(window, sizes, k).astype(int)) == slow_difference(sizes, k)
    assert len(packing.difference(np.zeros(0, np.int64), 3)) == 0


def test_window_count_rises_with_capacity():
    assert packing.windows_of(np.array([6, 6, 6]), 10).max() == 2  # the total asks for two
    sizes = np.random.default_rng(2).integers(1, 512, 4000)
    window = packing.windows_of(sizes, 2048)
    sums = np.bincount(window, sizes)
    assert sums.max() <= 2048 and len(sums) * 2048 <= sizes.sum() * 1.02 and (sums > 0).all()
    assert packing.windows_of(np.zeros(0, np.int64), 10).tolist() == []


def test_pack_covers_every_id_once(spark, tokenizer):
    rng = random.Random(3)
    rows = mixed_rows(n=40) + [(300, "same text again and again", "en", "s")] * 60 + [(k, prose(rng, 2500), "en", "s") for k in range(400, 420)]
    docs = documents(spark, rows)
    packed = packing.pack(docs, ids=True, group=8)
    got = packed.collect()
    by_sequence, by_document = {}, {}
    for r in got:
        assert r.length * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_document.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    ids = [e.ids + [1] for e in tokenizer.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]
    want = {}
    for r, x in zip(rows, ids, strict=True):
        want.setdefault((r[0], len(x)), []).append(x)
    assert want.keys() == by_document.keys()
    for key, parts in by_document.items():
        copies = len(want[key])
        starts = sorted(r.start for r in parts)
        assert starts == sorted(sorted(set(starts)) * copies)
        pieces = {(r.start, bytes(r.ids)) for r in parts}
        assert {(a, np.array(x[a : a + len(b) // 4], "<u4").tobytes()) for x in want[key] for a, b in pieces if x[a : a + len(b) // 4] == np.frombuffer(b, "<u4").tolist()} == pieces
        assert sum(r.length for r in parts) == copies * key[1]
    for s in packing.sequences(packed).collect():
        own = np.frombuffer(b"".join(bytes(r.ids) for r in sorted(by_sequence[s.sequence_id], key=lambda r: r.offset)), "<u4").tolist()
        assert s.tokens == len(own) and s.ids[: s.tokens] == own
        assert len(s.ids) == (s.tokens if s.tokens & (s.tokens - 1) == 0 else 2048) and set(s.ids[s.tokens :]) <= {50_256}


def test_little_padding(spark):
    rng = random.Random(4)
    packed = packing.pack(documents(spark, [(k, prose(rng, rng.randint(1, 900)), "en", "s") for k in range(1500)]))
    tokens, windows = packed.selectExpr("sum(length)", "count(distinct sequence_id)").first()
    assert tokens >= 0.985 * 2048 * windows


def test_empty_table(spark):
    assert packing.pack(documents(spark, [(1, "x", None, None)]).limit(0)).collect() == []
