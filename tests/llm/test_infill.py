"""Fill-in-middle against a token-by-token version, with chunks far smaller than the texts."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmat.llm import infill
from tests.llm.helpers import documents, mixed_rows

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def expected(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text, text
    if h4 % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


@pytest.mark.parametrize("chunk", [7, infill.CHUNK])
def test_fill_in_middle_against_tokens(spark, chunk):
    rng = random.Random(1)
    rows = mixed_rows(n=25) if chunk > 7 else [r for r in mixed_rows(n=25) if len(r[1] or "") < 3000]
    rows += [(200 + k, "".join(rng.choice(["ab", "Z", "<", "P>", "S", ">", " ", "é", "\U0001f600", "\n", "7"]) for _ in range(rng.randint(0, 60))), None, "s") for k in range(120)]
    rows += [(400, "has <P> inside", None, None), (401, "a<S", None, None), (402, "<M>", None, None)] + [(403, "many copies of one text " * 3, None, "s")] * 40
    docs = documents(spark, rows).withColumn("units", F.lit("x")).withColumn("first", F.lit(1))
    out = infill.fill_in_middle(docs, chunk=chunk)
    got = sorted(map(tuple, out.withColumn("again", infill.restore(F.col("output"), F.col("form"))).collect()), key=repr)
    assert got == sorted((expected(r[0], r[1]) for r in rows), key=repr)


def test_empty_table(spark):
    assert infill.fill_in_middle(documents(spark, [(1, "x", None, None)]).limit(0)).collect() == []


def test_automaton_composes():
    """Summaries of pieces compose to that of the whole, and units begin where a walk says so, for automata of two and three states."""
    rng = np.random.default_rng(0)
    three = infill.Automaton(np.arange(256) % 3, [[1, 2, 0], [0, 0, 0], [0, 1, 2]], [[1, 0, 1], [0, 1, 0], [0, 0, 0]])
    for machine, states in ((infill.UNITS, 2), (three, 3)):
        for n in (0, 1, 2, 3, 50, 257):
            data = rng.integers(0, 256, n).astype(np.uint8)
            codes = machine.codes(data)
            for entry in range(states):
                state, at = entry, []
                for i, c in enumerate(codes):
                    if machine.begins[c, state]:
                        at.append(i)
                    state = int(machine.apply[machine.function[c], state])
                assert machine.starts(codes, entry).tolist() == at
                exits, counts = machine.summary(codes)
                assert (exits[entry], counts[entry]) == (state, len(at))
                for cut in {0, n // 3, n}:
                    (e1, c1), (e2, c2) = machine.summary(codes[:cut]), machine.summary(codes[cut:])
                    assert (e2[e1[entry]], c1[entry] + c2[e1[entry]]) == (state, len(at))
