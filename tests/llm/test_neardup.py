import collections
import random

import pytest
from pyspark.sql import functions as F

from quillmat.llm import neardup
from quillmat.llm.components import components
from tests.llm.helpers import documents, mixed_rows, prose


def brute(rows, k, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else (frozenset([tuple(w)]) if w else frozenset())

    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                parent[top(i)] = top(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(sets):
        least[top(i)].append(d)
    name = {t: min([d for d in ds if d is not None], default=None) for t, ds in least.items()}
    return sorted(((str(d), len(s), str(name[top(i)]), d == name[top(i)]) for i, (d, s) in enumerate(sets)))


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(edits):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,limit", [(4, 256), (5, 16)])
def test_against_brute_force(spark, k, limit):
    rng = random.Random(k)
    rows = mixed_rows(seed=k)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = prose(rng, 30, vocabulary)
    n = 1000
    for edits in (1, 2, 4):  # crowded groups whose members are linked directly, over others, or not
        for t in near_copies(rng, prose(rng, 80, vocabulary), 40, edits):
            n += 1
            rows.append((n, t, "en", "s"))
    for _ in range(60):  # a passage that many share
        n += 1
        rows.append((n, prose(rng, 20, vocabulary) + " " + passage, "en", "s"))
    rows += [(n + 1 + i, rows[-1][1].upper(), "en", "s") for i in range(50)]  # exact copies but for case
    rng.shuffle(rows)
    got = neardup.near_duplicates(documents(spark, rows), shingle=k, limit=limit)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got.collect()) == brute(rows, k, 80)


def test_texts_under_one_doc_id_go_apart(spark):
    """A third of all rows under one doc_id, another without any: their sets are fetched by text, and no link is lost."""
    rng = random.Random(11)
    rows = []
    for i in range(40):
        words = [rng.choice("abcdefghijklmnop") + str(rng.randrange(30)) for _ in range(60)]
        for j, doc_id in enumerate((7, None, 100 + i)):
            rows.append((doc_id, " ".join([*words[:-1], f"end{j}"]), "en", "s"))
    docs = documents(spark, rows)
    made = neardup._texts_to_sets(docs.select("doc_id", "text"), docs.select(neardup.digest().alias("sid"), F.col("doc_id").cast("long").alias("_id"), neardup.digest().alias("_digest")), 5)
    plan = made._jdf.queryExecution().executedPlan().toString()
    by_id = [line for line in plan.splitlines() if "hashpartitioning(coalesce(" in line]
    assert by_id and all("_digest" in line or "md5" in line for line in by_id)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == 120 and {r.component_id for r in got} == {7} and [r.kept for r in got].count(True) == 40
    kept = neardup.one_of_each(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["7"] * 40 + ["None"] * 40


def test_empty_and_rows_kept(spark):
    none = documents(spark, [(1, "a", "en", "s")]).limit(0)
    assert neardup.near_duplicates(none).count() == 0
    rows = [(5, "a b c d e f g", "en", "s"), (2, "A b c d e f g", "en", "s"), (None, "a b c d e f g", "en", "s"), (9, None, None, None), (8, "", None, None)]
    kept = neardup.one_of_each(documents(spark, rows))
    assert kept.columns == none.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "8", "9", "None"]


@pytest.mark.parametrize("per_task", [250_000, 100])  # one part, and several
def test_components(spark, per_task):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + rng.randrange(50), 2000 + rng.randrange(50)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), per_task=per_task).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(200))
    for a, b in links[500:-2]:
        if a != b:
            assert got[a] == got[b] <= min(a, b)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
