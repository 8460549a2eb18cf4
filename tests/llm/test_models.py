import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from quillmat.llm import boosting, decontaminate, language, mixmodel, quality, textbuf
from tests.llm.helpers import documents, mixed_rows, prose

ENGLISH = ["the", "with", "thing", "house", "what", "they", "would", "sheep", "night", "worth"]
GERMAN = ["der", "nicht", "über", "schön", "zwischen", "straße", "jetzt", "pferd", "ich", "auch"]


def test_words_match_split():
    rng = random.Random(0)
    texts = [bytes(rng.choice(b"ab\xc3\xa9 \t\n\x0b\x0c\r\x1c") for _ in range(rng.randrange(60))) for _ in range(200)]
    hashes, begins = textbuf.words(texts)
    assert [len(t.split()) for t in texts] == np.diff(begins).tolist()
    seen = {}
    for w, h in zip([w for t in texts for w in t.split()], hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    field = language.Field(["a", "b", "c"], None, None, None, rng.normal(size=(3, 3)))
    lengths = [0, 1, 5, 40, 100]
    begins = np.concatenate([[0], np.cumsum(lengths)])
    e = rng.normal(size=(begins[-1], 3)) * 2
    got = field.marginals(e, begins)
    step = np.exp(field.transitions)
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        pot = np.exp(e[a:b])
        f, back = [], []
        v = np.full(3, 1 / 3)
        for p in pot:
            v = (v @ step) * p
            v /= v.sum()
            f.append(v)
        v = np.ones(3)
        for p in pot[::-1]:
            back.append(v)
            v = step @ (p * v)
            v /= v.sum()
        for i, (x, y) in enumerate(zip(f, back[::-1], strict=True)):
            assert np.allclose(got[a + i], x * y / (x * y).sum())


def test_marginals_against_all_label_sequences():
    rng = np.random.default_rng(1)
    field = language.Field(["a", "b", "c"], None, None, None, rng.normal(size=(3, 3)))
    for n in (1, 2, 6):
        e = rng.normal(size=(n, 3))
        want, whole = np.zeros((n, 3)), 0.0
        for labels in itertools.product(range(3), repeat=n):
            # before its first word a text may be in any language
            start = np.log(np.exp(field.transitions[:, labels[0]]).mean())
            w = math.exp(start + sum(e[t, y] for t, y in enumerate(labels)) + sum(field.transitions[a, b] for a, b in zip(labels, labels[1:], strict=False)))
            whole += w
            for t, y in enumerate(labels):
                want[t, y] += w
        assert np.allclose(field.marginals(e, np.array([0, n])), want / whole)


def test_emissions_against_word_by_word_sums():
    rng = np.random.default_rng(2)
    field = language.Field(["a", "b"], rng.normal(size=(1 << language.FEATURE_BITS, 2)), rng.normal(size=(1 << language.LEXICON_BITS, 2)), np.array([0.5, 2.0]), np.zeros((2, 2)))
    texts = ["Über den House", "", "a  xyz\tbc"]
    whole = language.words_of(texts)
    each = [language.words_of([w]) for t in texts for w in t.split()]
    assert np.diff(whole.begins).tolist() == [3, 0, 3] and whole.letters.tolist() == [len(w.lower().encode()) for t in texts for w in t.split()]
    got = field.emissions(whole)
    for row, one in zip(got, each, strict=True):  # words alone lie between line ends, in texts between blanks: only trigrams at the edges differ
        own = field.lexicon[one.lexicon[0]] * field.lexicon_weight + field.weights[one.affixes[0]].sum(0)
        inner = [g for g in one.trigrams.tolist()][1:-1]
        assert np.allclose(own + field.weights[inner].sum(0), row - field.weights[_edges(whole, one, inner)].sum(0))


def _edges(whole, one, inner):
    """The trigrams of a word within its text that it hasn't by itself."""
    for k, first in enumerate(whole.firsts):
        grams = whole.trigrams[first : whole.firsts[k + 1] if k + 1 < len(whole.firsts) else None].tolist()
        if whole.lexicon[k] == one.lexicon[0] and len(grams) == len(one.trigrams):
            return [grams[0], grams[-1]] if len(grams) > 1 else grams
    raise AssertionError


def test_language(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(3, 60), (ENGLISH, GERMAN)[i % 2]), ("en", "de")[i % 2], "s") for i in range(300)]
    switched = prose(rng, 40, ENGLISH) + " " + prose(rng, 10, GERMAN)
    rows += [(900, None, "en", "s"), (901, "123 !!", None, "s"), (902, "", None, None), (None, "the house", None, None), (903, switched, None, "s"), (903, switched, None, "s"), (904, prose(rng, 30_000, GERMAN), None, "s")]
    found = language.identify(documents(spark, rows), per_lang=80).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: r for r in found}
    right = [got[r[0]].lang_pred == r[2] for r in rows[:300] if got[r[0]].held_out]
    assert sum(right) / len(right) > 0.95
    assert all((got[k].lang_pred, got[k].score) == ("und", 0) for k in (900, 901, 902))
    assert got[None].lang_pred == "en" and not got[None].held_out
    assert got[903].lang_pred == "en" and 0.6 < got[903].score < 0.95  # a fifth of it is German
    assert got[904].lang_pred == "de"
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found if r.doc_id is not None)
    kept = language.identified_documents(documents(spark, rows), per_lang=80)
    assert kept.columns == documents(spark, rows[:1]).columns and kept.count() == len(rows) - 3
    none = documents(spark, rows).limit(0)
    assert language.identify(none).count() == 0
    assert {r.lang_pred for r in language.identify(documents(spark, [(1, "text", None, None)])).collect()} == {"und"}


def test_boosting():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    assert ((model.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    # the flat arrays say what walking the nodes says
    for row in x[:20]:
        total = model.base
        for node in model.roots:
            for _ in range(model.depth):
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            total += model.value[node]
        assert model.raw(row[None])[0] == pytest.approx(total)
    assert boosting.fit(x[:0], y[:0]).probability(x[:3]).tolist() == [0.5] * 3
    assert (boosting.fit(x[:50], np.ones(50)).probability(x[:3]) > 0.9).all()


def test_first_split_against_every_split():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (200, 3)).astype(float)
    y = (rng.random(200) < np.where(x[:, 1] > 6, 0.8, 0.3)).astype(float)
    model = boosting.fit(x, y, trees=1, depth=1)
    p = (y.sum() + 1) / 202
    g, h = p - y, np.full(200, p * (1 - p))
    score = lambda own: g[own].sum() ** 2 / (h[own].sum() + 1)
    best = max(((score(x[:, j] <= c) + score(x[:, j] > c), j, c) for j in range(3) for c in range(11) if min((x[:, j] <= c).sum(), (x[:, j] > c).sum()) >= 5), key=lambda o: o[0])
    root = model.roots[0]
    assert (model.feature[root], int(model.threshold[root])) == best[1:]
    own = x[:, best[1]] <= best[2]
    assert model.value[model.left[root]] == pytest.approx(-0.15 * g[own].sum() / (h[own].sum() + 1))


def test_statistics_against_plain_counts():
    text = "The cat, the CAT sat.\nthe cat sat!\n\nÉ 42 #"
    row = dict(zip(quality.FEATURES, quality.statistics([text.encode()])[0], strict=True))
    data, words = text.encode(), text.encode().split()
    share = lambda f: sum(map(f, data)) / len(data)
    assert row["share_upper"] == pytest.approx(share(lambda b: 65 <= b <= 90)) and row["share_lower"] == pytest.approx(share(lambda b: 97 <= b <= 122))
    assert row["share_digit"] == pytest.approx(share(lambda b: 48 <= b <= 57)) and row["share_beyond_ascii"] == pytest.approx(share(lambda b: b > 127))
    assert row["share_stop"] == pytest.approx(share(lambda b: b in b".!?")) and row["share_comma"] == pytest.approx(share(lambda b: b in b",;:"))
    assert row["log_bytes"] == pytest.approx(math.log1p(len(data))) and row["log_words"] == pytest.approx(math.log1p(len(words)))
    size = [len(w) for w in words]
    assert row["mean_word"] == pytest.approx(np.mean(size)) and row["sd_word"] == pytest.approx(np.std(size))
    count = collections.Counter(words)
    assert row["distinct_words"] == pytest.approx(len(count) / len(words)) and row["top_word"] == pytest.approx(max(count.values()) / len(words))
    assert row["distinct_pairs"] == pytest.approx(len(set(zip(words, words[1:], strict=False))) / (len(words) - 1))
    lines = data.split(b"\n")
    assert row["distinct_lines"] == pytest.approx(len(set(lines)) / len(lines)) and row["words_a_line"] == pytest.approx(len(words) / len(lines))
    assert row["same_as_before"] == 0 and row["upper_words"] == pytest.approx(2 / len(words)) and row["symbol_words"] == pytest.approx(1 / len(words))


def test_quality(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 60) if i % 2 else "BUY!! " * rng.randint(5, 60), "en", "s") for i in range(300)] + [r for r in mixed_rows() if r[0] is None or r[0] >= 100 and r[0] < 200]
    labels = [(i, i % 2, 0) for i in range(300)] + [(5, 1, 1), (None, 1, 0), (6, None, 0)]
    rows = [r for r in rows if not (r[0] is not None and 100 <= r[0] < 110 and r[1] in (None, ""))] + [(1000, None, None, None), (1001, "", None, None)]
    out = quality.score_quality(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    own = [r for r in out if r.doc_id is not None and r.doc_id < 300 and r.held_out and not 100 <= r.doc_id < 110]
    assert sum(r.predicted == r.doc_id % 2 for r in own) / len(own) > 0.97
    none = documents(spark, rows).limit(0)
    assert quality.score_quality(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert quality.score_quality(documents(spark, rows[:2]), spark.createDataFrame([], "doc_id long, quality int")).first().score == 0.5


def test_context_mixing(spark):
    rng = random.Random(8)
    words = [rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(40)]
    text = lambda n: " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(rng.randint(1, 200)), "en", "s") for i in range(200)] + [r for r in mixed_rows(n=5) if r[0] is None or r[0] >= 100]
    rows = [r for r in rows if not (r[0] is not None and 100 <= r[0] < 108 and r[2:] == ("en", "s"))]
    got = mixmodel.score_texts(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    counts, end = collections.Counter(), object()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), end]
    for i, t, *_ in rows:
        if not held(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    fresh = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 100]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)
    assert all(r.score <= 0 for r in got)
    assert mixmodel.score_texts(documents(spark, rows).limit(0)).count() == 0


def trained_mixer(texts, lesson, sizes):
    """A model with counts of ``texts`` and weights from ``lesson``, without Spark."""
    data = mixmodel.joined(texts)
    code = mixmodel.make_code(np.bincount(data, minlength=256))
    counts = mixmodel.Counts(code, sizes)
    counts.add(data)
    model = mixmodel.initial_model(code, sizes, counts.tables())
    sums, seen = np.zeros(64 * 64 * mixmodel.BUCKETS), np.zeros(64 * 64 * mixmodel.BUCKETS)
    mixmodel.learn_online(model, mixmodel.joined(lesson), sums, seen)
    model.refine = ((sums + 8 * model.refine) / (seen + 8)).astype(np.float32)
    return model, counts


def random_texts(rng, n, most=40):
    letters = "abcdeefgh\u00e9"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(60)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, most))).encode() for _ in range(n)]


def test_next_bytes_sum_to_one():
    rng = random.Random(3)
    texts = random_texts(rng, 80)
    model, _ = trained_mixer(texts[:60], texts[60:], mixmodel.Sizes(12, 16, 16))
    for prefix in (b"", b"a", b"abc", b"zq abd", b"unseen words and some m", b"a b ", texts[0][:25] + b" q", b"\xf0\x9f odd byt"):
        total = 0.0
        for byte in range(256):
            data = np.frombuffer(prefix + bytes([byte]) + (b"" if byte == 255 else b"\xff"), np.uint8)
            units = mixmodel.Units(data, model.code, model.sizes)
            (_, _, runs, _) = next(units.parts(1 << 20))
            log = [model.logs(run, model.outcome_logs())[run.at == len(prefix)] for run in runs]
            assert sum(map(len, log)) == 1
            total += 10 ** (np.concatenate(log)[0] / np.log(10) + model.code.escape[byte])
        assert total == pytest.approx(1, abs=1e-4), prefix


def slow_log10(model, text):
    """One text's score symbol by symbol, decision by decision."""
    code, sizes, out = model.code, model.sizes, 0.0
    hashed = lambda w: int(textbuf.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    words = text.lower().split()
    units = [w + b" " for w in words[:-1]] + [(words[-1] if words else b"") + b"\xff"]
    so_far: list[int] = []
    for i, unit in enumerate(units):
        before = hashed(units[i - 1][:-1]) if i else 0
        inside = [int(code.syms[32])]
        for k, byte in enumerate(unit):
            sym = int(code.syms[byte])
            if k < 2:
                recent = (so_far[::-1] + [0] * 4)[:4]
                key = (before + 1) & (2**64 - 1)
                if k:
                    key = (key * 0x9E3779B97F4A7C15 & (2**64 - 1)) ^ int(code.syms[unit[k - 1]])
                key = int(textbuf.mix(np.array([key], np.uint64))[0])
                table, bits = model.pairs, sizes.pairs
            else:
                recent = (inside[::-1] + [0] * 4)[:4]
                key, table, bits = hashed(unit[:k]), model.words, sizes.words
            one, two, three, four = (sum(s << 6 * (n - 1 - j) for j, s in enumerate(recent[:n])) for n in (1, 2, 3, 4))
            slots = [one, 64 + two, 64 + 4096 + three, 64 + 4096 + 64**3 + ((four * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - sizes.fourth))]
            for level in range(int(code.depths[sym])):
                node, bit = int(code.nodes[level, sym]), bool(code.bits[level, sym])
                word = int(mixmodel.lines(np.array([key >> 32], np.uint32), level, bits)[0]) | int(code.places[level, sym])
                x = np.array([*(model.table[s * 64 + node] / 16 for s in slots), table[word] / 16, 0.3])
                kind = 2 * (x[4] != 0) + (x[3] != 0)
                z = min(9.0, max(-9.0, float(model.weights[(min(k, 3) * 3 + min(level, 2)) * 4 + kind] @ x)))
                place = (recent[0] << 6 | node) * 48 + int((z + 9) * 47 / 18 + 0.5)
                p = min(1 - 1e-5, max(1e-5, float(model.refine[place])))
                out += math.log10(p if bit else 1 - p)
            out += float(code.escape[byte])
            so_far.append(sym)
            inside.append(sym)
    return out


def test_mixer_against_symbol_by_symbol(monkeypatch):
    rng = random.Random(4)
    texts = random_texts(rng, 60) + [b"", b" \n", b"x" * 300, b"\xf0\x9f\x98\x80 ok ok ok"]
    model, counts = trained_mixer(texts[:40], texts[40:50], mixmodel.Sizes(12, 16, 16))
    pairs = collections.Counter()  # what followed two symbols
    for t in texts[:40]:
        data = mixmodel.joined([t])
        sym = [int(s) for s in model.code.syms[data]]
        start = 0
        for i, s in enumerate(sym):
            inside = i - start >= 2
            recent = [*([0] * 2), *([int(model.code.syms[32])] + sym[start:i] if inside else sym[:i])][::-1]
            pairs[(recent[0] << 6 | recent[1]), s] += 1
            start = i + 1 if data[i] == 32 else start
    followed = counts.all[: 64**4].reshape(64, 64, 64, 64).sum(2).reshape(-1, 64)
    assert {(int(s), int(c)): int(followed[s, c]) for s, c in zip(*np.nonzero(followed), strict=True)} == dict(pairs)
    slots = model.table.reshape(-1, 64)
    assert np.array_equal(slots[64 : 64 + 4096], mixmodel.stretch_table(followed, model.code))
    assert np.array_equal(slots[:64], mixmodel.stretch_table(followed.reshape(64, 64, 64).sum(1), model.code))
    for piece in (1 << 20, 50):  # also in pieces that end inside texts
        monkeypatch.setattr(mixmodel, "PIECE", piece)
        got = model.log10(mixmodel.Units(mixmodel.joined(texts), model.code, model.sizes))
        assert got == pytest.approx([slow_log10(model, t) for t in texts], abs=2e-2, rel=1e-4)


def test_growing_tables():
    small, large = mixmodel.Sizes.of(10**6, 10**5, 26), mixmodel.Sizes.of(10**9, 10**7, 26)
    assert small.fourth < large.fourth and small.pairs < large.pairs and small.words < large.words
    assert max(mixmodel.Sizes.of(10**13, 10**10, 26).__dict__.values()) == 26


def test_decontamination(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(2000)]
    items = [(k, prose(rng, rng.randint(1, 60) if k else 1, vocabulary)) for k in range(60)] + [(60, None), (61, ""), (62, prose(rng, 300, vocabulary)), (63, "the of"), (None, prose(rng, 20, vocabulary))]
    rows = mixed_rows() + [(1000 + i, prose(rng, rng.randint(1, 300), vocabulary), "en", "s") for i in range(40)]
    n, want = 2000, set()
    for k, t in items:
        if t and len(t.split()) >= 8:
            for form in (str.upper, str.lower, lambda x: x.replace(" ", "\n\t")):
                rows.append((n, prose(rng, rng.randint(0, 200), vocabulary) + " " + form(t) + " " + prose(rng, rng.randint(0, 200), vocabulary), "en", "s"))
                want.add((n, k))
                n += 1
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    one = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(spark, rows), bench).collect()}
    long_items = {k for k, t in items if t and len(t.split()) >= 8}
    assert {x for x in one if x[1] in long_items} == want
    parted = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(spark, rows), bench, most_items=9).collect()}
    assert parted == one
    kept = decontaminate.decontaminated(documents(spark, rows), bench)
    assert kept.columns == documents(spark, rows[:1]).columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {x[0] for x in one}
    assert decontaminate.contaminated(documents(spark, rows).limit(0), bench).count() == 0
    assert decontaminate.contaminated(documents(spark, rows), bench.limit(0)).count() == 0


def test_wand_against_all_scores():
    rng = random.Random(10)
    vocabulary = [f"v{i}" for i in range(200)]
    index = decontaminate.build(list(range(150)), [prose(rng, rng.randint(5, 50), vocabulary) for _ in range(150)])
    for _ in range(30):
        hashes, _ = textbuf.words([prose(rng, rng.randint(1, 150), vocabulary).encode()])
        q = np.unique(index.find(hashes))
        q = q[q >= 0]
        if not len(q):
            continue
        scores = np.zeros(len(index.items))
        for t in q:
            scores[index.post_item[index.begins[t] : index.begins[t + 1]]] += index.post_impact[index.begins[t] : index.begins[t + 1]]
        for least in (0.05, 0.2, 0.5):
            _, item, score = index.wand(q, np.array([0]), least)
            assert {int(i): round(float(s), 9) for i, s in zip(item, score, strict=True)} == {i: round(s, 9) for i, s in enumerate(scores) if s >= least}
