"""Language identification by a linear-chain conditional random field over words.

Each word is scored for each language by its affixes, its byte trigrams and a lexicon; learned
transitions tie neighbours together, and forward-backward gives each word's distribution, so a text that
switches languages is labelled word by word.  A document's language is the one with the largest share of its letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmat.llm import textbuf
from quillmat.llm.quality import remainder

FEATURE_BITS, LEXICON_BITS, CHUNK = 16, 16, 32
LETTER = re.compile(r"[^\W\d_]")
_IS_LETTER = np.zeros(256, np.int64)
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _fold(h: np.ndarray, salt: int, bits: int = FEATURE_BITS) -> np.ndarray:
    return (textbuf.mix(h + np.uint64(salt)) >> np.uint64(64 - bits)).astype(np.uint16)


@dataclass
class Words:
    """The words of some texts: hashed affixes (one column each), trigrams with where each word's begin, lexicon cells, letters."""

    begins: np.ndarray
    affixes: np.ndarray
    trigrams: np.ndarray
    firsts: np.ndarray
    lexicon: np.ndarray
    letters: np.ndarray


def words_of(texts: list[str]) -> Words:
    blob = b"\n" + b"\n".join([t.lower().encode() for t in texts] + [b""])
    data = np.frombuffer(blob, np.uint8)
    starts, ends = textbuf.bounds(data)
    limits = np.cumsum([1] + [len(t.lower().encode()) + 1 for t in texts])
    size = np.minimum(ends - starts, 1 << 30)
    span = lambda a, b: textbuf.span_hashes(data, a, b)
    affix = [_fold(span(starts, starts + np.minimum(size, k)), k) for k in (1, 2, 3)]
    affix += [_fold(span(ends - np.minimum(size, k), ends), 10 + k) for k in (1, 2, 3)]
    three = (data[:-2].astype(np.uint64) | data[1:-1].astype(np.uint64) << np.uint64(8) | data[2:].astype(np.uint64) << np.uint64(16)) if len(data) > 2 else np.zeros(0, np.uint64)
    # a word's trigrams start one byte before it and end one byte behind it
    count = size
    firsts = np.concatenate([[0], np.cumsum(count)])[:-1]
    where = np.repeat(starts - 1 - firsts, count) + np.arange(int(count.sum()))
    grams = ((three[where] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURE_BITS)).astype(np.uint16)
    letters = np.concatenate([[0], np.cumsum(_IS_LETTER[data])])
    return Words(np.searchsorted(starts, limits), np.stack(affix, 1), grams, firsts, _fold(span(starts, ends), 99, LEXICON_BITS), letters[ends] - letters[starts])


@dataclass
class Field:
    """Weights of hashed features (rows) for each language (columns), of the lexicon, and of transitions from row to column."""

    langs: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    lexicon_weight: np.ndarray
    transitions: np.ndarray

    def emissions(self, w: Words) -> np.ndarray:
        out = self.lexicon[w.lexicon] * self.lexicon_weight
        for j in range(w.affixes.shape[1]):
            out += self.weights[w.affixes[:, j]]
        if len(w.firsts):
            out += np.add.reduceat(self.weights[w.trigrams], w.firsts, axis=0)
        return out

    def marginals(self, e: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Each word's distribution by forward-backward over its text.

        Texts are cut into chunks; products of transfer matrices over all chunks at once give the messages
        at their ends, so a long text takes as few steps as its chunks.
        """
        n_labels, step = len(self.langs), np.exp(self.transitions)
        lengths = np.diff(begins)
        chunks_of = -(-lengths // CHUNK)
        total = int(chunks_of.sum())
        if not total:
            return np.zeros((0, n_labels))
        first = np.concatenate([[0], np.cumsum(chunks_of)])
        text = np.repeat(np.arange(len(lengths)), lengths)
        offset = np.arange(len(e)) - begins[:-1][text]
        chunk, at = first[text] + offset // CHUNK, offset % CHUNK
        pot = np.ones((CHUNK, total, n_labels))
        real = np.zeros((CHUNK, total), bool)
        pot[at, chunk], real[at, chunk] = np.exp(e - e.max(1, keepdims=True)), True
        prod = np.tile(np.eye(n_labels), (total, 1, 1))
        for s in range(CHUNK):
            new = (prod.reshape(-1, n_labels) @ step).reshape(total, n_labels, n_labels) * pot[s][:, None, :]
            prod = np.where(real[s][:, None, None], new / np.maximum(new.max((1, 2), keepdims=True), 1e-300), prod)
        into, back = np.full((total, n_labels), 1 / n_labels), np.full((total, n_labels), 1.0)
        order = np.argsort(-chunks_of, kind="stable")
        longest = int(chunks_of.max())
        alive = np.searchsorted(-chunks_of[order], -np.arange(1, longest + 1), "right")
        for j in range(1, longest):
            c = first[order[: alive[j]]] + j
            v = np.einsum("ti,tij->tj", into[c - 1], prod[c - 1])
            into[c] = v / v.sum(1, keepdims=True)
        for j in range(longest - 1, 0, -1):
            c = first[order[: alive[j]]] + j
            v = np.einsum("tij,tj->ti", prod[c], back[c])
            back[c - 1] = v / v.sum(1, keepdims=True)
        forward = np.empty((CHUNK, total, n_labels))
        a = into
        for s in range(CHUNK):
            new = (a @ step) * pot[s]
            a = np.where(real[s][:, None], new / np.maximum(new.sum(1, keepdims=True), 1e-300), a)
            forward[s] = a
        out = np.empty((CHUNK, total, n_labels))
        b = back
        for s in range(CHUNK - 1, -1, -1):
            p = forward[s] * b
            out[s] = p / np.maximum(p.sum(1, keepdims=True), 1e-300)
            new = (pot[s] * b) @ step.T
            b = np.where(real[s][:, None], new / np.maximum(new.max(1, keepdims=True), 1e-300), b)
        return out[at, chunk]


def train(langs: list[str], lexicon_counts: np.ndarray, texts: list[str], labels: list[str], *, sequences: int = 6000, length: int = 48, batch: int = 64, rate: float = 0.3, seed: int = 5) -> Field:
    """Fit to labelled texts: sequences of words spliced from one to three of them, by stochastic gradients of the log-likelihood."""
    rng, n_labels = np.random.default_rng(seed), len(langs)
    rates = (lexicon_counts + 0.5) / (lexicon_counts.sum(0, keepdims=True) + 0.5 * len(lexicon_counts))
    lex = np.log(rates / rates.mean(1, keepdims=True)).clip(-4, 4)
    field = Field(langs, np.zeros((1 << FEATURE_BITS, n_labels)), lex, np.full(n_labels, 0.3), np.where(np.eye(n_labels) > 0, 1.0, -1.0))
    w = words_of(texts)
    y_text = np.array([langs.index(x) for x in labels])
    usable = [np.flatnonzero((np.diff(w.begins) >= 2) & (y_text == k)) for k in range(n_labels)]
    usable = [u for u in usable if len(u)]
    if not usable:
        return field
    sq_w, sq_t, sq_l = np.full_like(field.weights, 0.1), np.full_like(field.transitions, 1.0), np.full(n_labels, 1.0)
    ends = np.append(w.firsts[1:], len(w.trigrams))
    for _ in range(sequences // batch):
        picked, target = np.empty((length, batch), np.int64), np.empty((length, batch), np.int64)
        for b in range(batch):
            at = 0
            while at < length:
                k = usable[rng.integers(len(usable))]
                d = k[rng.integers(len(k))]
                n = min(length - at, int(rng.integers(6, length + 1)), int(w.begins[d + 1] - w.begins[d]))
                s = int(rng.integers(w.begins[d], w.begins[d + 1] - n + 1))
                picked[at : at + n, b], target[at : at + n, b] = np.arange(s, s + n), y_text[d]
                at += n
        flat = picked.ravel()
        count = ends[flat] - w.firsts[flat]
        grams = w.trigrams[np.repeat(w.firsts[flat] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))]
        sub = Words(np.array([0]), w.affixes[flat], grams, np.concatenate([[0], np.cumsum(count)[:-1]]), w.lexicon[flat], w.letters[flat])
        e = field.emissions(sub).reshape(length, batch, n_labels)
        pot, step = np.exp(e - e.max(2, keepdims=True)), np.exp(field.transitions)
        alpha, scale = np.empty_like(pot), np.empty((length, batch, 1))
        v = np.full((batch, n_labels), 1 / n_labels)
        for t in range(length):
            v = (v @ step) * pot[t]
            scale[t] = v.sum(1, keepdims=True)
            v = alpha[t] = v / scale[t]
        beta, g_t = np.ones((batch, n_labels)), np.zeros_like(step)
        grad = np.empty_like(pot)
        for t in range(length - 1, -1, -1):
            p = alpha[t] * beta
            grad[t] = p / p.sum(1, keepdims=True)
            if t:
                right = pot[t] * beta / scale[t]
                pair = alpha[t - 1][:, :, None] * step[None] * right[:, None, :]
                g_t += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
                beta = right @ step.T
        np.add.at(g_t, (target[:-1].ravel(), target[1:].ravel()), -1)
        grad = grad.reshape(-1, n_labels)
        grad[np.arange(len(flat)), target.ravel()] -= 1
        index = np.concatenate([*sub.affixes.T, grams])
        rows = np.concatenate([*[np.arange(len(flat))] * sub.affixes.shape[1], np.repeat(np.arange(len(flat)), count)])
        g_w = np.stack([np.bincount(index, grad[rows, k], 1 << FEATURE_BITS) for k in range(n_labels)], 1) / batch + 1e-5 * field.weights
        g_l = (lex[sub.lexicon] * grad).sum(0) / batch
        g_t /= batch
        sq_w += g_w**2
        sq_l += g_l**2
        sq_t += g_t**2
        field.weights -= rate * g_w / np.sqrt(sq_w)
        field.lexicon_weight -= 0.1 * g_l / np.sqrt(sq_l)
        field.transitions -= 0.1 * g_t / np.sqrt(sq_t)
    field.weights, field.lexicon = field.weights.astype(np.float32), field.lexicon.astype(np.float32)
    return field


def lexicon(docs: DataFrame, langs: list[str]) -> np.ndarray:
    """Counts of word hashes by language over all of ``docs(text, lang)``: a fixed table, each task sending its part of it in blocks."""
    size, block = 1 << LEXICON_BITS, 1 << 10
    number = {x: k for k, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((size, len(langs)), np.int64)
        for b in textbuf.chunks(batches, 0, 1 << 18):
            w = words_of([t or "" for t in b.column(0).to_pylist()])
            of = np.repeat([number[x] for x in b.column(1).to_pylist()], np.diff(w.begins))
            table += np.bincount(w.lexicon.astype(np.int64) * len(langs) + of, minlength=table.size).reshape(table.shape)
        if table.any():
            parts = table.reshape(size // block, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "counts"])

    kind = "block int, counts binary"
    got = docs.mapInArrow(count, kind).repartition("block").mapInArrow(add, kind).toArrow()
    out = np.zeros((size // block, block * len(langs)), np.int64)
    for k, c in zip(got["block"].to_pylist(), got["counts"].to_pylist(), strict=True):
        out[k] += np.frombuffer(c, np.int64)
    return out.reshape(size, len(langs))


def identify(docs: DataFrame, *, learns: Column | None = None, per_lang: int = 300, whole_rows: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score; other columns are ignored,
    or with ``whole_rows`` all of ``docs`` comes back as a struct ``doc`` with held_out, lang_pred and score beside it.

    Learned from the text and non-null lang of the documents that ``learns``, a condition on doc_id, admits (default: crc32 of doc_id
    modulo 3 is not 1; held_out is its opposite): the lexicon from all of them, the weights from the whole texts of about ``per_lang`` documents of each
    language, those of least hash.  Predictions use the whole text and nothing else.

    Null text, or none with a letter: ``und`` with score 0.  Very long texts: labelled whole.  Ties of languages go to the first by name.  No labelled
    row: ``und`` everywhere.  Null doc_id: never held out by the default.  Repeated rows: the same prediction.  Empty table: empty result.
    """
    spark = docs.sparkSession
    may = remainder(F.col("doc_id"), 3) != 1 if learns is None else learns
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = own.filter(may & F.col("lang").isNotNull() & F.col("text").isNotNull())
    per = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    langs, field = sorted(per), None
    if langs:
        limit = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(per_lang / per[k]))])
        u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
        sample = known.filter(u < limit[F.col("lang")]).select("text", "lang").toArrow()
        rows = sorted(zip(sample["lang"].to_pylist(), sample["text"].to_pylist(), strict=True))
        field = train(langs, lexicon(known.select("text", "lang"), langs), [r[1] for r in rows], [r[0] for r in rows])
    held = spark.sparkContext.broadcast(field)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        for b in textbuf.chunks(batches, 1, 1 << 18):
            texts = [t or "" for t in b.column(1).to_pylist()]
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            if f is not None:
                w = words_of(texts)
                p = f.marginals(f.emissions(w), w.begins) * w.letters[:, None]
                sums = np.concatenate([np.zeros((1, len(f.langs))), np.cumsum(p, axis=0)])
                share = sums[w.begins[1:]] - sums[w.begins[:-1]]
                best, whole = share.argmax(1), share.sum(1)
                for i, t in enumerate(texts):
                    if LETTER.search(t):
                        names[i], scores[i] = f.langs[best[i]], min(1.0, share[i, best[i]] / whole[i]) if whole[i] > 0 else 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names), pa.array(scores), *b.columns[2:]], ["held_out", "lang_pred", "score", "carried"])

    carried = F.struct(*[docs[c] for c in docs.columns]) if whole_rows else F.col("doc_id").cast("long")
    rows = docs.select((~may).alias("held_out"), F.col("text").cast("string").alias("text"), carried.alias("carried"))
    schema = T.StructType([T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("carried", rows.schema["carried"].dataType)])
    out = rows.mapInArrow(predict, schema)
    return out.select(F.col("carried").alias("doc" if whole_rows else "doc_id"), "held_out", "lang_pred", "score")


def identified_documents(docs: DataFrame, *, least_score: float = 0.35, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, but those without a letter or whose best language has less than ``least_score`` of the letters.

    Null, empty and wordless texts go; very long ones, ties, null doc_ids and repeated rows as in :func:`identify`.  Empty table: empty result.
    """
    found = identify(docs, whole_rows=True, **options)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select("doc.*")
