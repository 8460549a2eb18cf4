"""Benchmark decontamination: BM25 over the benchmark with block-max pruning, then verified overlap.

The benchmark is the indexed side; every passage of every training text is a query.  An item's
score is the share of its own BM25 mass that the passage's distinct words carry, so one threshold fits
all items.  Retrieval is block-max WAND for batches of passages: one whose terms' largest impacts can't reach
the threshold is done with, and of the others only blocks of items whose block maxima can are opened.  What is retrieved is verified on word runs of both
the item's halves, its question and its answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmat.llm import textbuf
from quillmat.llm.common import digest, same_row


@dataclass
class Item:
    id: int
    question: np.ndarray  # distinct hashes of word runs
    answer: np.ndarray


@dataclass
class Index:
    """Postings by term, in the order of items; ``opens`` says where a term's postings of each block of items begin,
    ``bound`` holds its largest impact there, ``whole`` in all."""

    terms: np.ndarray
    begins: np.ndarray
    post_item: np.ndarray
    post_impact: np.ndarray
    opens: np.ndarray
    bound: np.ndarray
    whole: np.ndarray
    items: list[Item]
    block: int
    run: int

    def find(self, words: np.ndarray) -> np.ndarray:
        """The number of each word's term, -1 for words that no item has."""
        if not len(self.terms):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def wand(self, terms: np.ndarray, starts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, score) of all items that score at least ``least``, for queries of distinct terms that begin at ``starts``.

        Block-max WAND for a batch of queries: lists' largest impacts must sum to the threshold for a query to
        go on, block maxima for a block of items to be opened; only the postings of open blocks are added up.
        """
        ends = np.append(starts[1:], len(terms))
        possible = np.flatnonzero(np.add.reduceat(self.whole[terms], starts, dtype=np.float64) >= least)
        none = np.zeros(0, np.int64)
        out: list[list[np.ndarray]] = [[none], [none], [np.zeros(0)]]
        for at in range(0, len(possible), 256):
            own = possible[at : at + 256]
            size = ends[own] - starts[own]
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            t = terms[np.repeat(starts[own] - first, size) + np.arange(int(size.sum()))]
            reach = np.add.reduceat(self.bound[t], first, axis=0, dtype=np.float64) >= least
            query, block = np.nonzero(reach)
            if not len(query):
                continue
            n = size[query]
            of = np.repeat(np.arange(len(query)), n)
            term = t[np.repeat(first[query] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]
            lo, hi = self.opens[term, block[of]], self.opens[term, block[of] + 1]
            n = hi - lo
            post = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            cell = np.repeat(of, n) * self.block + self.post_item[post] % self.block
            score = np.bincount(cell, self.post_impact[post], len(query) * self.block)
            good = np.flatnonzero(score >= least)
            out[0].append(own[query[good // self.block]])
            out[1].append(block[good // self.block] * self.block + good % self.block)
            out[2].append(score[good])
        return tuple(np.concatenate(x) for x in out)


def build(ids: list[int], texts: list[str | None], *, run: int = 4, block: int = 16, k1: float = 1.2, b: float = 0.75, among: tuple[dict, int, float] | None = None) -> Index:
    """Index items; those without a word are left out, since no text can contain them.

    ``among`` gives document frequencies by word hash, the number of items and their mean length if these are a part of a larger benchmark.
    """
    hashes, begins = textbuf.words([(t or "").lower().encode() for t in texts])
    own = [(i, hashes[a:e]) for i, a, e in zip(ids, begins[:-1], begins[1:], strict=True) if e > a]
    own.sort(key=lambda x: x[1][:1].tolist())  # items with a common start share blocks
    words = [np.unique(w, return_counts=True) for _, w in own]
    if among is None:
        df: dict = {}
        for u, _ in words:
            for x in u.tolist():
                df[x] = df.get(x, 0) + 1
        among = (df, len(own), float(np.mean([len(w) for _, w in own])) if own else 1.0)
    df, n, mean = among
    post, items = {}, []
    for k, ((item_id, w), (u, tf)) in enumerate(zip(own, words, strict=True)):
        freq = np.array([df[x] for x in u.tolist()])
        impact = np.log(1 + (n - freq + 0.5) / (freq + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / mean))
        for x, v in zip(u.tolist(), (impact / impact.sum()).tolist(), strict=True):
            post.setdefault(x, []).append((k, v))
        half = len(w) // 2
        parts = textbuf.shingle_sets(np.concatenate([w[: len(w) - half], w[len(w) - half :]]), np.array([0, len(w) - half, len(w)]), run)
        items.append(Item(item_id, *parts))
    terms = np.array(sorted(post), np.uint64)
    lists = [post[t] for t in terms.tolist()]
    flat = [x for one in lists for x in one]
    item, impact = np.array([x[0] for x in flat], np.int64), np.array([x[1] for x in flat], float)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    bound = np.zeros((len(terms), -(-max(len(items), 1) // block)), np.float32)
    np.maximum.at(bound, (np.repeat(np.arange(len(terms)), np.diff(starts)), item // block), impact)
    # rounded up, so that a bound stays one in single precision
    bound = np.where(bound > 0, np.nextafter(bound, np.float32(2)), bound)
    inside = np.zeros((len(terms), bound.shape[1] + 1), np.int64)
    np.add.at(inside, (np.repeat(np.arange(len(terms)), np.diff(starts)), item // block + 1), 1)
    opens = (np.cumsum(inside, axis=1) + starts[:-1, None]).astype(np.int32)
    return Index(terms, starts, item, impact, opens, bound, bound.max(1) if len(terms) else np.zeros(0, np.float32), items, block, run)


def retrieve(index: Index, texts: list[bytes], least: float, window: int) -> Iterator[tuple[int, int, float]]:
    """(text, item, score): the best passage's score of each item that some passage of the text retrieves.

    Passages are ``window`` words long and overlap by half.
    """
    hashes, begins = textbuf.words(texts)
    if not len(index.terms):
        return
    term = index.find(hashes)
    stride = window // 2
    text_of = np.repeat(np.arange(len(texts)), np.diff(begins))
    hit = np.flatnonzero(term >= 0)
    # each matched word lies in a half-window and so in two passages: the one that starts there and the one before
    half = (hit - begins[text_of[hit]]) // stride
    halves = np.concatenate([[0], np.cumsum(-(-np.diff(begins) // stride) + 1)])
    passage = halves[text_of[hit]] + half
    key = np.unique(np.concatenate([(passage + 1) * len(index.terms) + term[hit], passage * len(index.terms) + term[hit]]))
    p, t = key // len(index.terms), key % len(index.terms)
    if not len(p):
        return
    starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    best: dict[tuple[int, int], float] = {}
    query, item, score = index.wand(t, starts, least)
    text = np.searchsorted(halves, p[starts[query]], "right") - 1
    for x, i, v in zip(text.tolist(), item.tolist(), score.tolist(), strict=True):
        best[x, i] = max(v, best.get((x, i), 0.0))
    for (text, item), score in best.items():
        yield text, item, score


def overlaps(index: Index, item: Item, runs: np.ndarray) -> tuple[float, float]:
    """Shares of the item's question and answer runs that a text's sorted runs have; a part without a run counts as found."""
    return tuple(float(np.isin(x, runs).mean()) if len(x) else 1.0 for x in (item.question, item.answer))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, least_score: float = 0.6, least_overlap: float = 0.6, window: int = 128, run: int = 4, most_items: int = 2_000) -> DataFrame:
    """One row per row of ``docs`` and item that it contains: doc_id, item_id, score, question_overlap, answer_overlap.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored.  An item is retrieved where a passage of
    ``window`` words carries at least ``least_score`` of its BM25 mass (longer items: in a passage twice their length), and reported where
    also at least ``least_overlap`` of the runs of ``run`` words (a shorter half: of itself) of both its question, the first half, and its answer occur in the text.

    Only the benchmark is sent to all tasks, in parts of at most ``most_items`` items; a larger one takes a pass per part, with
    frequencies over the whole.  Null or empty texts and items: never contaminated.  Null doc_ids: reported with null.
    Very long texts are searched passage by passage, all of them.  Repeated rows: one row each.  Ties need no rule: every item above the
    thresholds is reported.  An empty table on either side: empty result.
    """
    return _found(docs, benchmark, least_score, least_overlap, window, run, most_items).drop("digest")


def _found(docs: DataFrame, benchmark: DataFrame, least_score: float, least_overlap: float, window: int, run: int, most_items: int) -> DataFrame:
    """The rows of ``contaminated`` with the digest of the text."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), digest().alias("digest"))
    kind = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, digest binary"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    count, longest, total = items.agg(F.count(F.lit(1)), F.max(F.size(F.split("text", r"\s+"))), F.sum(F.octet_length("text"))).first()
    parts = max(1, -(-count // most_items), -(-(total or 0) // (most_items * 2000)))
    window = max(window, 2 * (longest or 0))
    found = None
    frequencies = _frequencies(items) if parts > 1 else None
    for k in range(parts):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).toArrow()
        index = build(part["item_id"].to_pylist(), part["text"].to_pylist(), run=run, among=frequencies)
        held = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in textbuf.chunks(batches, 1):
                texts, rows = [(t or "").lower().encode() for t in b.column(1).to_pylist()], []
                ids, digests = b.column(0).to_pylist(), b.column(2).to_pylist()
                runs: dict[int, np.ndarray] = {}
                for text, item, score in retrieve(index, texts, least_score, window):
                    if text not in runs:
                        runs[text] = _runs(texts[text], run)
                    q, a = overlaps(index, index.items[item], runs[text])
                    if q >= least_overlap and a >= least_overlap:
                        rows.append((ids[text], index.items[item].id, score, q, a, digests[text]))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[2:5]], pa.array(cols[5], pa.binary())], [x.split()[0] for x in kind.split(", ")])

        out = slim.mapInArrow(search, kind)
        found = out if found is None else found.union(out)
    return found


def _runs(text: bytes, run: int) -> np.ndarray:
    """Hashes of a text's runs of up to ``run`` words: a short half of an item is one run of fewer words."""
    hashes, begins = textbuf.words([text])
    out = [textbuf.shingle_sets(hashes, begins, run)[0]]
    for k in range(1, min(run, len(hashes) + 1)):
        starts = np.arange(len(hashes) - k + 1)
        flat = hashes[(starts[:, None] + np.arange(k)).ravel()]
        own = textbuf.short_runs(flat.reshape(-1, k))
        out.append(np.unique(own))
    return np.concatenate(out)


def _frequencies(items: DataFrame) -> tuple[dict, int, float]:
    """Document frequencies over a benchmark of several parts; its vocabulary is the benchmark's, not the corpus's."""
    df: dict = {}
    n = length = 0
    for row in items.toLocalIterator():
        hashes, _ = textbuf.words([row["text"].lower().encode()])
        if len(hashes):
            n, length = n + 1, length + len(hashes)
            for x in np.unique(hashes).tolist():
                df[x] = df.get(x, 0) + 1
    return df, n, length / max(n, 1)


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, least_score: float = 0.6, least_overlap: float = 0.6, window: int = 128, run: int = 4, most_items: int = 2_000) -> DataFrame:
    """The rows of ``docs`` without those that contain an item, with all their columns.

    Rows go by doc_id (null included) and text, so namesakes stay, and repeated rows go together.  Null, empty and very long texts as in
    :func:`contaminated`.  Ties need no rule.  Empty tables: nothing goes.
    """
    bad = _found(docs, benchmark, least_score, least_overlap, window, run, most_items).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    return docs.join(bad, same_row(docs, bad), "left_anti")
