"""Scores of texts by logistic context mixing, beside a smoothed unigram base.

A text is the sequence of its lower-cased words with one space between them and an end.  Its bytes are coded as
binary decisions (a Huffman tree over the commonest bytes; rarer ones are escaped), so the total over all decisions is
the probability of the text: the two ways of every decision add up to 1, hence so do all next bytes.  Several
predictors, each a hashed context, look up how a decision went in the training texts; a mixer adds them in the logistic
domain with weights chosen by a gate, learned online decision block by decision block, and an adaptive probability map
refines the outcome.

The predictors are the last one to four symbols and a hash of words: at the first two symbols of a word (its head) the
word before with what the word has so far, later (in its tail) the word so far.  Contexts of a tail don't reach back
beyond its word, so equal words of a piece of text share one computation.

Context counts come from most of the training documents, weights and refinement from the rest of them (so that
the mixer sees contexts as unseen texts do).  Tables of counts are sized by the training tokens and words; every task adds
its documents to its own and sends the filled cells, which are summed by blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmat.llm import textbuf
from quillmat.llm.common import stored
from quillmat.llm.quality import remainder

SYMS = 64
END_BYTE, END, ESCAPE = 255, 0, 63
HEAD = 2
ORDERS = 4
INPUTS = ORDERS + 2
CLASSES, LEVELS, KINDS = 4, 3, 4
#: Weight sets: by place in the word (first, second, third symbol, later), level of the decision, and which contexts have been seen.
GATES, BUCKETS = CLASSES * LEVELS * KINDS, 48
BLOCK = 1 << 18  # counts in a block: of 64 contexts by 64 of symbols
LINE = 16  # cells side by side, for the decisions of two levels in one context of words
SCALE = 16.0
PIECE, LESSON = 1 << 20, 1 << 17  # bytes scored or learned from at a time
END_HASH = np.array([0x5DEECE66D1234567], np.uint64)


@dataclass(frozen=True)
class Sizes:
    """Bits of the tables: slots of the last four symbols, cells of word pairs and of words so far."""

    fourth: int
    pairs: int
    words: int

    @classmethod
    def of(cls, tokens: int, vocabulary: int, most_bits: int) -> Sizes:
        """For so many training tokens: a cell for eight of them, two for each distinct word."""
        bits = lambda cells, least: min(max(int(cells).bit_length(), least), most_bits)
        return cls(bits(vocabulary >> 5, 12), bits(tokens >> 3, 16), bits(vocabulary << 1, 16))

    @property
    def offsets(self) -> list[int]:
        """Where the slots of each order begin; one more at the end."""
        return [int(x) for x in np.cumsum([0, SYMS, SYMS**2, SYMS**3, 1 << self.fourth])]


@dataclass
class Code:
    """The alphabet and its tree: ``syms`` of bytes, (level, symbol) tables of nodes, bits and places among LINE, depths, cost of escaped bytes."""

    syms: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    places: np.ndarray
    depths: np.ndarray
    right: np.ndarray  # which symbols lie on the 1 side and the 0 side of each node
    left: np.ndarray
    escape: np.ndarray


def make_code(histogram: np.ndarray) -> Code:
    """From the counts of bytes (the end's included): the 62 commonest get symbols of their own."""
    h = histogram.astype(float).copy()
    ends, h[END_BYTE] = h[END_BYTE], -1
    order = np.argsort(-h, kind="stable")
    top, rare = order[: ESCAPE - 1], order[ESCAPE - 1 : 255]
    syms = np.full(256, ESCAPE, np.uint8)
    syms[top], syms[END_BYTE] = np.arange(1, ESCAPE), END
    weight = np.concatenate([[ends], h[top], [h[rare].sum()]]) + 0.5
    heap = [(w, i, (i,)) for i, w in enumerate(weight)]
    heapq.heapify(heap)
    paths: list[list[tuple[int, int]]] = [[] for _ in range(SYMS)]
    right, left = np.zeros((SYMS, SYMS), np.float32), np.zeros((SYMS, SYMS), np.float32)
    for node in range(SYMS - 1):
        (a, i, zeros), (b, _, ones) = heapq.heappop(heap), heapq.heappop(heap)
        for side, bit, to in ((zeros, 0, left), (ones, 1, right)):
            for s in side:
                paths[s].append((node, bit))
                to[s, node] = 1
        heapq.heappush(heap, (a + b, min(i, SYMS + node), zeros + ones))
    depths = np.array([len(p) for p in paths])
    nodes, bits, places = (np.zeros((depths.max(), SYMS), t) for t in (np.intp, bool, np.uint32))
    met: list[dict[int, int]] = [{} for _ in range(SYMS)]  # nodes of two levels each, in the order in which they come
    for s, p in enumerate(paths):
        for level, (node, bit) in enumerate(p[::-1]):
            nodes[level, s], bits[level, s] = node, bit
            places[level, s] = met[level // 2].setdefault(node, len(met[level // 2])) % LINE
    escape = np.zeros(256)
    escape[rare] = np.log10((h[rare] + 1) / (h[rare] + 1).sum())
    return Code(syms, nodes, bits, places, depths, right, left, escape)


def joined(texts: list[bytes]) -> np.ndarray:
    """Normalized texts in a row: lower-cased words with single spaces, each text with its end."""
    return np.frombuffer(b"".join([b" ".join(t.lower().split()) + b"\xff" for t in texts]), np.uint8)


@dataclass
class Run:
    """Symbols that are coded alike: their contexts, how often each is wanted, and whose they are."""

    place: int  # in the word: 0 and 1 are the head, 2 stands for 2 and 3 for more
    at: np.ndarray  # positions in the data
    sym: np.ndarray
    recent: np.ndarray  # the last four symbols, six bits each, the last one first
    key: np.ndarray  # 32 bits of the hash of words
    times: np.ndarray | None
    owner: np.ndarray  # the unit of each symbol; in tails a place in the list of distinct units


def slots(recent: np.ndarray, sizes: Sizes, first: int = 0) -> list[np.ndarray]:
    """Where the slots of these contexts begin, of orders ``first`` + 1 to four."""
    kept = [recent >> np.uint32(18), recent >> np.uint32(12), recent >> np.uint32(6), (recent * np.uint32(0x9E3779B1)) >> np.uint32(32 - sizes.fourth)]
    return [(x.astype(np.intp) << 6) + (o << 6) for x, o in zip(kept[first:], sizes.offsets[first:], strict=False)]


class Units:
    """The words of some normalized texts, each with the gap (a space or the end) that follows it."""

    def __init__(self, data: np.ndarray, code: Code, sizes: Sizes):
        self.data, self.syms, self.sizes = data, code.syms[data], sizes
        self.space = int(code.syms[32])
        self.gaps = np.flatnonzero((data == 32) | (data == END_BYTE))
        self.starts = np.concatenate([[0], self.gaps[:-1] + 1])[: len(self.gaps)]
        self.last = data[self.gaps] == END_BYTE
        self.text = np.cumsum(self.last) - self.last
        self.begins = np.concatenate([[0], self.gaps[self.last] + 1])[:-1]  # of texts
        self.hashes = np.zeros(len(self.gaps), np.uint64)

    def parts(self, most: int) -> Iterator[tuple[int, int, list[Run], np.ndarray]]:
        """Ranges of units of about ``most`` bytes (or a longer word) with their runs, and for each unit the place of its tail, -1 without one."""
        a = 0
        while a < len(self.gaps):
            b = max(a + 1, int(np.searchsorted(self.gaps, self.starts[a] + most, "right")))
            yield a, b, *self._part(a, b)
            a = b

    def _recent(self, first: int, end: int) -> np.ndarray:
        """The four symbols before each position, whatever text they are of."""
        padded = np.concatenate([np.zeros(max(0, 4 - first), np.uint8), self.syms[max(0, first - 4) : end]]).astype(np.uint32)
        n = end - first
        out = padded[3 : 3 + n] << np.uint32(18)
        for k, shift in ((2, 12), (1, 6), (0, 0)):
            out |= padded[k : k + n] << np.uint32(shift)
        return out

    def _part(self, a: int, b: int) -> tuple[list[Run], np.ndarray]:
        offset, end = int(self.starts[a]), int(self.gaps[b - 1]) + 1
        starts, gaps, syms = self.starts[a:b] - offset, self.gaps[a:b] - offset, self.syms[offset:end]
        size, recent = gaps - starts + 1, self._recent(offset, end)
        sums, down = textbuf.prefix_sums(self.data[offset:end])
        base, scale = sums[starts], down[starts]
        h = self.hashes[a:b] = textbuf.mix((sums[gaps] - base) * scale)
        before = np.empty(b - a, np.uint64)
        before[1:], before[0] = h[:-1], self.hashes[a - 1] if a else 0
        begin = self.begins[self.text[a:b]] - offset
        before[starts == begin] = 0
        runs = []
        for place in range(HEAD):
            own = np.flatnonzero(size > place)
            at = starts if place == 0 else starts[own] + place
            key, seen = before[own] + np.uint64(1), recent[at]
            near = np.flatnonzero(at - begin[own] < 4)  # nothing reaches back beyond a text's start
            for k in range(4):
                short = near[at[near] - begin[own[near]] <= k]
                seen[short] &= np.uint32(0xFFFFFF & ~((1 << 6 * (4 - k)) - 1))
            if place:
                key = key * np.uint64(0x9E3779B97F4A7C15) ^ syms[at - 1]
            runs.append(Run(place, at + offset, syms[at], seen, (textbuf.mix(key) >> np.uint64(32)).astype(np.uint32), None, own))
        tail = np.full(b - a, -1)
        own = np.flatnonzero(size > HEAD)
        if len(own):
            same = h[own] << np.uint64(1) | self.last[a:b][own]
            order = np.argsort(same)
            new = np.concatenate([[True], same[order[1:]] != same[order[:-1]]])
            tail[own[order]] = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            count, own = np.diff(np.append(first, len(order))).astype(np.int32), own[order[first]]
            length = size[own] - HEAD
            of = np.repeat(np.arange(len(own)), length)
            reach = np.arange(len(of)) - np.repeat(np.cumsum(length) - length - HEAD, length)
            at = np.repeat(starts[own], length) + reach
            key = textbuf.mix((sums[at] - base[own][of]) * scale[own][of]) >> np.uint64(32)
            seen = recent[at]
            # a space stands before the word's first symbol
            for k in (2, 3):
                short = np.flatnonzero(reach == k)
                seen[short] = seen[short] & np.uint32(0xFFFFFF & ~((1 << 6 * (4 - k)) - 1)) | np.uint32(self.space << 6 * (3 - k))
            for place, which in ((2, reach == 2), (3, reach > 2)):
                which = np.flatnonzero(which)
                whose = of[which]
                runs.append(Run(place, at[which] + offset, syms[at[which]], seen[which], key[which].astype(np.uint32), count[whose], whose))
        return runs, tail


def levels(code: Code, sym: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """An order from the deepest symbol on, and of each level (level, how many decide there, their symbols): always a front part."""
    order = np.argsort(-code.depths[sym].astype(np.int8), kind="stable")
    s = sym[order].astype(np.intp)
    counts = np.searchsorted(-code.depths[s], -np.arange(1, len(code.nodes) + 1), "right")
    return order, [(v, int(n), s[:n]) for v, n in enumerate(counts) if n]


def lines(key: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Where the cells of a context's decisions at this level and its neighbour begin."""
    h = (key ^ np.uint32((level // 2 + 1) * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
    return (h >> np.uint32(32 - bits)) & np.uint32(-LINE & 0xFFFFFFFF)


@dataclass
class Model:
    code: Code
    sizes: Sizes
    table: np.ndarray  # stretched probabilities by slot and node, times SCALE
    pairs: np.ndarray  # the same by cell
    words: np.ndarray
    weights: np.ndarray
    refine: np.ndarray
    steps: int = 0

    def decisions(self, run: Run) -> Iterator[tuple]:
        """The order of a run's symbols, then all their decisions, level by level: how many symbols have them, inputs of the mixer, weight set of each, bits, cells of the map."""
        order, each = levels(self.code, run.sym)
        yield order
        recent, key = run.recent.take(order), run.key.take(order)
        begins, before = slots(recent, self.sizes), (recent >> np.uint32(18)).astype(np.intp) << 6
        table, bits = (self.pairs, self.sizes.pairs) if run.place < HEAD else (self.words, self.sizes.words)
        for v, n, sym in each:
            node = self.code.nodes[v].take(sym)
            if v % 2 == 0:
                line = lines(key[:n], v, bits)
            x = np.empty((INPUTS, n), np.float32)
            for k, s in enumerate(begins):
                x[k] = self.table.take(s[:n] + node, mode="clip")
            x[-2] = table.take((line[:n] | self.code.places[v].take(sym)).astype(np.intp), mode="clip")
            kind = (x[-2] != 0).view(np.uint8) * np.uint8(2) + (x[ORDERS - 1] != 0)
            x[:-1] *= np.float32(1 / SCALE)
            x[-1] = 0.3
            yield n, x, (run.place * LEVELS + min(v, LEVELS - 1)) * KINDS, kind, self.code.bits[v].take(sym), before[:n] + node

    def mixed(self, x: np.ndarray, first: int, kind: np.ndarray) -> np.ndarray:
        """The weighted sums, with the set that the gate names: products with the sets of all kinds, of which each decision takes its own."""
        z = (self.weights[first : first + KINDS].astype(np.float32) @ x).ravel().take(kind * np.intp(x.shape[1]) + np.arange(x.shape[1]))
        return np.clip(z, -9, 9, out=z)

    def bucket(self, at: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The map's place for a sum: the last symbol and the node choose its row."""
        return at * BUCKETS + ((z + np.float32(9)) * np.float32((BUCKETS - 1) / 18) + np.float32(0.5)).astype(np.intp)

    def outcome_logs(self) -> np.ndarray:
        """Natural logarithms of the probabilities of 0 and of 1 for every place of the map, side by side."""
        p = np.clip(self.refine, 1e-5, 1 - 1e-5)
        return np.log(np.stack([1 - p, p], 1)).astype(np.float32).ravel()

    def logs(self, run: Run, outcomes: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each symbol of a run."""
        steps = self.decisions(run)
        order, sums = next(steps), np.zeros(len(run.sym))
        for n, x, first, kind, bit, at in steps:
            sums[:n] += outcomes.take((self.bucket(at, self.mixed(x, first, kind)) << 1) + bit, mode="clip")
        out = np.empty_like(sums)
        out[order] = sums
        return out

    def log10(self, units: Units) -> np.ndarray:
        """log10 of the probability of each text."""
        out, outcomes = np.zeros(len(units.begins)), self.outcome_logs()
        for a, b, runs, tail in units.parts(PIECE):
            each, tails = np.zeros(b - a), np.zeros(int(tail.max(initial=-1)) + 1)
            for run in runs:
                (each if run.place < HEAD else tails)[:] += np.bincount(run.owner, self.logs(run, outcomes), b - a if run.place < HEAD else len(tails))
            each[tail >= 0] += tails[tail[tail >= 0]]
            out += np.bincount(units.text[a:b], each, len(out))
        escape = self.code.escape[units.data]
        rare = np.flatnonzero(escape)
        out *= 1 / np.log(10)
        return out + np.bincount(np.searchsorted(units.begins, rare, "right") - 1, escape[rare], len(out))


def stretched(one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Counts as log odds with a fraction of a count added to each, 0 where nothing was seen."""
    z = np.log((one + 0.4) / (zero + 0.4))
    return np.clip(np.round(z * SCALE), -127, 127).astype(np.int8)


def stretch_table(counts: np.ndarray, code: Code) -> np.ndarray:
    """Counts of symbols (rows are slots) as stretched probabilities of a 1 at each node."""
    c = counts.astype(np.float32)
    return stretched(c @ code.right, c @ code.left)


def learn_online(model: Model, data: np.ndarray, sums: np.ndarray, seen_sums: np.ndarray) -> np.ndarray:
    """One pass over ``data``: weights move after every batch of decisions, ever less, and the map's cells count what came;
    returns how often each weight set was used."""
    used = np.zeros(GATES)
    for _, _, runs, _ in Units(data, model.code, model.sizes).parts(LESSON):
        for run in runs:
            steps = model.decisions(run)
            order = next(steps)
            every = np.ones(len(order), np.float32) if run.times is None else run.times[order].astype(np.float32)
            for n, x, first, kind, bit, at in steps:
                z, times = model.mixed(x, first, kind), every[:n]
                p = 1 / (1 + np.exp(-z))
                where = model.bucket(at, z)
                np.add.at(sums, where, bit * times.astype(np.float64))
                np.add.at(seen_sums, where, times.astype(np.float64))
                own = (np.arange(KINDS)[:, None] == kind) * times
                num, den = (own * (bit - p)) @ x.T, (own * (p * (1 - p))) @ (x * x).T
                rate = max(0.02, 0.3 / (1 + model.steps / 100))
                model.weights[first : first + KINDS] += rate * num / (den + 5)
                model.steps += 1
                used[first : first + KINDS] += own.sum(1)
    return used


# --- distributed parts


def _planes(x: np.ndarray) -> bytes:
    """Integers by byte planes, which compress well when most are small."""
    return x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return h, np.bincount(back, np.concatenate([p[1] for p in parts]), len(h)).astype(np.int64)


COUNTS = "bucket int, kind int, chunk long, hashes binary, counts binary, doc_id array<bigint>, stats array<double>"
_NAMES = [c.split()[0] for c in COUNTS.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64())]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], _NAMES)


def _each_row(b: pa.RecordBatch) -> Iterator[tuple]:
    """Rows as Python values, a few hundred at a time."""
    for at in range(0, b.num_rows, 256):
        part = b.slice(at, 256)
        yield from zip(*(part.column(i).to_pylist() for i in range(len(_NAMES))), strict=True)


def token_counts(train: DataFrame, buckets: int) -> DataFrame:
    """Counts of token hashes over all of ``train(text)``, a row per bucket of hashes; bucket -1 holds the counts of bytes."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        histogram, size = np.zeros(256, np.int64), 0

        def flush():
            h, c = _merge(held)
            at = np.searchsorted(h >> shift, np.arange(buckets + 1).astype(np.uint64))
            rows = [(b, 0, 0, h[i:j].tobytes(), c[i:j].tobytes(), None, None) for b, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
            return _rows(rows)

        for b in textbuf.chunks(batches, 0):
            texts = textbuf.texts_of(b.column(0))
            histogram += np.bincount(joined(texts), minlength=256)
            h, c = np.unique(textbuf.words(texts)[0], return_counts=True)
            held += [(h, c), (END_HASH, np.array([len(texts)]))]
            size += len(h)
            if size > 1_500_000:
                held = [_merge(held)]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        held = []
        textbuf.give_back()
        yield _rows([(-1, 0, 0, None, histogram.tobytes(), None, None)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        sizes: dict[int, int] = {}
        histogram = np.zeros(256, np.int64)
        for b in batches:
            for k, _, _, h, c, _, _ in _each_row(b):
                c = np.frombuffer(c, np.int64)
                if k < 0:
                    histogram += c
                    continue
                parts = held.setdefault(k, [])
                parts.append((np.frombuffer(h, np.uint64), c))
                sizes[k] = sizes.get(k, 0) + len(c)
                if sizes[k] > 2 * len(parts[0][0]) + 100_000:
                    held[k] = [_merge(parts)]
                    sizes[k] = -len(held[k][0][0]) // 2
        for k, parts in held.items():
            h, c = _merge(parts)
            yield _rows([(k, 0, 0, h.tobytes(), c.tobytes(), None, [float(c.sum()), float(len(c))])])
        if histogram.any():
            yield _rows([(-1, 0, 0, None, histogram.tobytes(), None, [0.0, 0.0])])

    return train.select("text").mapInArrow(count, COUNTS).repartition("bucket").mapInArrow(add, COUNTS)


class Counts:
    """Counts of what followed, in one array: symbols by slot of the last three and four, then zeros and ones by cell of word pairs and of words so far.

    What followed one and two symbols are sums of what followed three.
    """

    def __init__(self, code: Code, sizes: Sizes):
        self.code, self.sizes = code, sizes
        self.begins = [int(x) * BLOCK for x in np.cumsum([0, *[-(-n // BLOCK) for n in (SYMS**4, SYMS << sizes.fourth, 2 << sizes.pairs, 2 << sizes.words)]])]
        self.all = np.zeros(self.begins[-1], np.int32)

    def add(self, data: np.ndarray) -> None:
        for _, _, runs, _ in Units(data, self.code, self.sizes).parts(PIECE):
            for run in runs:
                times = np.int32(1) if run.times is None else run.times
                for t, s in enumerate(slots(run.recent, self.sizes, 2)):
                    np.add.at(self.all, s + run.sym + (self.begins[t] - (self.sizes.offsets[t + 2] << 6)), times)
                order, each = levels(self.code, run.sym)
                key, (bits, t) = run.key.take(order), (self.sizes.pairs, 2) if run.place < HEAD else (self.sizes.words, 3)
                times = times if run.times is None else times.take(order)
                for v, n, sym in each:
                    if v % 2 == 0:
                        line = lines(key[:n], v, bits)
                    at = ((line[:n] | self.code.places[v].take(sym)).astype(np.intp) << 1) + self.code.bits[v].take(sym)
                    np.add.at(self.all, at + self.begins[t], times if run.times is None else times[:n])

    def blocks(self) -> Iterator[tuple[int, int, int]]:
        """(table, start, end) of the blocks of counts."""
        for t, (a, b) in enumerate(zip(self.begins[:-1], self.begins[1:], strict=True)):
            yield from ((t, at, at + BLOCK) for at in range(a, b, BLOCK))

    def tables(self) -> list[np.ndarray]:
        """The stretched tables of slots, pairs and words."""
        return assembled(self.sizes, {k: stretched_block(t, self.all[a:b], self.code) for k, (t, a, b) in enumerate(self.blocks())})


def stretched_block(table: int, counts: np.ndarray, code: Code) -> np.ndarray:
    """A block of counts as log odds.  A block of the last three symbols has all that followed one symbol: before its own come the slots of one and two."""
    if table > 1:
        zero, one = counts.reshape(-1, 2).T.astype(np.float32)
        return stretched(one, zero)
    c = counts.reshape(-1, SYMS)
    if table == 0:
        two = c.reshape(SYMS, SYMS, SYMS).sum(1)
        c = np.concatenate([two.sum(0)[None], two, c])
    return stretch_table(c, code).ravel()


def assembled(sizes: Sizes, blocks: dict[int, np.ndarray]) -> list[np.ndarray]:
    """The tables of slots, pairs and words from their stretched blocks by number; absent ones hold no count."""
    at, out = sizes.offsets, [np.zeros((sizes.offsets[-1], SYMS), np.int8), np.zeros(1 << sizes.pairs, np.int8), np.zeros(1 << sizes.words, np.int8)]
    first = np.cumsum([0, SYMS, *[-(-n // BLOCK) for n in (SYMS << sizes.fourth, 2 << sizes.pairs)]])
    for k, b in blocks.items():
        t = int(np.searchsorted(first, k, "right")) - 1
        n = k - int(first[t])
        if t == 0:
            b = b.reshape(-1, SYMS)
            out[0][n], out[0][at[1] + n * SYMS : at[1] + (n + 1) * SYMS], out[0][at[2] + n * SYMS**2 : at[2] + (n + 1) * SYMS**2] = b[0], b[1 : 1 + SYMS], b[1 + SYMS :]
        else:
            into = out[0][at[3] :].reshape(-1) if t == 1 else out[t - 1]
            a = n * len(b)
            into[a : a + len(b)] = b[: len(into) - a]
    return [out[0].ravel(), *out[1:]]


def context_table(train: DataFrame, code: Code, sizes: Sizes) -> list[np.ndarray]:
    """The predictors' tables, from what followed each context in all of ``train(text)``.

    A task adds the texts of its splits (of several, where there are far more splits than cores) to a table and sends
    the filled cells by blocks; the driver gets the sums, a byte for each node of a slot or cell.
    """
    spark = train.sparkSession
    held = spark.sparkContext.broadcast((code, sizes))
    names = ["block", "cells", "counts"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for b in textbuf.chunks(batches, 0):
            counts = counts or Counts(*held.value)
            counts.add(joined(textbuf.texts_of(b.column(0))))
        textbuf.give_back()
        for k, (_, a, b) in enumerate(counts.blocks() if counts else ()):
            filled = np.flatnonzero(counts.all[a:b])
            if len(filled):
                row = (k, _planes(np.diff(filled, prepend=0)), _planes(counts.all[a:b][filled]))
                yield pa.RecordBatch.from_arrays([pa.array([x], y) for x, y in zip(row, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, cells, counts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                own = sums.setdefault(k, np.zeros(BLOCK, np.int64))
                own[np.cumsum(_from_planes(cells).astype(np.int64))] += _from_planes(counts)
        for k in list(sums):
            own_code, own_sizes = held.value
            ends = np.cumsum([SYMS, *[-(-n // BLOCK) for n in (SYMS << own_sizes.fourth, 2 << own_sizes.pairs)]])
            table = stretched_block(int(np.searchsorted(ends, k, "right")), sums.pop(k), own_code)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([table.tobytes()], pa.binary())], ["block", "table"])
        textbuf.give_back()

    together = train.select("text").coalesce(max(64, 4 * spark.sparkContext.defaultParallelism))
    sent = together.mapInArrow(count, "block int, cells binary, counts binary").repartition("block")
    blocks = {r["block"]: np.frombuffer(r["table"], np.int8) for r in sent.mapInArrow(add, "block int, table binary").toLocalIterator()}
    return assembled(sizes, blocks)


def fit_mixer(train: DataFrame, model: Model, groups: int) -> Model:
    """Weights and refinement from all of ``train(text)``.

    Texts are dealt into so many groups by their hash; each learns online from the same start, in the order of the hashes,
    and results are averaged by use.
    """
    held = train.sparkSession.sparkContext.broadcast(model)
    cells = SYMS * BUCKETS

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, group, texts, size = held.value, None, [], 0
        m, sums, seen, used = None, np.zeros(SYMS * cells), np.zeros(SYMS * cells), np.zeros(GATES)

        def finish():
            weights = np.concatenate([m.weights * used[:, None], used[:, None]], 1)
            rows = [(k, sums[k * cells : (k + 1) * cells], seen[k * cells : (k + 1) * cells]) for k in range(SYMS)] + [(SYMS, weights, np.ones(1))]
            rows = [r for r in rows if r[2].any()]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in (1, 2)]], ["part", "a", "b"])

        def lesson():
            used.__iadd__(learn_online(m, joined(texts), sums, seen))
            texts.clear()

        for b in textbuf.chunks(batches, 1, LESSON):
            for g, text in zip(b.column(0).to_pylist(), textbuf.texts_of(b.column(1)), strict=True):
                if g != group:
                    if m is not None:
                        lesson()
                        yield finish()
                        for x in (sums, seen, used):
                            x[:] = 0
                    group, m, size = g, Model(start.code, start.sizes, start.table, start.pairs, start.words, start.weights.copy(), start.refine), 0
                texts.append(text)
                size += len(text)
                if size >= LESSON:
                    lesson()
                    size = 0
        if m is not None:
            lesson()
            yield finish()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for k, x, y in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                own = sums.setdefault(k, [0.0, 0.0])
                own[0], own[1] = own[0] + np.frombuffer(x), own[1] + np.frombuffer(y)
        for k, (x, y) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["part", "a", "b"])

    kind = "part int, a binary, b binary"
    dealt = train.select(F.pmod(F.xxhash64("text"), F.lit(groups)).cast("int").alias("g"), "text").repartition(groups, "g").sortWithinPartitions("g", F.xxhash64("text"))
    weights, refine = model.weights, model.refine.copy()
    prior = refine.reshape(SYMS, cells)
    for row in dealt.mapInArrow(learn, kind).repartition("part").mapInArrow(add, kind).collect():  # 65 rows
        a, b = np.frombuffer(row["a"]), np.frombuffer(row["b"])
        if row["part"] == SYMS:
            a = a.reshape(GATES, -1)
            weights = np.where(a[:, -1:] > 0, a[:, :-1] / np.maximum(a[:, -1:], 1), weights)
        else:
            prior[row["part"]] = (a + 8 * prior[row["part"]]) / (b + 8)
    return Model(model.code, model.sizes, model.table, model.pairs, model.words, weights, refine.astype(np.float32))


def initial_model(code: Code, sizes: Sizes, tables: list[np.ndarray]) -> Model:
    weights = np.full((GATES, INPUTS), 0.3)
    weights[:, -1] = 0
    z = (np.arange(BUCKETS) / (BUCKETS - 1)) * 18 - 9
    return Model(code, sizes, *tables, weights, np.tile((1 / (1 + np.exp(-z))).astype(np.float32), SYMS * SYMS))


def score_texts(docs: DataFrame, *, learns: Column | None = None, weighs: Column | None = None, buckets: int | None = None, most_bits: int = 26) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``learns``, a condition on doc_id, admits training documents (default: crc32 of doc_id modulo 7 is not 2; held_out is its opposite); those of
    them that ``weighs`` admits too (default: that remainder is 6) set weights and refinement, the others the context counts;
    the base counts tokens of all.  ``buckets`` (a power of two; default: four per shuffle partition) is how many parts the vocabulary is counted and looked up in.
    The mixer's tables grow with the training tokens and words (see ``Sizes``) up to ``2**most_bits`` cells each, which is what a task must hold;
    the exact counts of the base have no such end.

    Base: tokens seen often (at most 65536 of them can be, by their share of all) are looked up where the text is; the others are
    sent by bucket to where their counts are, and their sums return by blocks of documents.

    Null or blank text: only the end.  Null doc_id: trains under the remainder of the empty text.  Very long text: coded in pieces that
    know what comes before.  Ties: there are none, a text's scores depend on it and the training texts alone; repeated rows have the
    same scores.  No training document: all counts 0.  Empty table: empty result.
    """
    spark = docs.sparkSession
    left = remainder(F.col("doc_id"), 7)
    may = left != 2 if learns is None else learns
    weigh = left == 6 if weighs is None else weighs
    if buckets is None:
        buckets = 1 << max(6, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = stored(token_counts(own.filter(may), buckets))
    totals = counted.agg(F.sum(F.get("stats", F.lit(0))).alias("n"), F.sum(F.get("stats", F.lit(1))).alias("v")).first()
    n, v = int(totals["n"] or 0), int(totals["v"] or 0)
    histogram = np.zeros(256, np.int64)
    for row in counted.filter("bucket = -1").select("counts").collect():
        histogram += np.frombuffer(row["counts"], np.int64)
    code, sizes, often = make_code(histogram), Sizes.of(n, v, most_bits), max(1, n >> 16)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h, c = np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[c >= often].view(np.int64)), pa.array(c[c >= often])], ["h", "c"])

    tokens = counted.filter("bucket >= 0")
    hot = tokens.select("hashes", "counts").mapInArrow(frequent, "h long, c long").toArrow()
    hot_h, hot_c = hot["h"].to_numpy().view(np.uint64), hot["c"].to_numpy()
    order = np.argsort(hot_h)
    start = initial_model(code, sizes, context_table(own.filter(may & ~weigh), code, sizes))
    model = fit_mixer(own.filter(may & weigh), start, 1 << (n >> 22).bit_length())
    held = spark.sparkContext.broadcast((model, hot_h[order], hot_c[order]))
    shift, floor = np.uint64(64 - (buckets.bit_length() - 1)), float(np.log10(n + v + 1))
    ends_seen = own.filter(may).count()
    end_base = float(np.log10(ends_seen + 1)) - floor

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hh, hc = held.value
        task, chunk = TaskContext.get().partitionId(), 0
        for b in textbuf.chunks(batches, 2):
            texts = textbuf.texts_of(b.column(2))
            units = Units(joined(texts), m.code, m.sizes)
            score = m.log10(units)
            word = units.gaps > units.starts  # all but the end of a blank text
            h, text = units.hashes[word], units.text[word]
            size, n_bytes = np.bincount(text, minlength=len(texts)), np.diff(np.append(units.begins, len(units.data)))
            at = np.minimum(np.searchsorted(hh, h), max(len(hh) - 1, 0))
            is_hot = hh[at] == h if len(hh) else np.zeros(len(h), bool)
            base = np.bincount(text[is_hot], np.log10(hc[at[is_hot]] + 1) - floor, len(texts)) + end_base
            known = np.bincount(text[is_hot], minlength=len(texts)) + (ends_seen > 0)
            stats = np.stack([b.column(1).to_numpy(zero_copy_only=False).astype(float), size + 1, known, base, score, n_bytes], 1)
            chunk += 1
            key = task << 40 | chunk
            rows = [(int(textbuf.mix(np.array([key], np.uint64))[0] % np.uint64(buckets)), 1, key, None, None, b.column(0).to_pylist(), stats.ravel())]
            order = np.argsort((h[~is_hot] >> shift).astype(np.uint16 if buckets <= 1 << 16 else np.uint64), kind="stable")
            cold, of = h[~is_hot][order], text[~is_hot][order]
            cut = np.searchsorted(cold >> shift, np.arange(buckets + 1).astype(np.uint64))
            rows += [(k, 2, key, cold[i:j].tobytes(), _planes(np.diff(of[i:j], prepend=0)), None, [float(len(texts))]) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
            yield _rows(rows)
        textbuf.give_back()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, h, c = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            out = []
            for r in _each_row(b):
                if r[1] == 0:
                    bucket, h, c = r[0], np.frombuffer(r[3], np.uint64), np.frombuffer(r[4], np.int64)
                elif r[1] == 1:
                    out.append(r)
                else:
                    if r[0] != bucket:
                        bucket, h, c = r[0], np.zeros(0, np.uint64), np.zeros(0, np.int64)
                    want, of, docs = np.frombuffer(r[3], np.uint64), np.cumsum(_from_planes(r[4]).astype(np.int64)), int(r[6][0])
                    at = np.minimum(np.searchsorted(h, want), max(len(h) - 1, 0))
                    count = np.where(h[at] == want, c[at], 0) if len(h) else np.zeros(len(want), np.int64)
                    sums, known = np.bincount(of, np.log10(count + 1) - floor, docs), np.bincount(of[count > 0], minlength=docs)
                    met = np.flatnonzero(sums)  # documents with a word in this bucket
                    out.append((0, 2, r[2], sums[met].tobytes(), _planes(np.diff(met, prepend=0)) + _planes(known[met]), None, None))
            if out:
                yield _rows(out)
        textbuf.give_back()

    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    names = [x.split()[0] for x in result.split(", ")]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, stats = None, [], np.zeros((0, 6))

        def done():
            bits = -stats[:, 4] * np.log2(10) / np.maximum(stats[:, 5], 1)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(stats[:, 0] > 0), pa.array(stats[:, 1].astype(np.int64)), pa.array(stats[:, 2].astype(np.int64)), pa.array(np.full(len(ids), n)), pa.array(stats[:, 3]), pa.array(stats[:, 4]), pa.array(bits)], names)

        for b in batches:
            for r in _each_row(b):
                if r[1] == 1:
                    if now is not None:
                        yield done()
                    now, ids, stats = r[2], r[5], np.array(r[6]).reshape(-1, 6)
                else:
                    at = np.cumsum(_from_planes(r[4][: len(r[4]) // 2]).astype(np.int64))
                    stats[at, 3] += np.frombuffer(r[3])
                    stats[at, 2] += _from_planes(r[4][len(r[4]) // 2 :])
        if now is not None:
            yield done()

    sent = own.select("doc_id", (~may).alias("held_out"), "text").mapInArrow(measure, COUNTS)
    met = tokens.union(sent).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(look_up, COUNTS)
    return met.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(total, result)
