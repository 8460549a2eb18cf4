"""Packing of tokenized documents into windows by multiway differencing.

Whole windows of long documents stand alone.  The rests are dealt at random to groups; within one, partial partitions (one
sum per window) are merged two at a time, always those of the largest imbalance, the fullest window of one with the emptiest of the other.
If the fullest window comes out above capacity, the group gets one window more.
"""

from __future__ import annotations

import heapq
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmat.llm.chat import VOCABULARY
from quillmat.llm.common import stored
from quillmat.llm.textbuf import chunks

WINDOW, END = 2048, 1
#: Rests are cut into pieces of so many tokens, since small ones even out; a group fills about so many windows.
PIECE, GROUP = 512, 256
#: Words and parts of words that a Python worker remembers (twice as many for a while), and their longest length.
WORDS, WORD = 500_000, 48
#: A space beside other white space isn't the start of a word of its own.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Letters, digits and white space up to the last code point that the short way knows, and what a byte-level vocabulary splits such text into before it merges.
_LAST = "ɏ"
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", r"0-9\xb2\xb3\xb9\xbc-\xbe", r" \t-\r\x85\xa0"
_PARTS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_L}{_N}{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def _letters() -> dict[int, str]:
    """The letters that stand for the bytes of a code point: printable bytes for themselves, the others for those from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in printed)
    of = {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(others)}
    return {c: "".join(of[b] for b in chr(c).encode()) for c in range(ord(_LAST) + 1)}


_LETTERS = _letters()
_encoders: dict[int, Encoder] = {}


class Memory(dict):
    """Values by word.  A full one is set aside; what is asked for again comes back from there, the rest goes with the next one."""

    def __init__(self):
        super().__init__()
        self.aside: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self) > WORDS:
            self.aside = dict(self)
            self.clear()

    def __missing__(self, word: str) -> bytes:
        self[word] = value = self.aside[word]
        return value


class Encoder:
    """Ids of texts, as little-endian bytes.

    Byte-level vocabularies split a text before every single space between characters that aren't white space, so what lies between two such
    spaces is encoded alone, and once.  Of a new word in Latin letters the parts that merges never cross are encoded alone, too.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.words, self.parts = Memory(), Memory()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _merged(self, part: str) -> bytes:
        try:
            return self.parts[part]
        except KeyError:
            ids = [k.id for k in self.tokenizer.model.tokenize(part.translate(_LETTERS))]
            self.parts[part] = value = struct.pack(f"<{len(ids)}I", *ids)
            return value

    def _encoded(self, texts: list[str]) -> list[bytes]:
        self.parts.turn()
        out = [b"".join(map(self._merged, _PARTS.findall(t))) if len(t) <= WORD and (t.isascii() or max(t) <= _LAST) else None for t in texts]
        others = iter(self._whole([t for t, b in zip(texts, out, strict=True) if b is None]))
        return [next(others) if b is None else b for b in out]

    def encode(self, texts: list[str]) -> list[bytes]:
        words = self.words
        words.turn()
        split = [t.split(" ") for t in texts]
        fresh = [w for w in set().union(*[s[1:] for s in split]) if w not in words]
        unclean = {w for w in fresh if not w or w[0].isspace() or w[-1].isspace()}
        if unclean or any(not s[0] or s[0][-1].isspace() for s in split):
            split = [_CUT.split(t) if not s[0] or s[0][-1].isspace() or not unclean.isdisjoint(s[1:]) else s for t, s in zip(texts, split, strict=True)]
            fresh = [w for w in set().union(*[s[1:] for s in split]) if w not in words]
        fresh = [w for w in fresh if w not in words.aside]
        words.update(zip(fresh, self._encoded([" " + w for w in fresh]), strict=True))
        heads = self._encoded([s[0] for s in split])
        out = [head + b"".join(map(words.__getitem__, s[1:])) for head, s in zip(heads, split, strict=True)]
        for w in fresh:
            if len(w) > WORD:
                del words[w]
        return out


def encoder(vocabulary: str) -> Encoder:
    """One per Python worker, which keeps its words from task to task."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item, by largest differencing over partitions of ``windows`` sums.

    Partitions hold their sums falling; those of few items only the positive ones.  Merges are recorded and opened again from the last to the items.
    """
    sums = [np.array([s], np.int64) for s in sizes]
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        width = min(windows, len(sums[a]) + len(sums[b]))
        both = np.zeros(width, np.int64)
        both[: len(sums[a])] = sums[a]
        both[width - len(sums[b]) :] += sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        if width == windows:
            both -= both[-1]
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-int(both[0]), len(sums)))
        merges.append((len(sums), a, b, order))
        sums.append(both)
    # places[m]: the window of each of a partition's sums, in their order
    places = {heap[0][1]: np.arange(windows)} if heap else {}
    for m, a, b, order in reversed(merges):
        place = places.pop(m)
        slots = np.empty(len(order), np.int64)
        slots[order] = place[: len(order)]
        places[a], places[b] = np.append(slots, place[len(order) :]), np.append(slots[::-1], place[len(order) :])
    return np.array([places[i][0] for i in range(len(sizes))], np.int64)


def windows_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, none above ``capacity``: as few windows as the total allows, and one more as long as one is too full."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, windows)
        if not len(sizes) or np.bincount(window, sizes).max() <= capacity:
            return window
        windows += 1


_FIELDS = ["at", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def pieces(docs: DataFrame, *, vocabulary: str = VOCABULARY, end: int = END, window: int = WINDOW, piece: int = PIECE, ids: bool = False) -> DataFrame:
    """The pieces that documents are cut into: at (a number of its own for each), doc_id, start, length, ids_crc32, doc_tokens, and with ``ids`` the ids as bytes."""
    with open(vocabulary, encoding="utf-8") as f:  # a parameter on the driver; executors get its content
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    names = [*_FIELDS, *(["ids"] if ids else [])]
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, at = encoder(held.value), TaskContext.get().partitionId() << 40
        for batch in chunks(batches, 1):
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), code.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                data += last
                n = len(data) // 4
                whole = n - n % window
                for a in [*range(0, whole, window), *range(whole, n, piece)]:
                    part = data[4 * a : 4 * min(a + (window if a < whole else piece), n)]
                    rows.append((at, doc_id, a, len(part) // 4, zlib.crc32(part), n, part))
                    at += 1
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:6]], *([pa.array(columns[6], pa.binary())] if ids else [])], names)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(cut, ", ".join(f"{n} long" for n in _FIELDS) + (", ids binary" if ids else ""))


def pack(docs: DataFrame, *, window: int = WINDOW, group: int = GROUP, **options) -> DataFrame:
    """One row per piece of every row of ``docs`` (doc_id, text; other columns are ignored): doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset; with ``ids=True`` also the piece's ids.

    A document is its ids and an end id; it is cut into whole windows, each a sequence of its own, and a rest in
    pieces, which :func:`windows_of` packs within random groups of about ``group`` windows.  So a task holds one group whatever the corpus, and documents
    alike, however many, fall into all groups.  sequence_id tells sequences apart, offset is the piece's first place there.

    Null or empty text: the end id alone.  Null or repeated doc_ids, equal rows: each row is a document.  Very long texts: many sequences.
    Equal lengths: by the pieces' numbers.  Empty table: empty result.
    """
    cut = stored(pieces(docs, window=window, **options))
    whole = cut.filter(F.col("length") == window)
    rest = cut.filter(F.col("length") < window)
    total = rest.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (window * group)))

    def fill(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("at")
        length = batch.column("length").to_numpy()
        own = windows_of(length, window)
        order = np.argsort(own, kind="stable")
        ends = np.cumsum(length[order])
        firsts = np.searchsorted(own[order], own[order])
        offset = np.empty(len(own), np.int64)
        offset[order] = ends - length[order] - (ends - length[order])[firsts]
        number = batch.column("group").to_numpy().astype(np.int64)
        return batch.drop_columns(["at", "group"]).append_column("sequence_id", pa.array(number << 24 | own)).append_column("offset", pa.array(offset))

    carried = [c for c in cut.columns if c != "at"]
    kinds = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in carried)
    packed = rest.withColumn("group", F.pmod(F.xxhash64("at"), F.lit(groups))).groupBy("group").applyInArrow(fill, f"{kinds}, sequence_id long, offset long")
    alone = whole.select(*carried, F.col("at").bitwiseOR(F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def sequences(packed: DataFrame, *, window: int = WINDOW, pad: int = 50_256) -> DataFrame:
    """(sequence_id, tokens, ids): the sequences of ``pack(..., ids=True)``, padded to the window unless their length is a power of two."""

    def join(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("offset")
        ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u4").astype(np.int32)
        n = len(ids)
        full = ids if n & (n - 1) == 0 else np.append(ids, np.full(window - n, pad, np.int32))
        return pa.table({"sequence_id": batch.column("sequence_id")[:1], "tokens": pa.array([n], pa.int32()), "ids": pa.array([full], pa.list_(pa.int32()))})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id long, tokens int, ids array<int>")
