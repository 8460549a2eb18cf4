"""Whole batches of texts as numpy arrays: bytes, word bounds and word hashes, without a loop over words.

Words are the runs between the six ASCII white-space bytes, as ``bytes.split()`` finds them.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        n = max(n, 2 * SEGMENT)
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a hash so that all its bits depend on all of its input's."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def texts_of(column: pa.Array, lower: bool = True) -> list[bytes]:
    """UTF-8 bytes of a string column, A-Z lowered, null as empty."""
    out = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
    return [x.lower() for x in out] if lower else out


def chunks(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most so many bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most_bytes, "right")))
            yield batch.slice(at, n)
            at += n


def give_back() -> None:
    """Return freed memory to the system; Python workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    word = np.empty(len(data) + 2, bool)
    word[0] = word[-1] = False
    word[1:-1] = ~_SPACE[data]
    change = np.flatnonzero(word[1:] != word[:-1])
    return change[::2], change[1::2]


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a polynomial before each byte (one more at the end), and the factors that make spans comparable wherever they start."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    sums, down = prefix_sums(data)
    return mix((sums[ends] - sums[starts]) * down[starts])


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's begin (one more at the end).

    Works through segments of a bounded number of bytes that end between words.
    """
    blob = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    lengths = np.cumsum([len(t) + 1 for t in texts])
    out, firsts, at = [], [], 0
    while at < len(blob):
        end = min(at + SEGMENT, len(blob))
        while end < len(blob):
            gap = np.flatnonzero(_SPACE[blob[end : end + SEGMENT]])
            if len(gap):
                end += int(gap[0]) + 1
                break
            end = min(end + SEGMENT, len(blob))
        part = blob[at:end]
        starts, ends = bounds(part)
        out.append(span_hashes(part, starts, ends))
        firsts.append(starts + at)
        at = end
    firsts_all = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.searchsorted(firsts_all, lengths)]).astype(np.int64)


_STEP = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25)]


def short_runs(rows: np.ndarray) -> np.ndarray:
    """Hashes of runs of words fewer than a shingle, one run a row; runs of different lengths differ."""
    k = rows.shape[1]
    steps = np.array([_STEP[j % 8] for j in range(k)], np.uint64)
    return mix((rows * steps + np.arange(k, dtype=np.uint64)).sum(1, dtype=np.uint64) + np.uint64(k))


def shingle_sets(hashes: np.ndarray, begins: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``k`` words; with fewer words its whole sequence as one."""
    n = max(0, len(hashes) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled += hashes[j : j + n] * _STEP[j % 8] + np.uint64(j)
    rolled = mix(rolled)
    out = []
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(short_runs(hashes[a:b][None]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
