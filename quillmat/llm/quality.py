"""Quality scores of documents: gradient-boosted trees over statistics of the whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmat.llm import boosting, textbuf
from quillmat.llm.common import stored

CLASSES = ("upper", "lower", "digit", "beyond_ascii", "space", "newline", "stop", "comma", "quote", "symbol")
_KIND = np.full(256, CLASSES.index("symbol"), np.uint8)
for _name, _set in (
    ("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("beyond_ascii", range(128, 256)),
    ("space", (9, 11, 12, 13, 32)), ("newline", (10,)), ("stop", b".!?"), ("comma", b",;:"), ("quote", b"'\"()-"),
):
    _KIND[list(_set)] = CLASSES.index(_name)
FEATURES = (*(f"share_{c}" for c in CLASSES), "log_bytes", "log_words", "mean_word", "sd_word", "distinct_words", "top_word", "same_as_before", "distinct_pairs", "distinct_lines", "log_lines", "words_a_line", "words_a_stop", "upper_words", "symbol_words")


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per text (bytes as they stand); all 0 but for defaults where a text is empty."""
    out = np.zeros((len(texts), len(FEATURES)))
    at = {f: i for i, f in enumerate(FEATURES)}
    hashes, begins = textbuf.words(texts)
    for i, t in enumerate(texts):
        data = np.frombuffer(t, np.uint8)
        n = max(len(data), 1)
        kinds = np.bincount(_KIND[data], minlength=len(CLASSES))
        out[i, : len(CLASSES)] = kinds / n
        w = hashes[begins[i] : begins[i + 1]]
        m = len(w)
        out[i, at["log_bytes"]], out[i, at["log_words"]] = np.log1p(len(data)), np.log1p(m)
        lines = t.split(b"\n")
        out[i, at["log_lines"]], out[i, at["distinct_lines"]] = np.log1p(len(lines)), len(set(lines)) / len(lines)
        out[i, at["words_a_line"]] = m / len(lines)
        out[i, at["words_a_stop"]] = min(m / (1 + kinds[CLASSES.index("stop")]), 1000)
        if m:
            starts, ends = textbuf.bounds(data)
            size = ends - starts
            _, counts = np.unique(w, return_counts=True)
            last = _KIND[data[ends - 1]]
            out[i, at["mean_word"]], out[i, at["sd_word"]] = size.mean(), size.std()
            out[i, at["distinct_words"]], out[i, at["top_word"]] = len(counts) / m, counts.max() / m
            out[i, at["same_as_before"]] = np.count_nonzero(w[1:] == w[:-1]) / m
            out[i, at["distinct_pairs"]] = len(np.unique(w[1:] * np.uint64(3) + w[:-1])) / max(m - 1, 1)
            out[i, at["upper_words"]] = np.count_nonzero(_KIND[data[starts]] == 0) / m
            out[i, at["symbol_words"]] = np.count_nonzero(last == CLASSES.index("symbol")) / m
    return out


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the doc_id as text, modulo ``of``; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of


def score_quality(docs: DataFrame, labels: DataFrame, *, learns: Column | None = None, most_rows: int = 20_000, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted; other columns are ignored.

    The trees are fitted to the labels of at most ``most_rows`` labelled documents, those of least hash; ``learns``, a condition on
    doc_id, says which may be used (default: crc32 of doc_id modulo 3 is not 1), and held_out is its opposite.  ``labels`` has doc_id
    and quality (0 or 1; null: no label; several rows: their rounded mean).  Scores depend on the text alone.

    Null or empty text: scored like any other, from its zero statistics.  Very long texts: measured whole.  Ties: equal statistics score
    alike; of documents with equal hashes any may be fitted last.  Null doc_id: never labelled.  Repeated rows: the same scores.
    No usable label: 0.5 everywhere.  Empty table: empty result.
    """
    spark = docs.sparkSession
    may = remainder(F.col("doc_id"), 3) != 1 if learns is None else learns

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textbuf.chunks(batches, 1):
            x = statistics(textbuf.texts_of(b.column(1), lower=False))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "x"])

    measured = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(measure, "doc_id long, x array<double>"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).filter("quality is not null and doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.round(F.avg("quality")).alias("y"))
    known = measured.filter(may).join(marks, "doc_id").select(F.xxhash64("doc_id").alias("h"), "x", "y")
    rows = known.orderBy("h").limit(most_rows).select("x", "y").toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    model = spark.sparkContext.broadcast(boosting.fit(x, np.array(rows["y"].to_pylist(), float), **options))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.value.probability(b.column(2).values.to_numpy().reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return measured.select("doc_id", (~may).alias("held_out"), "x").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
