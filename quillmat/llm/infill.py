"""Fill-in-middle by a parallel scan of an automaton over the texts.

A byte acts on the automaton's states as a function.  Those functions and all their compositions are a small
monoid, so a chunk of text is summed up by one of its elements and, for each state it may be entered in, the number of units that
begin in it.  Summaries compose associatively: composing those before a chunk tells its entry state and the units
before it, so the chunk that holds a cut is known without reading the others again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmat.llm.common import bounded
from quillmat.llm.textbuf import chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts of more bytes are scanned in chunks of as many, by several tasks.
CHUNK = 1 << 16


class Automaton:
    """A deterministic automaton on classes of bytes, entered in state 0.

    ``follow[c][s]`` is the state after a byte of class ``c`` in state ``s``, ``begins[c][s]`` is 1 if a unit begins at that byte.
    """

    def __init__(self, classes: np.ndarray, follow: list[list[int]], begins: list[list[int]]):
        self.classes, self.kinds = np.asarray(classes, np.uint8), len(follow)
        states = range(len(follow[0]))
        # behind the classes, the same ones for the first byte of a text, which is in state 0 wherever the scan comes from
        maps = [tuple(f) for f in follow] + [(f[0],) * len(f) for f in follow]
        self.begins = np.array([*begins, *[[b[0]] * len(b) for b in begins]], np.int8)
        known = [tuple(states)]
        for f in maps:
            if f not in known:
                known.append(f)
        for f in known:  # grows while it is walked, until all compositions are known
            for g in list(known):
                for h in (tuple(g[f[s]] for s in states), tuple(f[g[s]] for s in states)):
                    if h not in known:
                        known.append(h)
        self.apply = np.array(known, np.uint8)
        self.function = np.array([known.index(f) for f in maps], np.uint8)
        self.compose = np.array([[known.index(tuple(g[f[s]] for s in states)) for g in known] for f in known], np.uint8)

    def codes(self, data: np.ndarray, firsts: np.ndarray | None = None) -> np.ndarray:
        """Classes of the bytes; those at ``firsts`` begin a text."""
        out = self.classes[data]
        if firsts is not None:
            out[firsts] += np.uint8(self.kinds)
        return out

    def before(self, functions: np.ndarray) -> np.ndarray:
        """What all functions in front of each one compose to: pairs are composed, scanned, and opened again."""
        n = len(functions)
        if n < 2:
            return np.zeros(n, np.uint8)
        even = functions if n % 2 == 0 else np.append(functions, np.uint8(0))
        left = even[::2]
        out = np.empty(len(even), np.uint8)
        out[::2] = self.before(self.compose[left, even[1::2]])
        out[1::2] = self.compose[out[::2], left]
        return out[:n]

    def starts(self, codes: np.ndarray, entry: int = 0) -> np.ndarray:
        """Positions of the bytes at which units begin."""
        return np.flatnonzero(self.begins[codes, self.apply[self.before(self.function[codes]), entry]])

    def summary(self, codes: np.ndarray) -> tuple[list[int], list[int]]:
        """For each state to enter in: the state after the last byte, and how many units begin."""
        if not len(codes):
            return list(range(self.apply.shape[1])), [0] * self.apply.shape[1]
        functions = self.function[codes]
        before = self.before(functions)
        counts = [int(self.begins[codes, self.apply[before, s]].sum()) for s in range(self.apply.shape[1])]
        return self.apply[self.compose[before[-1], functions[-1]]].tolist(), counts


def _byte_classes() -> np.ndarray:
    """0: an ASCII letter, 1: the first byte of any other code point, 2: a further byte of one."""
    out = np.ones(256, np.uint8)
    out[65:91] = out[97:123] = 0
    out[0x80:0xC0] = 2
    return out


#: Units are runs of ASCII letters and any other single code points; state 1 is inside a run.
UNITS = Automaton(_byte_classes(), [[1, 1], [0, 0], [0, 1]], [[1, 0], [1, 1], [0, 0]])
_FURTHER = 2


def _cuts(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
    """Number of units of each text, and code points before the units numbered by the smaller and the larger remainder."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    codes = UNITS.codes(data, offsets[:-1][offsets[1:] > offsets[:-1]])
    starts = np.append(UNITS.starts(codes), len(data))
    at = np.searchsorted(starts[:-1], offsets)
    n = np.diff(at)
    points = np.concatenate([[0], np.cumsum(codes % UNITS.kinds != _FURTHER)])
    a, b = first % (n + 1), second % (n + 1)
    cut = lambda k: points[np.where(k < n, starts[at[:-1] + k], offsets[1:])] - points[offsets[:-1]]
    return [n, cut(np.minimum(a, b)), cut(np.maximum(a, b))]


def _local(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    out, fields = [], ["units", "cut", "cut2"]
    table = pa.RecordBatch.from_arrays([texts.cast(pa.string()), first, second], ["t", "a", "b"])
    for part in chunks(iter([table]), 0):
        cuts = _cuts(part.column(0), *(part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2)))
        out.append(pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cuts], fields))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([(f, pa.int64()) for f in fields]))


_PARTS = ["key", "first", "second", "number", "part"]


def _split(chunk: int):
    """The chunks of whole texts, cut between code points and numbered."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            for row in range(batch.num_rows):
                data = memoryview(batch.column(1)[row].as_buffer())
                at, number, parts = 0, 0, []
                while at < len(data):
                    end = min(at + chunk, len(data))
                    while end < len(data) and data[end] & 0xC0 == 0x80:
                        end -= 1
                    parts.append(bytes(data[at:end]))
                    at = end
                    if len(parts) == 16 or at == len(data):
                        same = [pa.array([batch.column(k)[row].as_py()] * len(parts), batch.column(k).type) for k in (0, 2, 3)]
                        yield pa.RecordBatch.from_arrays([*same, pa.array(range(number, number + len(parts)), pa.int32()), pa.array(parts, pa.binary())], _PARTS)
                        number, parts = number + len(parts), []

    return split


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for part in batch.column("part"):
            codes = UNITS.codes(np.frombuffer(part.as_buffer(), np.uint8))
            rows.append((*UNITS.summary(codes), int((codes != _FURTHER).sum())))
        exits, counts, points = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in _PARTS[:-1]], pa.array(exits, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64())), pa.array(points, pa.int64())], [*_PARTS[:-1], "exits", "counts", "points"]
        )


def _select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Code points before the wanted unit of a chunk that is entered in a known state."""
    for batch in batches:
        found = []
        for part, entry, want in zip(batch.column("part"), batch.column("entry").to_pylist(), batch.column("want").to_pylist(), strict=True):
            codes = UNITS.codes(np.frombuffer(part.as_buffer(), np.uint8))
            found.append(int((codes[: UNITS.starts(codes, entry)[want]] != _FURTHER).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("which"), pa.array(found, pa.int64())], ["key", "which", "inside"])


def _distributed(giant: DataFrame, chunk: int) -> DataFrame:
    """(key, units, cut, cut2) of every distinct key of ``giant(key, text, first, second)``; its texts travel in chunks, and once."""
    parts = giant.select("key", F.col("text").cast("binary").alias("text"), "first", "second").mapInArrow(_split(chunk), "key binary, first long, second long, number int, part binary")
    # copies of a text, which may be many, come from several partitions; each deals to tasks of its own
    dealt = parts.withColumn("salt", F.spark_partition_id()).repartition("key", "number", "salt").drop("salt")
    sums = dealt.mapInArrow(_summaries, "key binary, first long, second long, number int, exits array<long>, counts array<long>, points long")
    sums = sums.groupBy("key", "number").agg(*[F.first(c).alias(c) for c in ("first", "second", "exits", "counts", "points")])  # copies agree
    whole = sums.groupBy("key").agg(F.first("first").alias("first"), F.first("second").alias("second"), F.sort_array(F.collect_list(F.struct("number", "exits", "counts", "points"))).alias("s"))
    # compose from the left: the entry state of every chunk, and the units and code points before it
    start = F.struct(F.lit(0).cast("long").alias("state"), F.lit(0).cast("long").alias("units"), F.lit(0).cast("long").alias("points"))
    after = lambda b, x: F.struct(F.get(x["exits"], b["state"].cast("int")).alias("state"), (b["units"] + F.get(x["counts"], b["state"].cast("int"))).alias("units"), (b["points"] + x["points"]).alias("points"))
    step = lambda acc, x: F.concat(acc, F.array(after(F.element_at(acc, -1), x)))
    whole = whole.withColumn("before", F.aggregate("s", F.array(start), step)).withColumn("units", F.element_at("before", -1)["units"]).withColumn("points", F.element_at("before", -1)["points"])
    a, b = (F.col(c) % (F.col("units") + 1) for c in ("first", "second"))
    whole = whole.withColumn("wants", F.array(F.least(a, b), F.greatest(a, b)))
    wants = whole.select("key", "units", "points", "before", F.posexplode("wants").alias("which", "unit"))
    # the last chunk before whose end the unit begins; a cut behind the last unit lies at the end of the text
    number = F.size(F.filter("before", lambda x: x["units"] <= F.col("unit"))) - 1
    wants = wants.withColumn("number", number).withColumn("b", F.get("before", F.col("number")))
    wants = wants.select("key", "which", "units", "points", "unit", "number", F.col("b.state").alias("entry"), (F.col("unit") - F.col("b.units")).alias("want"), F.col("b.points").alias("base"))
    inside = parts.join(bounded(wants.filter("unit < units").select("key", "number", "which", "entry", "want")), ["key", "number"])
    inside = inside.select("key", "which", "part", "entry", "want").mapInArrow(_select, "key binary, which int, inside long").groupBy("key", "which").agg(F.first("inside").alias("inside"))
    place = wants.join(inside, ["key", "which"], "left").withColumn("at", F.when(F.col("unit") < F.col("units"), F.col("base") + F.col("inside")).otherwise(F.col("points")))
    return place.groupBy("key").agg(F.first("units").alias("units"), F.min("at").alias("cut"), F.max("at").alias("cut2"))


def draws(doc_id: Column, salt: str = "1:") -> list[Column]:
    """Four uniform integers of 32 bits from a digest of the salt and the doc_id."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _rest_after(text: Column, mark: str) -> Column:
    return F.substring(text, F.instr(text, mark) + len(mark), F.lit((1 << 31) - 1))


def _until(text: Column, mark: str) -> Column:
    return F.substring(text, F.lit(1), F.instr(text, mark) - 1)


def restore(output: Column, form: Column) -> Column:
    """The exact text of an output of :func:`fill_in_middle`, from the output and its form alone."""
    head, tail = F.substring(output, F.lit(1 + len(PREFIX)), F.lit((1 << 31) - 1)), _rest_after(output, MIDDLE)
    psm = F.concat(_until(head, SUFFIX), tail, _until(_rest_after(head, SUFFIX), MIDDLE))
    spm = F.concat(_until(_rest_after(head, PREFIX), MIDDLE), tail, _until(head, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_in_middle(docs: DataFrame, *, percent: int = 90, spm_percent: int = 20, salt: str = "1:", chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n, form, prefix_chars, middle_chars, output.

    Units are runs of ASCII letters and other single code points; n is their number.  Two draws from doc_id choose the units at which
    the middle begins and ends, two more whether (``percent``) and in which order (``spm_percent``) the parts are written.  A text that holds a mark
    stays plain, as does an empty one; plain rows have null prefix_chars and middle_chars.

    Null text: empty.  Null doc_id: drawn from the word null.  Equal rows, or doc_ids: equal draws, a row each.  Empty table: empty result.
    Texts of up to ``chunk`` bytes are scanned where they are; of longer ones only chunks travel, to be summed up by
    several tasks, and the cuts come back to the text by a key of doc_id and text.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    first, second, third, fourth = draws(F.col("doc_id"), salt)
    own = own.withColumns({"first": first, "second": second, "third": third, "fourth": fourth})
    local = F.arrow_udf(_local, "units long, cut long, cut2 long")
    short = own.filter(F.octet_length("text") <= chunk).withColumn("c", local("text", "first", "second")).select("*", "c.*").drop("c")
    giant = own.filter(F.octet_length("text") > chunk).withColumn("key", F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5("text")))))
    long = giant.join(bounded(_distributed(giant, chunk)), "key").drop("key")
    met = short.unionByName(long)
    plain = (F.col("text") == "") | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE) | (F.col("third") % 100 >= percent)
    met = met.withColumn("form", F.when(plain, "plain").when(F.col("fourth") % 100 < spm_percent, "spm").otherwise("psm"))
    cut, cut2 = F.col("cut").cast("int"), F.col("cut2").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), cut), F.substring("text", cut + 1, cut2 - cut), F.substring("text", cut2 + 1, F.lit((1 << 31) - 1))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    shaped = lambda c: F.when(F.col("form") != "plain", c)
    return met.select(
        "doc_id", F.col("units").alias("n"), "form", shaped(F.col("cut")).alias("prefix_chars"), shaped(F.col("cut2") - F.col("cut")).alias("middle_chars"),
        F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"),
    )
