"""Chat formatting by token-level assembly.

Each turn is encoded by itself and its parts spliced between reserved ids, which no text can
produce; the rendered form marks turns with control strings, and those occurring inside texts are escaped
reversibly.  Loss masks and positions come from prefix sums over the reserved ids and the turns.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
OPEN, HEAD, COLON, CLOSE = "<turn>", "### ", ": ", "</turn>"
#: What a template writes between texts; inside texts a backslash goes behind the first character.
CONTROL = re.compile(r"\\|</?turn>|### |<\|[a-z_]+\|>")
#: Characters encoded together, characters after which a long text may be cut, and where: behind a letter, before a space and another letter.
BATCH, PIECE = 1_000_000, 100_000
SEAM = re.compile(r"[A-Za-z](?= [A-Za-z])")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """Inverse of :func:`escape`: a doubled backslash is one, any other goes."""
    return re.sub(r"\\(\\?)", r"\1", text)


class Format:
    """A tokenizer and the ids reserved behind its vocabulary."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.turn, self.answer, self.text, self.end = range(n := self.tokenizer.get_vocab_size(), n + 4)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of every text.  Long ones are cut before single spaces between words, where the tokenizer's words end anyway, so
        the ids are those of the whole; a text without such a place isn't cut."""
        pieces = []
        for i, t in enumerate(texts):
            at = 0
            while len(t) - at > PIECE and (seam := SEAM.search(t, at + PIECE)):
                pieces.append((i, t[at : seam.start() + 1]))
                at = seam.start() + 1
            pieces.append((i, t[at:]))
        out: list[list[int]] = [[] for _ in texts]
        at = 0
        while at < len(pieces):
            to, size = at + 1, len(pieces[at][1])
            while to < len(pieces) and size + len(pieces[to][1]) <= BATCH:
                size += len(pieces[to][1])
                to += 1
            for (i, _), e in zip(pieces[at:to], self.tokenizer.encode_batch([p for _, p in pieces[at:to]], add_special_tokens=False), strict=True):
                out[i] += e.ids
            at = to
        return out

    def decode(self, ids) -> str:
        return self.tokenizer.decode(list(ids), skip_special_tokens=False) if len(ids) else ""

    def segments(self, roles: list[str], texts: list[str], loss_role: str) -> list[list[int]]:
        heads, bodies = self.encode([escape(r) for r in roles]), self.encode([escape(t) for t in texts])
        return [[self.answer if r == loss_role else self.turn, *h, self.text, *b, self.end] for r, h, b in zip(roles, heads, bodies, strict=True)]

    def mask(self, ids: np.ndarray) -> np.ndarray:
        """True for tokens of a text in an answering turn: open by the running sums of reserved ids."""
        opens = (ids == self.answer) | (ids == self.turn)
        latest = np.maximum.accumulate(np.where(opens, np.arange(len(ids)), 0)) if len(ids) else np.zeros(0, int)
        in_text = np.cumsum(ids == self.text) - np.cumsum(ids == self.end) > 0
        return in_text & (ids[latest] == self.answer) & (ids < self.turn)

    def read(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """(role, text) of each turn, as they stand in the output, still escaped."""
        opens, splits, ends = (np.flatnonzero(x) for x in (((ids == self.turn) | (ids == self.answer)), ids == self.text, ids == self.end))
        return [(self.decode(ids[a + 1 : b]), self.decode(ids[b + 1 : c])) for a, b, c in zip(opens, splits, ends, strict=True)]


def _vocabulary(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:  # a parameter on the driver; executors get its content
        return spark.sparkContext.broadcast(f.read())


def format_turns(turns: DataFrame, *, vocabulary: str = VOCABULARY, loss_role: str = "assistant") -> DataFrame:
    """One row per row of ``turns`` (conv_id, turn, role, text; other columns are ignored): conv_id, turn, ids, mask.

    ``ids`` is the turn's part of the conversation's token sequence, ``mask`` tells which of them count
    for the loss.  Null role or text: empty.  Turns encode independently, so a conversation of any length is
    spread over tasks; a very long text is one turn of one task, encoded piece by piece to the ids of the whole.  Repeated rows: each its own.
    Ties: rows are independent.  Empty table: empty result.
    """
    held = _vocabulary(turns.sparkSession, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = Format(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                roles, texts = ([x or "" for x in b.column(c).to_pylist()] for c in (2, 3))
                ids = [np.asarray(x, np.int32) for x in form.segments(roles, texts, loss_role)]
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.concatenate(ids)
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x) for x in (pa.array(flat, pa.int32()), pa.array(np.concatenate([form.mask(x) for x in ids])))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["conv_id", "turn", "ids", "mask"])

    slim = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return slim.mapInArrow(encode, "conv_id long, turn long, ids array<int>, mask array<boolean>")


def positions(formatted: DataFrame, block: int = 64) -> DataFrame:
    """Add ``start``, the position of each turn's first token in its conversation, by prefix sums.

    A conversation is summed in blocks of turns, so a long one isn't one task.  Turns with equal numbers follow their ids; null turns come first.
    """
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    rows = formatted.withColumn("_c", conv).withColumn("_b", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62)))).withColumn("_n", F.size("ids").cast("long"))
    each = rows.groupBy("_c", "_b").agg(F.sum("_n").alias("_s"))
    before = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("_c", "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_at"))
    inside = Window.partitionBy("_c", "_b").orderBy(F.col("turn").asc_nulls_first(), "ids").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(each, ["_c", "_b"])
    return rows.withColumn("start", F.col("_at") + F.col("_in")).drop("_c", "_b", "_n", "_at", "_in")


def read_back(formatted: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Digests of each conversation, read from its ids and masks alone: one row per conv_id.

    The digests run over a conversation's turns in order, so those pass one by one through a single
    task, which holds one turn at a time; encoding, the dear part, is done before.  Rows with a null conv_id form one conversation.
    Turns of equal number, repeated rows among them, follow in the order of their ids.  Empty table: empty result.
    """
    held = _vocabulary(formatted.sparkSession, vocabulary)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, now, out = Format(held.value), None, []

        def done():
            return [now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]]

        def flush():
            rows = [out.pop(0) for _ in range(len(out))]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k in (2, 4) else pa.int64()) for k in range(6)], names)

        for b in batches:
            for conv, ids, mask in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(done())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = ids.values.to_numpy()
                for role, text in form.read(ids):
                    now[1] += 1
                    now[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    now[5] += len(f"{OPEN}{HEAD}{role}{COLON}{text}{CLOSE}\n")
                loss = unescape(form.decode(ids[mask.values.to_numpy(zero_copy_only=False)]))
                now[3] += len(loss)
                now[4].update(loss.encode())
            if len(out) >= 1000:
                yield flush()
        if now is not None:
            out.append(done())
        if out:
            yield flush()

    dealt = formatted.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "ids")
    return dealt.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def render(turns: DataFrame) -> DataFrame:
    """The text form of each turn: conv_id, turn, formatted; what ``formatted_chars`` counts.

    The escape is done by Spark's own expressions, to the same effect as :func:`escape`.
    """

    def escaped(c: str):
        out = F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\"))
        return F.regexp_replace(F.regexp_replace(out, r"<(/?turn>|\|[a-z_]+\|>)", r"<\\$1"), "#(## )", r"#\\$1")

    return turns.select("conv_id", "turn", F.concat(F.lit(OPEN + HEAD), escaped("role"), F.lit(COLON), escaped("text"), F.lit(CLOSE + "\n")).alias("formatted"))
