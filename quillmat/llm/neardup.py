"""Near-duplicate documents by a chosen-path set similarity join on word shingles.

Documents with equal shingle sets are one class from the start.  For the classes, independent
trees branch by minwise values: the first level by a full minwise hash per tree, further levels
by values that each crowded node chooses for itself.  Small nodes are compared exhaustively on
signatures, crowded leaves block by block around common pivots.  What looks alike is confirmed on the full sets: first
along spanning forests, then, where a cluster of lookalikes is still apart, all that share one of their rarest shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmat.llm import textbuf
from quillmat.llm.common import cut, digest, discard, same_row, stored
from quillmat.llm.components import components

COORDS = 128
_RNG = np.random.Generator(np.random.PCG64(20240229))
_SEEDS32 = (_RNG.integers(0, 1 << 32, COORDS, np.uint64) | np.uint64(1)).astype(np.uint32)
_XORS32 = _RNG.integers(0, 1 << 32, COORDS, np.uint64).astype(np.uint32)
_SEEDS64 = _RNG.integers(0, 1 << 63, 64, np.uint64)
PIVOTS = 16


def minwise(sets: list[np.ndarray], trees: int) -> tuple[np.ndarray, np.ndarray]:
    """For nonempty sets: 64-bit minima for the roots of the trees, and a byte for each coordinate of the signature."""
    roots, sig = np.zeros((len(sets), trees), np.uint64), np.zeros((len(sets), COORDS), np.uint8)
    sizes, at = np.array([len(s) for s in sets]), 0
    while at < len(sets):  # pieces that fit the cache
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 1 << 15, "right")))
        h = np.concatenate(sets[at : at + n])
        starts = np.concatenate([[0], np.cumsum(sizes[at : at + n])[:-1]])
        low = (h >> np.uint64(32)).astype(np.uint32)
        for i in range(COORDS):
            m = np.minimum.reduceat((low ^ _XORS32[i]) * _SEEDS32[i], starts)
            sig[at : at + n, i] = (m * np.uint32(0x9E3779B1)) >> np.uint32(24)
        for t in range(trees):
            roots[at : at + n, t] = np.minimum.reduceat(textbuf.mix(h ^ _SEEDS64[t]), starts)
        at += n
    return roots, sig


def set_key(s: np.ndarray) -> bytes:
    """Sixteen bytes that only equal sets share, but for accidents of 128 bits."""
    return np.array([s.sum(dtype=np.uint64), textbuf.mix(s ^ _SEEDS64[63]).sum(dtype=np.uint64)], np.uint64).tobytes()


def sketches(docs: DataFrame, shingle: int, trees: int) -> DataFrame:
    """doc_id, n_shingles, sid (16 bytes that equal sets share; null for an empty set), roots and sig of every whole text, and its digest."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textbuf.chunks(batches, 1):
            sets = textbuf.shingle_sets(*textbuf.words(textbuf.texts_of(b.column(1))), shingle)
            full = [s for s in sets if len(s)]
            roots, sig = minwise(full, trees) if full else (np.zeros((0, trees), np.uint64), np.zeros((0, COORDS), np.uint8))
            sids, rs, ss, k = [], [], [], 0
            for s in sets:
                if len(s):
                    sids.append(set_key(s))
                    rs.append(roots[k].view(np.int64))
                    ss.append(sig[k].tobytes())
                    k += 1
                else:
                    sids.append(None)
                    rs.append(np.zeros(0, np.int64))
                    ss.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sids, pa.binary()), pa.array(rs, pa.list_(pa.int64())), pa.array(ss, pa.binary()), *b.columns[2:]],
                ["doc_id", "n_shingles", "sid", "roots", "sig", *b.schema.names[2:]],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), digest().alias("digest"))
    return slim.mapInArrow(sketch, "doc_id long, n_shingles long, sid binary, roots array<long>, sig binary, digest binary")


def _leaves(classes: DataFrame, limit: int, depth: int) -> DataFrame:
    """(node, sid, members): the leaves of all trees that hold at least two classes.

    A node of more than ``limit`` classes branches, at most ``depth`` times, by two coordinates that it chooses itself.
    """
    level = classes.select(F.posexplode("roots").alias("t", "r"), "sid").select(F.xxhash64("t", "r").alias("node"), "sid")
    leaves = None
    for d in range(depth + 1):
        # counted apart from the join, whose crowded nodes Spark can then split
        counts = cut(level.groupBy("node").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
        level = cut(level.join(counts, "node"))
        done = level if d == depth else level.filter(F.col("members") <= limit)
        leaves = done if leaves is None else leaves.union(done)
        crowded = level.filter(F.col("members") > limit)
        if d == depth or not crowded.head(1):
            break
        own = crowded.select("node", "sid").join(classes.select("sid", "sig"), "sid")
        paths = own.select("node", "sid", "sig", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
        coord = F.pmod(F.xxhash64("node", "j", F.lit(d)), F.lit(COORDS))
        value = F.expr("substring(sig, cast(_c as int) + 1, 1)")
        level = paths.withColumn("_c", coord).select(F.xxhash64("node", "j", F.lit(d), value).alias("node"), "sid")
    return leaves


def _alike(sig: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray, least: int, percent: int) -> np.ndarray:
    """How many coordinates agree, -1 where that or the sizes rule a link out: rows of ``sig`` against rows of ``other``."""
    out = np.full((len(sig), len(other)), -1, np.int16)
    for i in range(len(sig)):
        agree = np.count_nonzero(other == sig[i], axis=1)
        fits = (agree >= least) & (100 * np.minimum(m, n[i]) >= percent * np.maximum(m, n[i]))
        out[i, fits] = agree[fits]
    return out


def _forest(score: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of largest scores (Prim's method); -1 is no edge."""
    left, out, n = np.ones(len(score), bool), [], len(score)
    best, parent = np.full(n, -1, np.int32), np.full(n, -1)
    for _ in range(n):
        k = int(np.argmax(np.where(left, best, -2)))
        left[k] = False
        if best[k] >= 0:
            out.append((int(parent[k]), k))
        better = left & (score[k] > best)
        best[better], parent[better] = score[k][better], k
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole groups from batches sorted by the first ``keys`` columns, with the groups' starts and ends."""
    held: list[pa.RecordBatch] = []

    def split(last: bool):
        t = pa.Table.from_batches(held).combine_chunks()
        k = [np.array(t.column(c).to_pylist(), object) if pa.types.is_binary(t.schema.types[c]) else t.column(c).to_numpy() for c in range(keys)]
        new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1
        starts = np.concatenate([[0], new])
        whole = len(starts) if last else len(starts) - 1
        held[:] = [] if last else t.slice(int(starts[-1])).to_batches()
        ends = np.concatenate([starts[1:], [t.num_rows]])
        return t, starts[:whole], ends[:whole]

    for b in batches:
        if b.num_rows:
            held.append(b)
            if sum(x.num_rows for x in held) >= 2048:
                t, starts, ends = split(False)
                if len(starts):
                    yield t, starts, ends
    if held:
        yield split(True)


def _bytes(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


PAIRS = "a binary, b binary"


def _pairs_batch(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])


def _candidates(leaves: DataFrame, sigs: DataFrame, limit: int, least: int, percent: int) -> DataFrame:
    """Pairs along a spanning forest of what looks alike in every leaf.

    A leaf of more than ``limit`` classes is cut into blocks by hash; some pivots, drawn by hash too, join every block.
    """
    blocks = F.when(F.col("members") <= limit, 1).otherwise(F.ceil(F.col("members") / limit * 2)).cast("int")
    rows = leaves.join(sigs, "sid").withColumn("blocks", blocks)
    own = rows.select("node", F.pmod(F.xxhash64("sid", "node"), "blocks").cast("int").alias("block"), "sid", "sig", "n_shingles")
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("sid", "node", F.lit("pivot")), "members") < PIVOTS)
    pivots = rows.filter(pivot).select("node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "sid", "sig", "n_shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for t, starts, ends in _groups(batches, 2):
            sid, sig, n = t.column(2).to_pylist(), _bytes(t.column(3), COORDS), t.column(4).to_numpy()
            out = []
            two = starts[ends - starts == 2]
            if len(two):
                a, b = n[two], n[two + 1]
                fits = (np.count_nonzero(sig[two] == sig[two + 1], axis=1) >= least) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
                out += [(i, i + 1) for i in two[fits]]
            for s, e in zip(starts, ends, strict=True):
                if e - s > 2:
                    out += [(s + i, s + j) for i, j in _forest(_alike(sig[s:e], n[s:e], sig[s:e], n[s:e], least, percent))]
            pairs = {(sid[i], sid[j]) if sid[i] < sid[j] else (sid[j], sid[i]) for i, j in out if sid[i] != sid[j]} - seen
            if len(seen) < 1_000_000:
                seen |= pairs
            if pairs:
                yield _pairs_batch(list(pairs))

    dealt = own.union(pivots).repartition("node", "block").sortWithinPartitions("node", "block")
    return dealt.mapInArrow(compare, PAIRS).distinct()


def _crossing(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all ``xs`` with all ``ys``: products of their incidence matrices, some shared hashes at a time."""
    flat = np.concatenate([*xs, *ys])
    own = np.repeat(np.arange(len(xs) + len(ys)), [len(s) for s in (*xs, *ys)])
    column, count = np.unique(flat, return_inverse=True, return_counts=True)[1:]
    common = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[common] = np.arange(len(common))
    column = place[column]
    out = np.zeros((len(xs), len(ys)), np.float32)
    order = np.argsort(column, kind="stable")
    column, own = column[order], own[order]
    for at in range(0, len(common), 8192):
        lo, hi = np.searchsorted(column, [at, min(at + 8192, len(common))])
        m = np.zeros((len(xs) + len(ys), min(8192, len(common) - at)), np.float32)
        m[own[lo:hi], column[lo:hi] - at] = 1
        out += m[: len(xs)] @ m[len(xs) :].T
    return out


#: Counters by which shingles are ordered from rare to common; accidents only make the order a little worse.
COUNTERS = 1 << 20


def _prefixes(members: DataFrame, percent: int) -> DataFrame:
    """(node, sid, root, n): of each set in ``members(sid, root, set)`` its rarest shingles, as many as a similar set can't all lack.

    Two sets of the threshold share one of these if both follow one order.  The order is by a fixed table of hashed counts over all members, 4 MB in
    all.  Shingles that no other set can have are left out.
    """
    spark = members.sparkSession
    place = lambda h: ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
    block = 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for s in b.column(0).to_pylist():
                np.add.at(table, place(np.frombuffer(s, np.uint64)), 1)
        if table.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(COUNTERS // block, dtype=np.int32)), pa.array([x.tobytes() for x in table.reshape(-1, block)], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    kind = "block int, counts binary"
    table = np.zeros((COUNTERS // block, block), np.int32)
    for row in members.select("set").mapInArrow(count, kind).repartition("block").mapInArrow(add, kind).toLocalIterator():
        table[row["block"]] = np.frombuffer(row["counts"], np.int32)
    held = spark.sparkContext.broadcast(table.ravel())

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        for b in batches:
            for sid, root, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                h = np.frombuffer(raw, np.uint64)
                n = counts[place(h)]
                order = np.lexsort((h, n))[: len(h) - -(-percent * len(h) // 100) + 1]
                order = order[n[order] > 1]
                if len(order):
                    yield pa.RecordBatch.from_arrays([pa.array(h[order].view(np.int64)), *[pa.array([x] * len(order), pa.binary()) for x in (sid, root)], pa.array(np.full(len(order), len(h)))], ["node", "sid", "root", "n"])

    return members.select("sid", "root", "set").mapInArrow(rarest, "node long, sid binary, root binary, n long")


def _apart(pairs: DataFrame, crowded: DataFrame, roots: DataFrame) -> DataFrame:
    """(sid, root): the classes that may have links not found yet.

    These are the clusters of what looks alike, directly or over others, and the leaves ``crowded(node, sid)`` that were only compared in blocks,
    as far as they hold several components.
    """
    clusters = components(pairs).select(F.col("root").alias("cluster"), F.col("node").alias("sid"))
    both = clusters.union(crowded.select(F.xxhash64("node").cast("string").cast("binary"), "sid"))
    rows = cut(both.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid")))
    mixed = rows.groupBy("cluster").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a <> _b").select("cluster")
    return rows.join(mixed, "cluster").select("sid", "root").distinct()


def _between(members: DataFrame, sets: DataFrame, limit: int, percent: int) -> DataFrame:
    """All links between different components of ``members(sid, root)``, or as many as connect them.

    Members meet where they share one of their rarest shingles (see ``_prefixes``): in groups of up to ``limit`` those of
    different components as candidates for ``confirm``.  Larger groups, of sets that have hardly a shingle of their own, are joined to families and these
    compared on full sets, chunk by block, all outside a family's largest component with all members; of the links found in a
    chunk and block those are returned that connect something.
    """
    shared = cut(_prefixes(members.join(sets, "sid"), percent))
    groups = shared.groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a <> _b").select("node", "members")
    met = cut(shared.join(cut(groups), "node"))  # counted apart, so that Spark may split a crowded group

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts, ends in _groups(batches, 1):
            sid, root, n = t.column(1).to_pylist(), t.column(2).to_pylist(), t.column(3).to_numpy()
            found = set()
            for s, e in zip(starts, ends, strict=True):
                number = {r: k for k, r in enumerate(dict.fromkeys(root[s:e]))}
                of, size = np.array([number[r] for r in root[s:e]]), n[s:e]
                may = (of[:, None] < of[None]) & (100 * np.minimum(size[:, None], size[None]) >= percent * np.maximum(size[:, None], size[None]))
                found |= {(sid[s + i], sid[s + j]) if sid[s + i] < sid[s + j] else (sid[s + j], sid[s + i]) for i, j in zip(*np.nonzero(may), strict=True)}
            if found:
                yield _pairs_batch(list(found))

    small = met.filter(F.col("members") <= limit).select("node", "sid", "root", "n").repartition("node").sortWithinPartitions("node")
    links = confirm(cut(small.mapInArrow(cross, PAIRS).distinct()), sets, percent)
    large = met.filter(F.col("members") > limit)
    if not large.head(1):
        return links
    # sets that share such a group, directly or over others, are compared once, in however many groups they meet
    families = components(large.select(F.col("sid").alias("a"), F.concat(F.lit("shingle "), F.col("node").cast("string")).cast("binary").alias("b")))
    rows = large.select("sid", "root").distinct().join(families.select(F.col("node").alias("sid"), F.col("root").alias("cluster")), "sid")
    return links.union(_compared(cut(rows), sets, 2 * limit, percent))


def _compared(rows: DataFrame, sets: DataFrame, limit: int, percent: int) -> DataFrame:
    """Links between components of each cluster in ``rows(cluster, sid, root)``, from comparing full sets."""
    per = rows.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("k"))
    mixed = per.groupBy("cluster").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("members"), (F.sum("k") - F.max("k")).alias("others"))
    rows = rows.join(mixed, "cluster").withColumn("blocks", F.ceil(F.col("members") / limit).cast("int")).withColumn("chunks", F.ceil(F.col("others") / limit).cast("int"))
    rows = rows.join(sets, "sid")
    block, chunk = F.pmod(F.xxhash64("sid", F.lit("b")), "blocks").cast("int"), F.pmod(F.xxhash64("sid", F.lit("c")), "chunks").cast("int")
    whole = rows.select("cluster", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("outside"), "sid", "root", "set")
    outside = rows.filter(F.col("root") != F.col("main")).select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), chunk.alias("chunk"), F.lit(True).alias("outside"), "sid", "root", "set")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts, ends in _groups(batches, 3):
            side, sid, root, full = t.column(3).to_numpy(), t.column(4).to_pylist(), t.column(5).to_pylist(), t.column(6)
            found: list[tuple[bytes, bytes]] = []
            for s, e in zip(starts, ends, strict=True):
                xs, ys = s + np.flatnonzero(side[s:e]), s + np.flatnonzero(~side[s:e])
                if not len(xs) or not len(ys):
                    continue
                a, b = ([np.frombuffer(full[int(i)].as_py(), np.uint64) for i in k] for k in (xs, ys))
                both = _crossing(a, b).astype(np.int64)
                sizes = np.array([len(x) for x in a])[:, None] + np.array([len(y) for y in b])[None]
                parent: dict[bytes, bytes] = {}

                def top(x, parent=parent):
                    while parent.setdefault(x, x) != x:
                        x = parent[x]
                    return x

                for i, j in zip(*np.nonzero(100 * both >= percent * (sizes - both)), strict=True):
                    p, q = top(root[xs[i]]), top(root[ys[j]])
                    if p != q:
                        parent[p] = q
                        found.append((sid[xs[i]], sid[ys[j]]))
            if found:
                yield _pairs_batch(found)

    dealt = whole.union(outside).repartition("cluster", "block", "chunk").sortWithinPartitions("cluster", "block", "chunk")
    return dealt.mapInArrow(compare, PAIRS)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets meet the threshold.

    The end with more partners is dealt out by salt with copies of its set, so no task gets all pairs of a hub.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    p = pairs.join(ends.select(F.col("x").alias("a"), F.col("n").alias("na")), "a").join(ends.select(F.col("x").alias("b"), F.col("n").alias("nb")), "b")
    hub = F.col("na") >= F.col("nb")
    p = p.select(F.when(hub, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(hub, F.col("b")).otherwise(F.col("a")).alias("x"), F.ceil(F.greatest("na", "nb") / 64).cast("int").alias("salts"))
    p = p.withColumn("salt", F.pmod(F.xxhash64("x"), "salts").cast("int")).join(sets.select(F.col("sid").alias("x"), F.col("set").alias("set_x")), "x")
    copies = p.select("hub", "salt").distinct().join(sets.select(F.col("sid").alias("hub"), F.col("set").alias("set_hub")), "hub")
    both = p.join(copies, ["hub", "salt"]).select("hub", "x", "set_hub", "set_x")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for b in batches:
            ok = []
            for h, sh, sx in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if h != last:
                    last, held = h, np.frombuffer(sh, np.uint64)
                other = np.frombuffer(sx, np.uint64)
                both = len(np.intersect1d(held, other, assume_unique=True))
                ok.append(100 * both >= percent * (len(held) + len(other) - both))
            kept = b.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    return both.mapInArrow(check, PAIRS)


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, trees: int = 10, limit: int = 256, depth: int = 2, least: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``docs`` needs doc_id and text; other columns are ignored.  Texts are lower-cased (A-Z); a set holds the distinct runs of
    ``shingle`` words, or the whole sequence of a shorter text.  Two documents are linked if ``100 * intersection >= percent *
    union``; component_id is the smallest doc_id reachable, and kept says whether it is the row's own.

    A pair at the threshold fails to meet in one tree with probability under 0.25 where its nodes are small, and in all ``trees`` under
    1e-6; fewer than ``least`` of 128 agreeing coordinates, with which a pair doesn't look alike, it has with about 1e-5.  Nodes still
    crowded after ``depth`` levels are compared block by block and with pivots first, then exactly: all their members and all
    clusters of lookalikes that are still apart meet on their rarest shingles.  No node, block or group is capped.

    Null, empty or blank text: an empty set, linked with nothing, kept.  Null doc_id: the row takes part, and its component is
    named by the others; alone its component_id is null and it is kept.  Repeated rows: same component, each kept
    if its doc_id is the least.  Ties: the least doc_id names a component, so there are none.  Very long texts are sketched whole, one at a
    time.  Empty table: empty result.
    """
    out = _labelled(docs, shingle, percent, trees, limit, depth, least)
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _labelled(docs: DataFrame, shingle: int, percent: int, trees: int, limit: int, depth: int, least: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, sid, digest, root (null without a set) and component_id."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = stored(sketches(own, shingle, trees))
    named = base.filter(F.col("sid").isNotNull())
    least_id = cut(named.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("rows")))
    # one row of each class keeps its roots and signature
    first = named.join(least_id.select("sid", F.col("doc_id").alias("_least")), "sid").filter(F.col("doc_id").eqNullSafe(F.col("_least")))
    classes = stored(first.dropDuplicates(["sid"]).select("sid", "doc_id", "digest", "n_shingles", "roots", "sig"))
    sigs = classes.select("sid", "sig", "n_shingles")
    leaves = _leaves(classes, limit, depth)
    pairs = cut(_candidates(leaves, sigs, limit, least, percent))
    crowded = leaves.filter(F.col("members") > limit).select("node", "sid")
    alike = pairs.select(F.explode(F.array("a", "b")).alias("sid")).union(crowded.select("sid")).distinct()
    sets = stored(_texts_to_sets(own, alike.join(classes.select("sid", F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")), "sid"), shingle))
    links = cut(confirm(pairs, sets, percent))
    roots = cut(components(links))
    apart = cut(_apart(pairs, crowded, roots))
    if apart.head(1):
        more = cut(_between(apart, sets, limit, percent))
        if more.head(1):
            roots = cut(components(links.union(more)))
    discard(sets)
    labels = roots.select(F.col("node").alias("sid"), "root")
    per = least_id.join(labels, "sid", "left").select("sid", "doc_id", F.coalesce("root", "sid").alias("root"))
    smallest = per.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = per.select("sid", "root").join(smallest, "root").select("sid", "root", "component_id")
    return base.drop("roots", "sig").join(of_class, "sid", "left")


def _texts_to_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(sid, set) for the classes in ``wanted(sid, _id, _digest)``: the rows of that doc_id and text are shingled again, so rows of one doc_id go apart."""
    ids = wanted.select("_id", "_digest").distinct()
    texts = docs.join(ids.hint("shuffle_hash"), same_row(docs, ids), "left_semi")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textbuf.chunks(batches, 1):
            sets = [s for s in textbuf.shingle_sets(*textbuf.words(textbuf.texts_of(b.column(1))), shingle) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["sid", "set"])

    made = texts.mapInArrow(full, "sid binary, set binary")
    return made.join(wanted.select("sid"), "sid", "left_semi").dropDuplicates(["sid"])


def one_of_each(docs: DataFrame, *, shingle: int = 5, percent: int = 80, trees: int = 10, limit: int = 256, depth: int = 2, least: int = 80) -> DataFrame:
    """The rows of ``docs`` with one of each near-duplicate component: that of the least doc_id and digest of its text.

    Rows go by doc_id and text, not by doc_id alone; of equal rows one stays, too.  Of a component's rows with a null doc_id one
    stays beside the named one, that of the least digest.  Rows without words (null, empty or blank texts) are kept.  Very long texts as in
    :func:`near_duplicates`.  Ties: doc_id, then digest, decide.  Empty table: empty result.
    """
    rows = _labelled(docs, shingle, percent, trees, limit, depth, least).filter("root is not null")
    per = cut(rows.groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("rows")))
    per = per.withColumn("unnamed", F.col("doc_id").isNull())
    key = F.struct("doc_id", "digest")
    first = per.groupBy("root", "unnamed").agg(F.sum("rows").alias("all"), F.min(key).alias("first")).filter("all > 1")
    fate = cut(per.join(first, ["root", "unnamed"]).withColumn("stays", key == F.col("first")).filter("not stays or rows > 1").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "stays"))
    out = docs.join(fate, same_row(docs, fate), "left_anti")
    again = fate.filter("stays")
    if again.head(1):
        # one of equal rows: gathered by key in parts first, so that many copies don't meet in one task
        marked = docs.join(again, same_row(docs, again), "left_semi").withColumns({"_one_id": F.col("doc_id").cast("long"), "_one_digest": digest()})
        out = out.union(marked.dropDuplicates(["_one_id", "_one_digest"]).select(*docs.columns))
    return out
