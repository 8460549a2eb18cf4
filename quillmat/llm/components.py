"""Connected components of a link table: links are contracted part by part, then by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmat.llm.common import cut


def _hang(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Each node's neighbours hung onto the least of them and itself.

    The least is an aggregate with partial sums.  Among all edges, where nodes can be hubs, it is worked out apart from the
    join, so that Spark may split a hub's rows there.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = edges.join(cut(least) if larger_only else least, "u")
    if larger_only:
        return out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _contracted(edges: DataFrame) -> DataFrame:
    """Each partition's nodes hung onto the least that its own edges connect them to."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def top(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        kinds = None
        for b in batches:
            kinds = b.schema
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p, q = top(u), top(v)
                if p != q:
                    parent[max(p, q)] = min(p, q)
        if parent:
            hung = [(x, r) for x in parent if (r := top(x)) != x]
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hung], kinds.types[k]) for k in (0, 1)], ["u", "v"])

    return edges.mapInArrow(contract, edges.schema)


def components(links: DataFrame, most_rounds: int = 60, per_task: int = 250_000) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is the least node of its component.

    Parts of about ``per_task`` links, of which few links have but one, are contracted where they are; what several parts hold then
    goes through rounds of stars until nothing moves.

    Rows with a null end or equal ends link nothing; repeated links count once.  Ties need no rule, nodes are distinct.  No links: empty result.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = cut(edges), None
    parts = -(-edges.count() // per_task)
    edges = _contracted(edges.coalesce(max(1, parts)))
    if parts <= 1:
        return _with_roots(edges)
    edges = cut(edges)
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both, True).filter("u <> v").distinct()
        small = _hang(large, False).filter("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
        if now == before:
            return _with_roots(edges)
        before = now
    raise RuntimeError("components did not settle")


def _with_roots(edges: DataFrame) -> DataFrame:
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
