"""Sharding by a hierarchical weighted hash tree.

A document descends the levels region, rack and shard; at each node every child draws
``-ln(u) / weight`` with ``u`` hashed from the document and the child's path, and the smallest
draw wins.  A child's draw doesn't depend on its siblings, so when weights change, documents
only move into subtrees that gained weight or out of those that lost it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmat.llm.common import KEY_BITS, bucket_bits, cut, exclusive_sums, hash_key

#: A tree is {child: subtree or weight of a shard}; the leaves' keys are shard numbers.
Tree = dict


def topology(shards: int, base: int = 8) -> Tree:
    """The standing tree for so many equal shards: pairs of shards are racks, pairs of racks regions.

    Up to ``base`` shards lie in that grid; each one beyond it is a region of its own, so a
    further shard (from ``base`` on) takes documents only into itself.
    """
    tree: Tree = {}
    for s in range(shards):
        if s < base:
            tree.setdefault(f"region{s // 4}", {}).setdefault(f"rack{s // 2}", {})[s] = 1.0
        else:
            tree[f"region+{s}"] = {f"rack+{s}": {s: 1.0}}
    return tree


def weight(node: Tree | float) -> float:
    return sum(map(weight, node.values())) if isinstance(node, dict) else float(node)


def draw(doc: str, path: str, w: float) -> Column:
    u = (hash_key(doc, F.lit(path)) + 1) / F.lit(float(1 << KEY_BITS))
    return -F.ln(u) / F.lit(w)


def descend(doc: str, tree: Tree, path: str = "") -> Column:
    """The shard number of the column ``doc`` in ``tree``; a child of weight 0 gets nothing."""
    children = [(f"{path}/{k}", k, v) for k, v in tree.items() if weight(v) > 0]
    if not children:
        raise ValueError("a tree needs a shard with a positive weight")
    inner = [descend(doc, v, p) if isinstance(v, dict) else F.lit(int(k)) for p, k, v in children]
    if len(children) == 1:
        return inner[0]
    won = F.array_min(F.array(*[F.struct(draw(doc, p, weight(v)).alias("d"), F.lit(i).alias("i")) for i, (p, _, v) in enumerate(children)]))["i"]
    out = F.when(won == 0, inner[0])
    for i, x in enumerate(inner[1:], 1):
        out = out.when(won == i, x)
    return out


def assign(docs: DataFrame, *, tree: Tree | None = None, grown: Tree | None = None, shards: int = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Only doc_id and text are read.  The law is ``key``: doc_id and the tree alone decide.  ``slot`` numbers
    a shard's rows from 0 without gaps, in the order of a hash of doc_id and checksum; it is found by ranges of that hash, so no shard is numbered by one task.

    Null doc_id: treated as the word null, so all such rows share a shard.  Null text: size 1, checksum 0; empty and very long texts by the same rule.
    Ties of draws go to the first child, ties of slots follow doc_id, checksum and size.  Repeated rows get a slot each.  Empty table: empty result.
    """
    tree, grown = tree or topology(shards), grown or topology(shards + 1)
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    slim = slim.select("*", F.lit("key").alias("law"), descend("doc_id", tree).cast("int").alias("shard"), descend("doc_id", grown).cast("int").alias("grown_shard"), F.lit(1).cast("long").alias("_one")).withColumn("_key", hash_key("doc_id", "text_crc32", F.lit("slot")))
    slim = cut(slim)
    out = exclusive_sums(slim, "shard", "_key", ["doc_id", "text_crc32", "size"], {"_one": "slot"}, bucket_bits(slim.count()))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard")


def sharded_documents(docs: DataFrame, *, tree: Tree | None = None, grown: Tree | None = None, shards: int = 8) -> DataFrame:
    """``docs`` with the columns shard and grown_shard (in place of any so named), by the rules of :func:`assign`; no row moves.

    Only doc_id decides, so null, empty and very long texts make no difference; repeated rows share a shard.  Empty table: empty result.
    """
    tree, grown = tree or topology(shards), grown or topology(shards + 1)
    return docs.withColumns({"shard": descend("doc_id", tree).cast("int"), "grown_shard": descend("doc_id", grown).cast("int")})
