"""Sharding by a hierarchical weighted hash tree.

A tree has three levels: regions, racks and shards, each shard with a weight.
A row descends the tree; at every node each child draws ``-ln(u) / weight``
from a hash of the row's key and the child's name, and the lowest draw wins,
so a child gets the share of its subtree's weight.  A weight that changes
alters only the draws of the nodes above it: rows move into or out of the
changed subtrees alone.  ``grow`` adds a shard as a region of its own, so the
new shard takes rows only into itself and no other row moves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuzzyspark.llm.common import hash60, numbered, text_of

#: {region: {rack: {shard: weight}}}
Tree = dict[str, dict[str, dict[int, float]]]
LAW = "key"


def default_tree(n_shards: int, founded: int = 16, racks: int = 2, per_rack: int = 4) -> Tree:
    """A tree founded with ``founded`` shards, in regions of ``racks`` x ``per_rack`` shards of weight 1, and
    grown one shard at a time to ``n_shards``; fewer shards are founded as they are."""
    tree: Tree = {}
    for s in range(min(n_shards, founded)):
        region, rest = divmod(s, racks * per_rack)
        tree.setdefault(f"g{region}", {}).setdefault(f"r{rest // per_rack}", {})[s] = 1.0
    for _ in range(founded, n_shards):
        tree = grow(tree)
    return tree


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a new region of its own."""
    shard = 1 + max((s for racks in tree.values() for shards in racks.values() for s in shards), default=-1)
    return {**tree, f"g{len(tree)}": {"r0": {shard: weight}}}


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (hash60(F.concat(F.lit(f"{name}|"), key)).cast("double") + 1.0) / float(1 << 60)
    return -F.log(u) / F.lit(float(weight))


def _pick(key: Column, path: str, weights: dict) -> Column:
    """The child with the lowest draw; equal draws go to the child named first."""
    names = list(weights)
    if len(names) == 1:
        return F.lit(0)
    drawn = F.array(*[F.struct(_draw(key, f"{path}/{n}", weights[n]).alias("d"), F.lit(i).alias("i"))
                      for i, n in enumerate(names)])
    return F.array_min(drawn)["i"]


def _branch(which: Column, options: list[Column]) -> Column:
    return reduce(lambda rest, x: F.when(which == F.lit(x[0]), x[1]).otherwise(rest),
                  list(enumerate(options))[:-1], options[-1])


def assign(df: DataFrame, tree: Tree, key: Column, out: str) -> DataFrame:
    """Add the shard of every row, descending one level at a time."""
    total = lambda x: sum(map(total, x.values())) if isinstance(x, dict) else x
    weights = lambda x: {n: total(c) for n, c in x.items()}
    g, r, s = "__g", "__r", "__s"
    regions = list(tree.items())
    df = df.withColumn(g, _pick(key, "", weights(tree)))
    df = df.withColumn(r, _branch(F.col(g), [_pick(key, n, weights(racks)) for n, racks in regions]))
    df = df.withColumn(s, _branch(F.col(g), [
        _branch(F.col(r), [_pick(key, f"{n}/{m}", weights(shards)) for m, shards in racks.items()])
        for n, racks in regions]))
    shard = _branch(F.col(g), [
        _branch(F.col(r), [_branch(F.col(s), [F.lit(x) for x in shards]) for shards in racks.values()])
        for _, racks in regions])
    return df.withColumn(out, shard.cast("int")).drop(g, r, s)


def shard_documents(docs: DataFrame, n_shards: int = 16, founded: int = 16) -> DataFrame:
    """Place every document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The key is the doc_id, so rows of one doc_id share a shard, repeated rows
    and null ids (key ``null``) included; they get slots of their own.  Slots
    number a shard's rows from 0 by doc_id (nulls first), then checksum and
    size.  A null text counts as empty (size 1, checksum 0); an empty table
    gives no rows; further columns are ignored."""
    tree = default_tree(n_shards, founded)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    raw = F.encode(text_of(), "UTF-8")
    slim = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"),
                       F.crc32(raw).alias("text_crc32"), F.lit(LAW).alias("law"))
    slim = assign(assign(slim, tree, key, "shard"), grow(tree), key, "grown_shard")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()]
    return numbered(slim, ["shard"], order, "shards").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

