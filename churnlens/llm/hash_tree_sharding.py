"""Shards from a hierarchical weighted hash tree (DataFrame functions only).

A tree has regions, racks and shards, each shard with a weight; a rack's weight
is the sum of its shards', a region's the sum of its racks'.  A key descends:
on each level every child draws -ln(u) / weight, u in (0, 1) from a hash of the
key and the child's name, and the smallest draw wins.  A child's draw depends on
its own weight alone.  So when weights change, keys move only into subtrees whose
weight grew and out of those whose weight fell, and the choice inside any other
subtree stays as it was.

``grow`` adds a shard as a new region of its own: no old subtree changes, so keys
move only into the new shard.  ``tree_of(n)`` follows from the number of shards
alone: 24 shards in 3 regions of 2 racks of 4, each further one grown.

Rows with equal keys share a shard; a null key is a key like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import materialise

#: Region -> rack -> [(shard, weight)].
Tree = list[list[list[tuple[int, float]]]]
REGIONS, RACKS, SHARDS = 3, 2, 4


def tree_of(n: int) -> Tree:
    """The tree of ``n`` shards of weight 1 (below 24 the first tree's places are filled in order)."""
    base = min(n, REGIONS * RACKS * SHARDS)
    leaves = [(s, 1.0) for s in range(base)]
    racks = [leaves[i:i + SHARDS] for i in range(0, base, SHARDS)]
    tree = [racks[i:i + RACKS] for i in range(0, len(racks), RACKS)]
    for _ in range(base, n):
        tree = grow(tree)
    return tree


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """``tree`` and one more shard, a region by itself."""
    return [*tree, [[(1 + max((s for g in tree for k in g for s, _ in k), default=-1), weight)]]]


def _pick(draws: list[tuple[Column, int]]) -> Column:
    """Index of the smallest draw."""
    if len(draws) == 1:
        return F.lit(draws[0][1])
    best = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for d, i in draws]))
    return best["i"]


def _draw(key: Column, name: str, weight: float) -> Column:
    # the hash's upper 53 bits, centred in (0, 1)
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) * 2.0 ** -53
    return -F.log(u) / F.lit(float(weight))


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of ``key``.  Only the chosen subtree's draws are computed."""
    def child(names: list[tuple[str, float]]) -> Column:
        live = [(_draw(key, name, w), i) for i, (name, w) in enumerate(names) if w > 0]
        if not live:
            raise ValueError("a tree needs a shard of positive weight")
        return _pick(live)

    def choose(which: Column, options: list[Column | None]) -> Column:
        some = [(i, o) for i, o in enumerate(options) if o is not None]
        out = some[-1][1]
        for i, o in reversed(some[:-1]):
            out = F.when(which == i, o).otherwise(out)
        return out

    weigh = lambda rack: sum(w for _, w in rack)
    regions = []
    for g, region in enumerate(tree):
        racks = [choose(child([(f"shard {s}", w) for s, w in rack]), [F.lit(s) for s, _ in rack]) if weigh(rack) > 0 else None
                 for rack in region]
        regions.append(choose(child([(f"rack {g}.{k}", weigh(rack)) for k, rack in enumerate(region)]), racks)
                       if any(r is not None for r in racks) else None)
    return choose(child([(f"region {g}", sum(map(weigh, region))) for g, region in enumerate(tree)]), regions).cast("int")


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its shard, its slot there (gapless from 0) and the shard it
    would have with one shard more.

    size: UTF-8 bytes of the text (null: none) plus 8; text_crc32 of a null text:
    that of no bytes, 0.  Slots number rows by input partition, then doc_id; the
    window runs within a partition and shard, and the rows before it come from a
    running sum over one row for each of these, so a shard of any size is numbered
    by many tasks.  The narrow rows are written once, which fixes the partitions.
    """
    key, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    rows = materialise(docs.select(
        key.alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(key, tree_of(shards)).alias("shard"), shard_of(key, tree_of(shards + 1)).alias("grown_shard"),
        F.spark_partition_id().alias("part")), "shards")
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "part", F.coalesce(F.sum("n").over(
        Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    w = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("rank", F.row_number().over(w)).join(before, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("before") + F.col("rank") - 1).alias("slot"), "grown_shard"))
