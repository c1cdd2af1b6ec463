"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

At each level every child of the node that a row has reached draws an exponential waiting time, -ln(u) / weight, u
hashed from the identifier and the child's place in the tree; the row descends to the child that draws least, which
is each one with a chance in proportion to its weight.  A node's weight is the sum of its shards'.  The draws of a
node depend on nothing outside it, so a changed weight moves rows only into or out of the nodes on its path: between
regions only to or from the region that changed, inside it only to or from the rack, and so on.  A shard that is
added opens a region of its own; rows then move only into it, never between old shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import own_names, store, text_or_empty

SHARDS_PER_RACK = 4
RACKS_PER_REGION = 3
#: Cells of each shard in which rows are numbered: slots need no sort of a whole shard.
CELLS = 512
OVERHEAD = 16
#: Regions of racks of (shard, weight).
Tree = list[list[list[tuple[int, float]]]]


def tree(weights: Sequence[float]) -> Tree:
    """Shards 0, 1, ... of these weights in regions and racks that are filled in order."""
    leaves = [(shard, float(w)) for shard, w in enumerate(weights)]
    racks = [leaves[i : i + SHARDS_PER_RACK] for i in range(0, len(leaves), SHARDS_PER_RACK)]
    return [racks[i : i + RACKS_PER_REGION] for i in range(0, len(racks), RACKS_PER_REGION)]


def even(n: int) -> Tree:
    return tree([1.0] * n)


def with_shard(nodes: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    return [*nodes, [[(1 + max((s for region in nodes for rack in region for s, _ in rack), default=-1), weight)]]]


def least(key: Column, weights: Column, path: Sequence[Column], seed: int) -> Column:
    """The place of the child that draws least of children with these weights; one of weight 0 is never drawn."""

    def wait(weight: Column, child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, *path, child, F.lit(seed)), 11).cast("double")
        draw = F.when(weight > 0, -F.log((bits + 0.5) / F.lit(float(1 << 53))) / weight)
        return F.struct(draw.isNull().alias("never"), draw.alias("draw"), child.alias("child"))

    return F.array_min(F.transform(weights, wait))["child"]


def descend(rows: DataFrame, key: Column, nodes: Tree, seed: int = 17, prefix: str = "") -> DataFrame:
    """The rows with region, rack (its place in the region) and shard that the key reaches, a draw among the children of
    each node on the way; a level a projection, so that each draw is made once."""
    total = lambda node: node[1] if isinstance(node, tuple) else sum(map(total, node))
    if not total(nodes) > 0:
        raise ValueError("one shard at least needs a weight above 0")
    each = lambda of, xs: F.array(*[of(x) for x in xs])
    weight = lambda node: F.lit(float(total(node)))
    racks = each(lambda region: each(weight, region), nodes)
    leaves = each(lambda region: each(lambda rack: each(weight, rack), region), nodes)
    shards = each(lambda region: each(lambda rack: each(lambda leaf: F.lit(leaf[0]), rack), region), nodes)
    region, rack, leaf = F.col(f"{prefix}region"), F.col(f"{prefix}rack"), F.col(f"{prefix}leaf")
    rows = rows.withColumn(f"{prefix}region", least(key, each(weight, nodes), [F.lit(0)], seed))
    rows = rows.withColumn(f"{prefix}rack", least(key, F.get(racks, region), [F.lit(1), region], seed))
    rows = rows.withColumn(f"{prefix}leaf", least(key, F.get(F.get(leaves, region), rack), [F.lit(2), region, rack], seed))
    return rows.withColumn(f"{prefix}shard", F.get(F.get(F.get(shards, region), rack), leaf)).drop(f"{prefix}leaf")


def shard_rows(docs: DataFrame, nodes: Tree, grown: Tree | None = None, seed: int = 17, cells: int = CELLS) -> DataFrame:
    """Shard and slot of every row of docs(doc_id, text).

    Rows: doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law ('key'), region, rack, shard, slot
    (gapless from 0 in each shard), grown_shard (the shard in the tree `grown`; null without one).  The identifier
    and the tree alone decide the shard; rows with one identifier share it, and those without one count as one
    identifier.  A null text is empty.  Rows that agree in all columns may swap slots.  Slots come from counts of
    cells of a shard and a numbering within the cell, so no task ever holds a whole shard.
    """
    law = own_names(docs, ["doc_id", "text"])
    key = F.col("doc_id")
    body = text_or_empty().cast("binary")
    placed = law.select(key, (F.octet_length(body).cast("long") + OVERHEAD).alias("size"), F.crc32(body).alias("text_crc32"), F.pmod(F.xxhash64(key, F.lit(~seed)), F.lit(cells)).cast("int").alias("cell"))
    placed = descend(placed, key, nodes, seed)
    placed = descend(placed, key, grown, seed, "grown_") if grown else placed.withColumn("grown_shard", F.lit(None).cast("int"))
    placed = store(placed.select("doc_id", "size", "text_crc32", "cell", "region", "rack", "shard", "grown_shard"), "shards")
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "size", "text_crc32")
    numbered = placed.withColumn("at_cell", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard",
        (F.col("base") + F.col("at_cell")).cast("long").alias("slot"), "grown_shard",
    )
