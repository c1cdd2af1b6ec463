"""Mixing sources to target weights, by quotas of blocks that a multivariate-hypergeometric tree splits among shards.

1. Targets: sources share a total by weight; a target stops at `max_repeats` times its source, and the excess goes to
   the others by weight until none is above.
2. Blocks: the documents of a source fall into blocks by a hash.  A source takes whole passes over all its blocks,
   then whole blocks in a permuted order, and of one last block as many documents as come nearest to the target.
3. Tree: the quotas (block draws a source) are split between halves of the output shards, again and again, by draws
   from the multivariate hypergeometric distribution; each shard ends with an exact number of blocks of each source.
   A node's draw is seeded by its range of shards alone, so each task descends from the root to its own shards, and
   nothing of the size of sources times shards is held anywhere.
4. Permuted, disjoint ranges of a source's block draws go to the shards, and each shard is shuffled by itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import boxed, own_names, store, text_or_empty, word_count

WEIGHTS = (5.0, 2.0, 1.0)
RATIO = 1.5
MAX_REPEATS = 2
#: Output shards at least; there are as many as shuffle partitions if those are more, so that shards stay of one size.
SHARDS = 64
#: Documents a block has on average; a source has at most MAX_BLOCKS blocks and all have ALL_BLOCKS, and one more a
#: source, which then grow.  (The hypergeometric draws take fewer than 10 ** 9 blocks.)
BLOCK_DOCS = 64
MAX_BLOCKS, ALL_BLOCKS = 4096, 1 << 28


def targets(sources: DataFrame, weights: Sequence[float], ratio: float, max_repeats: float) -> DataFrame:
    """sources(source, source_size, n_docs) with s_rank and target.  Sources are ranked by code point, null last, and
    take the weights in turn.  By rising cap / weight, the level is the first at which the rest fits under its caps."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("s_rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("s_rank", F.lit(len(weights))) + 1)
    cap = F.col("source_size") * F.lit(float(max_repeats))
    ranked = ranked.withColumns({"weight": weight, "cap": cap}).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", "s_rank")
    everyone = Window.partitionBy()
    level = (F.sum("source_size").over(everyone) * ratio - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(
        order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    ranked = ranked.withColumn("level", level)
    share = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everyone)
    return ranked.withColumn("share", share).select(
        "source", "source_size", "n_docs", "s_rank", F.sum("n_docs").over(everyone).alias("all_docs"),
        F.when(F.col("share").isNull() | (F.col("full_at") < F.col("share")), F.col("cap")).otherwise(F.col("share") * F.col("weight")).alias("target"),
    )


def split_quotas(quotas: np.ndarray, shards: int, seed: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """[source, shard] block draws of the shards from `first` to before `last`: halves of the shard range take a
    hypergeometric share of what their parent has."""
    last = shards if last is None else last
    out = np.zeros((len(quotas), last - first), dtype=np.int64)
    nodes = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while nodes:
        low, high, have = nodes.pop()
        if high <= first or last <= low:
            continue
        if high - low == 1:
            out[:, low - first] = have
            continue
        middle = (low + high) // 2
        left_total = int(have.sum()) * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(have, left_total, method="marginals") if left_total else np.zeros_like(have)
        nodes += [(low, middle, left), (middle, high, have - left)]
    return out


def deal(ranks: list[int], quotas: list[int], shards: int, tasks: int, seed: int):
    """s_rank, shard, n: a task walks the tree to its range of shards."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column("id").to_pylist():
                first, last = shards * task // tasks, shards * (task + 1) // tasks
                part = split_quotas(np.array(quotas, dtype=np.int64), shards, seed, first, last)
                at, shard = np.nonzero(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ranks, dtype=np.int32)[at]), pa.array((shard + first).astype(np.int32)), pa.array(part[at, shard])], names=["s_rank", "shard", "n"])

    return run


def spot(seed: int, *parts: Column) -> Column:
    return F.xxhash64(*parts, F.lit(seed))


class Plan(NamedTuple):
    """sizes(doc_id, source, spot, size), sources(of, s_rank, source_size, target, passes, n_blocks) and, for each block,
    the draws that its documents share and which of them are in the partial one."""

    sizes: DataFrame
    sources: DataFrame
    blocks: DataFrame


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, ratio: float = RATIO, max_repeats: int = MAX_REPEATS, shards: int | None = None, seed: int = 29) -> Plan:
    """What the mixture of docs(doc_id, text, source) takes.  Words are counted once.  Sources are collected in one place
    (a row each, as the weights name them), documents never: each is decided by its block's row and its own hash.  In
    the last block of a source, documents are taken in hash order while they fit, and one more that comes nearest to
    what is left."""
    spark = docs.sparkSession
    shards = shards or max(SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slim = store(own_names(docs, ["doc_id", "text", "source"]).select("doc_id", "source", spot(seed, F.col("doc_id")).alias("spot"), word_count(text_or_empty()).alias("size")), "mix-sizes")
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    aimed = targets(sources, weights, ratio, max_repeats)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("int")
    aimed = aimed.withColumn("passes", passes).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    block_docs = F.greatest(F.lit(float(BLOCK_DOCS)), F.col("all_docs") / ALL_BLOCKS)
    aimed = store(aimed.withColumn("n_blocks", F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("n_docs") / block_docs))), "mix-sources")
    of_source = aimed.withColumnRenamed("source", "of")

    blocked = in_blocks(slim.select("source", "spot", "size"), of_source)
    blocks = blocked.groupBy("s_rank", "block", "passes", "rest").agg(F.sum("size").alias("words"))
    permuted = Window.partitionBy("s_rank").orderBy(spot(seed + 1, F.col("s_rank"), F.col("block")), "block")
    blocks = blocks.withColumn("upto", F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    blocks = blocks.withColumn("whole", F.col("upto") <= F.col("rest"))
    last = ~F.col("whole") & (F.col("upto") - F.col("words") < F.col("rest"))
    blocks = store(blocks.withColumn("room", F.when(last, F.col("rest") - F.col("upto") + F.col("words"))), "mix-blocks")

    # the last block: documents in hash order while they fit, then the one nearest to what is left
    edge = blocked.join(blocks.where(F.col("room").isNotNull()).select("s_rank", "block", "room"), ["s_rank", "block"])
    run = F.sum("size").over(Window.partitionBy("s_rank", "block").orderBy("spot"))  # peers of one hash together
    edge = edge.withColumn("fits", run <= F.col("room"))
    cut = edge.groupBy("s_rank", "block").agg(
        F.max(F.when(F.col("fits"), F.col("spot"))).alias("cut"),
        (F.first("room") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0))).alias("left"),
    )
    groups = edge.where(~F.col("fits")).groupBy("s_rank", "block", "spot").agg(F.sum("size").alias("size"))
    nearest = groups.join(cut, ["s_rank", "block"]).where(F.abs(F.col("size") - F.col("left")) < F.col("left"))
    nearest = nearest.groupBy("s_rank", "block").agg(F.min_by("spot", F.struct(F.abs(F.col("size") - F.col("left")), "spot")).alias("filler"))

    # block draws in permuted order, a pass after the other, dealt to shards by the tree's quotas
    ways = F.filter(F.sequence(F.lit(0), F.lit(int(max_repeats))), lambda p: (p < F.col("passes")) | ((p == F.col("passes")) & (F.col("whole") | F.col("room").isNotNull())))
    units = blocks.select("s_rank", "block", F.explode(ways).alias("pass"))
    units = store(units.withColumn("place", F.row_number().over(Window.partitionBy("s_rank").orderBy("pass", spot(seed + 2, F.col("s_rank"), F.col("block"), F.col("pass")), "block"))), "mix-draws")
    counts = sorted((r["s_rank"], r["n"]) for r in units.groupBy("s_rank").agg(F.count(F.lit(1)).alias("n")).collect())
    tasks = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = spark.range(0, tasks, 1, tasks).mapInArrow(deal([r for r, _ in counts], [n for _, n in counts], shards, tasks, seed), "s_rank int, shard int, n long")
    upto = F.sum("n").over(Window.partitionBy("s_rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranges = dealt.select("s_rank", "shard", upto.alias("upto"), "n")
    places = ranges.select("s_rank", "shard", F.explode(F.sequence((F.col("upto") - F.col("n") + 1).cast("int"), F.col("upto").cast("int"))).alias("place"))
    units = units.join(places, ["s_rank", "place"])
    draws = units.groupBy("s_rank", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("all_draws"))
    of_block = blocks.select("s_rank", "block", "whole", F.col("room").isNotNull().alias("partial")).join(draws, ["s_rank", "block"], "left")
    of_block = of_block.join(cut.drop("left"), ["s_rank", "block"], "left").join(nearest, ["s_rank", "block"], "left")
    return Plan(slim, of_source.select("of", "s_rank", "source_size", "target", "passes", "rest", "n_blocks"), store(of_block, "mix-plan"))


def in_blocks(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows(source, spot, ...) with what `sources` says of theirs, and their block."""
    joined = rows.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return joined.withColumn("block", F.pmod(F.col("spot"), F.col("n_blocks")).cast("int"))


def drawn(rows: DataFrame, decided: Plan) -> DataFrame:
    """rows(source, spot, ...) with draws: array of (pass, shard), empty for a document that is not taken."""
    found = in_blocks(rows, decided.sources).join(decided.blocks, ["s_rank", "block"])
    within = F.coalesce(F.col("spot") <= F.col("cut"), F.lit(False)) | F.coalesce(F.col("spot") == F.col("filler"), F.lit(False))
    extra = F.col("whole") | (F.col("partial") & within)
    some = F.coalesce("all_draws", F.array().cast("array<struct<pass:int,shard:int>>"))
    return found.withColumn("draws", F.filter(some, lambda d: (d["pass"] < F.col("passes")) | extra))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, ratio: float = RATIO, max_repeats: int = MAX_REPEATS, shards: int | None = None, seed: int = 29) -> DataFrame:
    """doc_id, source, size (words), source_size, target, draws (array of pass, output shard) and taken (size times draws)
    of every row of docs(doc_id, text, source).

    A null text has size 0; a null source is a source of its own.  Rows with one doc_id are taken together.  Reruns
    give the same plan.
    """
    decided = plan(docs, weights, ratio, max_repeats, shards, seed)
    taken = (F.col("size") * F.size("draws")).cast("long").alias("taken")
    return drawn(decided.sizes, decided).select("doc_id", "source", "size", "source_size", "target", "draws", taken)


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, ratio: float = RATIO, max_repeats: int = MAX_REPEATS, shards: int | None = None, seed: int = 29) -> DataFrame:
    """The rows of the mixture with the columns of docs, whatever their names: a document once a draw, laid out by output
    shard and shuffled inside each."""
    decided = plan(docs, weights, ratio, max_repeats, shards, seed)
    rows = docs.select(boxed(docs), F.col("source").alias("source"), spot(seed, F.col("doc_id")).alias("spot"))
    rows = drawn(rows, decided).select("row", F.explode("draws").alias("draw"))
    order = [F.col("draw.shard"), spot(seed + 3, F.col("row.doc_id"), F.col("draw.pass")), F.col("row.doc_id")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "draw.shard").sortWithinPartitions(*order).select("row.*")
