"""Mixing sources to target weights by systematic sampling.

Targets: sources in code-point order (null last) weigh ``weights`` in turn
and share ``share`` times all words; a target stops at ``most`` times its
source, and the excess is shared again by weight until none is above.  That
fixed point is a water level: sources are filled in the order of capacity per
weight, from cumulative sums over the (few) sources.

Sampling: within its source each document expects target / source size
copies.  The expected copies are summed up in a fixed order (long documents
first, so neighbours are alike and the words taken stay near the target), one
random offset per source is added, and a document is emitted once for each
integer boundary that its step crosses: never more than ``most`` times, and
the same on each run.  A hot source is no single group: rows are ordered by
range partitioning, the blocks of a source are summed apart, and a block adds
what stands before it.

Defined results: a null text has size 0 and is taken 0 or more times with 0
words; sources without words have target 0; repeated rows are documents of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sendero.llm.common import TOKEN, materialise, text_or_empty

UNIT = 1_000_000_000  # copies are summed in billionths, exactly
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sizes``: source, source_size (one row per source; a table as small as
    the list of sources).  Adds the target of each source, in words."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("room", F.col("source_size") * most)
    filling = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("room").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # The water level if all sources filled earlier are at their cap; a source
    # is capped where even so it would get more than its room.
    levels = ranked.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= F.col("room"))
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("room") / F.col("weight"), F.col("level")))).over(everything)["level"]
    return levels.select("source", "source_size", F.when(F.col("capped"), F.col("room").cast("double")).otherwise(
        final * F.col("weight")).alias("target"))


def _offset(seed: str) -> Column:
    """A number below UNIT for each source, from the digits of a hash."""
    name = F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % UNIT


def systematic_copies(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs``: doc_id, source, size, step (expected copies in units of
    1 / UNIT).  Adds ``copies``."""
    order = [F.col("size").desc(), F.col("doc_id").asc_nulls_last()]
    ranged = docs.repartitionByRange(F.col("source").asc_nulls_first(), *order).withColumn("block", F.spark_partition_id())
    ranged = materialise(ranged, "mix-order")  # so that each reader sees the same blocks
    blocks = ranged.groupBy("source", "block").agg(F.sum(F.col("step").cast("decimal(38,0)")).alias("whole"))
    ahead = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"),
                           F.coalesce(F.sum("whole").over(ahead), F.lit(0)).cast("decimal(38,0)").alias("ahead"))
    rows = ranged.join(blocks, (F.col("block") == F.col("b_block")) & F.col("source").eqNullSafe(F.col("b_source")))
    within = Window.partitionBy("block", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    upto = (F.col("ahead") + F.sum(F.col("step").cast("decimal(38,0)")).over(within) + _offset(seed)).cast("decimal(38,0)")
    crossed = F.floor(F.col("upto") / UNIT) - F.floor((F.col("upto") - F.col("step")) / UNIT)
    return rows.withColumn("upto", upto).withColumn("copies", crossed.cast("long")).drop(
        "b_source", "b_block", "ahead", "upto", "block")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Per document: size, source_size, target (its source's), copies, taken."""
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"),
                        F.regexp_count(text_or_empty(), F.lit(TOKEN)).cast("long").alias("size"))
    sized = materialise(sized, "mix-sizes")  # the texts are read once
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most).select(F.col("source").alias("t_source"), "source_size", "target")
    step = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * UNIT)).otherwise(0)
    aimed = sized.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source").withColumn(
        "step", step.cast("long"))
    return systematic_copies(aimed, seed).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
