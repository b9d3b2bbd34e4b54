"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of shuffled documents. A document's virtual finish time is its source's
tokens up to and including it, divided by the source's target; one global order by finish time,
cut at the total budget, serves every source in proportion to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, n_words

#: Buckets of the shuffle key in a source, and of the virtual time up to twice the budget.
KEY_DIGITS, TIME_BUCKETS = 3, 4096


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row per source: its size, rank, weight and target.

    Sources in code-point order, null last, take the weights in turn. Targets share the total size
    in proportion to the weights; a target stops at max_epochs times its source's size and the excess
    is shared again. That is a water level: with sources ordered by the level at which they fill, the
    first one whose own level is not below the level of those left over fixes it.
    """
    everything = Window.partitionBy()
    ranked = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * max_epochs)
    )
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    levels = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full_before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("place", F.row_number().over(by_level))
        .withColumn("fits", (F.col("total") - F.col("full_before")).cast("double") * F.col("weight") / F.col("weight_left") <= F.col("cap"))
    )
    first = F.min(F.when(F.col("fits"), F.col("place"))).over(everything)
    at = lambda name: F.max(F.when(F.col("place") == F.col("first"), F.col(name))).over(everything)
    filled = levels.withColumn("first", first).withColumn("left", at("total") - at("full_before")).withColumn("share", at("weight_left"))
    target = F.when(F.col("place") < F.col("first"), F.col("cap").cast("double")).otherwise(F.col("left").cast("double") * F.col("weight") / F.col("share"))
    return filled.select("source", "source_rank", "source_size", "weight", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    weights: tuple[float, ...] = (1, 2, 3),
    max_epochs: int = 3,
    row_col: str | None = None,
) -> DataFrame:
    """Per row of docs: id, source, size, source_size, target, taken (tokens, repeats counted).

    size defaults to the number of words in text. A null text has size 0 and is never taken; a null
    source is a source of its own, the last one. Rows that share an id are documents of their own.
    Copies of a document beyond the first are queued after the whole source, one epoch each. The
    order within a source is that of md5(id), so reruns and retried tasks agree. An empty table
    gives an empty result. row_col, a number of each row's own, is carried along and breaks ties.

    A source's running total is a prefix sum over 16**KEY_DIGITS key ranges plus one inside each, so
    that a source with a third of all rows is spread over thousands of groups; the global cut is
    found in the same two steps over ranges of virtual time.
    """
    scratch = Scratch(docs.sparkSession)
    size = n_words(F.col("text")) if size is None else size
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    row = ["row"] if row_col else []
    sized = scratch.save(docs.select(*[F.col(row_col).alias(r) for r in row], F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), key.alias("key")))
    sized = sized.withColumn("range", F.substring("key", 1, KEY_DIGITS))
    sources = source_targets(sized, weights, max_epochs)

    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size")).withColumn("range_before", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    ranges = ranges.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.source", "range", "range_before", "source_rank", "source_size", "target")
    within = Window.partitionBy("source_rank", "range").orderBy("key", "id", "size", *row).rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        sized.alias("d")
        .join(ranges.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.range") == F.col("r.range")))
        .select(*[f"d.{r}" for r in row], "d.id", "d.source", "d.size", "d.key", "d.range", "range_before", "source_rank", "source_size", "target")
        .withColumn("cum", F.sum("size").over(within) + F.col("range_before"))
        .select(*row, "id", "source", "size", "source_rank", "source_size", "target", "cum")
    )
    queued = scratch.save(queued)

    finish = lambda epoch: (F.col("source_size") * epoch + F.col("cum")).cast("double") / F.col("target")
    copies = queued.where("size > 0").select("size", "source_rank", "cum", F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), finish(e).alias("finish")) for e in range(max_epochs)])).alias("c"))
    copies = copies.select("size", "source_rank", "cum", "c.finish", F.least(F.floor(F.col("c.finish") * TIME_BUCKETS), F.lit(2 * TIME_BUCKETS)).alias("slot"))
    in_order = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = copies.groupBy("slot").agg(F.sum("size").alias("slot_size")).withColumn("upto", F.sum("slot_size").over(in_order))
    budget = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget")).first().budget
    over = slots.where(F.col("upto") > budget).orderBy("slot").limit(1).select("slot", (F.col("upto") - F.col("slot_size")).alias("before")).collect()
    if over:  # the slot in which the budget runs out: the last copy that fits
        order = Window.partitionBy("slot").orderBy("finish", "source_rank", "cum").rowsBetween(Window.unboundedPreceding, 0)
        last = copies.where(F.col("slot") == over[0].slot).withColumn("upto", F.sum("size").over(order) + over[0].before).where(F.col("upto") <= budget)
        last = last.agg(F.max(F.struct("finish", "source_rank", "cum")).alias("last")).first().last
        cut = F.struct(F.lit(last.finish), F.lit(last.source_rank).cast("int"), F.lit(last.cum).cast("long")) if last else None
        slot_of = lambda e: F.least(F.floor(finish(e) * TIME_BUCKETS), F.lit(2 * TIME_BUCKETS))
        taken = [(slot_of(e) < over[0].slot) | ((F.struct(finish(e), "source_rank", "cum") <= cut) if cut is not None else F.lit(False)) for e in range(max_epochs)]
    else:
        taken = [F.lit(True)] * max_epochs
    times = sum((t.cast("long") for t in taken), F.lit(0))
    return queued.select(*[F.col(r).alias(row_col) for r in row], F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.when(F.col("size") > 0, F.col("size") * times).otherwise(0).cast("long").alias("taken"))
