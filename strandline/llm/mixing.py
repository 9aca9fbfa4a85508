"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

DataFrame functions only. Shuffles carry ids and sizes, never texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the order key that make a slice: 16 ** 3 slices of each source.
SLICE_DIGITS = 3


def water_fill(sources: DataFrame, budget: Column, max_epochs: float) -> DataFrame:
    """Targets of the sources (columns source, source_size, weight), as column target.

    The level is where the sum of least(max_epochs * size, level * weight) meets the budget: sources sorted by the level at
    which they are full, those below the level stay at their cap and their excess goes to the others by weight.
    One row a source; a budget above all caps fills every source.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (
        sources.withColumn("cap", cap)
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("budget", budget)
        .withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("budget") - F.col("filled")) / F.col("weight_left"))
        .withColumn("water", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything))
    )
    above = F.col("water").isNotNull() & (F.col("full_at") > F.col("water"))
    return rows.select("source", "source_size", "weight", F.when(above, F.col("water") * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """Repetitions of each document so that sources come near their targets.

    docs: columns doc_id, source, size (long). Returns doc_id, source, size, source_size, target, repeats, taken: one row per
    input row. Sources by code point, null last, take the weights in turn; the budget is share * all sizes, and no source is
    repeated more than max_epochs times. Of a source with target / size = w + f, every document is taken w times, and those
    first in a keyed order once more until f * size words are reached, to the nearest document.

    A source may hold most rows: rows are dealt by (source, slice of the order key), so no task holds a source. Rows alike in
    every column are told apart by their place only. Null or negative sizes count as 0; a source of size 0 has target 0; an
    empty table gives no rows; a null doc_id is ordered by the key of the empty string. Other columns are dropped.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select("doc_id", "source", F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("long").alias("size"), key.alias("key"))
    rows = rows.withColumn("slice", F.substring("key", 1, SLICE_DIGITS))

    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    sources = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sources.withColumn("weight", weight)
    targets = water_fill(sources, F.sum("source_size").over(everything) * F.lit(float(share)), max_epochs)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = targets.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))

    # the words of a source that stand in earlier slices: at most 16 ** SLICE_DIGITS rows a source
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
    plan = slices.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
    plan = plan.select(F.col("source").alias("p_source"), F.col("slice").alias("p_slice"), "source_size", "target", "whole", "part", "before")

    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("so_far", F.sum("size").over(inside))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("slice") == F.col("p_slice")))
    once_more = (F.col("part") > 0) & (F.col("before") + F.col("so_far") - F.col("size") / 2 <= F.col("part"))
    repeats = (F.col("whole") + once_more.cast("long")).cast("long")
    rows = rows.withColumn("repeats", repeats)
    return rows.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs with each row as often as plan (doc_id, repeats) says; rows that plan lacks or has at 0 go.

    A doc_id that plan has more than once gets its largest count.
    """
    times = plan.groupBy("doc_id").agg(F.max("repeats").alias("repeats")).where("repeats > 0")
    times = times.select(F.col("doc_id").alias("__mix_id"), F.sequence(F.lit(1).cast("long"), F.col("repeats")).alias("__mix_times"))
    joined = docs.join(times, docs["doc_id"].eqNullSafe(F.col("__mix_id")))
    return joined.withColumn("__mix_time", F.explode("__mix_times")).select(*(docs[c] for c in docs.columns))
