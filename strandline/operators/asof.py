"""As-of joins: for each row the last of other rows at or before it, by key, time and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.template import define_computed


def as_of(rows: DataFrame, marks: DataFrame, key: str, order: tuple[str, ...], slice_: Column) -> DataFrame:
    """rows with the column mark, a struct of marks' columns: the last of marks with the same key and not after the row by order; null if none.

    Both are put together and ordered, and the last mark so far is carried along, so no row meets more than its neighbours and a range
    is never joined. slice_ (an expression of order that never falls as order rises, such as a day) cuts a key into slices
    that different tasks take: what a slice starts with is the last mark of those before, one row a slice. Where order ties, the mark
    counts as before the row. A null key has no marks; rows of null order come first.
    """
    names = marks.columns
    kept = F.struct(*names)
    left = rows.select(F.col(key).alias("__key"), slice_.alias("__slice"), F.struct(*order).alias("__order"), F.lit(1).alias("__side"), F.struct(*rows.columns).alias("__row"), F.lit(None).cast(marks.select(kept.alias("m")).schema["m"].dataType).alias("__mark"))
    right = marks.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), slice_.alias("__slice"), F.struct(*order).alias("__order"), F.lit(0).alias("__side"), F.lit(None).cast(rows.select(F.struct(*rows.columns).alias("r")).schema["r"].dataType).alias("__row"), kept.alias("__mark"))
    both = left.unionByName(right)
    within = Window.partitionBy("__key", "__slice").orderBy("__order", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("__seen", F.last("__mark", ignorenulls=True).over(within)).where("__side = 1")
    # the last mark before each slice
    last = both.groupBy("__key", "__slice").agg(F.max_by("__mark", F.when(F.col("__side") == 0, F.col("__order"))).alias("__last"))
    before = Window.partitionBy("__key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("__key", "__slice", F.last("__last", ignorenulls=True).over(before).alias("__carried")).where("__carried is not null")
    carried = carried.withColumnsRenamed({"__key": "__k", "__slice": "__s"})
    out = seen.join(carried, F.col("__key").eqNullSafe(F.col("__k")) & F.col("__slice").eqNullSafe(F.col("__s")), "left")
    return out.select("__row.*", F.coalesce("__seen", "__carried").alias("mark"))


def _last_note(acts: DataFrame, notes: DataFrame) -> DataFrame:
    """Each interaction with its actor's own last note before it."""
    rows = acts.select("source_id", "target_id", "relation", F.col("actor").alias("pubkey"), "created_at", F.col("source_id").alias("id"))
    marks = notes.select("pubkey", "created_at", "id")
    found = as_of(rows, marks, "pubkey", ("created_at", "id"), F.floor(F.col("created_at") / 86400))
    return found.select("source_id", "target_id", "relation", F.col("mark.id").alias("last_note"), (F.col("created_at") - F.col("mark.created_at")).alias("seconds"))


define_computed("join_as_of", "Each interaction with its actor's own last note by time and id, at or before it.", ("acts", "notes"), _last_note, """
SELECT source_id, target_id, relation, m.id AS last_note, created_at - m.created_at AS seconds FROM (
  SELECT a.source_id, a.target_id, a.relation, a.created_at, max({'created_at': n.created_at, 'id': n.id}) AS m
  FROM acts a LEFT JOIN notes n ON n.pubkey = a.actor AND (n.created_at < a.created_at OR (n.created_at = a.created_at AND n.id <= a.source_id)) GROUP BY ALL) x""")
