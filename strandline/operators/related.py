"""Related notes by sets of hashtags, without a row for each pair of notes that share one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.folders import cut

#: Notes of a hashtag that are candidates, and places of a note's list.
NEWEST, PLACES = 200, 10


def related_notes(notes: DataFrame, norm_tag_hashtags: DataFrame, best_of_author: DataFrame, repost_notes: DataFrame, thr_edges: DataFrame) -> DataFrame:
    """one, two, reasons, score, rn: disc_related_notes.

    Notes with the same set of hashtags share them with the same candidates, so those are scored once a set. What another reason
    relates to a note gets its hashtags' score by a join. Of all others, which have hashtags only, a note's first ten without
    itself suffice: whatever comes after them has ten before it, as other reasons only add.
    """
    sets = cut(norm_tag_hashtags.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("tags")))
    order = Window.partitionBy("tag").orderBy(F.desc("created_at"), F.desc("id"))
    dated = norm_tag_hashtags.join(notes.select("id", "created_at"), F.col("event_id") == F.col("id")).select("tag", "id", "created_at")
    newest = dated.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= NEWEST).select("tag", F.col("id").alias("two"))
    each = sets.select("tags").distinct().select("tags", F.explode(F.split("tags", " ")).alias("tag"))
    shared = cut(each.join(newest, "tag").groupBy("tags", "two").agg((30 + 5 * F.count(F.lit(1))).alias("hashtag")))
    leading = Window.partitionBy("tags").orderBy(F.desc("hashtag"), "two")
    first = cut(shared.withColumn("rn", F.row_number().over(leading)).where(F.col("rn") <= PLACES + 1).select("tags", "two", "hashtag"))
    near = sets.join(first, "tags").where("event_id <> two").select(F.col("event_id").alias("one"), "two", F.lit(None).cast("string").alias("reason"), F.lit(0).cast("long").alias("score"), "hashtag")

    of_sets = sets.select(F.col("event_id").alias("__id"), "tags")
    own = notes.select("id", "pubkey").join(of_sets, F.col("id") == F.col("__id"), "left").select(F.col("id").alias("one"), "pubkey", "tags")
    best = best_of_author.select("pubkey", F.col("id").alias("two"), "engaged")
    author = own.join(best, "pubkey").where("one <> two").select("one", "two", F.lit("author").alias("reason"), (20 + F.least(F.lit(20), F.col("engaged"))).cast("long").alias("score"), "tags")

    def both_ways(pairs: DataFrame, reason: str, forth: int, back: int) -> DataFrame:
        ways = pairs.select("one", "two", F.lit(forth).alias("score")).union(pairs.select("two", "one", F.lit(back)))
        return ways.groupBy("one", "two").agg(F.max("score").cast("long").alias("score")).select("one", "two", F.lit(reason).alias("reason"), "score")

    reposts = both_ways(repost_notes.select(F.col("target_id").alias("one"), F.col("id").alias("two")), "repost", 50, 45)
    threads = both_ways(thr_edges.where("not parent_missing").select(F.col("parent").alias("one"), F.col("child").alias("two")), "thread", 35, 30)
    sparse = reposts.union(threads).join(of_sets, F.col("one") == F.col("__id"), "left").select("one", "two", "reason", "score", "tags")
    others = author.union(sparse).join(shared, ["tags", "two"], "left").select("one", "two", "reason", "score", "hashtag")

    pairs = near.union(others).repartition("one").groupBy("one", "two").agg(F.collect_set("reason").alias("reasons"), F.sum("score").alias("score"), F.max("hashtag").alias("hashtag"))
    reasons = F.when(F.col("hashtag").isNull(), F.col("reasons")).otherwise(F.array_union("reasons", F.array(F.lit("hashtag"))))
    scored = pairs.select("one", "two", F.array_join(F.array_sort(reasons), ",").alias("reasons"), (F.col("score") + F.coalesce("hashtag", F.lit(0))).alias("score"))
    ranked = Window.partitionBy("one").orderBy(F.desc("score"), "two")
    return scored.withColumn("rn", F.row_number().over(ranked)).where(F.col("rn") <= PLACES)
