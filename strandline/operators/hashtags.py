"""Hashtags of posts and how many posts have a word, without a row for each word of each post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.folders import cut

#: Words of a post that are looked at first; posts that need more are looked at whole.
SOON = 25


def _words(text: Column) -> Column:
    """Distinct words of four letters or more in lower case, in the order of their first places."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]{4,}"), F.lit(0)), F.lower))


def parted(posts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """posts whose id no other has, and those that share theirs or have none; None if there are none of these."""
    shared = cut(posts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").select(F.col("id").alias("shared")))
    if shared.isEmpty():
        return posts, None
    same = F.col("id").eqNullSafe(F.col("shared"))
    return posts.join(shared, same, "left_anti"), posts.join(shared, same, "left_semi")


def rows_of(posts: DataFrame) -> DataFrame:
    """id, author, ts, lang, tag, pos: post_words of posts that share their ids."""
    each = posts.select("id", "author", "ts", "lang", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("pos", "x"))
    return each.groupBy("id", "author", "ts", "lang", F.lower("x").alias("tag")).agg(F.min("pos").alias("pos"))


def tag_counts(posts: DataFrame) -> DataFrame:
    """tag, df, id: how many posts have a word, and the post of a word that one has. Counts meet in the tasks before the shuffle."""
    once, others = parted(posts)
    each = once.select("id", F.explode(_words(F.col("text"))).alias("tag"))
    if others is not None:
        each = each.unionByName(rows_of(others).select("id", "tag"))
    return cut(each.groupBy("tag").agg(F.count(F.lit(1)).alias("df"), F.min("id").alias("id")))


def hashtags(posts: DataFrame, tag_counts: DataFrame) -> DataFrame:
    """id, author, ts, lang, tag: the first five words of each post that two posts have.

    A post's words that no other has are few, so they come to it, and not all its words to their counts. Its first SOON words go
    with its id; the whole text is looked at again only where those don't hold five, nor all of its words.
    """
    once, others = parted(posts)
    alone = cut(tag_counts.where("df = 1").groupBy("id").agg(F.collect_list("tag").alias("alone")).withColumnRenamed("id", "own"))

    def first(heads: DataFrame) -> DataFrame:
        """heads (id, author, ts, lang, w, more) with tags, the first five of w that other posts have too."""
        met = heads.join(alone, F.col("id") == F.col("own"), "left")
        return met.withColumn("tags", F.slice(F.array_except("w", F.coalesce("alone", F.array().cast("array<string>"))), 1, 5)).drop("alone", "own")

    heads = once.select("id", "author", "ts", "lang", _words(F.col("text")).alias("all")).select("id", "author", "ts", "lang", F.slice("all", 1, SOON).alias("w"), (F.size("all") > SOON).alias("more"))
    soon = cut(first(heads))
    open_ = soon.where("more and size(tags) < 5").select("id")
    out = soon.where("not more or size(tags) = 5").select("id", "author", "ts", "lang", F.explode("tags").alias("tag"))
    if not open_.isEmpty():
        rest = once.join(open_, "id", "left_semi").select("id", "author", "ts", "lang", _words(F.col("text")).alias("w"))
        out = out.unionByName(first(rest).select("id", "author", "ts", "lang", F.explode("tags").alias("tag")))
    if others is not None:
        order = Window.partitionBy("id").orderBy("pos", "tag")
        met = rows_of(others).join(tag_counts.where("df >= 2").select("tag"), "tag", "left_semi")
        out = out.unionByName(met.withColumn("rn", F.row_number().over(order)).where("rn <= 5").select("id", "author", "ts", "lang", "tag"))
    return cut(out)


def frequent(posts: DataFrame, tag_counts: DataFrame) -> DataFrame:
    n = posts.agg(F.count(F.lit(1)).alias("n"))  # one row
    return cut(tag_counts.crossJoin(F.broadcast(n)).where("df >= 100 and df * 50 >= n").select("tag", "df"))
