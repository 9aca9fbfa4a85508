"""Exact deduplication by skew-safe combining: local winners, salted merges, then one merge of the salts' winners.

Every merge groups by digest and by the whole text, so equality is always decided on contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_groups(docs: DataFrame, salts: int = 16, normalise=lambda text: text) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    docs: columns doc_id and text; others are dropped. Texts are equal when identical after normalise (null counts as empty).
    The largest doc_id of equal texts stays.

    1. Spark's partial aggregate, keyed by digest and text, leaves one row per task and text: the local winner.
    2. Local winners meet by (digest, salt, text), the salt taken from the task, so a text that every task holds is spread.
    3. The salts' winners, salts rows a text at most, meet by (digest, text).
    Rows then take their group's outcome by a join on digests, without texts; Spark splits its large keys.

    Rows that repeat a doc_id count in group_size and share its verdict. A null doc_id never wins over another; a group of
    null ids only has keep_id null and kept true. An empty table gives no rows.
    """
    text = normalise(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", text.alias("text"))

    def digests(text: Column) -> list[Column]:
        return [F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.xxhash64(text).alias("check"), F.octet_length(text).alias("bytes")]

    keyed = rows.select("doc_id", "text", *digests(F.col("text")))
    salted = keyed.withColumn("salt", F.spark_partition_id() % salts)
    by_salt = salted.groupBy("digest", "check", "bytes", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = by_salt.groupBy("digest", "check", "bytes", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    groups = groups.select("digest", "check", "bytes", "keep_id", "group_size")

    members = rows.select("doc_id", *digests(F.col("text")))
    joined = members.join(groups, ["digest", "check", "bytes"])
    return joined.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
