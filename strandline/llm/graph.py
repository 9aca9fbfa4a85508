"""Union-find over edges as tables: large-star and small-star rounds until nothing changes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (u, v); component is the smallest node reachable.

    Each round hooks every node's larger neighbours to its least neighbour (large star), then its smaller neighbours to the
    least of them (small star); rounds grow with the logarithm of a component's size. A round is two shuffles of the edges,
    each by a join that Spark can split at hot nodes; only two numbers a round reach the driver. Self edges and nulls are
    dropped; no edges give no rows.
    """
    now = edges.where("u is not null and v is not null and u <> v")
    now = written(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sign = _sign(now)
    while sign[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        hooked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = written(hooked.where("u <> v").distinct(), "edges")
        before, sign = sign, _sign(now)
        if sign == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _sign(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
