"""Rollups that merge: daily sketches of users and amounts for any window, and exact slices up to a watermark with a raw tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.folders import new_folder
from ..plans.template import build, define_computed, oracle
from ..sources.store import Store
from .graph import cut

#: Distinct users: 2 ** LG cells, a standard error of 1.04 / 2 ** (LG / 2), 1.6 %. Quantiles: K, a rank error of 1.7 % in 99 of 100 cases.
LG, K = 12, 200
USERS_ERROR, RANK_ERROR = 0.05, 0.03


def daily(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, day, n, users (a HyperLogLog sketch), amounts (a KLL sketch) of rows (by, ts, pubkey, sats).

    A sketch is a few kilobytes, made partly in the tasks that hold the rows, so a hot group costs no more than another. Null users
    and amounts are not counted.
    """
    grouped = rows.groupBy(*by, F.to_date("ts").alias("day"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("pubkey", F.lit(LG)).alias("users"), F.kll_sketch_agg_bigint(F.col("sats").cast("long"), F.lit(K)).alias("amounts"))


def windows(sketches: DataFrame, by: tuple[str, ...], until: Column, days: tuple[int, ...], shares: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """by, days, n, users (estimate), amounts (array of the quantiles at shares) of the last days up to until, from daily sketches only.

    Sketches merge without loss, so the estimate of a window is that of its rows, and no raw row is read again.
    """
    each = sketches.select(*by, "day", "n", "users", "amounts", F.explode(F.array(*map(F.lit, days))).alias("days"))
    own = each.where((F.col("day") > F.date_sub(until, F.col("days"))) & (F.col("day") <= until)).groupBy(*by, "days")
    merged = own.agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"), F.kll_merge_agg_bigint("amounts").alias("a"))
    return merged.select(*by, "days", "n", "users", F.array(*(F.kll_sketch_get_quantile_bigint("a", F.lit(s)) for s in shares)).alias("amounts"))


class HourlySlices:
    """Rows and distinct events by relay and hour: a stored slice of the hours before a watermark, and the rest from raw rows.

    rows: relay, event_id, seen_at. The watermark is a whole hour, so an hour is in the slice or in the tail and distinct counts
    add up. Rows that come later for an hour of the slice name the hours that are counted again. The slice is in buckets by day.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        self.slice = Store(spark, path, ("relay", "hour"), ("-version",), bucket_by=("day",), buckets=buckets)

    @staticmethod
    def counted(rows: DataFrame) -> DataFrame:
        hours = rows.withColumn("hour", F.date_trunc("hour", F.col("seen_at").cast("timestamp")).cast("timestamp_ntz"))
        return hours.groupBy("relay", "hour").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("events"))

    def _put(self, counts: DataFrame) -> None:
        version = (self.slice.batches() or [-1])[-1] + 1
        self.slice.upsert(counts.withColumn("day", F.to_date("hour")).withColumn("version", F.lit(version)), version)

    def advance(self, rows: DataFrame, since, until) -> None:
        """Take the hours from since (None: all before) up to until, both whole hours, into the slice."""
        part = rows.where(F.col("seen_at") < until)
        self._put(self.counted(part if since is None else part.where(F.col("seen_at") >= since)))

    def repair(self, rows: DataFrame, late: DataFrame, until) -> None:
        """Count the hours anew that late rows fall into and that the slice holds; rows: all, late ones too."""
        hour = lambda df: F.date_trunc("hour", df["seen_at"].cast("timestamp"))
        dirty = late.where(F.col("seen_at") < until).select("relay", hour(late).alias("__hour")).distinct().withColumnRenamed("relay", "__relay")
        self._put(self.counted(rows.where(F.col("seen_at") < until).join(dirty, (F.col("relay") == F.col("__relay")) & (hour(rows) == F.col("__hour")), "left_semi")))

    def read(self, rows: DataFrame, until) -> DataFrame:
        """relay, hour, n, events: the slice, and the hours from until on from rows."""
        tail = self.counted(rows.where(F.col("seen_at") >= until))
        held = self.slice.read()
        return tail if held is None else held.select("relay", "hour", "n", "events").union(tail)


def _window_estimates(ev: DataFrame, present: DataFrame) -> DataFrame:
    """Windows from sketches, held against the raw rows: exact counts, and whether the estimates are within their errors."""
    until = present.first()["as_of"].date()  # one row
    found = windows(cut(daily(ev, ("kind",))), ("kind",), F.lit(until), (7, 30))
    each = ev.select("kind", "pubkey", "sats", F.to_date("ts").alias("day"), F.explode(F.array(F.lit(7), F.lit(30))).alias("days")).where((F.col("day") > F.date_sub(F.lit(until), F.col("days"))) & (F.col("day") <= F.lit(until)))
    both = each.join(found.withColumnsRenamed({"n": "of", "users": "about"}), ["kind", "days"])
    shares = [F.avg((F.col("sats") < F.get("amounts", k)).cast("double")).alias(f"below{k}") for k in (0, 1)] + [F.avg((F.col("sats") <= F.get("amounts", k)).cast("double")).alias(f"upto{k}") for k in (0, 1)]
    held = both.groupBy("kind", "days").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pubkey").alias("users"), F.first("of").alias("of"), F.first("about").alias("about"), *shares)
    close = F.abs(F.col("about") - F.col("users")) <= F.greatest(F.lit(1.0), USERS_ERROR * F.col("users"))
    ranks = [(F.col(f"below{k}") <= s + RANK_ERROR) & (F.col(f"upto{k}") >= s - RANK_ERROR) for k, s in ((0, 0.5), (1, 0.9))]
    return held.select("kind", "days", F.col("of").alias("n"), "users", close.alias("users_close"), (ranks[0] & ranks[1]).alias("amounts_close"))


define_computed("eco_window_estimates", "Events and users by kind over 7 and 30 days from merged daily sketches, and whether the estimates keep their errors.", ("ev", "present"), _window_estimates, """
SELECT kind, days, count(*) AS n, count(DISTINCT pubkey) AS users, true AS users_close, true AS amounts_close FROM ev CROSS JOIN present CROSS JOIN (SELECT unnest([7, 30]) AS days) w
WHERE CAST(ts AS DATE) > CAST(as_of AS DATE) - days AND CAST(ts AS DATE) <= CAST(as_of AS DATE) GROUP BY kind, days""")


def _sliced_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours by relay: two slices, rows that come late for them, and a raw tail."""
    rows = build(spark, sf_dir, "sightings")
    early = rows.where("event_id % 10 > 0")
    slices = HourlySlices(spark, new_folder(spark, "slices"), 16)
    slices.advance(early, None, "1997-01-01 00:00:00")
    slices.advance(early, "1997-01-01 00:00:00", "1999-06-01 00:00:00")
    slices.repair(rows, rows.where("event_id % 10 = 0"), "1999-06-01 00:00:00")
    return slices.read(rows, "1999-06-01 00:00:00")


QUERIES = {"rel_activity_sliced": _sliced_query}


def oracles() -> dict[str, str]:
    return {"rel_activity_sliced": oracle("rel_activity_hourly")}
