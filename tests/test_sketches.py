"""Sketches that merge, and slices with a tail."""

import datetime as dt

from pyspark.sql import functions as F

from strandline.operators import sketches as s
from strandline.plans.folders import new_folder


def test_merged_windows_are_within_their_errors(spark):
    rows = spark.range(200_000).select(F.lit("all").alias("g"), (F.xxhash64("id") % 30_000).alias("pubkey"), (F.col("id") % 1000).alias("sats"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 13).alias("ts"))
    daily = s.daily(rows, ("g",)).persist()
    until = rows.agg(F.max("ts")).first()[0].date()
    got = {r["days"]: r for r in s.windows(daily, ("g",), F.lit(until), (1, 7, 30)).collect()}
    for days in (1, 7, 30):
        own = rows.where((F.to_date("ts") > F.date_sub(F.lit(until), days)) & (F.to_date("ts") <= F.lit(until)))
        n, users = own.agg(F.count(F.lit(1)), F.countDistinct("pubkey")).first()
        assert got[days]["n"] == n and abs(got[days]["users"] - users) <= s.USERS_ERROR * users
        for q, share in zip(got[days]["amounts"], (0.5, 0.9), strict=True):
            assert abs(own.where(F.col("sats") <= q).count() / n - share) <= s.RANK_ERROR


def test_slice_and_tail_equal_a_recount(spark):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(k % 3, k % 50, at + dt.timedelta(minutes=7 * k)) for k in range(600)], "relay int, event_id long, seen_at timestamp_ntz")
    early = rows.where("event_id % 5 > 0")
    slices = s.HourlySlices(spark, new_folder(spark, "slices"), 4)
    whole = sorted(map(tuple, s.HourlySlices.counted(rows).collect()))
    assert sorted(map(tuple, slices.read(rows, "2024-01-01 00:00:00").collect())) == whole
    slices.advance(early, None, "2024-01-02 00:00:00")
    slices.advance(early, "2024-01-02 00:00:00", "2024-01-03 05:00:00")
    assert sorted(map(tuple, slices.read(rows, "2024-01-03 05:00:00").collect())) != whole
    slices.repair(rows, rows.where("event_id % 5 = 0"), "2024-01-03 05:00:00")
    assert sorted(map(tuple, slices.read(rows, "2024-01-03 05:00:00").collect())) == whole
