"""Streaming jobs: what a batch reads, state that expires, counts once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strandline.plans.folders import new_folder
from strandline.streaming.known import KnownIds

DAY = dt.date(2024, 1, 1)


def rows(spark, pairs):
    return spark.createDataFrame([(i, DAY + dt.timedelta(d) if d is not None else None, "x") for i, d in pairs], "id string, day date, body string")


def store(known, new, batch):
    new.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(known.events)
    known.add(new, batch)


@pytest.fixture
def hundred_days(spark):
    root = new_folder(spark, "known")
    known = KnownIds(spark, f"{root}/events", f"{root}/filters")
    stored = [(f"e{d}-{k}", d) for d in range(100) for k in range(20)] + [("no day", None)]
    store(known, rows(spark, stored), 0)
    return known


def test_only_the_days_of_a_batch_are_read(spark, hundred_days):
    known = hundred_days
    batch = rows(spark, [("e3-1", 3), ("fresh", 3), ("e40-0", 40), ("e40-0", 41), ("other", 200), ("no day", None), ("none", None)])
    new = known.new(batch, 1)
    assert sorted((r["id"], (r["day"] - DAY).days if r["day"] else None) for r in new.collect()) == [("e40-0", 41), ("fresh", 3), ("none", None), ("other", 200)]
    read = [f for f in known.stored([DAY + dt.timedelta(3)], 1).inputFiles()]
    assert read and all("day=2024-01-04" in f for f in read)
    plan = known.stored([DAY + dt.timedelta(3), DAY + dt.timedelta(4)], 1)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "PartitionFilters" in plan and "2024-01-0" in plan.split("PartitionFilters")[1]


def test_without_suspects_no_stored_day_is_read(spark, hundred_days, monkeypatch):
    asked = []
    monkeypatch.setattr(KnownIds, "stored", lambda self, days, before: asked.extend(days))
    fresh = rows(spark, [(f"fresh{k}", k % 100) for k in range(50)])
    assert hundred_days.new(fresh, 1).count() == 50 and asked == []


def test_a_full_filter_and_reruns_change_nothing(spark, monkeypatch):
    from strandline.streaming import known as module

    monkeypatch.setattr(module, "WORDS", 1)
    monkeypatch.setattr(module, "SHARDS", 1)
    root = new_folder(spark, "known")
    known = KnownIds(spark, f"{root}/events", f"{root}/filters")
    rng, seen = random.Random(1), set()
    for batch in range(3):
        pairs = {(f"e{rng.randrange(300)}", rng.randrange(3)) for _ in range(150)}
        for _ in range(2):
            new = known.new(rows(spark, pairs), batch).persist()
            assert {(r["id"], (r["day"] - DAY).days) for r in new.collect()} == pairs - seen
            store(known, new, batch)
        seen |= pairs


def hours(spark, rows):
    return spark.createDataFrame([(i, u, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for i, u, m in rows], "event_id long, user_id long, ts timestamp_ntz").withColumn("ts", F.col("ts").cast("timestamp"))


def budget(spark, batches, per_hour=2, chunk=10_000):
    """What passes, and the path of the state."""
    from strandline.streaming.budget import rocksdb, within_budget
    from strandline.streaming.jobs import start

    path, out = new_folder(spark, "files"), new_folder(spark, "out")
    for k, b in enumerate(batches):
        hours(spark, b).coalesce(1).write.parquet(f"{path}/{k}")
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", chunk)
    with rocksdb(spark):
        start(within_budget(stream, per_hour), out).awaitTermination()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    return sorted(r["event_id"] for r in spark.read.parquet(out).collect()), f"{out}-state"


def test_budget_does_not_depend_on_chunks(spark):
    rng = random.Random(4)
    batches = [[(k * 1000 + i, rng.randrange(3), k * 60 + rng.randrange(60)) for i in range(60)] for k in range(3)]
    want = []
    for b in batches:  # batches are an hour each, and hours don't meet
        for u in range(3):
            want += [i for _, i in sorted((m, i) for i, v, m in b if v == u)[:2]]
    assert budget(spark, batches)[0] == budget(spark, batches, chunk=3)[0] == sorted(want)


def test_an_hour_is_shared_by_batches(spark):
    assert budget(spark, [[(1, 7, 5)], [(2, 7, 3), (3, 7, 50)], [(4, 7, 59), (5, 8, 59)]])[0] == [1, 2, 5]


def test_an_idle_recipient_has_no_state(spark):
    day = 24 * 60
    _, state = budget(spark, [[(1, 7, 5), (2, 8, 6)], [(3, 8, day)], [(4, 9, 4 * day)], [(5, 9, 4 * day + 200)]])
    held = spark.read.format("statestore").option("path", state).option("stateVarName", "taken").load()
    assert {r[0] for r in held.select("key.user_id").collect()} == {9}


CLAIM = "event_id long, counter string, key long, amount long, ts timestamp, sign int"


def claims(spark, rows):
    return spark.createDataFrame([(i, "n", k, a, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), s) for i, k, a, h, s in rows], CLAIM)


def test_an_event_counts_once_and_is_purged_once(spark, monkeypatch):
    from strandline.sources.store import Store
    from strandline.streaming.counters import ClaimedCounters

    c = ClaimedCounters(spark, new_folder(spark, "claims"), keep_hours=100, buckets=4)
    sums = lambda: {r["key"]: r["amount"] for r in c.sums().collect()}
    first = claims(spark, [(1, 7, 5, 0, 1), (1, 7, 5, 1, 1), (2, 7, 3, 0, 1), (3, 8, 1, 0, 1)])
    c.apply(first, 0)
    assert sums() == {7: 8, 8: 1}
    c.apply(first, 0)
    assert sums() == {7: 8, 8: 1}
    second = claims(spark, [(1, 7, 5, 0, 1), (4, 7, 1, 2, 1), (2, None, None, 0, -1), (2, None, None, 0, -1), (99, None, None, 0, -1)])
    # cut off before its claims are committed, then run again
    monkeypatch.setattr(Store, "_commit", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        c.apply(second, 1)
    monkeypatch.undo()
    for _ in range(2):
        c.apply(second, 1)
        assert sums() == {7: 6, 8: 1}
    c.apply(claims(spark, [(2, None, None, 0, -1), (3, 8, 1, 3, 1)]), 2)
    assert sums() == {7: 6, 8: 1}
    c.apply(claims(spark, [(2, 7, 3, 4, 1), (5, 8, 2, 4, 1), (5, 8, 2, 4, -1)]), 3)  # after its purge an event counts anew
    assert sums() == {7: 9, 8: 1}


def test_claims_pass_with_time_and_late_rows_are_set_aside(spark):
    from strandline.streaming.counters import ClaimedCounters

    c = ClaimedCounters(spark, new_folder(spark, "claims"), keep_hours=10, buckets=1)
    c.apply(claims(spark, [(1, 7, 1, 0, 1)]), 0)
    c.apply(claims(spark, [(2, 7, 1, 50, 1)]), 1)
    c.apply(claims(spark, [(3, 7, 1, 51, 1), (1, 7, 1, 0, 1)]), 2)
    assert {r["key"]: r["amount"] for r in c.sums().collect()} == {7: 3}
    assert {r["event_id"] for r in c.ledger.read().collect()} == {2, 3}
    assert {r["event_id"] for r in spark.read.parquet(f"{c.path}/late").collect()} == {1}


def users(spark, rows):
    return spark.createDataFrame([(i, u, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for i, u, h in rows], "event_id long, user_id long, ts timestamp")


def counted(c):
    return {r["user_id"]: r["events"] for r in c.counters.read().collect()}


def test_a_recount_reads_what_changed(spark):
    from strandline.streaming.counters import UserCounters

    c = UserCounters(spark, new_folder(spark, "users"), buckets=32)
    c.apply(users(spark, [(i, i % 100, i % 500) for i in range(3000)]), 0)
    size = lambda df: sum(spark.sparkContext._jvm.java.io.File(f.removeprefix("file://").removeprefix("file:")).length() for f in df.inputFiles())
    batch = users(spark, [(5000, 42, 1), (42, 42, 42)])
    buckets = c.events.touched(batch)
    c.apply(batch, 1)
    assert len(buckets) == 1 and size(c.events.read(buckets)) < size(c.events.read()) / 10
    assert {b for b, f in c.events.manifest()["buckets"].items() if f.startswith(f"data/{1:012d}")} == {str(buckets[0])}
    assert counted(c) == {u: 31 if u == 42 else 30 for u in range(100)}


def test_scopes(spark):
    from strandline.streaming.counters import UserCounters

    c = UserCounters(spark, new_folder(spark, "users"), buckets=4)
    c.apply(users(spark, [(i, i % 10, i) for i in range(100)]), 0)
    wrong = c.counters.read().select("user_id", F.lit(-1).cast("long").alias("events"), "last_at", F.lit(1).alias("version"))
    c.counters.upsert(wrong, 1)
    right = lambda: {u for u, n in counted(c).items() if n == 10}
    c.rebuild("event", of=spark.createDataFrame([(13,), (777,)], "event_id long"))
    assert right() == {3}
    c.rebuild("author", of=spark.createDataFrame([(5,), (999,)], "user_id long"))
    assert right() == {3, 5} and counted(c)[999] == 0
    c.rebuild("range", since=dt.datetime(2024, 1, 1, 21), until=dt.datetime(2024, 1, 1, 22))
    assert right() == {1, 2, 3, 5}
    c.rebuild("all")
    assert right() == set(range(10))
    with pytest.raises(ValueError, match="scope"):
        c.rebuild("some")


def test_a_batch_of_many_rows_has_several_files(spark, monkeypatch):
    from strandline.streaming import jobs

    monkeypatch.setattr(jobs, "FILE_ROWS", 100)
    seen = []
    stream = jobs._batches(spark, spark.range(1000).withColumnRenamed("id", "x"), F.col("x") % jobs.FILES)

    def look(batch, batch_id):
        seen.append((len(batch.inputFiles()) > 1 or batch.select(F.input_file_name()).distinct().count() > 1, {r[0] for r in batch.select("arrival").distinct().collect()}, batch.count()))

    stream.writeStream.option("checkpointLocation", jobs.folder(spark, "seen")).foreachBatch(look).trigger(availableNow=True).start().awaitTermination()
    assert seen == [(True, {0}, 334), (True, {1}, 333), (True, {2}, 333)]
