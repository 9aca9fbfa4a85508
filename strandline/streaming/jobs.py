"""Structured Streaming jobs. Each takes a streaming frame and a folder; the queries run them over the driver's files to the end.

The queries' fixtures are the driver's events in several files, one a batch, with what the jobs are there for: repeats in later
batches, parents that come after their children, and retractions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.folders import new_folder as folder
from ..sources.payloads import payloads_of, validate_events
from .budget import rocksdb, within_budget
from .counters import ClaimedCounters, UserCounters
from .known import KnownIds


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def start(stream: DataFrame, out: str, mode: str = "append") -> StreamingQuery:
    """Each batch to out/batch=<id>, written anew if the batch runs again: so every row counts once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").foreachBatch(write).trigger(availableNow=True).start()


def ingest(raw: DataFrame, out: str, blocked: DataFrame | None = None) -> StreamingQuery:
    """Raw payloads (relay_url, payload) to out/events, out/quarantine and out/sightings.

    blocked: pubkeys whose events don't pass the gate. An event is stored once: ids are dropped that the batch repeats, and those
    that earlier batches stored on the same day of their own time. Known ids are looked up by the batch's days (known.KnownIds): in a
    filter a day, then, for those that it can't rule out, in that day's files, which alone are listed and read. Sightings of every
    accepted event are kept, by relay. A batch that runs again replaces what it wrote.
    """
    known = KnownIds(raw.sparkSession, f"{out}/events", f"{out}/filters")

    def write(batch: DataFrame, batch_id: int) -> None:
        found = validate_events(batch).persist()
        good = found.where("error_code is null").select("relay_url", "e.*")
        if blocked is not None:
            good = good.join(blocked, "pubkey", "left_anti")
        new = good.drop("relay_url").dropDuplicates(["id"]).withColumn("day", F.to_date(F.timestamp_seconds("created_at")))
        new = known.new(new, batch_id).persist()
        new.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{out}/events")
        known.add(new, batch_id)
        good.select(F.col("id").alias("event_id"), "relay_url").distinct().write.mode("overwrite").parquet(f"{out}/sightings/batch={batch_id}")
        found.where("error_code is not null").select("relay_url", "payload", "error_code", "error_stage").write.mode("overwrite").parquet(f"{out}/quarantine/batch={batch_id}")
        new.unpersist()
        found.unpersist()

    return raw.writeStream.option("checkpointLocation", f"{out}-state").foreachBatch(write).trigger(availableNow=True).start()


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first of the rows of an event_id that come within delay of each other by ts, over batches."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def tumbling(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events and values by type and hour; rows later than delay are dropped."""
    hours = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "event_type")
    return hours.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("window.start").alias("hour"), "event_type", "n", "value")


def sliding(events: DataFrame, delay: str = "1 hour", size: str = "24 hours", step: str = "1 hour") -> DataFrame:
    """Events of the last size by type, every step."""
    days = events.withWatermark("ts", delay).groupBy(F.window("ts", size, step), "event_type")
    return days.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("since"), "event_type", "n")


def sliding_week(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    return sliding(events, delay, "7 days", "1 day")


def repaired(notes: DataFrame, delay: str = "60 days") -> DataFrame:
    """child, parent, late of the references of notes (id, parent, ts, arrival) whose parent arrives, before or after the child.

    Two streams of the same notes meet on the parent's id; each side waits for the other for delay of event time.
    """
    children = notes.where("parent is not null").withWatermark("ts", delay).select(F.col("id").alias("child"), "parent", F.col("ts").alias("child_ts"), F.col("arrival").alias("child_arrival"))
    parents = notes.withWatermark("ts", delay).select(F.col("id").alias("known"), F.col("ts").alias("parent_ts"), F.col("arrival").alias("parent_arrival"))
    meet = (F.col("parent") == F.col("known")) & F.expr(f"child_ts >= parent_ts - INTERVAL {delay} AND child_ts <= parent_ts + INTERVAL {delay}")
    return children.join(parents, meet).select("child", "parent", (F.col("parent_arrival") > F.col("child_arrival")).alias("late"))


# the queries over the driver's events
FILES, FILE_ROWS = 3, 50_000


def _batches(spark: SparkSession, rows: DataFrame, arrival: Column) -> DataFrame:
    """A stream of rows, those of an arrival (0 to FILES - 1, in that order) one batch.

    Each arrival has as many files as the others, one for every FILE_ROWS rows of the smallest one, so that tasks share a batch.
    """
    path = folder(spark, "files")
    rows = rows.withColumn("arrival", arrival.cast("int"))
    sizes = [r["n"] for r in rows.groupBy("arrival").agg(F.count(F.lit(1)).alias("n")).collect()]  # FILES numbers
    files = max(1, min(sizes) // FILE_ROWS) if len(sizes) == FILES else 1
    for k in range(FILES):  # file times must differ in order
        own = rows.where(F.col("arrival") == k)
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").parquet(f"{path}/{k}")
    schema = spark.read.parquet(f"{path}/0").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _by_time(spark: SparkSession, rows: DataFrame) -> Column:
    """Thirds of the time that rows cover."""
    a, b = rows.agg(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts"))).first()  # two numbers
    return F.least(F.floor((F.unix_timestamp("ts") - a) * FILES / F.lit(b - a + 1)), F.lit(FILES - 1))


def _in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return _batches(spark, rows, _by_time(spark, rows))


def _query(job, mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = folder(spark, job.__name__)
        start(job(_in_time(spark, sf_dir)), out, mode).awaitTermination()
        return spark.read.parquet(out).drop("batch")

    return run


def _last_batch(job):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = folder(spark, job.__name__)
        start(job(_in_time(spark, sf_dir)), out, "complete").awaitTermination()
        found = spark.read.parquet(out)
        last = found.agg(F.max("batch").alias("last"))  # one row
        return found.join(F.broadcast(last), F.col("batch") == F.col("last")).drop("batch", "last")

    return run


def _ingest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "ingest")
    rows = _rows(spark, sf_dir)
    again = rows.where("event_id % 5 = 0").withColumn("again", F.lit(1))  # seen once more, a batch later, at another relay
    both = rows.withColumn("again", F.lit(0)).union(again)
    payloads = payloads_of(both.repartition("event_id").select("event_id", "user_id", "event_type", "props", F.col("ts"), "again")).withColumn("again", F.col("again"))
    payloads = payloads.withColumn("relay_url", F.when(F.col("again") == 1, "wss://second").otherwise(F.col("relay_url")))
    raw = _batches(spark, payloads.select("relay_url", "payload", "event_id", "again"), (F.col("event_id") + F.col("again")) % FILES)
    blocked = rows.where("user_id % 10 = 0").select(F.sha2(F.col("user_id").cast("string"), 256).alias("pubkey")).distinct()
    ingest(raw.select("relay_url", "payload"), out, blocked).awaitTermination()
    parts = [spark.read.parquet(f"{out}/{name}").select(F.lit(name).alias("part"), key.alias("key")) for name, key in (("events", F.lit("")), ("sightings", F.lit("")), ("quarantine", F.col("error_code")))]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"))


def _dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    parts = _by_time(spark, rows)
    # every third event comes twice in its batch, every fourth again in the next batch
    both = rows.withColumn("shift", F.lit(0)).union(rows.where("event_id % 3 = 0").withColumn("shift", F.lit(0))).union(rows.where("event_id % 4 = 0").withColumn("shift", F.lit(1)))
    out = folder(spark, "dedup")
    stream = _batches(spark, both, F.least(parts + F.col("shift"), F.lit(FILES - 1)))
    start(deduplicated(stream, "40 days"), out).awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id", "event_type")


def _budget_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "budget")
    with rocksdb(spark):
        start(within_budget(_in_time(spark, sf_dir), 2), out).awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id")


def _repair_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    notes = _rows(spark, sf_dir).select(F.col("event_id").alias("id"), F.when(k % 3 > 0, F.col("event_id") - 1 - k % 20).alias("parent"), "ts")
    out = folder(spark, "repair")
    start(repaired(_batches(spark, notes, F.col("id") % FILES)), out).awaitTermination()
    return spark.read.parquet(out).select("child", "parent", "late")


def _counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth event comes again a batch later and counts once; every seventh is purged in the next batch, every 21st twice."""
    rows = _rows(spark, sf_dir)
    parts = _by_time(spark, rows)
    sats: Column = F.when(F.col("event_type") == "purchase", F.floor(F.col("value") * 100)).otherwise(0).cast("long")
    adds = rows.select("event_id", F.col("user_id").alias("key"), "ts", F.lit(1).alias("sign"), F.explode(F.array(F.struct(F.lit("events").alias("counter"), F.lit(1).cast("long").alias("amount")), F.struct(F.lit("sats").alias("counter"), sats.alias("amount")))).alias("x"), parts.alias("part"))
    adds = adds.select("event_id", "x.counter", "key", "x.amount", "ts", "sign", "part")
    again = adds.where("event_id % 5 = 0 and event_id % 7 > 0").withColumn("part", F.col("part") + 1)
    purged = adds.where("event_id % 7 = 0").withColumn("sign", F.lit(-1)).withColumn("part", F.col("part") + 1)
    purged = purged.unionByName(purged.where("event_id % 21 = 0").withColumn("part", F.col("part") + 1))
    both = adds.unionByName(again).unionByName(purged)
    counters = ClaimedCounters(spark, folder(spark, "claimed"), buckets=8)
    counters.start(_batches(spark, both, F.least(F.col("part"), F.lit(FILES - 1)))).awaitTermination()
    sums = counters.sums()
    each = lambda name: F.sum(F.when(F.col("counter") == name, F.col("amount")).otherwise(0))
    return sums.groupBy(F.col("key").alias("user_id")).agg(each("events").alias("events"), each("sats").alias("sats"))


def _dirty_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = UserCounters(spark, folder(spark, "dirty"), buckets=8)
    counters.start(_in_time(spark, sf_dir)).awaitTermination()
    return counters.counters.read().select("user_id", "events", F.unix_timestamp("last_at").alias("last_at"))


def _scope_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of all users, written wrongly, then rebuilt for the users of ten events, five users, and a day."""
    rows = _rows(spark, sf_dir)
    counters = UserCounters(spark, folder(spark, "scopes"), buckets=8)
    counters.apply(rows, 0)
    wrong = counters.counters.read().select("user_id", F.lit(-1).cast("long").alias("events"), F.lit(None).cast("timestamp").alias("last_at"), F.lit(1).alias("version"))
    counters.counters.upsert(wrong, 1)
    counters.rebuild("event", of=rows.where("event_id < 10").select("event_id"))
    counters.rebuild("author", of=rows.where("user_id between 1 and 5").select("user_id"))
    counters.rebuild("range", since="2024-01-10 00:00:00", until="2024-01-10 06:00:00")
    return counters.counters.read().select("user_id", "events", F.unix_timestamp("last_at").alias("last_at"))


QUERIES = {
    "str_ingest": _ingest_query,
    "str_dedup": _dedup_query,
    "str_tumbling": _last_batch(tumbling),
    "str_sliding": _last_batch(sliding),
    "str_sliding_week": _last_batch(sliding_week),
    "str_recipient_state": _budget_query,
    "str_late_repair": _repair_query,
    "str_incremental_counts": _counts_query,
    "str_dirty_recount": _dirty_query,
    "str_scoped_rebuild": _scope_query,
}
_N = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
ORACLES = {
    "str_ingest": f"""
WITH e AS (SELECT event_id, user_id, {_N} % 20 AS n, user_id % 10 = 0 AS blocked FROM events), s AS (SELECT * FROM e UNION ALL SELECT * FROM e WHERE event_id % 5 = 0)
SELECT 'events' AS part, '' AS key, count(*) AS n FROM e WHERE n NOT BETWEEN 1 AND 9 AND NOT blocked
UNION ALL SELECT 'sightings', '', count(*) FROM s WHERE n NOT BETWEEN 1 AND 9 AND NOT blocked
UNION ALL SELECT 'quarantine', ['empty', 'invalid_json', 'not_object', 'missing_field', 'field_type', 'field_format', 'field_range', 'id_mismatch', 'control_characters'][n], count(*) FROM s WHERE n BETWEEN 1 AND 9 GROUP BY n""",
    "str_dedup": "SELECT event_id, user_id, event_type FROM events",
    "str_tumbling": "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "str_sliding": "SELECT date_trunc('hour', ts)::TIMESTAMP - to_hours(k) AS since, event_type, count(*) AS n FROM events, range(24) AS r(k) GROUP BY 1, 2",
    "str_sliding_week": "SELECT date_trunc('day', ts)::TIMESTAMP - to_days(k::INT) AS since, event_type, count(*) AS n FROM events, range(7) AS r(k) GROUP BY 1, 2",
    "str_recipient_state": "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn FROM events) r WHERE rn <= 2",
    "str_late_repair": f"""
SELECT c.event_id AS child, p.event_id AS parent, p.event_id % 3 > c.event_id % 3 AS late FROM (SELECT event_id, event_id - 1 - {_N} % 20 AS target FROM events WHERE {_N} % 3 > 0) c JOIN events p ON c.target = p.event_id""",
    "str_incremental_counts": """
SELECT user_id, CAST(sum(sign) AS BIGINT) AS events, CAST(sum(sign * CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS sats
FROM (SELECT *, 1 AS sign FROM events UNION ALL SELECT *, -1 FROM events WHERE event_id % 7 = 0) e GROUP BY user_id""",
    "str_dirty_recount": "SELECT user_id, count(*) AS events, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_at FROM events GROUP BY user_id",
    "str_scoped_rebuild": """
WITH s AS (SELECT user_id FROM events WHERE event_id < 10 OR user_id BETWEEN 1 AND 5 OR ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-10 06:00:00')
SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM s) THEN count(*) ELSE -1 END AS events,
       CASE WHEN user_id IN (SELECT user_id FROM s) THEN CAST(floor(epoch(max(ts))) AS BIGINT) END AS last_at FROM events GROUP BY user_id""",
}
