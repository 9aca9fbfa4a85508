"""Counters over batches: deltas that apply once by claims, and recounts that read only what a batch or a scope touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


class ClaimedCounters:
    """Sums by (counter, key) to which an event adds once, and from which its purge takes back once what it added.

    Folders below path: claims, the ledger of applied (event_id, counter) with what each added; deltas, the change of each batch;
    late, rows that came when their claims may be gone. A batch looks its claims up in the ledger's buckets that it touches; as it
    rewrites those, claims go that are more than keep_hours of event time older than the newest event, and those taken back, so an
    event that comes again after its purge counts anew. A batch that runs again starts from the ledger before it and replaces its
    deltas, whatever of it was written.
    """

    def __init__(self, spark: SparkSession, path: str, keep_hours: int = 24 * 90, buckets: int = 64):
        self.spark, self.path, self.keep_hours = spark, path, keep_hours
        self.ledger = Store(spark, f"{path}/claims", ("event_id", "counter"), ("-batch",), buckets=buckets)

    def _newest(self, before: int):
        """The newest event time, in seconds, that batches below before have seen; one row a batch."""
        from .jobs import exists

        if not before or not exists(self.spark, f"{self.path}/marks"):
            return None
        return self.spark.read.parquet(f"{self.path}/marks").where(F.col("batch") < before).agg(F.max("newest")).first()[0]

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """batch: event_id, counter, key, amount, ts, sign (1 adds, -1 takes back); rows of sign -1 need only the first two.

        An event that the batch adds several times counts once, with its earliest ts; what it adds and takes back, in that order, is nothing.
        """
        rows = batch.persist()
        by = ["event_id", "counter"]
        newest = self._newest(batch_id)
        fresh = "true" if newest is None else f"ts IS NULL OR unix_timestamp(ts) >= {newest - self.keep_hours * 3600}"
        adds, late = rows.where(f"sign > 0 AND ({fresh})"), rows.where(f"sign > 0 AND NOT ({fresh})")
        adds = adds.groupBy(*by).agg(F.min_by(F.struct("key", "amount", "ts"), F.struct("ts", "key", "amount")).alias("x")).select(*by, "x.*")
        held = self.ledger.near(rows, batch_id)
        if held is not None:
            held = held.select(*by, "key", "amount", "ts")
            adds = adds.join(held.select(*by), by, "left_anti")
        adds = adds.persist()
        backs = rows.where("sign < 0").select(*by).distinct()
        taken = (adds if held is None else held.unionByName(adds)).join(backs, by, "left_semi").persist()
        deltas = adds.select("counter", "key", "amount").unionByName(taken.select("counter", "key", (-F.col("amount")).alias("amount")))
        deltas.groupBy("counter", "key").agg(F.sum("amount").alias("amount")).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch_id}")
        late.write.mode("overwrite").parquet(f"{self.path}/late/batch={batch_id}")
        changed = adds.join(taken.select(*by), by, "left_anti").withColumn("applied", F.lit(True)).unionByName(taken.withColumn("applied", F.lit(False)))
        self.ledger.upsert(changed.withColumn("batch", F.lit(batch_id)), batch_id, keep=f"applied AND ({fresh})")
        rows.agg(F.max(F.unix_timestamp("ts")).alias("newest")).write.mode("overwrite").parquet(f"{self.path}/marks/batch={batch_id}")
        for df in (taken, adds, rows):
            df.unpersist()

    def start(self, events: DataFrame) -> StreamingQuery:
        return events.writeStream.option("checkpointLocation", f"{self.path}/state").foreachBatch(self.apply).trigger(availableNow=True).start()

    def sums(self) -> DataFrame:
        """counter, key, amount."""
        return self.spark.read.parquet(f"{self.path}/deltas").groupBy("counter", "key").agg(F.sum("amount").alias("amount"))


class UserCounters:
    """Events and last_at of each user, kept by recounting the users that a batch or a scope touches, from their events only.

    Events (event_id, user_id, ts) are stored in buckets by user, their owners in buckets by event. A batch's users name the buckets
    that are rewritten, read and recounted; nothing else is touched.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path
        self.events = Store(spark, f"{path}/events", ("event_id",), ("ts",), bucket_by=("user_id",), buckets=buckets)
        self.owners = Store(spark, f"{path}/owners", ("event_id",), ("user_id",), buckets=buckets)
        self.counters = Store(spark, f"{path}/counters", ("user_id",), ("-version",), buckets=buckets)

    def recount(self, users: DataFrame, batch: int | None = None) -> list[int]:
        """Count users (user_id) anew; those without events get 0. Returns the buckets of events read."""
        buckets = self.events.touched(users)
        users = users.select("user_id").distinct()
        own = self.events.read(buckets)
        none = F.lit(None).cast("timestamp")
        if own is None:
            counted = users.select("user_id", F.lit(0).cast("long").alias("events"), none.alias("last_at"))
        else:
            found = own.join(users, "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_at"))
            counted = users.join(found, "user_id", "left").select("user_id", F.coalesce("events", F.lit(0).cast("long")).alias("events"), "last_at")
        version = (self.counters.batches() or [-1])[-1] + 1 if batch is None else batch
        self.counters.upsert(counted.withColumn("version", F.lit(version)), version)
        return buckets

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("event_id", "user_id", "ts").where("user_id is not null").persist()
        self.events.upsert(rows, batch_id)
        self.owners.upsert(rows.select("event_id", "user_id"), batch_id)
        self.recount(rows, batch_id)
        rows.unpersist()

    def start(self, events: DataFrame) -> StreamingQuery:
        return events.writeStream.option("checkpointLocation", f"{self.path}/state").foreachBatch(self.apply).trigger(availableNow=True).start()

    def rebuild(self, scope: str, of: DataFrame | None = None, since=None, until=None) -> list[int]:
        """Recount one scope: "event" (of: event_id), "author" (of: user_id), "range" (users with an event from since to until) or "all".

        Events and authors are found by their buckets; a range reads users and times of all, the times pushed down to the scan.
        Counters of users that have no event any more are recounted to 0 where the scope names them, and by "all". Returns
        the buckets of events that the recount reads.
        """
        if scope == "event":
            owners = self.owners.near(of)
            users = None if owners is None else owners.join(of.select("event_id"), "event_id", "left_semi")
        elif scope == "author":
            users = of
        elif scope == "range":
            users = self.events.read().where(F.col("ts").between(since, until))
        elif scope == "all":
            users = self.events.read().select("user_id").union(self.counters.read().select("user_id"))
        else:
            raise ValueError(f"no scope {scope!r}")
        return [] if users is None else self.recount(users.select("user_id"))
