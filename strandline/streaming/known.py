"""Ids that earlier batches stored, looked up by day: a persisted Bloom filter a day first, then the ids of the days that it can't rule out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Store

#: A day's filter: SHARDS rows of WORDS longs, 2 million bits; PROBES bits an id. A day of 200,000 ids lets 1 id in 50 through
#: wrongly, a fuller one more; those are looked up, so the outcome is the same.
SHARDS, WORDS, PROBES = 64, 512, 4


def _places(id_: Column) -> tuple[Column, list[Column]]:
    """Shard of an id, and its bits in that shard."""
    one, bits = F.xxhash64(id_), 64 * WORDS
    first, step = (F.pmod(F.xxhash64(id_, F.lit(k)), F.lit(bits)) for k in (7, 8))
    return F.pmod(one, F.lit(SHARDS)).cast("int"), [F.pmod(first + step * i, F.lit(bits)).cast("int") for i in range(PROBES)]


class KnownIds:
    """Which of a batch's rows (id, day and more) have ids that earlier batches stored under events, a table by day and batch."""

    def __init__(self, spark: SparkSession, events: str, filters: str):
        self.spark, self.events = spark, events
        self.filters = Store(spark, filters, ("day", "shard"), ("-batch",), bucket_by=("day",), buckets=256)

    @staticmethod
    def days(rows: DataFrame) -> list:
        """The distinct days of rows, a few dates."""
        return [r[0] for r in rows.select("day").distinct().collect()]

    def stored(self, days: list, before: int) -> DataFrame | None:
        """id and day of what batches below before stored on those days; no other day's folder is listed or read."""
        from .jobs import exists

        paths = [p for d in days if exists(self.spark, p := f"{self.events}/day={d if d is not None else '__HIVE_DEFAULT_PARTITION__'}")]
        if not paths:
            return None
        found = self.spark.read.option("basePath", self.events).parquet(*paths)
        near = F.col("day").cast("date").isin([d for d in days if d is not None])
        return found.where((near | F.col("day").isNull() if None in days else near) & (F.col("batch") < before)).select("id", F.col("day").cast("date").alias("day"))

    def new(self, rows: DataFrame, batch: int) -> DataFrame:
        """The rows whose id no batch below batch stored on the same day."""
        held = self.filters.near(rows.select("day").distinct(), batch)
        if held is None:
            return rows
        shard, at = _places(F.col("id"))
        held = held.where(F.col("day").isin([d for d in self.days(rows) if d is not None])).select(F.col("day").alias("__day"), F.col("shard").alias("__shard"), "words")
        bit = lambda p: F.getbit(F.element_at("words", F.floor(p / 64).cast("int") + 1), p % 64)
        seen = F.lit(True)
        for p in at:
            seen = seen & (F.coalesce(bit(p), F.lit(0)) == 1)
        probed = rows.withColumn("__s", shard).join(held, (F.col("day") == F.col("__day")) & (F.col("__s") == F.col("__shard")), "left")
        probed = probed.withColumn("__maybe", seen & F.col("words").isNotNull()).select(*rows.columns, "__maybe").persist()
        maybe = probed.where("__maybe or day is null")
        stored = self.stored(self.days(maybe), batch)
        sure = probed.where("not __maybe and day is not null").select(*rows.columns)
        maybe = maybe.select(*rows.columns)
        if stored is None:
            return sure.unionByName(maybe)
        confirmed = maybe.join(stored.withColumnsRenamed({"id": "__id", "day": "__day"}), F.col("id").eqNullSafe(F.col("__id")) & F.col("day").eqNullSafe(F.col("__day")), "left_anti")
        return sure.unionByName(confirmed)

    def add(self, rows: DataFrame, batch: int) -> None:
        """Add the ids of rows to their days' filters, as that batch; only those days' filters are rewritten."""
        shard, at = _places(F.col("id"))
        bits = rows.where("day is not null").select("day", shard.alias("shard"), F.explode(F.array(*at)).alias("p"))
        bits = bits.select("day", "shard", F.floor(F.col("p") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, p % 64)").alias("bits"))
        held = self.filters.near(rows.select("day").distinct(), batch)
        if held is not None:
            old = held.where(F.col("day").isin([d for d in self.days(rows) if d is not None])).select("day", "shard", F.posexplode("words").alias("word", "bits"))
            bits = bits.unionByName(old)
        # every word of a filter is there, so that they stand in an array
        empty = bits.select("day", "shard").distinct().select("day", "shard", F.explode(F.sequence(F.lit(0), F.lit(WORDS - 1))).alias("word"), F.lit(0).cast("long").alias("bits"))
        words = bits.unionByName(empty).groupBy("day", "shard", "word").agg(F.bit_or("bits").alias("bits"))
        whole = words.groupBy("day", "shard").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w"))
        dense = F.transform("w", lambda x: x["bits"])
        self.filters.upsert(whole.select("day", "shard", dense.alias("words"), F.lit(batch).alias("batch")), batch)
