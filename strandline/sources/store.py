"""Tables kept by merging: rows are upserted by key into hash buckets of plain Parquet, and a manifest names the files that count.

A commit rewrites only the buckets that its rows fall into, into a folder of its own, then writes its manifest, which is the one step
that makes it seen. Manifests are numbered by batch: a batch that runs again starts from the same state as the first time, and one
that has been committed changes nothing. One writer at a time; readers see a whole commit or none.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Store:
    """A table at path (a folder of the store the session shares).

    keys: columns that name a row. order: SQL expressions; of rows with the same keys the one whose values come first, in ascending
    order, stays; where they tie, the row of the newer batch. combine: instead of order, an SQL aggregate for each column that is no key. bucket_by: the columns (of the keys or
    not) whose hash chooses the bucket; rows of a key must agree in them. files: files a bucket, for buckets that one task shouldn't write.

    buckets holds for the table's life: some 256 MB a bucket when it is full is a good size. A manifest has one line a bucket.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], order: tuple[str, ...] = (), combine: dict[str, str] | None = None, bucket_by: tuple[str, ...] = (), buckets: int = 64, files: int = 1):
        if bool(order) == bool(combine):
            raise ValueError("a store has either an order or aggregates")
        self.spark, self.path, self.keys, self.order, self.combine = spark, path.rstrip("/"), tuple(keys), tuple(order), combine or {}
        self.bucket_by, self.buckets, self.files = tuple(bucket_by) or self.keys, buckets, files

    # the file system
    def _fs(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        place, fs = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(place)) if fs.exists(place) else []

    # manifests
    def batches(self) -> list[int]:
        """The batches committed, in order."""
        return [int(x.removesuffix(".json")) for x in self._names(f"{self.path}/manifests") if x.endswith(".json")]

    def manifest(self, before: int | None = None) -> dict | None:
        """The newest manifest, or the newest of a batch below before: schema, and the folder of each bucket that has rows."""
        found = [b for b in self.batches() if before is None or b < before]
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{found[-1]:012d}.json", wholetext=True).first()[0]) if found else None

    def _commit(self, batch: int, manifest: dict) -> None:
        now, fs = self._fs(f"{self.path}/manifests/{batch:012d}.writing")
        out = fs.create(now, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final, _ = self._fs(f"{self.path}/manifests/{batch:012d}.json")
        if fs.exists(final) or not fs.rename(now, final):
            raise RuntimeError(f"batch {batch} of {self.path} was committed by another writer")

    # reading
    def bucket(self, **columns: str) -> Column:
        """The bucket of a row; columns: names under which other frames hold the columns of bucket_by."""
        return F.pmod(F.xxhash64(*(F.col(columns.get(c, c)) for c in self.bucket_by)), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, **columns: str) -> list[int]:
        """The buckets that rows fall into: numbers below buckets, the only thing that reaches the driver."""
        return sorted(r[0] for r in rows.select(self.bucket(**columns)).distinct().collect())

    def read(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame | None:
        """The table, or those of its buckets, as of the newest batch (below before); None before the first commit."""
        manifest = self.manifest(before)
        if manifest is None:
            return None
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/{folder}" for b, folder in manifest["buckets"].items() if buckets is None or int(b) in set(buckets)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def near(self, rows: DataFrame, before: int | None = None, **columns: str) -> DataFrame | None:
        """What the table holds in the buckets that rows fall into: to be joined with rows."""
        return self.read(self.touched(rows, **columns), before)

    # writing
    def _one(self, rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
        """One row for each value of by, which are the keys and what follows from them."""
        rest = [c for c in rows.columns if c not in (*by, "__age")]
        if self.combine:
            return rows.groupBy(*by).agg(*(F.expr(self.combine[c]).alias(c) for c in rest))
        best = F.min_by(F.struct(*rest), F.struct(*(F.expr(x) for x in self.order), *(["__age"] if "__age" in rows.columns else []))) if rest else F.lit(0)
        out = rows.groupBy(*by).agg(best.alias("__row"))
        return out.select(*by, "__row.*") if rest else out.select(*by)

    def upsert(self, rows: DataFrame, batch: int | None = None, keep: str | None = None) -> list[int]:
        """Merge rows into the table as that batch (by default the next), and return the buckets written.

        keep: an SQL condition; rows of the buckets written that don't meet it go, so that a table of passing state stays small.

        Rows are combined by key before they meet the table, partly in the tasks that hold them, so a key of any number of rows makes
        no large group. New columns of rows, and columns that rows lack, are null on the other side.
        """
        return self._change(self._one(rows, tuple(dict.fromkeys((*self.bucket_by, *self.keys)))), batch, False, keep)

    def delete(self, rows: DataFrame, batch: int | None = None) -> list[int]:
        """Take the rows out whose keys (and bucket_by) rows names; returns the buckets written."""
        return self._change(rows.select(*dict.fromkeys((*self.bucket_by, *self.keys))).distinct(), batch, True, None)

    def _change(self, rows: DataFrame, batch: int | None, take_out: bool, keep: str | None) -> list[int]:
        done = self.batches()
        batch = (done[-1] + 1 if done else 0) if batch is None else batch
        if batch in done:
            return []
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        rows = rows.persist()
        try:
            buckets = self.touched(rows)
            before = self.manifest(batch) or {"buckets": {}}
            old = self.read(buckets, batch)
            if old is None:
                merged = None if take_out else rows
            elif take_out:
                merged = old.join(rows.select(*self.keys), [old[k].eqNullSafe(rows[k]) for k in self.keys], "left_anti")
            else:
                merged = old.withColumn("__age", F.lit(1)).unionByName(rows.withColumn("__age", F.lit(0)), allowMissingColumns=True)
            kept = {b: f for b, f in before["buckets"].items() if int(b) not in set(buckets)}
            schema = before.get("schema")
            if merged is not None:
                columns = [c for c in merged.columns if c != "__age"]
                schema = self._nullable(merged.select(*columns).schema).jsonValue()
                merged = merged.withColumn("__bucket", self.bucket())
                by = ("__bucket", *dict.fromkeys((*self.bucket_by, *self.keys)))
                # one shuffle: rows of a bucket's part meet, are merged and written there
                salt = F.pmod(F.xxhash64(F.lit(1), *self.keys), F.lit(self.files))
                merged = merged.repartition(max(1, min(len(buckets) * self.files, 2000)), "__bucket", *([salt] if self.files > 1 else []))
                if not take_out and old is not None:
                    merged = self._one(merged, by)
                if keep is not None:
                    merged = merged.where(keep)
                folder = f"data/{batch:012d}"
                merged.select(*columns, "__bucket").sortWithinPartitions("__bucket", *self.keys).write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/{folder}")
                kept |= {x.partition("=")[2]: f"{folder}/{x}" for x in self._names(f"{self.path}/{folder}") if x.startswith("__bucket=")}
            if schema is not None:
                self._commit(batch, {"batch": batch, "schema": schema, "buckets": kept})
            return buckets
        finally:
            rows.unpersist()

    @staticmethod
    def _nullable(schema: StructType) -> StructType:
        for field in schema.fields:
            field.nullable = True
        return schema

    def vacuum(self, keep: int = 2) -> None:
        """Delete manifests but the newest keep, and the files that none of those names."""
        done = self.batches()
        named = set()
        for b in done[-keep:]:
            named |= set(self.manifest(b + 1)["buckets"].values())
        for b in done[:-keep]:
            place, fs = self._fs(f"{self.path}/manifests/{b:012d}.json")
            fs.delete(place, False)
        for folder in self._names(f"{self.path}/data"):
            for bucket in self._names(f"{self.path}/data/{folder}"):
                if f"data/{folder}/{bucket}" not in named and (not done or int(folder) <= done[-1]):
                    place, fs = self._fs(f"{self.path}/data/{folder}/{bucket}")
                    fs.delete(place, True)
