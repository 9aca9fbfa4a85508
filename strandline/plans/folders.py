"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, as in tests, a local master gets a folder of its own; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='strandline-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """df written to a table in spark.checkpoint.dir and read back: cuts lineage and, unlike a checkpoint, computes df once."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that a loop writes, deleted when it ends: with Scratch(spark, name) as scratch. What it returns must stand elsewhere by then."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, new_folder(spark, name), 0

    def __enter__(self) -> Scratch:
        return self

    def cut(self, df: DataFrame) -> DataFrame:
        """df written and read back: cuts lineage and, unlike a checkpoint, computes df once."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
