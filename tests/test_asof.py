"""As-of joins against looking at every mark."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators.asof import as_of


@pytest.mark.parametrize("width", [1, 10, 10**6])
def test_brute_force(spark, width):
    rng = random.Random(width)
    key = lambda: rng.choice([None, 1, 1, 1, 1, 2, 3])
    rows = [(key(), rng.randrange(100), rng.randrange(5), f"r{n}") for n in range(300)]
    marks = [(key(), rng.randrange(100), rng.randrange(5), n) for n in range(60)]
    marks = list({m[:3]: m for m in marks}.values())  # one mark a place
    got = as_of(spark.createDataFrame(rows, "k long, t long, id long, name string").repartition(4), spark.createDataFrame(marks, "k long, t long, id long, n long"), "k", ("t", "id"), F.floor(F.col("t") / width))
    assert got.columns == ["k", "t", "id", "name", "mark"]
    want = {}
    for k, t, i, name in rows:
        own = [m for m in marks if k is not None and m[0] == k and m[1:3] <= (t, i)]
        want[name] = max(own, key=lambda m: m[1:3])[3] if own else None
    assert {r["name"]: r["mark"] and r["mark"]["n"] for r in got.collect()} == want


def test_a_hot_key_is_cut(spark):
    rows = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("t"), "id")
    marks = rows.where("id % 1000 = 7")
    got = as_of(rows, marks, "k", ("t", "id"), F.floor(F.col("t") / 50))
    assert got.where("mark.t = t - (t - 7) % 1000").count() == 4993 and got.where("mark is null").count() == 7
