"""The upsert store against recomputing from all rows."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.plans.folders import new_folder
from strandline.sources.store import Store


def files(store):
    return {b: f for b, f in (store.manifest() or {"buckets": {}})["buckets"].items()}


def events(rng, n, keys=40):
    return [(rng.choice([None, *range(keys)]), rng.randrange(3), rng.randrange(50), i, f"v{i}") for i in range(n)]


ROW = "pubkey long, kind int, created_at long, id long, body string"


def newest(rows):
    out = {}
    for r in rows:
        k = r[:2]
        if k not in out or (r[2], r[3]) > (out[k][2], out[k][3]):
            out[k] = r
    return sorted(out.values(), key=repr)


def latest(spark, **more):
    return Store(spark, new_folder(spark, "store"), ("pubkey", "kind"), ("-created_at", "-id"), **more)


@pytest.mark.parametrize("files_", [1, 3])
def test_overlapping_batches_equal_a_recompute(spark, files_):
    rng = random.Random(3)
    store = latest(spark, buckets=8, files=files_)
    first, second, third = events(rng, 200), events(rng, 150), events(rng, 5)
    second += first[:60]
    for batch, rows in ((4, first), (7, second), (7, second), (9, third), (7, second)):
        store.upsert(spark.createDataFrame(rows, ROW).repartition(3), batch)
    assert store.batches() == [4, 7, 9]
    assert sorted(map(tuple, store.read().collect()), key=repr) == newest(first + second + third)
    assert sorted(map(tuple, store.read(before=9).collect()), key=repr) == newest(first + second)
    with pytest.raises(ValueError, match="comes after"):
        store.upsert(spark.createDataFrame(third, ROW), 8)


def test_only_touched_buckets_are_written(spark):
    store = latest(spark, buckets=16)
    store.upsert(spark.createDataFrame(events(random.Random(1), 300), ROW))
    before = files(store)
    one = spark.createDataFrame([(3, 1, 99, 1000, "new")], ROW)
    assert store.upsert(one) == store.touched(one)
    after = files(store)
    assert len({b for b in after if after[b] != before.get(b)}) == 1
    read = store.near(one).inputFiles()
    assert len(read) == 1 and f"__bucket={store.touched(one)[0]}" in read[0]


def test_a_batch_cut_off_before_its_manifest_is_not_seen(spark, monkeypatch):
    store = latest(spark, buckets=4)
    a, b = events(random.Random(5), 50), events(random.Random(6), 50)
    store.upsert(spark.createDataFrame(a, ROW))
    monkeypatch.setattr(Store, "_commit", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.upsert(spark.createDataFrame(b, ROW))
    monkeypatch.undo()
    assert sorted(map(tuple, store.read().collect()), key=repr) == newest(a)
    store.upsert(spark.createDataFrame(b, ROW))
    assert sorted(map(tuple, store.read().collect()), key=repr) == newest(a + b)


def test_sums_deletes_and_vacuum(spark):
    store = Store(spark, new_folder(spark, "store"), ("k",), combine={"n": "sum(n)", "top": "max(top)"}, buckets=4)
    assert store.read() is None and store.near(spark.range(3).toDF("k")) is None
    rows = spark.createDataFrame([(i % 10, 1, i) for i in range(100)], "k long, n long, top long")
    for _ in range(3):
        store.upsert(rows)
    assert {(r["k"], r["n"], r["top"]) for r in store.read().collect()} == {(k, 30, 90 + k) for k in range(10)}
    store.delete(spark.createDataFrame([(3,), (77,), (None,)], "k long"))
    store.vacuum(1)
    assert {r["k"] for r in store.read().collect()} == set(range(10)) - {3}
    assert len(store.batches()) == 1
    kept = {f"data/{d}/{b}" for d in store._names(f"{store.path}/data") for b in store._names(f"{store.path}/data/{d}") if b.startswith("__")}
    assert kept == set(files(store).values())
    store.delete(store.read().select("k"))
    assert store.read().count() == 0
    store.upsert(rows.where("k = 5"))
    assert [tuple(r) for r in store.read().collect()] == [(5, 10, 95)]


def test_new_columns_and_other_buckets(spark):
    store = Store(spark, new_folder(spark, "store"), ("id",), ("id",), bucket_by=("user",), buckets=8)
    store.upsert(spark.range(50).select("id", (F.col("id") % 5).alias("user")))
    store.upsert(spark.createDataFrame([(3, 3, "x"), (100, 1, "y")], "id long, user long, note string"))
    assert store.read().count() == 51 and store.read().where("note is not null").count() == 2
    assert store.near(spark.createDataFrame([(1,)], "who long"), user="who").where("user = 1").count() == 11
    store.upsert(spark.createDataFrame([], "id long, user long, note string"))
    assert store.read().count() == 51


def test_rows_that_keep_rejects_go_after_the_merge(spark):
    store = latest(spark, buckets=2)
    store.upsert(spark.createDataFrame([(1, 0, 1, 1, "a"), (2, 0, 1, 1, "a")], ROW))
    store.upsert(spark.createDataFrame([(1, 0, 2, 1, "gone")], ROW), keep="body <> 'gone'")
    assert [r["pubkey"] for r in store.read().collect()] == [2]
