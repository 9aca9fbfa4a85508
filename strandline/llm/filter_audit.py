"""Audit of how document filters interact, in every order, by wide packed counters.

A document is known to the audit by its mask: which filters it fails, and whether it is labelled good or toxic. Every mask maps to one
big integer with a 64-bit field for each outcome of each step of each order. Integers add field by field, as no count reaches 2**64,
so the sum over a part's documents holds all of the part's counts at once, and partial sums merge by addition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)
WIDTH = 8  # bytes of a field
#: Distinct parts whose integers a task holds before it passes them on.
PARTS_HELD = 256


@cache
def integers() -> tuple[int, ...]:
    """The big integer of each mask: bit i for the filter FILTERS[i], then GOOD and TOXIC."""
    out = []
    for mask in range(4 << len(FILTERS)):
        fields = np.zeros((len(ORDERS), len(FILTERS), len(OUTCOMES)), "<u8")
        for o, order in enumerate(ORDERS):
            gone = False
            for s, name in enumerate(order):
                bit = 1 << FILTERS.index(name)
                fails = bool(mask & bit)
                removed = fails and not gone
                alone = mask & (GOOD - 1) == bit
                fields[o, s] = (not (gone or fails), removed, fails and gone, alone, removed and bool(mask & GOOD), removed and bool(mask & TOXIC))
                gone = gone or fails
        out.append(int.from_bytes(fields.tobytes(), "little"))
    return tuple(out)


def unpacked(total: int) -> np.ndarray:
    """(orders, steps, outcomes) of counts from a sum of integers()."""
    shape = (len(ORDERS), len(FILTERS), len(OUTCOMES))
    return np.frombuffer(total.to_bytes(int(np.prod(shape)) * WIDTH, "little"), "<u8").reshape(shape).astype("int64")


def flags(text: Column) -> Column:
    """The mask of the filters that a text alone decides: A to D. null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    found = words(text)
    n = F.size(found)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (n < 100, 100 * F.size(F.array_distinct(found)) < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike(r"[#$%&*|]"))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n): documents of each part and mask, in several rows where they were counted apart.

    Filter E needs the least doc_id of each text over the whole table. Equal texts meet by digest (SHA-256, a second hash and the
    length), counted by part and labels first, so a text that many documents share leaves one row a task, part and label.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = [F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.xxhash64(text).alias("check"), F.octet_length(text).alias("bytes")]
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), flags(F.col("text")).alias("mask"), *key)
    found = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0)).alias("toxic"))
    labelled = rows.join(found, "doc_id", "left").withColumn("mask", F.col("mask") + F.coalesce("good", F.lit(0)) + F.coalesce("toxic", F.lit(0)))
    # one row for each document that repeats itself whole; a null doc_id is neither smaller nor larger than any
    once = labelled.groupBy("doc_id", "digest", "check", "bytes", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    nulls = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    alike = once.groupBy("digest", "check", "bytes", "part", "mask").agg(F.sum("n").alias("n"), first.alias("first"), nulls.alias("nulls"))
    least = alike.groupBy("digest", "check", "bytes").agg(F.min("first.doc_id").alias("least"))
    met = alike.join(least, ["digest", "check", "bytes"])
    free = F.col("nulls") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    e = 1 << FILTERS.index("E")
    both = F.array(F.struct(F.col("mask"), free.alias("n")), F.struct((F.col("mask") + e).alias("mask"), (F.col("n") - free).alias("n")))
    return met.select("part", F.explode(both).alias("x")).select("part", "x.mask", "x.n").where("n > 0")


def _packed(counts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, mask, n) to (part, total): each part's sum of integers, as bytes."""
    of, totals = integers(), {}
    for batch in counts:
        for part, mask, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            totals[part] = totals.get(part, 0) + n * of[mask]
        if len(totals) > PARTS_HELD:
            yield _rows(totals)
            totals = {}
    yield _rows(totals)


def _merged(sums: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, total) to (part, total) with fewer rows a part. Rows that come in the order of their parts give one row a part."""
    part, total = None, 0
    for batch in sums:
        for p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part:
                if part is not None:
                    yield _rows({part: total})
                part, total = p, 0
            total += int.from_bytes(t, "little")
    if part is not None:
        yield _rows({part: total})


def _rows(totals: dict[str, int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(totals), pa.string()), pa.array([_bytes(t) for t in totals.values()], pa.binary())], ["part", "total"])


def _bytes(total: int) -> bytes:
    return total.to_bytes(len(ORDERS) * len(FILTERS) * len(OUTCOMES) * WIDTH, "little")


def _report(sums: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders = [o for o in ORDERS for _ in FILTERS]
    steps = [s for _ in ORDERS for s in range(1, len(FILTERS) + 1)]
    for batch in sums:
        for part, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts = unpacked(int.from_bytes(total, "little"))
            removed = counts[:, :, OUTCOMES.index("removed")]
            share = {f: sum(int(removed[o, order.index(f)]) for o, order in enumerate(ORDERS)) for f in FILTERS}
            columns = [pa.array([part] * len(orders), pa.string()), pa.array(orders), pa.array(steps, pa.int32())]
            columns += [pa.array(counts[:, :, k].ravel(), pa.int64()) for k in range(len(OUTCOMES))]
            columns.append(pa.array([share[o[s - 1]] for o, s in zip(orders, steps, strict=True)], pa.int64()))
            yield pa.record_batch(columns, ["part", "filter_order", "step", *OUTCOMES, "shapley"])


def audit(docs: DataFrame, labels: DataFrame, salts: int = 32) -> DataFrame:
    """600 rows for each part (value of lang; null and empty are one part): part, filter_order, step, counts of OUTCOMES, shapley.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic; other columns are dropped. Filters: A under 100 words; B 100 times the
    distinct words under 80 times the words; C 100 times the A-Z over 10 times the code points; D holds one of #$%&*|; E the text of
    a smaller doc_id. kept: documents that pass this step and all before; removed: those that fail here first; redundant: those that
    fail here and were removed before; unique_fails: those that fail this step's filter only; good_lost, toxic_lost: removed ones
    with such a label; shapley: what the step's filter removes, summed over all orders.

    Partial sums are made where rows lie, then by part and salt, then by part: a part of any share of the rows meets as salts
    integers at most in the last step, and no step holds more than PARTS_HELD integers of some 29 KB.

    A null text counts as empty, and fails A. A null doc_id has no label, fails no E and makes no other fail it. Rows that repeat
    a doc_id count each; with the same text they don't make each other fail E. Of several labels of a document any that says 1
    counts. Empty documents give no rows; empty labels no losses.
    """
    sums = masks(docs, labels).mapInArrow(_packed, "part string, total binary")
    salted = sums.withColumn("salt", F.spark_partition_id() % salts).repartition("part", "salt").sortWithinPartitions("part")
    some = salted.select("part", "total").mapInArrow(_merged, "part string, total binary")
    whole = some.repartition("part").sortWithinPartitions("part").mapInArrow(_merged, "part string, total binary")
    counts = ", ".join(f"{k} long" for k in (*OUTCOMES, "shapley"))
    return whole.mapInArrow(_report, f"part string, filter_order string, step int, {counts}")
