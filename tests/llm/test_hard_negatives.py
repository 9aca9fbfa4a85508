"""Hard negatives against all scores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import hard_negatives as h


def brute(rows, every, np_=5, nn=5, floor=80):
    """rows: vec_id, label, v."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905,E731
    limit = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    anchors = {}
    for i, label, v in rows:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for i, (label, v) in anchors.items():
        s = [(-limit(dot(v, w)), j, m) for j, m, w in rows if j != i]
        pos = sorted((x, j) for x, j, m in s if m == label)[:np_]
        for p, j in pos:
            neg = sorted((x, k) for x, k, m in s if m != label and floor * -p <= 100 * -x <= 100 * -p)[:nn]
            out += [(i, j, r + 1, k, -p, -x) for r, (x, k) in enumerate(neg)]
    return sorted(out)


def found(spark, rows, every):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, label int, v array<long>, block string, rank int, chunk int").repartition(3)
    out = h.hard_negatives(df, F.col("vec_id") % every == 0)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in out.collect())


@pytest.mark.parametrize("kind", ["plain", "clustered", "ties", "large", "ragged"])
def test_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(h, "BLOCK_CELLS", 60)
    monkeypatch.setattr(h, "CHUNK_CELLS", 700)
    monkeypatch.setattr(h, "STEP_ROWS", 50)
    monkeypatch.setattr(h, "STEP_ANCHORS", 3)
    rng = np.random.default_rng(4)
    n, d = 300, 9
    v = rng.normal(0, 100, (n, d))
    if kind == "clustered":
        v = rng.normal(0, 100, (4, d))[rng.integers(0, 4, n)] + rng.normal(0, 10, (n, d))
    if kind == "ties":
        v = rng.integers(-1, 2, (n, d)) * (rng.random((n, 1)) < 0.8)
    if kind == "large":
        v = rng.normal(0, 1e16, (n, d))
    v = v.astype("i8").tolist()
    if kind == "ragged":
        v = [x[: i % 11] for i, x in enumerate(v)]
    rows = [(i, int(rng.integers(0, 3)), x) for i, x in enumerate(v)]
    rows += [rows[5], rows[5], rows[20], (20, 1, v[3])]
    assert found(spark, rows, 20) == brute(rows, 20)


def test_few_and_none(spark):
    assert found(spark, [], 2) == []
    assert found(spark, [(0, 1, [3])], 2) == []
    rows = [(0, 1, []), (1, 1, []), (3, 2, []), (5, 1, [7]), (-2, 2, [1, 1])]
    assert found(spark, rows, 2) == brute(rows, 2)


def test_who_takes_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001], 1), (2, [nan, 0.0], 1), (3, [0.0, -inf], 1), (4, [None, 0.0], 1), (5, None, 1), (6, [0.0], None), (None, [0.0], 1), (7, [], 1), (8, [3e38], 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, v string")
    assert sorted((r["vec_id"], r["label"], r["v"]) for r in h.quantised(df).collect()) == [(1, 1, [128, -1]), (7, 1, []), (8, 2, [2**63 - 1])]


def test_above_is_exact():
    rng = random.Random(1)
    for _ in range(60):
        d, a, n = rng.randrange(1, 20), rng.randrange(1, 6), rng.randrange(1, 40)
        scale = np.array([rng.choice([1, 50]) for _ in range(d)])
        q = np.array([[rng.randrange(-9, 10) for _ in range(d)] for _ in range(a)]) * scale
        y = np.array([[rng.randrange(-9, 10) for _ in range(d)] for _ in range(n)]) * scale
        low = np.array([rng.choice([-(2**63), -50, 0, 40, 5000, 200000]) for _ in range(a)])
        i, j, s = h.above(q, low, y)
        want = {(x, z, int(q[x] @ y[z])) for x in range(a) for z in range(n) if q[x] @ y[z] >= low[x]}
        assert {*zip(i.tolist(), j.tolist(), s.tolist(), strict=True)} == want
