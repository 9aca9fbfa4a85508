import random

import pytest

from strandline.llm.mixing import mix, repeated

SCHEMA = "doc_id long, source string, size long"


def filled(sizes, weights, budget, most):
    """Targets by clamping and sharing the excess again until none is above its cap."""
    caps = {s: most * n for s, n in sizes.items()}
    full, left = {}, dict(weights)
    while left:
        level = (budget - sum(full.values())) / sum(left.values())
        over = [s for s in left if level * left[s] > caps[s] + 1e-12]
        if not over:
            return full | {s: level * w for s, w in left.items()}
        for s in over:
            full[s] = caps[s]
            del left[s]
    return full


def test_targets_and_taken(spark):
    rng = random.Random(1)
    sources = ["b", "a", "Z", "é", None, "empty"]
    rows = [(i, rng.choices(sources, [60, 5, 10, 3, 5, 0])[0], rng.choice([0, 5, 80, 400])) for i in range(3000)] + [(-1, "empty", None)]
    found = mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    sizes = {s: sum(n or 0 for _, t, n in rows if t == s) for s in sources}
    ordered = sorted((s for s in sources if s is not None)) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(ordered)}
    targets = filled(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
    for s in sources:
        own = [r for r in found if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]}
        assert all(r["target"] == pytest.approx(targets[s]) for r in own)
        assert abs(sum(r["taken"] for r in own) - targets[s]) <= 200
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
    again = {(r["doc_id"], r["taken"]) for r in mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in found}


def test_empty_and_ties(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a", 10)] * 4 + [(None, "a", 10)]
    assert mix(spark.createDataFrame(rows, SCHEMA)).count() == 5


def test_repeated_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "x", 7), (2, "y", 8), (None, "z", 9)], "doc_id long, repeats string, size int")
    plan = spark.createDataFrame([(1, 2), (2, 0), (None, 1)], "doc_id long, repeats long")
    got = repeated(docs, plan)
    assert got.columns == docs.columns and sorted(r["repeats"] for r in got.collect()) == ["x", "x", "z"]
