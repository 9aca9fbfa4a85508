"""Substring deduplication against a count of all windows."""

import random

import pytest

from strandline.llm import substring_dedup
from strandline.llm.substring_dedup import without_repeats


def brute(rows, size):
    """doc_id, n_words, n_removed, kept words."""
    words = [(t or "").encode().split() for _, t in rows]
    n = {}
    for w in words:
        for i in range(len(w) - size + 1):
            n[tuple(w[i : i + size])] = n.get(tuple(w[i : i + size]), 0) + 1
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if n[tuple(w[i : i + size])] > 1:
                gone |= set(range(i, i + size))
        out.append((doc, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def found(df):
    rows = df.collect()
    for r in rows:
        assert sum(s["to"] - s["from"] for s in r["spans"]) == r["n_removed"]
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in rows), key=repr)


def sample(rng, n=120):
    shared = [[f"s{rng.randrange(50)}" for _ in range(k)] for k in (9, 10, 11, 30, 200)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(6)):
            w += rng.choice(shared)[rng.randrange(3) :] if rng.random() < 0.4 else [f"w{rng.randrange(8 if i % 9 == 0 else 3000)}" for _ in range(rng.randrange(40))]
        rows.append((rng.choice([None, i, i, i]), rng.choice([" ", "\n", "\x0b \t", "  "]).join(w)))
    rows += [(5, None), (None, None), (6, ""), (7, " \n "), rows[3], rows[3], rows[4], (8, "a " * 9), (9, "a " * 10), (10, "ab " * 11), (11, "ß x " * 30)]
    return rows


@pytest.mark.parametrize(("chunk_words", "chunk_windows"), [(400_000, 1_500_000), (60, 50)])
def test_brute_force(spark, monkeypatch, chunk_words, chunk_windows):
    monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", chunk_words)
    monkeypatch.setattr(substring_dedup, "CHUNK_WINDOWS", chunk_windows)
    rows = sample(random.Random(chunk_words))
    docs = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], "doc_id long, text string, tag int, k0 string, place int, n int").repartition(6)
    assert found(without_repeats(docs, size=10, gram=4)) == brute(rows, 10)


@pytest.mark.parametrize("most_bits", [3, 6])
def test_a_full_sketch_loses_nothing(spark, most_bits):
    rows = sample(random.Random(2), 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(without_repeats(docs, size=10, gram=10, most_bits=most_bits)) == brute(rows, 10)


def test_hot_passage_and_long_text(spark):
    rng = random.Random(8)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(i, " ".join([f"a{i}", f"b{i}", *passage, f"c{i}"])) for i in range(400)] + [(1000, " ".join(f"l{k}" for k in range(60_000)) + " " + " ".join(passage[:36]))]
    got = found(without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)))
    assert got == brute(rows, 35)


def test_empty(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
