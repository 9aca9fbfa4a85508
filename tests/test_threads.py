"""Depths by pointer jumping."""

import random

from strandline.operators import threads as t
from strandline.plans.folders import Scratch


def brute(edges, levels):
    up = dict(edges)
    out = {}
    for c in up:
        seen, at = [c], c
        while at in up and up[at] not in seen and len(seen) <= levels:
            at = up[at]
            seen.append(at)
        out[c] = (len(seen) - 1, at)
    return out


def found(spark, edges, levels):
    with Scratch(spark, "test") as scratch:
        rows = t.chains(spark.createDataFrame(edges, "child long, parent long"), levels, scratch).collect()
    assert len(rows) == len({r["id"] for r in rows})
    return {r["id"]: (r["depth"], r["root"]) for r in rows}


def test_forest_against_walking(spark):
    rng = random.Random(2)
    edges = [(i, rng.randrange(max(0, i - 6), i)) for i in range(1, 400) if i % 50]
    for levels in (200, 13, 1):
        assert found(spark, edges, levels) == brute(edges, levels)


def test_cycles_and_what_leads_into_them(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, 7), (7, 6), (10, 11), (11, 12), (20, 20)]
    want = brute([e for e in edges if e[0] != e[1]], 200)
    assert found(spark, edges, 200) == want and want[5] == (4, 3)


def test_long_chains_hold_a_row_a_note(spark, monkeypatch):
    sizes = []
    own = Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df: sizes.append((out := own(self, df)).count()) or out)
    edges = [(c * 1000 + i, c * 1000 + i - 1) for c in range(40) for i in range(1, 300)]
    got = found(spark, edges, 200)
    assert got == brute(edges, 200) and max(sizes) == len(edges) and len(sizes) <= 11


def test_empty(spark):
    assert found(spark, [], 200) == {}
