import random

import pytest

from strandline.operators.graph import hops, neighborhoods, pagerank


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")


def test_ring_is_uniform(spark):
    n = 32
    found = pagerank(_edges(spark, [(f"n{i:02}", f"n{(i + k) % n:02}") for i in range(n) for k in (1, 2, 3)])).collect()
    assert len(found) == n and all(abs(r["score"] - 1 / n) < 1e-9 for r in found)


def test_pagerank_with_dangling_nodes_and_teleport(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(20)}", f"n{rng.randrange(25)}") for _ in range(60)]
    nodes = sorted({x for p in pairs for x in p})
    start = {x: (1.0 if x in ("n1", "n2") else 0.0) for x in nodes}
    total = sum(start.values())
    restart = {x: v / total for x, v in start.items()}
    score = dict(restart)
    out = {}
    for a, _ in pairs:
        out[a] = out.get(a, 0) + 1
    for _ in range(30):
        lost = sum(score[x] for x in nodes if x not in out)
        new = {x: 0.15 * restart[x] + 0.85 * lost * restart[x] for x in nodes}
        for a, b in pairs:
            new[b] += 0.85 * score[a] / out[a]
        score = new
    seeds = spark.createDataFrame([("n1", 1.0), ("n2", 1.0)], "node string, weight double")
    found = {r["node"]: r["score"] for r in pagerank(_edges(spark, pairs), seeds).collect()}
    assert found.keys() == score.keys()
    assert all(found[x] == pytest.approx(score[x], abs=1e-8) for x in nodes)


def test_hops_and_neighbourhoods(spark):
    edges = _edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "a")])
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r["node"]: r["hops"] for r in hops(edges, seeds, 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    found = {(r["node"], r["hops"], round(r["weight"], 3)) for r in neighborhoods(edges, seeds, 3, 3).collect()}
    assert found == {("a", 0, 1.0), ("b", 1, 0.5), ("c", 1, 0.5)}


def test_empty_graph(spark):
    assert pagerank(_edges(spark, [("a", "b")]).limit(0)).count() == 0


def test_pushes_stay_local_and_within_their_error(spark, monkeypatch):
    from strandline.operators import graph
    from strandline.plans.folders import Scratch

    rng = random.Random(9)
    # many clusters; a viewer's walk hardly leaves its own
    edges = [(c * 20 + rng.randrange(20), c * 20 + rng.randrange(20), 1.0 + rng.random()) for c in range(60) for _ in range(120)] + [(c * 20, (c * 20 + 20) % 1200, 0.01) for c in range(60)] + [(5, 5000, 1.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    teleport = spark.createDataFrame([(1, 1, 1.0), (1, 5, 1.0), (2, 405, 1.0), (3, 999_999, 1.0)], "viewer long, node long, weight double")
    rows = []
    own = Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, x: rows.append((out := own(self, x)).count() if "left" in x.columns else 0) or (out if "left" in x.columns else own(self, x)))
    scores, errors = graph.pushed(df, teleport, epsilon=1e-3)
    got = {(r["viewer"], r["node"]): r["score"] for r in scores.collect()}
    bound = {r["viewer"]: r["error"] for r in errors.collect()}
    exact = {(r["viewer"], r["node"]): r["score"] for r in graph.personalized(df, teleport, 10**6, max_rounds=60, tolerance=1e-12).collect()}
    assert {v for v, _ in got} == {1, 2} == set(bound)
    for k, score in exact.items():
        assert -1e-6 <= score - got.get(k, 0.0) <= bound[k[0]] + 1e-6
    for v in bound:
        assert abs(sum(s for (w, _), s in got.items() if w == v) + bound[v] - 1) < 1e-6 and bound[v] < 0.5
    assert max(rows) < 150  # of 1,201 nodes for each of two viewers


def test_personal_ranks_read_the_edges_that_walks_reach(spark, monkeypatch):
    from strandline.operators import graph

    near, far = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "end")], [(f"f{i}", f"f{i + 1}") for i in range(40)] + [("f3", "a")]
    starts = spark.createDataFrame([("a", "a", 1.0)], "viewer string, node string, weight double")
    assert {r["node"] for r in graph.reachable(_edges(spark, near + far), starts, 9).collect()} == {"a", "b", "c", "end"}
    assert {r["node"] for r in graph.reachable(_edges(spark, far), starts.selectExpr("viewer", "'f0' AS node", "weight"), 3).collect()} == {"f0", "f1", "f2"}
    sizes, before = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: sizes.append(before(df)) or sizes[-1])
    found = graph.personalized(_edges(spark, near + far), starts, 9, max_rounds=6).collect()
    tables = [t for t in sizes if t.columns == ["src", "dst", "share"]]
    assert tables[-1].count() == len(near)
    assert sorted(map(tuple, found)) == sorted(map(tuple, graph.personalized(_edges(spark, near), starts, 9, max_rounds=6).collect()))
