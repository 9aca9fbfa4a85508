"""Trust over graphs: PageRank, hops, neighbourhoods. Iterations are joins; only a number a round reaches the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.folders import Scratch, cut
from ..plans.template import REGISTRY, define, define_computed
from ..sources import adapters  # noqa: F401

#: Rounds after which lineage is cut, and the change of scores is looked at.
CUT_EVERY = 2


def shares(edges: DataFrame) -> DataFrame:
    """src, dst, share: what part of a node's score goes along each edge. Duplicates add up, nulls and weights of 0 or less are dropped.

    Totals come from an aggregate and a join, so a node with very many edges is not one task's.
    """
    edges = edges.where("src is not null and dst is not null and weight > 0").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    return edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share"))


def pagerank(edges: DataFrame, teleport: DataFrame | None = None, damping: float = 0.85, max_rounds: int = 30, tolerance: float = 1e-9) -> DataFrame:
    """(node, score) of edges (src, dst, weight); duplicates add up, nulls and weights of 0 or less are dropped.

    teleport: (node, weight) of the nodes that walks restart from, by weight; all alike if it is None or has no node of the graph. The
    mass of nodes without edges goes where walks restart. Stops after max_rounds, or when scores change by less than tolerance
    in all; that is looked at every CUT_EVERY rounds. Every round is one join of the edges, dealt by src once, with the scores.
    """
    edges = cut(shares(edges))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    if teleport is None:
        nodes = nodes.withColumn("own", F.lit(1.0))
    else:
        given = teleport.groupBy("node").agg(F.sum("weight").alias("own"))
        nodes = nodes.join(given, "node", "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    totals = nodes.agg(F.sum("own").alias("total"), F.count(F.lit(1)).alias("n"))  # one row
    nodes = nodes.crossJoin(F.broadcast(totals)).select("node", F.when(F.col("total") > 0, F.col("own") / F.col("total")).otherwise(1.0 / F.col("n")).alias("restart"))
    nodes = cut(nodes)
    scores = nodes.select("node", F.col("restart").alias("score"))
    for round_ in range(1, max_rounds + 1):
        received = edges.join(scores, edges["src"] == scores["node"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        # what nodes without edges hold is what was not received, as scores add up to 1
        lost = received.agg((1 - F.coalesce(F.sum("got"), F.lit(0.0))).alias("lost"))  # one row
        new: Column = (1 - damping) * F.col("restart") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("restart"))
        after = nodes.join(received, F.col("node") == F.col("dst"), "left").crossJoin(F.broadcast(lost)).select("node", new.alias("score"))
        if round_ % CUT_EVERY == 0 or round_ == max_rounds:
            after = cut(after)
            if tolerance > 0 and round_ > CUT_EVERY:
                change = after.join(before.withColumnRenamed("score", "was"), "node").agg(F.sum(F.abs(F.col("score") - F.col("was"))).alias("d"))
                if (change.first()["d"] or 0.0) < tolerance:
                    return after
            before = after
        scores = after
    return scores


def reachable(edges: DataFrame, starts: DataFrame, max_rounds: int) -> DataFrame:
    """(node) of starts and of all that walks along edges (src, dst) of fewer than max_rounds steps reach: a frontier a round."""
    seen = frontier = cut(starts.select("node").distinct())
    for _ in range(max_rounds - 1):
        frontier = cut(edges.join(frontier, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return cut(seen)


def personalized(edges: DataFrame, teleport: DataFrame, k: int, damping: float = 0.85, max_rounds: int = 30, tolerance: float = 1e-9) -> DataFrame:
    """(viewer, node, score, rank): the k best nodes for each viewer of teleport (viewer, node, weight), by walks that restart at its nodes.

    Only nodes that a walk reaches have rows, and all viewers take a round together. Rounds read the edges of those nodes alone, which
    are found first, so they cost what walks reach and not what the graph has. The mass of nodes without edges goes back to
    the viewer's own. Ends as pagerank does, by the largest change of any viewer's scores; equal scores are in order of nodes.
    """
    edges = cut(shares(edges))
    known = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    given = teleport.where("weight > 0").groupBy("viewer", "node").agg(F.sum("weight").alias("own")).join(known, "node", "left_semi")
    totals = given.groupBy("viewer").agg(F.sum("own").alias("total"))
    restart = cut(given.join(totals, "viewer").select("viewer", "node", (F.col("own") / F.col("total")).alias("restart")))
    edges = cut(edges.join(reachable(edges, restart, max_rounds), F.col("src") == F.col("node"), "left_semi"))
    scores = restart.select("viewer", "node", F.col("restart").alias("score"))
    for round_ in range(1, max_rounds + 1):
        got = scores.join(edges, scores["node"] == edges["src"]).groupBy("viewer", F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        lost = got.groupBy("viewer").agg((1 - F.sum("got")).alias("lost"))
        back = restart.join(lost, "viewer", "left").select("viewer", "node", ((1 - damping) * F.col("restart") + damping * F.coalesce("lost", F.lit(1.0)) * F.col("restart")).alias("back"))
        after = got.join(back, ["viewer", "node"], "full").select("viewer", "node", (damping * F.coalesce("got", F.lit(0.0)) + F.coalesce("back", F.lit(0.0))).alias("score"))
        if round_ % CUT_EVERY == 0 or round_ == max_rounds:
            after = cut(after)
            if round_ > CUT_EVERY:
                both = after.join(before.withColumnRenamed("score", "was"), ["viewer", "node"], "full")
                change = both.groupBy("viewer").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))).alias("d")).agg(F.max("d").alias("d"))
                if (change.first()["d"] or 0.0) < tolerance:
                    scores = after
                    break
            before = after
        scores = after
    order = Window.partitionBy("viewer").orderBy(F.desc("rounded"), "node")
    ranked = scores.withColumn("rounded", F.round("score", 10)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("viewer", "node", F.col("rounded").alias("score"), "rank")


def pushed(edges: DataFrame, teleport: DataFrame, epsilon: float = 1e-4, damping: float = 0.85, max_rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """Local personalized PageRank by forward push: (viewer, node, score) and (viewer, error).

    Each viewer of teleport (viewer, node, weight) starts with residual 1 at its nodes. A round settles, of every node whose residual
    is over epsilon for each of its edges (one at least), the part 1 - damping, and passes the rest along its edges; nodes
    without edges pass it back to the viewer's own. So a viewer settles 1 - damping times epsilon for each edge that a round
    reads, and reads 1 / ((1 - damping) * epsilon) edges at most in all, however large the graph. Scores are too low, each by no more
    than error, the residual that is left, which all nodes share.

    A round is one join of the active rows with the edges; one number reaches the driver. Edges as in shares().
    """
    with Scratch(edges.sparkSession, "push") as scratch:
        edges = scratch.cut(shares(edges))
        degrees = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
        known = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
        given = teleport.where("weight > 0").groupBy("viewer", "node").agg(F.sum("weight").alias("own")).join(known, "node", "left_semi")
        totals = given.groupBy("viewer").agg(F.sum("own").alias("total"))
        restart = scratch.cut(given.join(totals, "viewer").join(degrees, "node", "left").select("viewer", "node", (F.col("own") / F.col("total")).alias("restart"), F.coalesce("degree", F.lit(0)).alias("degree")))
        now = restart.select("viewer", "node", F.lit(0.0).alias("score"), F.col("restart").alias("left"), "degree")
        active = F.col("left") > epsilon * F.greatest("degree", F.lit(1))
        for _ in range(max_rounds):
            out = now.where(active)
            along = out.where("degree > 0").join(edges, F.col("node") == F.col("src")).select("viewer", F.col("dst").alias("node"), (damping * F.col("left") * F.col("share")).alias("got"))
            back = out.where("degree = 0").groupBy("viewer").agg(F.sum(damping * F.col("left")).alias("got")).join(restart, "viewer").select("viewer", "node", (F.col("got") * F.col("restart")).alias("got"))
            got = along.union(back).groupBy("viewer", "node").agg(F.sum("got").alias("got")).join(degrees.withColumnRenamed("degree", "own"), "node", "left")
            rest = F.when(active, 0.0).otherwise(F.col("left"))
            after = now.select("viewer", "node", (F.col("score") + F.when(active, (1 - damping) * F.col("left")).otherwise(0.0)).alias("score"), rest.alias("left"), "degree")
            both = after.join(got, ["viewer", "node"], "full")
            now = scratch.cut(both.select("viewer", "node", F.coalesce("score", F.lit(0.0)).alias("score"), (F.coalesce("left", F.lit(0.0)) + F.coalesce("got", F.lit(0.0))).alias("left"), F.coalesce("degree", "own", F.lit(0)).alias("degree")))
            if now.where(active).isEmpty():
                break
        now = cut(now.select("viewer", "node", "score", "left"))
    return now.where("score > 0").select("viewer", "node", "score"), now.groupBy("viewer").agg(F.sum("left").alias("error"))


def hops(edges: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """(node, hops) of the nodes within max_hops of seeds (node), along edges (src, dst): a frontier a round, joined to nodes not seen before."""
    seen = cut(seeds.select("node").where("node is not null").distinct().withColumn("hops", F.lit(0)))
    for h in range(1, max_hops + 1):
        next_ = edges.join(seen.where(F.col("hops") == h - 1), edges["src"] == F.col("node")).select(F.col("dst").alias("node")).distinct()
        next_ = next_.join(seen, "node", "left_anti").withColumn("hops", F.lit(h))
        seen = cut(seen.union(next_))
    return seen


def neighborhoods(edges: DataFrame, seeds: DataFrame, max_hops: int, max_members: int) -> DataFrame:
    """(seed, node, hops, weight): up to max_members nodes of each seed by hops, then id; weight 1 / (hops + 1)."""
    seen = cut(seeds.select(F.col("node").alias("seed"), "node").where("node is not null").distinct().withColumn("hops", F.lit(0)))
    order = Window.partitionBy("seed").orderBy("hops", "node")
    for h in range(1, max_hops + 1):
        next_ = edges.join(seen.where(F.col("hops") == h - 1), edges["src"] == F.col("node")).select("seed", F.col("dst").alias("node")).distinct()
        next_ = next_.join(seen, ["seed", "node"], "left_anti").withColumn("hops", F.lit(h))
        seen = cut(seen.union(next_).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= max_members).drop("rn"))
    return seen.withColumn("weight", 1.0 / (F.col("hops") + 1))


ROUNDS = 30


def _trust_hops(trust_seeds: DataFrame, contacts: DataFrame, settings: DataFrame) -> DataFrame:
    limit = settings.first()
    edges = contacts.where("follower <> followed").select(F.col("follower").alias("src"), F.col("followed").alias("dst"))
    near = hops(edges, trust_seeds.where("active").select(F.col("pubkey").alias("node")), limit["max_hops"])
    trusted = edges.join(near, edges["src"] == near["node"], "left_semi").groupBy("dst").agg(F.countDistinct("src").alias("n"))
    large = trusted.where(F.col("n") >= limit["large_floor"]).select(F.col("dst").alias("node"), F.lit(1).alias("hops"))
    return near.union(large).groupBy(F.col("node").alias("pubkey")).agg(F.min("hops").alias("hops"))


define_computed("trust_hops", "Least hops from the active seeds, at most max_hops; and accounts that large_floor of those or more follow, at one hop.", ("trust_seeds", "contacts", "settings"), _trust_hops, """
WITH RECURSIVE h(pubkey, hops) AS (SELECT pubkey, 0 FROM trust_seeds WHERE active UNION SELECT c.followed, h.hops + 1 FROM h JOIN contacts c ON c.follower = h.pubkey AND c.follower <> c.followed CROSS JOIN settings s WHERE h.hops < s.max_hops),
m AS (SELECT pubkey, min(hops) AS hops FROM h GROUP BY pubkey),
l AS (SELECT c.followed AS pubkey FROM contacts c JOIN m ON c.follower = m.pubkey WHERE c.follower <> c.followed GROUP BY c.followed HAVING count(DISTINCT c.follower) >= (SELECT large_floor FROM settings))
SELECT pubkey, CAST(min(hops) AS INTEGER) AS hops FROM (SELECT pubkey, hops FROM m UNION ALL SELECT pubkey, 1 FROM l) u GROUP BY pubkey""")


def _rank_sql(restart: str, rounds: int = ROUNDS) -> str:
    """DuckDB's form of pagerank over trust_merge_graph: every round spelled out. restart: SQL of node and weight."""
    parts = [
        "e AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM trust_merge_graph WHERE weight > 0)",
        f"n AS MATERIALIZED (SELECT node, weight / sum(weight) OVER () AS restart, node NOT IN (SELECT src FROM e) AS dangling FROM ({restart}) t WHERE node IN (SELECT src FROM e UNION SELECT dst FROM e))",
        "r0 AS (SELECT node, restart AS score FROM n)",
    ]
    for k in range(rounds):
        lost = f"(SELECT coalesce(sum(r.score), 0) FROM r{k} r JOIN n ON n.node = r.node WHERE n.dangling)"
        got = f"(SELECT dst, sum(score * share) AS got FROM e JOIN r{k} ON src = node GROUP BY dst)"
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT n.node, 0.15::DOUBLE * restart + 0.85::DOUBLE * (coalesce(got, 0) + {lost} * restart) AS score FROM n LEFT JOIN {got} g ON n.node = dst)")
    return "WITH " + ",\n".join(parts) + f"\nSELECT node, round(score, 8) AS score FROM r{rounds}"


_NODES = "SELECT src AS node FROM trust_merge_graph WHERE weight > 0 UNION SELECT dst FROM trust_merge_graph WHERE weight > 0"


def _trust_pagerank(trust_merge_graph: DataFrame) -> DataFrame:
    return pagerank(trust_merge_graph).select("node", F.round("score", 8).alias("score"))


def _trust_seed_teleport(trust_merge_graph: DataFrame, trust_seeds: DataFrame) -> DataFrame:
    seeds = trust_seeds.where("active").select(F.col("pubkey").alias("node"), F.lit(1.0).alias("weight"))
    return pagerank(trust_merge_graph, seeds).select("node", F.round("score", 8).alias("score"))


define_computed("trust_pagerank", "PageRank over follow and interaction edges: 30 rounds at most, or until scores change by less than 1e-9.", ("trust_merge_graph",), _trust_pagerank, _rank_sql(f"SELECT node, 1.0::DOUBLE AS weight FROM ({_NODES}) x"))
define_computed("trust_seed_teleport", "The same with walks that restart at the active seeds.", ("trust_merge_graph", "trust_seeds"), _trust_seed_teleport, _rank_sql(f"SELECT node, CASE WHEN node IN (SELECT pubkey FROM trust_seeds WHERE active) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM ({_NODES}) x"))
define("trust_scores", "Scores of users: pubkey, score.", "SELECT node AS pubkey, score FROM {trust_pagerank}")
define("viewers", "Viewers of personal rankings and whom they follow, at a weight of 1 each, themselves too: viewer, node, weight. Active seeds that follow somebody.", """
SELECT c.follower AS viewer, c.followed AS node, 1e0 AS weight FROM {contacts} c JOIN {trust_seeds} s ON c.follower = s.pubkey AND s.active WHERE c.follower <> c.followed UNION SELECT c.follower, c.follower, 1e0 FROM {contacts} c JOIN {trust_seeds} s ON c.follower = s.pubkey AND s.active""")


def _trust_personalized(trust_merge_graph: DataFrame, viewers: DataFrame) -> DataFrame:
    found = personalized(trust_merge_graph, viewers, 50).select("viewer", "node", F.round("score", 5).alias("score"))
    return found


def _personalized_sql(rounds: int = ROUNDS, k: int = 50) -> str:
    parts = [
        "e AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM trust_merge_graph WHERE weight > 0)",
        "t AS MATERIALIZED (SELECT viewer, node, weight / sum(weight) OVER (PARTITION BY viewer) AS restart FROM viewers WHERE node IN (SELECT src FROM e UNION SELECT dst FROM e))",
        "r0 AS (SELECT viewer, node, restart AS score FROM t)",
    ]
    for j in range(rounds):
        lost = f"(SELECT viewer, sum(score) AS lost FROM r{j} WHERE node NOT IN (SELECT src FROM e) GROUP BY viewer)"
        got = f"(SELECT viewer, dst AS node, sum(score * share) AS got FROM e JOIN r{j} ON src = node GROUP BY viewer, dst)"
        back = f"(SELECT t.viewer, t.node, 0.15::DOUBLE * restart + 0.85::DOUBLE * coalesce(l.lost, 0) * restart AS back FROM t LEFT JOIN {lost} l ON t.viewer = l.viewer)"
        parts.append(f"r{j + 1} AS MATERIALIZED (SELECT viewer, node, 0.85::DOUBLE * coalesce(got, 0) + coalesce(back, 0) AS score FROM {got} g FULL OUTER JOIN {back} b USING (viewer, node))")
    return "WITH " + ",\n".join(parts) + f"\nSELECT viewer, node, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY viewer ORDER BY round(score, 10) DESC, node) AS rn FROM r{rounds}) x WHERE rn <= {k}"


define_computed("trust_personalized", "The 50 best users for each viewer by walks that restart at the viewer and whom it follows.", ("trust_merge_graph", "viewers"), _trust_personalized, _personalized_sql())


#: Of the query over the driver's graph; an odd number, so that no residual stands on it.
EPSILON, PUSHES = 1.37e-3, 40


def _trust_push(trust_merge_graph: DataFrame, viewers: DataFrame) -> DataFrame:
    scores, errors = pushed(trust_merge_graph, viewers, EPSILON, max_rounds=PUSHES)
    best = scores.withColumn("rounded", F.round("score", 7)).withColumn("rn", F.row_number().over(Window.partitionBy("viewer").orderBy(F.desc("rounded"), "node"))).where("rn <= 50")
    return best.join(errors, "viewer").select("viewer", "node", F.round("score", 5).alias("score"), F.round("error", 5).alias("error"))


def _push_sql(k: int = 50) -> str:
    active = f"r > {EPSILON}::DOUBLE * greatest(degree, 1)"
    parts = [
        "e AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM trust_merge_graph WHERE weight > 0)",
        "g AS MATERIALIZED (SELECT src AS node, count(*) AS degree FROM e GROUP BY src)",
        "t AS MATERIALIZED (SELECT viewer, node, weight / sum(weight) OVER (PARTITION BY viewer) AS restart FROM viewers WHERE node IN (SELECT src FROM e UNION SELECT dst FROM e))",
        "p0 AS (SELECT viewer, node, 0.0::DOUBLE AS p, restart AS r, coalesce(degree, 0) AS degree FROM t LEFT JOIN g USING (node))",
    ]
    for j in range(PUSHES):
        moved = f"SELECT viewer, dst AS node, 0.85::DOUBLE * r * share AS got FROM p{j} JOIN e ON src = node WHERE {active} UNION ALL SELECT t.viewer, t.node, l.got * t.restart FROM (SELECT viewer, sum(0.85::DOUBLE * r) AS got FROM p{j} WHERE degree = 0 AND {active} GROUP BY viewer) l JOIN t ON l.viewer = t.viewer"
        stay = f"SELECT viewer, node, p + CASE WHEN {active} THEN 0.15::DOUBLE * r ELSE 0 END AS p, CASE WHEN {active} THEN 0 ELSE r END AS r FROM p{j} UNION ALL SELECT viewer, node, 0, got FROM ({moved}) m"
        parts.append(f"p{j + 1} AS MATERIALIZED (SELECT viewer, node, p, r, coalesce(degree, 0) AS degree FROM (SELECT viewer, node, sum(p) AS p, sum(r) AS r FROM ({stay}) s GROUP BY viewer, node) x LEFT JOIN g USING (node))")
    last = f"p{PUSHES}"
    return "WITH " + ",\n".join(parts) + f"""
SELECT viewer, node, round(p, 5) AS score, round(error, 5) AS error FROM (SELECT *, row_number() OVER (PARTITION BY viewer ORDER BY round(p, 7) DESC, node) AS rn FROM {last} WHERE p > 0) x JOIN (SELECT viewer, sum(r) AS error FROM {last} GROUP BY viewer) w USING (viewer) WHERE rn <= {k}"""


define_computed("trust_pushed", "The 50 best users for each viewer by local pushes, and the bound of their scores' error.", ("trust_merge_graph", "viewers"), _trust_push, _push_sql())


def _neighborhoods_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.template import build

    made: dict = {}
    edges = build(spark, sf_dir, "follow", made).select(F.col("follower").alias("src"), F.col("followed").alias("dst"))
    return neighborhoods(edges, build(spark, sf_dir, "hood_seeds", made).withColumnRenamed("pubkey", "node"), 2, 100).select("seed", "node", "hops", F.round("weight", 6).alias("weight"))


define("hood_seeds", "Seeds of neighbourhoods in the graph of customers and suppliers: the ten customers of largest balance.", "SELECT concat('c', @str(c_custkey)) AS pubkey FROM {customer} ORDER BY c_acctbal DESC, c_custkey LIMIT 10")


def _neighborhoods_oracle() -> str:
    ctes = f"WITH follow AS ({REGISTRY['follow'].duckdb()}), trust_seeds AS ({REGISTRY['hood_seeds'].duckdb()})"
    return f"""{ctes},
h1 AS (SELECT DISTINCT s.pubkey AS seed, f.followed AS node FROM trust_seeds s JOIN follow f ON f.follower = s.pubkey WHERE f.followed <> s.pubkey),
a AS (SELECT pubkey AS seed, pubkey AS node, 0 AS hops FROM trust_seeds UNION ALL SELECT seed, node, 1 FROM h1),
c1 AS (SELECT seed, node, hops FROM (SELECT a.*, row_number() OVER (PARTITION BY seed ORDER BY hops, node) AS rn FROM a) r WHERE rn <= 100),
h2 AS (SELECT DISTINCT c.seed, f.followed AS node FROM c1 c JOIN follow f ON f.follower = c.node WHERE c.hops = 1 AND NOT EXISTS (SELECT 1 FROM c1 x WHERE x.seed = c.seed AND x.node = f.followed)),
b AS (SELECT * FROM c1 UNION ALL SELECT seed, node, 2 FROM h2)
SELECT seed, node, hops, round(1.0 / (hops + 1), 6)::DOUBLE AS weight FROM (SELECT b.*, row_number() OVER (PARTITION BY seed ORDER BY hops, node) AS rn FROM b) r WHERE rn <= 100"""


QUERIES = {"trust_neighborhoods": _neighborhoods_query}


def oracles() -> dict[str, str]:
    return {"trust_neighborhoods": _neighborhoods_oracle()}
