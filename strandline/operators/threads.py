"""Threads: edges, depth, summaries and hot conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.folders import Scratch
from ..plans.template import define, define_computed
from .graph import cut

#: Threads are followed this far.
LEVELS = 200


def ancestors(thr_edges: DataFrame, levels: int = LEVELS) -> DataFrame:
    """id, ancestor, distance, missing for every child of thr_edges (child, parent, parent_missing; one parent a child).

    Chains double in each round: what stands k above the note k above it is 2 * k above. So 200 levels take eight joins. A chain
    that runs into a cycle ends before it meets an ancestor or the note itself again.
    """
    edges = thr_edges.select("child", "parent").where("child is not null and parent is not null")
    far = cut(edges.select(F.col("child").alias("id"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    reach = 1
    while reach < levels:
        ends = far.where(F.col("distance") == reach).select("id", F.col("ancestor").alias("mid"))
        more = ends.join(far.select(F.col("id").alias("mid"), "ancestor", (F.col("distance") + reach).alias("distance")), "mid").select("id", "ancestor", "distance")
        more = cut(more.where((F.col("distance") <= levels)))
        if more.isEmpty():
            break
        far = cut(far.union(more).where("id <> ancestor").groupBy("id", "ancestor").agg(F.min("distance").alias("distance")))
        reach *= 2
    absent = thr_edges.where("parent_missing").select(F.col("parent").alias("ancestor")).distinct().withColumn("absent", F.lit(True))
    return far.where("id <> ancestor").join(absent, "ancestor", "left").select("id", "ancestor", "distance", F.coalesce("absent", F.lit(False)).alias("missing"))


def chains(edges: DataFrame, levels: int, scratch: Scratch) -> DataFrame:
    """id, depth, root of every child of edges (child, parent; one parent a child): its last ancestor within levels, and how far that is.

    Pointer jumping: a row a child points to an ancestor, and each round to what that points to, so a chain of any length takes the
    logarithm of its length in rounds, and no round holds more than a row a child. A pointer that no child is has come to its
    root. What has none after as many rounds as the number of children has binary digits leads into a cycle; those alone
    get their ancestors one by one, up to where the cycle closes. Where a chain is longer than levels, its node's ancestor
    there is found by the pointers of the rounds that add up to levels.
    """
    now = scratch.cut(edges.where("child is not null and parent is not null and child <> parent").select(F.col("child").alias("id"), F.col("parent").alias("at"), F.lit(1).cast("long").alias("far"), F.lit(False).alias("ended")))
    jumps, n, open_ = [now], now.count(), -1
    for _ in range(max(1, n.bit_length() + 1)):
        onward = now.select(F.col("id").alias("__id"), F.col("at").alias("__at"), F.col("far").alias("__far"))
        ended = F.col("__id").isNull()
        now = scratch.cut(now.join(onward, F.col("at") == F.col("__id"), "left").select("id", F.coalesce("__at", "at").alias("at"), (F.col("far") + F.coalesce("__far", F.lit(0))).alias("far"), ended.alias("ended")))
        jumps.append(now)
        open_ = now.where("not ended").count()
        if not open_:
            break
    short = now.where(f"ended and far <= {levels}").select("id", F.col("far").cast("int").alias("depth"), F.col("at").alias("root"))
    # jumps[k] goes 2 ** k up
    far = now.where(f"ended and far > {levels}").select("id", F.col("id").alias("at"))
    for k in range(levels.bit_length()):
        if levels >> k & 1 and k < len(jumps):
            step = jumps[k].select(F.col("id").alias("__id"), F.col("at").alias("__at"))
            far = far.join(step, F.col("at") == F.col("__id")).select("id", F.col("__at").alias("at"))
    out = short.union(far.select("id", F.lit(levels).alias("depth"), F.col("at").alias("root")))
    if open_ > 0:
        caught = edges.join(now.where("not ended").select(F.col("id").alias("child")), "child", "left_semi")
        ring = ancestors(caught.select("child", "parent", F.lit(False).alias("parent_missing")), levels)
        out = out.union(ring.groupBy("id").agg(F.max("distance").alias("depth"), F.max_by("ancestor", "distance").alias("root")))
    return out


def depth_of(notes: DataFrame, thr_edges: DataFrame) -> DataFrame:
    """id, depth, root of every note of notes (id), by thr_edges (child, parent, parent_missing)."""
    with Scratch(notes.sparkSession, "depth") as scratch:
        found = cut(chains(thr_edges.where("not parent_missing").select("child", "parent"), LEVELS, scratch))
    return notes.select("id").join(found, "id", "left").select("id", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("root", "id").alias("root"))


define("thr_edges", "Edges of replies to parent and root with whether each is missing.", """
SELECT c.event_id AS child, c.parent, c.root, p.id IS NULL AS parent_missing, r.id IS NULL AS root_missing, n.pubkey AS author, n.ts AS child_at FROM (SELECT event_id, @num(parent) AS parent, @num(root) AS root FROM {thr_parent}) c JOIN {notes} n ON c.event_id = n.id
LEFT JOIN {notes} p ON c.parent = p.id LEFT JOIN {notes} r ON c.root = r.id WHERE c.event_id <> c.parent""", kept=True)
define("thr_unresolved", "References whose target is absent, and those that a note that came later than its reply resolves.", """
SELECT child, parent, 'missing' AS state FROM {thr_edges} WHERE parent_missing UNION ALL SELECT e.child, e.parent, 'repaired' FROM {thr_edges} e JOIN {notes} p ON e.parent = p.id WHERE NOT e.parent_missing AND p.ts > e.child_at""")
define_computed("thr_ancestors", "Ancestors of every note up to LEVELS levels, by their least distance, with whether they are missing; cycles end where they close.", ("thr_edges",), ancestors, f"""
WITH RECURSIVE w(id, ancestor, distance, path) AS (SELECT child, parent, 1, [child, parent] FROM thr_edges
  UNION ALL SELECT w.id, e.parent, w.distance + 1, list_append(w.path, e.parent) FROM w JOIN thr_edges e ON e.child = w.ancestor WHERE w.distance < {LEVELS} AND NOT list_contains(w.path, e.parent))
SELECT w.id, w.ancestor, CAST(w.distance AS INTEGER) AS distance, w.ancestor IN (SELECT parent FROM thr_edges WHERE parent_missing) AS missing FROM w""")
define_computed("thr_depth", "Depth and root of every note: its furthest ancestor that is known, of at most LEVELS, itself if it has none.", ("notes", "thr_edges"), lambda notes, thr_edges: depth_of(notes, thr_edges), f"""
WITH RECURSIVE e AS (SELECT child, parent FROM thr_edges WHERE NOT parent_missing), w(id, ancestor, distance, path) AS (SELECT child, parent, 1, [child, parent] FROM e
  UNION ALL SELECT w.id, e.parent, w.distance + 1, list_append(w.path, e.parent) FROM w JOIN e ON e.child = w.ancestor WHERE w.distance < {LEVELS} AND NOT list_contains(w.path, e.parent))
SELECT n.id, coalesce(max(w.distance), 0)::INTEGER AS depth, coalesce(arg_max(w.ancestor, w.distance), n.id) AS root FROM notes n LEFT JOIN w ON n.id = w.id GROUP BY n.id""")
define("thr_summary", "Per root: replies, participants, last activity, replies and authors of a day and a week, direct replies, latency of the first reply, branching times 100, depth.", """
SELECT t.root, count(*) AS replies, count(DISTINCT n.pubkey) AS participants, max(n.created_at) AS last_at, @count_if(n.ts > p.as_of - INTERVAL 1 DAY) AS replies_24h, count(DISTINCT CASE WHEN n.ts > p.as_of - INTERVAL 1 DAY THEN n.pubkey END) AS authors_24h, @count_if(n.ts > p.as_of - INTERVAL 7 DAYS) AS replies_7d,
  count(DISTINCT CASE WHEN n.ts > p.as_of - INTERVAL 7 DAYS THEN n.pubkey END) AS authors_7d, @count_if(t.depth = 1) AS direct, greatest(min(n.created_at) - min(r.created_at), 0) AS first_reply_s, @div(100 * count(*), count(DISTINCT e.parent)) AS branching_x100, max(t.depth) AS depth
FROM {thr_depth} t JOIN {notes} n ON t.id = n.id JOIN {notes} r ON t.root = r.id JOIN {thr_edges} e ON t.id = e.child CROSS JOIN {present} p WHERE t.depth > 0 GROUP BY t.root""", kept=True)
define("thr_velocity", "Hot rank of a conversation: none for one author; small groups capped by authors a reply; else weight and bonus.", """
SELECT root, replies, participants, round(CASE WHEN participants <= 1 THEN 0 WHEN participants <= 5 THEN (participants - 1) * least(1e0, 8e0 * participants / greatest(replies, 1))
  ELSE replies + least(replies, 50) * 15e-2 END, 6) AS velocity FROM {thr_summary}""")
define("thr_hot", "The hottest 20 conversations of a day, a week and a month.", """
SELECT days, root, replies, participants, velocity, rn FROM (SELECT w.days, v.root, v.replies, v.participants, v.velocity, row_number() OVER (PARTITION BY w.days ORDER BY v.velocity DESC, v.replies DESC, v.root) AS rn FROM {thr_velocity} v JOIN {thr_summary} s ON v.root = s.root CROSS JOIN {present} p CROSS JOIN {windows} w WHERE s.last_at > @unix(p.as_of) - w.days * 86400) r WHERE rn <= 20""")
define("thr_replies_page", "Replies of each note in pages of ten, oldest and newest first: the first page, and the one after its cursor.", """
SELECT parent, direction, child, rn, @div(rn - 1, 10) + 1 AS page FROM (SELECT e.parent, d.direction, e.child, row_number() OVER (PARTITION BY e.parent, d.direction ORDER BY CASE WHEN d.direction = 'asc' THEN @unix(e.child_at) ELSE -@unix(e.child_at) END, CASE WHEN d.direction = 'asc' THEN e.child ELSE -e.child END) AS rn
  FROM {thr_edges} e CROSS JOIN (SELECT 'asc' AS direction UNION ALL SELECT 'desc') d) r WHERE rn <= 20""")
define("thr_window", "A note with its ancestors from the root down, the missing ones too, and the first 50 replies and comments in order of time.", """
SELECT n.id, coalesce(a.n, 0) AS ancestors, coalesce(a.ids, '') AS ancestor_ids, coalesce(a.missing, 0) AS missing, coalesce(r.n, 0) AS replies, coalesce(r.ids, '') AS reply_ids FROM {notes} n
LEFT JOIN (SELECT id, count(*) AS n, @in_order(ancestor, -distance) AS ids, @count_if(missing) AS missing FROM {thr_ancestors} GROUP BY id) a ON n.id = a.id
LEFT JOIN (SELECT parent, count(*) AS n, @in_order(child, rn) AS ids FROM (SELECT parent, child, row_number() OVER (PARTITION BY parent ORDER BY child_at, child) AS rn FROM (SELECT parent, child, child_at FROM {thr_edges} UNION SELECT @num(c.parent), c.event_id, n.ts FROM {ref_comments} c JOIN {notes} n ON c.event_id = n.id WHERE c.parent_by = 'id') u) w WHERE rn <= 50 GROUP BY parent) r ON n.id = r.parent""")
define("thr_activity", "Of each note's own answers: of a day, a week and the week before, and their change.", """
SELECT n.id, @count_if(e.child_at > p.as_of - INTERVAL 1 DAY) AS day, @count_if(e.child_at > p.as_of - INTERVAL 7 DAYS) AS week, @count_if(e.child_at <= p.as_of - INTERVAL 7 DAYS AND e.child_at > p.as_of - INTERVAL 14 DAYS) AS week_before, max(v.velocity) AS velocity
FROM {notes} n JOIN {thr_edges} e ON n.id = e.parent LEFT JOIN {thr_velocity} v ON n.id = v.root CROSS JOIN {present} p GROUP BY n.id""")
define("thr_shape_daily", "Threads a day, median first reply, mean depth and branching.", """
SELECT @date(r.ts) AS day, count(*) AS threads, round(@quantile(s.first_reply_s, 0.5), 6) AS p50_first_reply_s, round(avg(s.depth), 6) AS depth, round(avg(s.branching_x100), 6) AS branching_x100 FROM {thr_summary} s JOIN {notes} r ON s.root = r.id GROUP BY @date(r.ts)""")
define("thr_conversations", "Conversations as threads: turns, speakers, characters.", """
SELECT root, count(*) AS turns, count(DISTINCT author) AS speakers, max(turn) AS depth, @isum(length(text)) AS chars FROM {chat} GROUP BY root""")
