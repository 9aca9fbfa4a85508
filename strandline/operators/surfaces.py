"""Polls, badges, goals, groups, live chats, token payments; and rankings for search, viewers and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.folders import cut
from ..plans.template import define


def _lead(text: Column) -> Column:
    """Up to four characters of text, before the first that LIKE reads as a wildcard."""
    return F.substring(F.regexp_extract(text, "^[^_%]*", 0), 1, 4)


def _starts(text: Column, sizes: Column) -> Column:
    """text cut to each of sizes, as an array."""
    return F.transform(sizes, lambda n: F.substring(F.coalesce(text, F.lit("")), F.lit(1), n))


def _rated(found: DataFrame, key_begins: Column) -> DataFrame:
    """q, kind, key, score, rn: the five best documents of each q, of which found has k, a and t, key, alias and title in lower case, and size, the title's."""
    tier = F.when(F.col("k") == F.col("q"), 120).when(F.col("a") == F.col("q"), 95).when(F.col("t") == F.col("q"), 90).when(key_begins, 80).otherwise(70)
    rated = found.withColumn("tier", tier).select("q", "kind", "key", F.expr("round(tier + 25e0 * length(q) / greatest(length(q), size, 1) + least(10, ln(1e0 + popularity)), 6)").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "kind", F.asc_nulls_last("key"))
    return rated.withColumn("rn", F.row_number().over(order)).where("rn <= 5")


def _documents_rank(srch_term_df: DataFrame, attr_profile_fields: DataFrame, srch_documents: DataFrame) -> DataFrame:
    """srch_documents_rank by equal prefixes: all documents' keys and titles are cut to the shapes (length, places of _) of the queries that
    begin as they do. What a document has for a query follows from the cut alone, so cuts are ranked before they meet the queries, and one
    that very many documents share leaves a task as five rows. Queries with % go by LIKE, among what begins as they do."""
    queries = cut(srch_term_df.select(F.col("tag").alias("q")).union(attr_profile_fields.select(F.lower("name"))).union(attr_profile_fields.select("ln_address")).where("q is not null").distinct())
    queries = queries.withColumn("lead", _lead(F.col("q")))
    wild = queries.where(F.contains("q", F.lit("%")))
    plain = queries.where(~F.contains("q", F.lit("%")))
    none = F.array().cast("array<int>")
    open_ = F.when(F.contains("q", F.lit("_")), F.filter(F.sequence(F.lit(1), F.length("q")), lambda i: F.substring("q", i, F.lit(1)) == "_")).otherwise(none)
    shapes = cut(plain.groupBy("lead").agg(F.collect_set(F.struct(F.length("q").alias("n"), open_.alias("open"))).alias("shapes")))
    # one row: a number, and five at most
    limits = F.broadcast(cut(plain.agg(F.max(F.length("q")).alias("longest"), F.collect_set(F.length("lead")).alias("sizes"))))
    # titles by digest and no longer than tells them from queries
    short = F.substring(F.lower("title"), F.lit(1), F.col("longest") + 1)
    documents = cut(srch_documents.crossJoin(limits).select("kind", "key", "alias", "popularity", F.length("title").alias("size"), F.sha2("title", 256).alias("digest"), short.alias("t")).distinct())
    documents = documents.withColumn("k", F.lower("key")).withColumn("a", F.lower("alias"))
    k, a, t = F.col("k"), F.col("a"), F.col("t")
    starts = F.array_distinct(F.concat(_starts(k, F.col("sizes")), _starts(t, F.col("sizes")), F.array(F.coalesce(_lead(a), F.lit("")))))
    met = documents.crossJoin(limits).withColumn("lead", F.explode(starts)).join(shapes, "lead")

    def heads(text: Column) -> Column:
        """text cut to the shapes of its lead, _ at their open places."""
        cuts = F.transform(F.filter("shapes", lambda s: s.n <= F.length(text)), lambda s: F.reduce(s.open, F.substring(text, F.lit(1), s.n), lambda head, i: F.overlay(head, F.lit("_"), i, F.lit(1))))
        return F.when(F.startswith(text, F.col("lead")), cuts).otherwise(F.array().cast("array<string>"))

    alias = F.when(_lead(a) == F.col("lead"), F.array(a)).otherwise(F.array().cast("array<string>"))
    met = met.withColumn("of_key", heads(k)).withColumn("q", F.explode(F.array_distinct(F.concat("of_key", heads(t), alias))))
    found = _rated(met, F.array_contains("of_key", F.col("q"))).join(plain.select("q"), "q")
    if not wild.isEmpty():
        whole = srch_documents.select("kind", "key", "title", "alias", "popularity").distinct().withColumns({"k": F.lower("key"), "t": F.lower("title"), "a": F.lower("alias"), "size": F.length("title")})
        each = F.sequence(F.lit(0), F.lit(4))
        starts = F.array_distinct(F.concat(_starts(k, each), _starts(t, each), F.array(F.coalesce(_lead(a), F.lit("")))))
        # a backslash stands for itself, as in DuckDB
        pattern = F.concat(F.replace(F.col("q"), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
        like = {x: F.coalesce(F.like(F.col(x), pattern), F.lit(False)) for x in ("k", "t")}
        pairs = whole.withColumn("lead", F.explode(starts)).join(wild, "lead").where(like["k"] | like["t"] | (a == F.col("q")))
        found = found.unionByName(_rated(pairs, like["k"]))
    return cut(found.select("q", "kind", "key", "score", "rn"))

# smaller surfaces; notes and acts stand in for their own kinds of event
define("eco_polls", "Votes of each option of a poll: one a voter, the newest one before the poll's end.", """
SELECT poll, option_, count(*) AS votes FROM (SELECT v.poll, v.actor, v.option_, row_number() OVER (PARTITION BY v.poll, v.actor ORDER BY v.created_at DESC, v.source_id DESC) AS rn FROM {poll_votes} v JOIN {polls} p ON v.poll = p.poll WHERE v.created_at <= p.ends_at) v WHERE rn = 1 GROUP BY poll, option_""")
define("eco_badges", "Awards of each badge, its holders, and how many of them accepted it.", """
SELECT b.badge, count(*) AS awards, count(DISTINCT b.actor) AS holders, count(DISTINCT a.actor) AS accepted FROM {badge_awards} b LEFT JOIN {badge_acceptances} a ON b.badge = a.badge AND b.actor = a.actor GROUP BY b.badge""")
define("eco_goals", "Sats raised against the goal of each note with one.", """
SELECT g.id, g.goal, coalesce(z.sats, 0) AS raised, @div(coalesce(z.sats, 0) * 10000, g.goal) AS done_bps FROM {goals} g LEFT JOIN {cnt_zaps} z ON g.id = z.target_id""")
define("eco_groups", "Messages, members and last time of each group, with its size class.", """
SELECT grp, messages, members, last_at, CASE WHEN members < 5 THEN 'small' WHEN members < 12 THEN 'medium' ELSE 'large' END AS size FROM (SELECT grp, count(*) AS messages, count(DISTINCT pubkey) AS members, max(created_at) AS last_at FROM {group_messages} GROUP BY grp) g""")
define("eco_live_chat", "Chats, chatters and last time of each live address.", "SELECT value AS address, count(*) AS chats, count(DISTINCT pubkey) AS chatters, max(created_at) AS last_at FROM {tags} WHERE name = 'a' GROUP BY value")
define("note_live", "Live addresses: open ones have a chat in the last three days and an event that has not ended, a day after its start.", """
SELECT l.address, l.last_at, l.chats, CASE WHEN s.id IS NULL THEN 'unknown' WHEN s.created_at + 86400 * 10 < @unix(p.as_of) THEN 'ended' ELSE 'open' END AS status FROM {eco_live_chat} l LEFT JOIN {state_addressable} s ON l.address = concat(@str(s.kind), ':', @str(s.pubkey), ':', s.d) CROSS JOIN {present} p WHERE l.last_at > @unix(p.as_of) - 259200""")
define("fact_nutzaps", "Token payments of an amount: sats, unit and mint of each.", "SELECT source_id, receiver, sats, unit, mint FROM {token_payments} WHERE sats > 0")
define("attr_file_metadata", "Files of notes: the first address, type in lower case, size if it is a number, and digest.", """
SELECT event_id, max(CASE WHEN name = 'url' THEN value END) AS url, max(CASE WHEN name = 'm' THEN lower(value) END) AS mime, max(CASE WHEN name = 'size' AND @matches(value, '^[0-9]+$') THEN @num(value) END) AS size, max(CASE WHEN name = 'x' AND @matches(value, '^[0-9a-f]{64}$') THEN value END) AS digest
FROM {tags} WHERE name IN ('url', 'm', 'size', 'x') GROUP BY event_id HAVING max(CASE WHEN name = 'url' THEN value END) IS NOT NULL""")
define("ref_zap_targets", "Payments whose receiver wrote the target, per author and target.", "SELECT author, target_id, count(*) AS n, @isum(sats) AS sats FROM {acts} WHERE relation = 'zap' GROUP BY author, target_id")
# rankings
define("disc_trust_hashtags", "Hashtags of tags by the weights of the authors of their notes.", """
SELECT h.tag, count(*) AS notes, round(sum(coalesce(w.weight, 0)), 4) AS weight FROM {norm_tag_hashtags} h JOIN {notes} n ON h.event_id = n.id LEFT JOIN {disc_engager_weight} w ON n.pubkey = w.pubkey GROUP BY h.tag""")
define("disc_rank_reasons", "For the week's trending notes how often each signal rises from one place to the next, and the signal whose order agrees best with the ranking.", """
SELECT signal, rises, row_number() OVER (ORDER BY rises, signal) AS place FROM (SELECT signal, @count_if(value > before) AS rises FROM (SELECT signal, value, lag(value) OVER (PARTITION BY signal ORDER BY score DESC, id DESC) AS before FROM (
  SELECT n.id, n.score, g.signal, CASE g.signal WHEN 'replies' THEN CAST(c.replies AS DOUBLE) WHEN 'reactions' THEN CAST(c.reactions AS DOUBLE) WHEN 'zaps' THEN CAST(c.zaps AS DOUBLE) ELSE n.weight END AS value FROM (SELECT t.id, t.score_7d AS score, w.reply_w + w.zap_w AS weight FROM {disc_trending_notes} t JOIN {disc_weighted_engagement} w ON t.id = w.target_id AND w.days = 7) n
  JOIN {cnt_event_counts} c ON n.id = c.id CROSS JOIN (SELECT 'replies' AS signal UNION ALL SELECT 'reactions' UNION ALL SELECT 'zaps' UNION ALL SELECT 'weight') g) u) l GROUP BY signal) g""")
define("disc_personal_conversations", "For each viewer the three conversations of highest velocity that its cohort takes part in; of an author the five newest conversations are looked at.", """
SELECT viewer, root, velocity, people, rn FROM (SELECT viewer, root, velocity, people, row_number() OVER (PARTITION BY viewer ORDER BY velocity DESC, people DESC, root DESC) AS rn FROM (
  SELECT c.viewer, d.root, max(v.velocity) AS velocity, count(DISTINCT d.pubkey) AS people FROM {disc_personal_cohort} c JOIN (SELECT pubkey, root FROM (SELECT pubkey, root, row_number() OVER (PARTITION BY pubkey ORDER BY last_at DESC, root DESC) AS rn FROM (
    SELECT n.pubkey, t.root, max(n.created_at) AS last_at FROM {thr_depth} t JOIN {notes} n ON t.id = n.id WHERE t.depth > 0 GROUP BY n.pubkey, t.root) g) x WHERE rn <= 5) d ON c.other = d.pubkey JOIN {thr_velocity} v ON d.root = v.root GROUP BY c.viewer, d.root) g) r WHERE rn <= 3""")
define("disc_personal_profiles", "For each viewer the five profiles that its cohort engages, pays, follows, and newly follows most, whom it doesn't follow itself.", """
SELECT viewer, list, author, value, rn FROM (SELECT u.viewer, u.list, u.author, u.value, row_number() OVER (PARTITION BY u.viewer, u.list ORDER BY u.value DESC, u.author) AS rn FROM (
  SELECT c.viewer, 'engaged' AS list, a.author, count(DISTINCT a.actor) AS value FROM {disc_personal_cohort} c JOIN {recent_acts} a ON a.actor = c.other GROUP BY c.viewer, a.author UNION ALL SELECT c.viewer, 'supported', a.author, @isum(a.sats) FROM {disc_personal_cohort} c JOIN {recent_acts} a ON a.actor = c.other WHERE a.relation = 'zap' GROUP BY c.viewer, a.author
  UNION ALL SELECT c.viewer, 'followed', f.other, count(*) FROM {disc_personal_cohort} c JOIN {disc_personal_cohort} f ON f.viewer = c.other GROUP BY c.viewer, f.other
  UNION ALL SELECT c.viewer, 'rising', f.followed, count(*) FROM {disc_personal_cohort} c JOIN {contacts} f ON f.follower = c.other CROSS JOIN {present} p WHERE f.since > @unix(p.as_of) - 604800 GROUP BY c.viewer, f.followed) u
LEFT JOIN {contacts} own ON u.viewer = own.follower AND u.author = own.followed WHERE own.follower IS NULL AND u.viewer <> u.author) r WHERE rn <= 5""")
define("disc_personal_ranked", "For each viewer the three notes that its cohort bookmarks and pays most, and hashtags and clients that most of it use.", """
SELECT viewer, list, item, value, rn FROM (SELECT viewer, list, item, value, row_number() OVER (PARTITION BY viewer, list ORDER BY value DESC, item) AS rn FROM (
  SELECT c.viewer, 'zapped' AS list, @str(a.target_id) AS item, @isum(a.sats) AS value FROM {disc_personal_cohort} c JOIN {recent_acts} a ON a.actor = c.other WHERE a.relation = 'zap' GROUP BY c.viewer, a.target_id
  UNION ALL SELECT c.viewer, 'bookmarked', i.value, count(DISTINCT i.pubkey) FROM {disc_personal_cohort} c JOIN {state_items} i ON i.pubkey = c.other JOIN {state_replaceable} r ON i.event_id = r.id WHERE i.kind = 10003 AND i.name = 'e' GROUP BY c.viewer, i.value
  UNION ALL SELECT c.viewer, 'hashtag', t.tag, count(*) FROM {disc_personal_cohort} c JOIN {author_tags} t ON t.pubkey = c.other WHERE t.side = 'seed' GROUP BY c.viewer, t.tag
  UNION ALL SELECT c.viewer, 'client', k.client, count(*) FROM {disc_personal_cohort} c JOIN (SELECT DISTINCT pubkey, value AS client FROM {tags} WHERE name = 'client') k ON k.pubkey = c.other GROUP BY c.viewer, k.client) u) r WHERE rn <= 3""")
define("disc_curated", "Curated lists in their stored order, at most 30 items: follow sets by identifier, pins, and long posts of each author.", """
SELECT list, owner, item, rn FROM (SELECT concat('set ', i.d) AS list, @str(i.pubkey) AS owner, i.value AS item, row_number() OVER (PARTITION BY i.pubkey, i.d ORDER BY i.idx) AS rn FROM {state_items} i JOIN {state_replaceable} r ON i.event_id = r.id WHERE i.kind = 30000
UNION ALL SELECT 'pins', @str(pubkey), item, place FROM {state_pins} UNION ALL SELECT 'reads', author, @str(id), row_number() OVER (PARTITION BY author ORDER BY id) FROM {posts} WHERE length(text) >= 2000) u WHERE rn <= 30""")
define("sink_archive_day", "One JSON document a day: its leading hashtags with authors and, in hundredths, their ratio to the usual.", """
SELECT day, concat('{"day":"', @str(day), '","hashtags":[', @in_order(concat('{"tag":"', tag, '","authors":', @str(authors), ',"factor_x100":', coalesce(@str(CAST(floor(factor * 100) AS BIGINT)), 'null'), '}'), rn), ']}') AS document FROM {day_leaders} GROUP BY day""")
define("disc_archive", "Each day's leading hashtags, one row each, with the day's posts and authors and the ratio to the usual.", "SELECT l.day, l.tag, l.rn, l.authors, l.factor, v.posts, v.all_authors FROM {day_leaders} l JOIN (SELECT @date(ts) AS day, count(*) AS posts, count(DISTINCT author) AS all_authors FROM {posts} GROUP BY @date(ts)) v ON l.day = v.day")
define("sink_search_docs", "Search documents of the last ten days of posts for an outer index, whole words of the body up to 500 characters.", """
SELECT id, ts, CASE WHEN length(text) <= 500 THEN text ELSE regexp_replace(substring(text, 1, 500), '[^ ]*$', '') END AS body, length(text) > 500 AS trimmed FROM {posts} CROSS JOIN {post_now} WHERE ts > as_of - INTERVAL 10 DAYS""")
define("srch_documents_rank", "For all hashtags, and all profiles' names and addresses, as queries on all documents: exact key 120, alias 95, title 90, prefix of the key 80, of the title 70, words in common up to 25, and popularity.", """
SELECT q, kind, key, score, rn FROM (SELECT q, kind, key, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, kind, key) AS rn FROM (
  SELECT q.q, d.kind, d.key, round(CASE WHEN lower(d.key) = q.q THEN 120 WHEN lower(d.alias) = q.q THEN 95 WHEN lower(d.title) = q.q THEN 90 WHEN lower(d.key) LIKE concat(q.q, '%') THEN 80 WHEN lower(d.title) LIKE concat(q.q, '%') THEN 70 ELSE 0 END + 25e0 * length(q.q) / greatest(length(q.q), length(d.title), 1) + least(10, ln(1e0 + d.popularity)), 6) AS score
  FROM (SELECT tag AS q FROM {srch_term_df} UNION SELECT lower(name) FROM {attr_profile_fields} UNION SELECT ln_address FROM {attr_profile_fields}) q
  JOIN {srch_documents} d ON q.q IS NOT NULL AND (lower(d.key) LIKE concat(q.q, '%') OR lower(d.title) LIKE concat(q.q, '%') OR lower(d.alias) = q.q) GROUP BY q.q, d.kind, d.key, d.alias, d.title, d.popularity) s) r WHERE rn <= 5""", ("srch_term_df", "attr_profile_fields", "srch_documents"), _documents_rank)
define("srch_note_score", "Score of each result: 0.35 of its share of the query's terms (0.85 at least with the phrase), 0.45 of recency, halving every 72 hours, 0.2 of engagement; times 0.15 for stubs and 0.05 for automated texts.", """
SELECT s.item_id, s.id, round((35e-2 * CASE WHEN s.phrase THEN greatest(85e-2, least(1e0, s.shared / CAST(t.terms AS DOUBLE))) ELSE least(1e0, s.shared / CAST(t.terms AS DOUBLE)) END + 45e-2 * exp(-ln(2e0) * greatest(@unix(n.as_of) - @unix(p.ts), 0) / 259200e0) + 2e-1 * least(1e0, ln(1e0 + p.raw) / ln(51e0)))
  * CASE WHEN @size(@extract_all(p.text, '[^ \\n]+')) <= 3 THEN 15e-2 ELSE 1e0 END * CASE WHEN @matches(p.text, '[|][^|]*[|][^|]*[|][^|]*[|]') OR lower(p.author) LIKE '%rss feed%' THEN 5e-2 ELSE 1e0 END, 6) AS score
FROM {srch_notes} s JOIN {srch_query_terms} t ON s.item_id = t.item_id JOIN {post_engagement} p ON s.id = p.id CROSS JOIN {post_now} n""")
define("srch_note_rank", "Results in order: a copy of a text by the same author within seven days of the one before it at a fiftieth of its score; of an author's results at most two among the first 20, the others after them.", """
SELECT item_id, id, score, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN by_author <= 2 THEN 0 ELSE 1 END, score DESC, id) AS place FROM (SELECT item_id, id, score, row_number() OVER (PARTITION BY item_id, author ORDER BY score DESC, id) AS by_author FROM (
  SELECT item_id, id, author, round(score * CASE WHEN copy > 1 THEN 2e-2 ELSE 1e0 END, 6) AS score FROM (SELECT s.item_id, s.id, p.author, s.score, CASE WHEN @unix(p.ts) - lag(@unix(p.ts)) OVER (PARTITION BY s.item_id, p.author, coalesce(f.fingerprint, @str(s.id)) ORDER BY p.ts, s.id) <= 604800 THEN 2 ELSE 1 END AS copy
  FROM {srch_note_score} s JOIN {posts} p ON s.id = p.id LEFT JOIN {norm_content_fingerprint} f ON s.id = f.id) c) d) r""")
define("srch_profile_rank", "Profiles found for a query by tier, bots five tiers behind, then by followers, activity, words and posts.", """
SELECT q, pubkey, tier, score, row_number() OVER (PARTITION BY q ORDER BY tier, score DESC, pubkey) AS place FROM (SELECT s.q, s.pubkey, s.tier + CASE WHEN g.bot THEN 5 ELSE 0 END AS tier,
  round(ln(1e0 + g.followers) + 3 * CASE WHEN g.last_at IS NULL THEN 0e0 ELSE exp(-ln(2e0) * greatest(@unix(p.as_of) - g.last_at, 0) / 1209600e0) END + CASE s.tier WHEN 0 THEN 1e0 WHEN 1 THEN 65e-2 ELSE 45e-2 END + 15e-2 * ln(1e0 + g.posts), 6) AS score FROM {srch_profiles} s JOIN {srch_profile_signals} g ON s.pubkey = g.pubkey CROSS JOIN {present} p) r""")
define("srch_fresh_merge", "Each query's page, and where it has no post of the last three days its three newest matches by any of its terms, each post once.", """
SELECT item_id, id, min(fresh) AS fresh FROM (SELECT item_id, id, 0 AS fresh FROM {srch_notes} UNION ALL SELECT r.item_id, r.id, 1 FROM (
  SELECT q.item_id, i.id, row_number() OVER (PARTITION BY q.item_id ORDER BY p.ts DESC, i.id DESC) AS rn FROM (SELECT DISTINCT b.item_id, lower(e.x) AS term FROM {benchmark} b, @each_at(@extract_all(b.text, '[A-Za-z]{5,}'), e)) q JOIN {srch_index} i ON q.term = i.term JOIN {posts} p ON i.id = p.id CROSS JOIN {post_now} n WHERE p.ts > n.as_of - INTERVAL 3 DAYS GROUP BY q.item_id, i.id, p.ts) r
  LEFT JOIN (SELECT DISTINCT s.item_id FROM {srch_notes} s JOIN {posts} p ON s.id = p.id CROSS JOIN {post_now} n WHERE p.ts > n.as_of - INTERVAL 3 DAYS AND s.rn <= 5) f ON r.item_id = f.item_id WHERE r.rn <= 3 AND f.item_id IS NULL) u GROUP BY item_id, id""")
define("srch_enrich_authors", "Results with what is known of their author: posts, first and last time, leading language.", """
SELECT s.item_id, s.id, p.author, a.lang, g.posts, g.first_at, g.last_at FROM {srch_notes} s JOIN {posts} p ON s.id = p.id LEFT JOIN {auth_languages} a ON p.author = a.author AND a.rn = 1 JOIN (SELECT author, count(*) AS posts, min(ts) AS first_at, max(ts) AS last_at FROM {posts} GROUP BY author) g ON p.author = g.author""")
define("srch_trust_filter", "Profiles found for a query in three modes: all in order, the trusted lifted by ten places, the trusted only.", """
SELECT mode, q, pubkey, row_number() OVER (PARTITION BY mode, q ORDER BY place - CASE WHEN trusted AND mode = 'prefer_trusted' THEN 10 ELSE 0 END, place) AS place FROM (SELECT m.mode, r.q, r.pubkey, r.place, t.pubkey IS NOT NULL AS trusted FROM {srch_profile_rank} r LEFT JOIN {trusted_users} t ON r.pubkey = t.pubkey
  CROSS JOIN (SELECT 'all' AS mode UNION ALL SELECT 'prefer_trusted' UNION ALL SELECT 'trusted_only') m) x WHERE mode <> 'trusted_only' OR trusted""")
define("state_extended_lists", "Items of each author's newest lists of every kind: mutes, pins, relays, bookmarks, interests, message relays, sets by identifier.", "SELECT r.pubkey, r.kind, r.d, r.id, i.name, count(DISTINCT i.value) AS items, @in_order(i.value, i.idx) AS in_order FROM {state_replaceable} r JOIN {state_items} i ON r.id = i.event_id WHERE r.kind >= 10000 GROUP BY r.pubkey, r.kind, r.d, r.id, i.name")
define("ret_author_recent", "Events that each author's newest 20 of 14 days leave out, by age or by the cap.", """
SELECT e.pubkey, @count_if(e.ts <= p.as_of - INTERVAL 14 DAYS) AS by_age, @count_if(e.ts > p.as_of - INTERVAL 14 DAYS) AS by_cap FROM {ev} e CROSS JOIN {present} p LEFT JOIN {state_author_recent} r ON e.id = r.id WHERE r.id IS NULL GROUP BY e.pubkey""")
define("day_leaders", "Leading five hashtags of each day with their usual number of authors, and the ratio to it.", """
SELECT d.day, d.tag, d.authors, b.typical, round(CASE WHEN b.days >= 7 THEN d.authors / b.typical END, 6) AS factor, d.rn FROM (SELECT day, tag, authors, row_number() OVER (PARTITION BY day ORDER BY authors DESC, n DESC, tag) AS rn FROM {eco_hashtag_daily}) d LEFT JOIN {eco_entity_baseline} b ON d.tag = b.tag WHERE d.rn <= 5""")
define("post_engagement", "Engagement that stands for a post's: of the note with its number.", "SELECT p.id, p.author, p.ts, p.text, coalesce(4 * c.replies + 3 * c.reposts + c.reactions + 2 * c.zaps, 0) AS raw FROM {posts} p LEFT JOIN {cnt_event_counts} c ON p.id = c.id")
