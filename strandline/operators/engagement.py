"""Counts of interactions, and facts about them."""

from __future__ import annotations

from ..plans.template import define

for _relation, _name in (("reply", "cnt_replies"), ("reaction", "cnt_reactions")):
    define(_name, f"Distinct {_relation} contributions of each target.", f"SELECT target_id, count(DISTINCT source_id) AS n FROM {{acts}} WHERE relation = '{_relation}' GROUP BY target_id")
define("cnt_zaps", "Count and sats of payments of each note, by id or by address, each receipt once a note.", """
SELECT target_id, count(*) AS n, @isum(sats) AS sats FROM (SELECT source_id, target_id, sats FROM {acts} WHERE relation = 'zap' UNION SELECT a.source_id, d.id, a.sats FROM {address_acts} a JOIN {note_addresses} d ON a.address = d.address WHERE a.relation = 'zap') u GROUP BY target_id""")
define(
    "cnt_event_counts",
    "All counters of every note, zero where there is nothing.",
    """
SELECT n.id, coalesce(r.n, 0) AS replies, coalesce(a.n, 0) AS reactions, coalesce(p.n, 0) AS reposts, coalesce(z.n, 0) AS zaps, coalesce(z.sats, 0) AS sats
FROM {notes} n LEFT JOIN {cnt_replies} r ON n.id = r.target_id LEFT JOIN {cnt_reactions} a ON n.id = a.target_id
LEFT JOIN {cnt_reposts} p ON n.id = p.target_id LEFT JOIN {cnt_zaps} z ON n.id = z.target_id""",
)
define("fact_reactions", "Reactions with the target's author.", "SELECT source_id, target_id, actor, author, created_at FROM {acts} WHERE relation = 'reaction'")
define("fact_reposts", "Reposts with the target's author, and the text of the reply that quotes it by the same actor, if there is one.", """
SELECT a.source_id, a.target_id, a.actor, a.author, a.created_at, q.text AS quote FROM {acts} a LEFT JOIN (SELECT actor, target_id, @first_by(text, id) AS text FROM {replies} WHERE text <> '' GROUP BY actor, target_id) q ON a.actor = q.actor AND a.target_id = q.target_id WHERE a.relation = 'repost'""")
define("fact_zap_receipts", "Payments of notes: receipt, sender, receiver, target, sats.", "SELECT source_id AS receipt_id, actor AS sender, author AS receiver, target_id, sats, created_at FROM {acts} WHERE relation = 'zap'")
define(
    "norm_reaction_key",
    "Key of each reaction's content: + for likes, - for dislikes, else its first characters.",
    """
SELECT source_id, CASE WHEN content IN ('', '+') THEN '+' WHEN content = '-' THEN '-' ELSE substring(content, 1, 8) END AS reaction_key
FROM {reaction_contents} r""",
)
define(
    "fact_reaction_breakdown",
    "Reactions by target and key; keys after the first 50 that a target saw count as other.",
    """
SELECT target_id, CASE WHEN place <= 50 THEN reaction_key ELSE 'other' END AS reaction_key, count(*) AS n FROM (
  SELECT target_id, reaction_key, dense_rank() OVER (PARTITION BY target_id ORDER BY first_id, reaction_key) AS place FROM (
    SELECT a.target_id, a.source_id, k.reaction_key, min(a.source_id) OVER (PARTITION BY a.target_id, k.reaction_key) AS first_id
    FROM {acts} a JOIN {norm_reaction_key} k ON a.source_id = k.source_id) f) d
GROUP BY target_id, CASE WHEN place <= 50 THEN reaction_key ELSE 'other' END""",
)
define(
    "fact_viewer_actions",
    "What each viewer did to each note.",
    """
SELECT actor AS viewer, target_id, bool_or(relation = 'reaction') AS liked, bool_or(relation = 'reply') AS replied, bool_or(relation = 'repost') AS reposted, bool_or(relation = 'zap') AS zapped
FROM {acts} GROUP BY actor, target_id""",
)
define("fact_event_actions", "Pages of the actors on a note by kind of action, newest first: of pages of three the first two, each with the cursor that the next begins after.", """
SELECT target_id, relation, source_id, actor, rn, @div(rn - 1, 3) + 1 AS page, lag(source_id, 3) OVER (PARTITION BY target_id, relation ORDER BY rn) AS after_id FROM (SELECT a.*, row_number() OVER (PARTITION BY target_id, relation ORDER BY created_at DESC, source_id DESC) AS rn FROM {acts} a) r WHERE rn <= 6""")
define(
    "fact_top_zap",
    "The largest single payment of each note.",
    "SELECT target_id, receipt_id, sender, sats FROM (SELECT z.*, row_number() OVER (PARTITION BY target_id ORDER BY sats DESC, created_at, receipt_id) AS rn FROM {fact_zap_receipts} z) r WHERE rn = 1",
)
define("fact_user_zaps", "Payments that each user sent and received, the 20 largest and the 20 newest.", """
SELECT who, side, sort, receipt_id, sats, rn FROM (SELECT u.*, row_number() OVER (PARTITION BY who, side, sort ORDER BY CASE WHEN sort = 'sats' THEN sats ELSE created_at END DESC, receipt_id DESC) AS rn FROM (
  SELECT z.sender AS who, 'sent' AS side, s.sort, z.receipt_id, z.sats, z.created_at FROM {fact_zap_receipts} z CROSS JOIN (SELECT 'sats' AS sort UNION ALL SELECT 'time') s
  UNION ALL SELECT z.receiver, 'received', s.sort, z.receipt_id, z.sats, z.created_at FROM {fact_zap_receipts} z CROSS JOIN (SELECT 'sats' AS sort UNION ALL SELECT 'time') s) u) r WHERE rn <= 20""")
define("fact_zap_totals_profile", "Payments received by each profile.", "SELECT receiver, count(*) AS n, @isum(sats) AS sats FROM {payments} GROUP BY receiver")
define("fact_note_stats", "Counters of notes with quotes, people and the last activity; engagement of its quotes and reposts rolled up.", """
SELECT c.id, c.replies, c.reactions, c.reposts, c.zaps, c.sats, coalesce(x.people, 0) AS people, x.last_at, coalesce(q.n, 0) AS quotes, coalesce(q.engaged, 0) AS quote_engagement FROM {cnt_event_counts} c
LEFT JOIN (SELECT target_id, count(DISTINCT actor) AS people, max(created_at) AS last_at FROM {acts} GROUP BY target_id) x ON c.id = x.target_id
LEFT JOIN (SELECT q.target, count(DISTINCT q.event_id) AS n, @isum(k.replies + k.reactions + k.reposts + k.zaps) AS engaged FROM {ref_quotes} q JOIN {cnt_event_counts} k ON q.event_id = k.id WHERE q.kind = 'id' GROUP BY q.target) q ON @str(c.id) = q.target""")
define(
    "norm_zap_bucket",
    "Histogram of payments by size.",
    """
SELECT bucket, count(*) AS n, @isum(sats) AS sats FROM (SELECT sats, CASE WHEN sats < 100 THEN 'under 100' WHEN sats < 1000 THEN '100 to 999' WHEN sats < 10000 THEN '1000 to 9999'
  WHEN sats < 100000 THEN '10000 to 99999' ELSE '100000 and more' END AS bucket FROM {payments}) b GROUP BY bucket""",
)
define(
    "fact_follower_edges",
    "Followers of each profile, and how many it follows.",
    """
SELECT coalesce(a.followed, b.follower) AS profile, coalesce(a.n, 0) AS followers, coalesce(b.n, 0) AS following
FROM (SELECT followed, count(*) AS n FROM {follow} GROUP BY followed) a FULL OUTER JOIN (SELECT follower, count(*) AS n FROM {follow} GROUP BY follower) b ON a.followed = b.follower""",
)
define("fact_follower_gain_loss", "Whom each contact list of an author adds and drops against the list before it.", """
SELECT pubkey, id, created_at, @joined(CASE WHEN side = 'gained' THEN @str(followed) END) AS gained, @joined(CASE WHEN side = 'lost' THEN @str(followed) END) AS lost FROM (
  SELECT l.pubkey, l.id, l.created_at, 'gained' AS side, n.followed FROM {contact_versions} l JOIN {contact_items} n ON l.id = n.event_id LEFT JOIN {contact_items} b ON l.before_id = b.event_id AND n.followed = b.followed WHERE b.followed IS NULL
  UNION ALL SELECT l.pubkey, l.id, l.created_at, 'lost', b.followed FROM {contact_versions} l JOIN {contact_items} b ON l.before_id = b.event_id LEFT JOIN {contact_items} n ON l.id = n.event_id AND n.followed = b.followed WHERE n.followed IS NULL) c GROUP BY pubkey, id, created_at""")
# joins by the shapes that queries use
define("join_inner_equi", "Interactions with the facts of their source event.", "SELECT a.source_id, a.relation, e.kind, e.pubkey FROM {acts} a JOIN {ev} e ON a.source_id = e.id")
define("join_full_outer", "Sent and received payments of each user side by side.", """
SELECT coalesce(a.actor, b.author) AS profile, coalesce(a.n, 0) AS sent, coalesce(b.n, 0) AS received
FROM (SELECT actor, count(*) AS n FROM {acts} WHERE relation = 'zap' GROUP BY actor) a FULL OUTER JOIN (SELECT author, count(*) AS n FROM {acts} WHERE relation = 'zap' GROUP BY author) b ON a.actor = b.author""")
define("join_left_semi", "Notes with a payment.", "SELECT id, pubkey FROM {notes} n WHERE EXISTS (SELECT 1 FROM {acts} a WHERE a.target_id = n.id AND a.relation = 'zap')")
define("join_left_anti", "Notes that answer nothing.", "SELECT id, pubkey FROM {notes} n WHERE NOT EXISTS (SELECT 1 FROM {edges} e WHERE e.child = n.id)")
define("join_self_mutual", "Reciprocal follow edges, once each.", "SELECT one, two FROM (SELECT least(follower, followed) AS one, greatest(follower, followed) AS two, count(*) AS n FROM (SELECT DISTINCT follower, followed FROM {follow} WHERE follower <> followed) f GROUP BY 1, 2) p WHERE n = 2")
define("join_cross_grid", "Notes by weekday and hour over the full grid.", """
SELECT d.dow, h.hour, coalesce(n.n, 0) AS n FROM (SELECT @grid(0, 6) AS dow) d CROSS JOIN (SELECT @grid(0, 23) AS hour) h
LEFT JOIN (SELECT @dow(ts) AS dow, hour(ts) AS hour, count(*) AS n FROM {notes} GROUP BY 1, 2) n ON n.dow = d.dow AND n.hour = h.hour""")
define("join_scalar_cross", "Totals of the network in one row.", """
SELECT a.notes, b.acts, c.authors FROM (SELECT count(*) AS notes FROM {notes}) a CROSS JOIN (SELECT count(*) AS acts FROM {acts}) b CROSS JOIN (SELECT count(DISTINCT pubkey) AS authors FROM {ev}) c""")
define("join_temporal_cursor", "Interactions newer than the actor's own last note, which is the row of the greatest time and, of those, of the greatest id.", """
SELECT a.author, count(*) AS unseen FROM {acts} a LEFT JOIN (SELECT pubkey, max(created_at) AS seen_at, -@first_by(-id, -created_at) AS seen_id FROM {notes} GROUP BY pubkey) c ON a.author = c.pubkey
WHERE c.pubkey IS NULL OR a.created_at > c.seen_at OR (a.created_at = c.seen_at AND a.source_id > c.seen_id) GROUP BY a.author""")
define("join_or_union", "Interactions matched by id or by author's newest note, each once.", """
SELECT target_id, count(*) AS n FROM (
  SELECT a.source_id, a.target_id FROM {acts} a JOIN {notes} n ON a.target_id = n.id
  UNION SELECT a.source_id, m.id FROM {acts} a JOIN (SELECT pubkey, max(id) AS id FROM {notes} GROUP BY pubkey) m ON a.author = m.pubkey) u GROUP BY target_id""")
define("join_gate_open_if_empty", "Interactions of trusted actors, of all if nobody is trusted.", """
SELECT a.source_id, a.actor FROM {acts} a CROSS JOIN (SELECT count(*) AS n FROM {trusted_users}) g LEFT JOIN {trusted_users} t ON a.actor = t.pubkey WHERE g.n = 0 OR t.pubkey IS NOT NULL""")
define("trusted_users", "Users within the hops of trust, large accounts included.", "SELECT pubkey, hops FROM {trust_hops}")
define("join_lateral_topk", "For each tag its newest 200 posts, each with the number of the tag's other posts by the same author.", """
SELECT a.tag, a.id, b.n - 1 AS others FROM (SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY tag ORDER BY ts DESC, id DESC) AS rn FROM {hashtags} h) r WHERE rn <= 200) a JOIN (SELECT tag, author, count(*) AS n FROM {hashtags} GROUP BY tag, author) b ON a.tag = b.tag AND a.author = b.author""")
define("cnt_reposts", "Distinct reposts of each note: by id, and by an address that stands for the author's note of that identifier where the same repost doesn't name the note already.", """
SELECT target_id, count(DISTINCT source_id) AS n FROM (SELECT source_id, target_id FROM {acts} WHERE relation = 'repost' UNION SELECT a.source_id, d.id FROM {address_acts} a JOIN {note_addresses} d ON a.address = d.address WHERE a.relation = 'repost') u GROUP BY target_id""")
define("note_addresses", "The current note of each address that notes carry: address, id.", "SELECT value AS address, event_id AS id FROM (SELECT t.*, row_number() OVER (PARTITION BY value ORDER BY created_at DESC, event_id DESC) AS rn FROM {tags} t WHERE name = 'a') r WHERE rn = 1", kept=True)
define("join_left_enrich", "Notes with their counters, attributes and first hashtag, zero or null where there is none.", """
SELECT n.id, n.pubkey, coalesce(r.n, 0) AS replies, coalesce(z.sats, 0) AS sats, coalesce(a.warned, false) AS warned, a.client, h.topic FROM {notes} n LEFT JOIN {cnt_replies} r ON n.id = r.target_id LEFT JOIN {cnt_zaps} z ON n.id = z.target_id
LEFT JOIN {attr_event_attributes} a ON n.id = a.event_id LEFT JOIN (SELECT event_id, min(tag) AS topic FROM {norm_tag_hashtags} GROUP BY event_id) h ON n.id = h.event_id""")
define("fact_report_counts", "Reports by day and type, of notes and of their authors' profiles: reports, reporters, and the share by trusted ones.", """
SELECT @date(a.ts) AS day, r.type, count(*) AS n, count(DISTINCT a.actor) AS reporters, count(DISTINCT r.author) AS profiles, count(DISTINCT r.target_id) AS notes, @count_if(t.pubkey IS NOT NULL) AS by_trusted FROM {ref_reports} r JOIN {acts} a ON r.source_id = a.source_id LEFT JOIN {trusted_users} t ON a.actor = t.pubkey GROUP BY @date(a.ts), r.type""")
define("fact_profile_reports", "Reports of each profile by type, with its first and last time.", "SELECT r.author, r.type, count(*) AS n, count(DISTINCT a.actor) AS reporters, min(a.created_at) AS first_at, max(a.created_at) AS last_at FROM {ref_reports} r JOIN {acts} a ON r.source_id = a.source_id GROUP BY r.author, r.type")
define("contact_versions", "Contact lists with the one before: id, pubkey, created_at, before_id.", "SELECT id, pubkey, created_at, lag(id) OVER (PARTITION BY pubkey ORDER BY created_at, id) AS before_id FROM {states} WHERE kind = 3")
define("contact_items", "Distinct followed of each contact list.", "SELECT DISTINCT event_id, @num(value) AS followed FROM {state_items} WHERE kind = 3 AND name = 'p'")
define("fact_profile_edges", "Followers of each user in newest contact lists, how many it follows, and how many trusted followers it has.", """
SELECT coalesce(a.followed, b.follower) AS pubkey, coalesce(a.n, 0) AS followers, coalesce(b.n, 0) AS following, coalesce(a.trusted, 0) AS trusted_followers
FROM (SELECT c.followed, count(*) AS n, count(t.pubkey) AS trusted FROM {contacts} c LEFT JOIN {trusted_users} t ON c.follower = t.pubkey GROUP BY c.followed) a FULL OUTER JOIN (SELECT follower, count(*) AS n FROM {contacts} GROUP BY follower) b ON a.followed = b.follower""")
define("join_self_pair", "Pairs of relays that carried the same event.", "SELECT a.relay AS one, b.relay AS two, count(*) AS n FROM {ingest_provenance} a JOIN {ingest_provenance} b ON a.event_id = b.event_id AND b.relay > a.relay GROUP BY a.relay, b.relay")
