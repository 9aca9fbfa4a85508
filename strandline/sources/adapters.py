"""Frames of the social-event model, derived from the driver's tables. Production frames of the same columns take their place."""

from __future__ import annotations

from ..operators import hashtags as words_of_posts
from ..plans.template import define, define_computed

define("present", "The fixed present: the newest event's time.", "SELECT max(ts) AS as_of FROM {events}")
define(
    "ev",
    "Canonical events: id, pubkey, created_at, ts, kind, k, target, sats.",
    """
SELECT event_id AS id, user_id AS pubkey, @unix(ts) AS created_at, ts, k, greatest(event_id - 1 - (k % 20), 0) AS target,
  CASE WHEN event_type = 'signup' THEN 0 WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' AND k % 5 = 0 THEN 6
       WHEN event_type = 'click' THEN 7 WHEN event_type = 'purchase' THEN 9735 ELSE 1984 END AS kind,
  CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 100) AS BIGINT) ELSE 0 END AS sats
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events}) e""",
)
define("notes", "Notes: events of kind 1.", "SELECT id, pubkey, created_at, ts, k, target FROM {ev} WHERE kind = 1")
define(
    "acts",
    "Interactions whose target is a note: source_id, target_id, relation, actor, author, created_at, ts, sats.",
    """
SELECT e.id AS source_id, n.id AS target_id,
  CASE e.kind WHEN 1 THEN 'reply' WHEN 6 THEN 'repost' WHEN 7 THEN 'reaction' WHEN 9735 THEN 'zap' ELSE 'report' END AS relation,
  e.pubkey AS actor, n.pubkey AS author, e.created_at, e.ts, e.sats, e.k
FROM {ev} e JOIN {notes} n ON e.target = n.id WHERE e.kind IN (1, 6, 7, 9735, 1984) AND e.id <> n.id""",
    kept=True,
)
define(
    "follow",
    "Follow edges: follower, followed.",
    """
SELECT DISTINCT follower, followed FROM (
  SELECT concat('c', @str(o.o_custkey)) AS follower, concat('s', @str(l.l_suppkey)) AS followed FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
  UNION ALL
  SELECT concat('s', @str(l.l_suppkey)), concat('c', @str(o.o_custkey)) FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey WHERE l.l_returnflag = 'R') x""",
)
define(
    "payments",
    "Payment receipts: id, sender, receiver, sats, ts.",
    """
SELECT l.l_orderkey * 10 + l.l_linenumber AS id, concat('c', @str(o.o_custkey)) AS sender, concat('s', @str(l.l_suppkey)) AS receiver,
  CAST(floor(l.l_extendedprice) AS BIGINT) AS sats, l.l_shipdate AS ts
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
)
define(
    "sightings",
    "Sightings of events at relays: event_id, relay, seen_at.",
    "SELECT l_orderkey AS event_id, l_suppkey % 12 AS relay, @minutes_after(l_shipdate, l_linenumber) AS seen_at FROM {lineitem}",
)
define(
    "posts",
    "Notes with text: id, author, ts, lang, text.",
    "SELECT doc_id AS id, source AS author, @hours_before(@time(2024-01-31 00:00:00), doc_id % 720) AS ts, lang, coalesce(text, '') AS text FROM {documents}",
)
define("post_now", "The fixed present of posts.", "SELECT max(ts) AS as_of FROM {posts}")
define(
    "hashtags",
    "The first five distinct words of four letters or more of a post that two posts have: id, author, ts, lang, tag.",
    """
SELECT id, author, ts, lang, tag FROM (
  SELECT w.*, row_number() OVER (PARTITION BY w.id ORDER BY w.pos, w.tag) AS rn FROM {post_words} w JOIN (SELECT tag FROM {post_words} GROUP BY tag HAVING count(*) >= 2) t ON w.tag = t.tag) r WHERE rn <= 5""",
    ("posts", "tag_counts"),
    lambda posts, tag_counts: words_of_posts.hashtags(posts, tag_counts),
)
define(
    "links",
    "Links of pages: id, author (host), ts, url, domain.",
    """
SELECT id, author, ts, url, lower(regexp_extract(url, '^https?://(?:www[.])?([^/?#:]+)', 1)) AS domain FROM (
  SELECT page_id AS id, lower(regexp_extract(url, '^https?://(?:www[.])?([^/?#:]+)', 1)) AS author,
    @hours_before(@time(2024-01-31 00:00:00), page_id % 720) AS ts, regexp_replace(e.x, '#.*$', '') AS url
  FROM {pages}, @each_at(@extract_all(concat(coalesce(url, ''), ' ', coalesce(html, '')), 'https?://[A-Za-z0-9./?&=_%~-]+'), e)) u""",
)
define(
    "chat",
    "Threads of conversations: id, parent, root, author, turn, text.",
    """
SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent, conv_id * 1000 AS root,
  concat(role, @str(conv_id)) AS author, turn, coalesce(text, '') AS text FROM {conversations}""",
)
define(
    "probes",
    "Probe observations of relays: relay, ok, latency_ms, ts.",
    "SELECT o_custkey % 12 AS relay, o_orderstatus <> 'F' AS ok, CAST(floor(o_totalprice) AS BIGINT) % 3000 AS latency_ms, o_orderdate AS ts FROM {orders}",
)
define("edges", "Thread edges of notes: child, parent, child_at, author.", "SELECT c.id AS child, p.id AS parent, c.ts AS child_at, c.pubkey AS author FROM {notes} c JOIN {notes} p ON c.target = p.id WHERE c.id <> p.id")
define("windows", "Windows of rankings, in days.", "SELECT 1 AS days UNION ALL SELECT 7 UNION ALL SELECT 30")
define(
    "tags",
    "Tags of notes, one row each: event_id, pubkey, created_at, ts, k, idx, name, value, hint (third value), marker (fourth). A tag's place in its event is idx.",
    """
SELECT * FROM (SELECT e.id AS event_id, e.pubkey, e.created_at, e.ts, e.k, g.idx,
  CASE WHEN g.idx <= 1 THEN 'e' WHEN g.idx = 2 AND e.k % 2 = 0 THEN 'e' WHEN g.idx = 3 THEN 'p' WHEN g.idx = 4 AND e.k % 5 = 0 THEN 'q' WHEN g.idx = 5 THEN 't' WHEN g.idx = 6 AND e.k % 4 > 0 THEN 'client'
    WHEN g.idx = 7 AND e.k % 13 = 0 THEN 'expiration' WHEN g.idx = 8 AND e.k % 4 = 0 THEN 'a' WHEN g.idx = 9 AND e.k % 17 = 0 THEN 'content-warning' WHEN g.idx = 10 AND e.k % 3 = 0 THEN 'emoji' WHEN g.idx = 11 THEN 'l'
    WHEN g.idx = 12 AND e.k % 12 = 1 THEN 'E' WHEN g.idx = 12 AND e.k % 12 = 7 THEN 'A' WHEN g.idx = 13 AND e.k % 10 = 3 THEN 'proxy' WHEN g.idx = 14 AND e.k % 8 = 5 THEN 'nonce' WHEN g.idx = 15 AND e.k % 6 = 1 THEN 'k'
    WHEN g.idx = 16 AND e.k % 14 = 2 THEN 'subject' WHEN g.idx = 17 AND e.k % 15 = 4 THEN 'alt' WHEN g.idx = 18 AND e.k % 16 = 6 THEN 'published_at' WHEN g.idx IN (19, 20) AND e.k % 11 = 0 THEN 'zap' WHEN g.idx = 21 AND e.k % 3 < 2 THEN 'L'
    WHEN g.idx IN (22, 23, 24) AND e.k % 7 = 0 THEN 'i' WHEN g.idx = 25 AND e.k % 9 = 0 THEN 'url' WHEN g.idx = 26 AND e.k % 9 = 0 THEN 'm' WHEN g.idx = 27 AND e.k % 9 = 0 THEN 'size' WHEN g.idx = 28 AND e.k % 9 = 0 THEN 'x'
    WHEN g.idx = 29 AND e.k % 21 = 0 THEN 'lang' WHEN g.idx = 30 THEN 't' END AS name,
  CASE g.idx WHEN 0 THEN @str(e.target) WHEN 1 THEN @str(greatest(e.target - e.k % 7, 0)) WHEN 2 THEN @str(greatest(e.target - e.k % 11, 0)) WHEN 3 THEN @str((e.pubkey * 7 + e.k) % 150)
    WHEN 4 THEN CASE WHEN e.k % 10 = 0 THEN concat('30023:', @str(e.pubkey), ':post') ELSE @str(e.target) END WHEN 5 THEN concat('#Tag', @str(e.k % 9)) WHEN 6 THEN concat('App ', @str(e.k % 8))
    WHEN 7 THEN @str(e.created_at + e.k * 3600) WHEN 8 THEN concat('30023:', @str(e.pubkey), ':d', @str(e.k % 5)) WHEN 9 THEN 'reason' WHEN 10 THEN concat(':name', @str(e.k % 12), ':')
    WHEN 11 THEN CASE WHEN e.k % 3 = 2 THEN CASE WHEN e.k % 2 = 0 THEN 'de' ELSE 'EN ' END ELSE concat('label', @str(e.k % 6)) END
    WHEN 12 THEN CASE WHEN e.k % 12 = 1 THEN @str(greatest(e.target - e.k % 5, 0)) ELSE concat('30023:', @str(e.k % 40), ':d', @str(e.k % 3)) END WHEN 13 THEN concat('https://bridge.example/', @str(e.id)) WHEN 14 THEN @str(e.k * 17)
    WHEN 15 THEN CASE WHEN e.k % 12 = 1 THEN '1' ELSE '30023' END WHEN 16 THEN concat(' Subject ', @str(e.k % 4)) WHEN 17 THEN 'a picture' WHEN 18 THEN @str(e.created_at - 86400) WHEN 21 THEN 'ugc'
    WHEN 22 THEN concat('GitHub:user', @str(e.pubkey % 30)) WHEN 23 THEN concat('mastodon:m.example/@u', @str(e.pubkey % 50)) WHEN 24 THEN concat('github:other', @str(e.k)) WHEN 25 THEN concat('https://files.example/', @str(e.k % 23), '.jpg')
    WHEN 26 THEN CASE WHEN e.k % 2 = 0 THEN 'image/jpeg' ELSE 'Video/MP4' END WHEN 27 THEN CASE WHEN e.k % 4 = 0 THEN 'unknown' ELSE @str(e.k * 1000) END WHEN 28 THEN @sha256(@str(e.k % 23)) WHEN 29 THEN 'fr'
    WHEN 30 THEN CASE e.k % 4 WHEN 0 THEN concat('tag', @str(e.k % 9)) WHEN 1 THEN '2024' WHEN 2 THEN 'two words' ELSE concat('##TAG', @str(e.k % 5)) END ELSE @str((e.pubkey + g.idx) % 150) END AS value,
  CASE WHEN g.idx = 11 THEN CASE WHEN e.k % 3 = 2 THEN 'ISO-639-1' ELSE '' END WHEN g.idx = 13 THEN CASE e.k % 3 WHEN 0 THEN 'activitypub' WHEN 1 THEN 'rss' ELSE 'web' END WHEN g.idx = 14 THEN @str(e.k % 12)
    WHEN g.idx IN (0, 1, 2, 3) THEN CASE e.k % 16 WHEN 3 THEN 'ws://localhost:7000' WHEN 5 THEN 'wss://192.168.1.9/' WHEN 7 THEN 'https://relay.example.com' WHEN 9 THEN concat('wss://relay', @str(e.k % 3), '.example.com/inbox/') ELSE concat('WSS://Relay', @str(e.k % 12), '.Example.com:443/') END ELSE '' END AS hint,
  CASE WHEN g.idx = 0 THEN CASE e.k % 4 WHEN 0 THEN 'ROOT' WHEN 2 THEN 'reply' ELSE '' END WHEN g.idx = 1 THEN CASE e.k % 3 WHEN 0 THEN 'reply' WHEN 2 THEN 'mention' ELSE '' END ELSE '' END AS marker
  FROM {ev} e CROSS JOIN (SELECT @grid(0, 30) AS idx) g WHERE e.kind = 1) t WHERE name IS NOT NULL""",
)
define(
    "profiles",
    "Profile documents of customers: pubkey, doc (JSON), updated_at.",
    """
SELECT c_custkey AS pubkey, concat('{"name": "', c_name, '", "display_name": "', CASE WHEN c_custkey % 9 = 0 THEN 'RSS Feed' ELSE '' END, '", "nip05": "', lower(c_mktsegment), '@Example', @str(c_nationkey), '.com", "lud16": "User', @str(c_custkey % 700), '@Pay', @str(c_custkey % 7), '.Example", "website": "https://www.site', @str(c_custkey % 40), '.org/x", "bot": ', CASE WHEN c_custkey % 20 = 0 THEN 'true' ELSE 'false' END, '}') AS doc,
  @seconds_before(@time(2024-01-31 00:00:00), c_custkey * 977) AS updated_at
FROM {customer} UNION ALL SELECT c_custkey, concat('{"name": "old ', c_name, '", "nip05": "", "website": ""}'), @seconds_before(@time(2024-01-31 00:00:00), c_custkey * 977 + 86400) FROM {customer} WHERE c_custkey % 3 = 0""",
)
define("relay_lists", "Relays that each customer lists: pubkey, relay.", "SELECT DISTINCT o.o_custkey AS pubkey, s.relay FROM {sightings} s JOIN {orders} o ON s.event_id = o.o_orderkey WHERE o.o_orderpriority LIKE '1%' OR o.o_orderpriority LIKE '2%'")
define(
    "settings",
    "Parameters of a run, one row: hops of trust, floor of trusted followers of a large account, weight of the untrusted, days of new followers, size of an author's list.",
    "SELECT 2 AS max_hops, 12 AS large_floor, 1e-1 AS untrusted, 7 AS new_days, 20 AS recent_cap, 5e-1 AS cohort_share",
)
define(
    "states",
    "Replaceable and addressable events and deletions of users: id, pubkey, created_at, ts, kind, d, n (number of items).",
    """
SELECT id, pubkey, created_at, ts, kind, CASE WHEN kind >= 30000 THEN concat('d', @str(id % 3)) ELSE '' END AS d, id % 9 AS n FROM (
  SELECT id, pubkey, created_at, ts, CASE k % 13 WHEN 0 THEN 0 WHEN 1 THEN 10000 WHEN 2 THEN 10001 WHEN 3 THEN 10002 WHEN 4 THEN 10003 WHEN 5 THEN 10015 WHEN 6 THEN 10050 WHEN 7 THEN 30023 WHEN 8 THEN 30315 WHEN 9 THEN 30000 WHEN 10 THEN 5 ELSE 3 END AS kind
  FROM {ev} WHERE kind IN (0, 6, 7, 1984)) e""",
)
define(
    "state_items",
    "Items of those events' lists, one row a tag: event_id, pubkey, kind, d, created_at, idx, name, value, third.",
    """
SELECT s.id AS event_id, s.pubkey, s.kind, s.d, s.created_at, g.idx,
  CASE WHEN s.kind IN (3, 30000) THEN 'p' WHEN s.kind = 10000 THEN CASE g.idx % 3 WHEN 0 THEN 'p' WHEN 1 THEN 'word' ELSE 'e' END WHEN s.kind = 10002 THEN 'r' WHEN s.kind = 10015 THEN 't' WHEN s.kind = 10050 THEN 'relay'
    WHEN s.kind IN (10003, 5) AND g.idx % 4 = 3 THEN 'a' ELSE 'e' END AS name,
  CASE WHEN s.kind IN (3, 30000) THEN @str((s.pubkey * 7 + g.idx * 13 + s.id % 2) % 150 + 1) WHEN s.kind = 10000 THEN CASE g.idx % 3 WHEN 0 THEN @str((s.pubkey * 3 + g.idx) % 150 + 1) WHEN 1 THEN concat('point ', @str(s.id % 6)) ELSE @str(s.id - g.idx) END
    WHEN s.kind = 10002 THEN CASE WHEN g.idx = 4 THEN 'not a relay' ELSE concat('wss://relay', @str((s.pubkey + g.idx * g.idx) % 12), '.example.com/') END WHEN s.kind = 10015 THEN concat('Tag', @str((s.pubkey + g.idx) % 9)) WHEN s.kind = 10050 THEN concat('wss://relay', @str((s.pubkey + g.idx) % 12), '.example.com')
    WHEN s.kind IN (10003, 5) AND g.idx % 4 = 3 THEN concat('30023:', @str(s.pubkey), ':d', @str(s.id % 3)) WHEN s.kind = 5 THEN @str(s.id - g.idx * 2 - 1) ELSE @str(greatest(s.id - g.idx * 5, 1)) END AS value,
  CASE WHEN s.kind = 10002 THEN CASE g.idx % 3 WHEN 0 THEN '' WHEN 1 THEN 'read' ELSE 'write' END ELSE '' END AS third
FROM {states} s CROSS JOIN (SELECT @grid(0, 8) AS idx) g WHERE g.idx < s.n""",
)
define(
    "receipts",
    "Payment receipts with what their tags hold: source_id, receipt_key, target_id, author, created_at, amount, description, invoice, p_tag.",
    """
SELECT source_id, actor AS receipt_key, target_id, author, created_at, CASE k % 4 WHEN 0 THEN @str(sats * 1000 + k % 1000) WHEN 1 THEN '-5' ELSE '' END AS amount,
  CASE k % 5 WHEN 0 THEN concat('{"pubkey": "', @str(actor), '", "tags": [["p", "1"], ["amount", "', @str(sats * 1000 + 500), '"]]}') WHEN 1 THEN '{"pubkey": "nobody", "tags": []}' WHEN 2 THEN 'no json' ELSE '' END AS description,
  concat(CASE k % 3 WHEN 0 THEN 'lnbc' WHEN 1 THEN 'LNTB' ELSE 'lnbcrt' END, CASE WHEN k % 17 = 3 THEN '' ELSE @str(k * 2345 + 1) END, CASE source_id % 5 WHEN 0 THEN 'm' WHEN 1 THEN 'u' WHEN 2 THEN 'n' WHEN 3 THEN 'p' ELSE '' END, '1pdata') AS invoice,
  CASE WHEN k % 3 = 1 THEN @str(actor + 1) ELSE '' END AS p_tag FROM {acts} WHERE relation = 'zap'""",
)
define(
    "replies",
    "Replies with text: id, target_id, author (the target's), actor, created_at, text.",
    """
SELECT e.id, e.target - e.target % 25 AS target_id, (e.target - e.target % 25) % 150 + 1 AS author, e.pubkey AS actor, e.created_at,
  CASE e.k % 12 WHEN 0 THEN 'GM!' WHEN 1 THEN 'Good morning, friend' WHEN 2 THEN 'nice one here' WHEN 3 THEN 'nice one there' WHEN 4 THEN 'great catch' WHEN 5 THEN 'great catchh' WHEN 6 THEN concat('I do not think that point ', @str(e.k), ' of the note holds for long')
    WHEN 7 THEN 'the same long sentence that several people copied into their answers' WHEN 8 THEN 'https://files.example/a.png' WHEN 9 THEN 'gm now is coffee time in the whole wide world of ours' WHEN 10 THEN concat('thanks ', @str(e.k % 7)) ELSE '' END AS text
FROM {ev} e WHERE e.kind IN (1, 7)""",
)
define("blocked", "Authors that the operators block: pubkey.", "SELECT c_custkey AS pubkey FROM {customer} WHERE c_acctbal < -700")
define("seed_config", "Seeds as the configuration lists them: pubkey, as text.", "SELECT concat(' ', @str(c_custkey), ' ') AS pubkey FROM {customer} WHERE c_custkey <= 150 AND c_acctbal > 9200 UNION ALL SELECT @str(c_custkey) FROM {customer} WHERE c_custkey <= 12 UNION ALL SELECT ''")
define("seed_before", "Seeds of the last run: pubkey, active.", "SELECT c_custkey AS pubkey, c_custkey % 2 = 0 AS active FROM {customer} WHERE c_custkey <= 30")
define(
    "post_words",
    "Distinct words of four letters or more of posts, in lower case, with their first place: id, author, ts, lang, tag, pos.",
    "SELECT p.id, p.author, p.ts, p.lang, lower(e.x) AS tag, min(e.pos) AS pos FROM {posts} p, @each_at(@extract_all(p.text, '[A-Za-z]{4,}'), e) GROUP BY p.id, p.author, p.ts, p.lang, lower(e.x)",
)
define("domain_author_daily", "Which authors link a domain on which day: domain, author, day. Some domains rise, some fade.", """
SELECT DISTINCT concat('site', @str(CASE WHEN k % 5 = 3 AND day_ago > 7 THEN 9 WHEN k % 5 = 4 AND day_ago <= 7 THEN 9 ELSE k % 5 END), '.org') AS domain, author, day FROM (SELECT e.k, e.pubkey AS author, @date(e.ts) AS day, @days(@date(p.as_of), @date(e.ts)) AS day_ago FROM {ev} e CROSS JOIN {present} p WHERE e.kind IN (1, 7)) x""")
define("search_terms", "Terms for spelling: hashtags and frequent words with their posts, and misspelt forms of frequent words, a letter short, that a few posts have: tag, df.", """
SELECT tag, max(df) AS df FROM (SELECT tag, df FROM {srch_term_df} UNION ALL SELECT tag, df FROM {frequent_words} UNION ALL SELECT concat(substring(tag, 1, 2), substring(tag, 4)), 1 + length(tag) % 5 FROM {frequent_words} WHERE length(tag) >= 6) t GROUP BY tag""")
define("frequent_words", "Words of posts that a fiftieth of them have, and a hundred at least: tag, df.", "SELECT w.tag, count(*) AS df FROM {post_words} w CROSS JOIN (SELECT count(*) AS n FROM {posts}) p GROUP BY w.tag, p.n HAVING count(*) >= 100 AND count(*) * 50 >= p.n", ("posts", "tag_counts"), lambda posts, tag_counts: words_of_posts.frequent(posts, tag_counts))
define_computed("tag_counts", "Posts of each word, and the post of a word that only one has: tag, df, id.", ("posts",), lambda posts: words_of_posts.tag_counts(posts), "SELECT tag, count(*) AS df, min(id) AS id FROM post_words GROUP BY tag")
define("address_acts", "Reposts and payments that name an address: source_id, relation, address, sats.", "SELECT source_id, relation, concat('30023:', @str(author), ':d', @str(k % 5)) AS address, sats FROM {acts} WHERE relation IN ('repost', 'zap') AND k % 3 = 0")
define("report_types", "Types of reports, as their tags say: source_id, type.", "SELECT source_id, CASE k % 4 WHEN 0 THEN 'spam' WHEN 1 THEN 'nudity' WHEN 2 THEN 'impersonation' ELSE 'other' END AS type FROM {acts} WHERE relation = 'report'")
define("post_parents", "Posts that answer another: id, parent.", "SELECT id, id - 1 AS parent FROM {posts} WHERE id % 10 > 0")
define("relay_documents", "What relays say of themselves: relay, software, version, features.", "SELECT DISTINCT relay, concat('soft', @str(relay % 3)) AS software, concat('1.', @str(relay % 4)) AS version, relay % 5 AS features FROM {sightings}")
define("relay_states", "States of relays before their next: relay, before.", "SELECT DISTINCT relay, CASE WHEN relay % 3 = 0 THEN 'admitted' ELSE 'candidate' END AS before FROM {sightings}")
define("tracked_accounts", "Accounts that are tracked whatever they do: pubkey.", "SELECT DISTINCT pubkey FROM {ev} WHERE pubkey % 20 = 0")
define("polls", "Polls and when they end, three days after their note: poll, ends_at.", "SELECT id AS poll, created_at + 259200 AS ends_at FROM {notes}")
define("poll_votes", "Votes: poll, source_id, actor, option_, created_at.", "SELECT target_id AS poll, source_id, actor, k % 4 AS option_, created_at FROM {acts} WHERE relation = 'reaction'")
define("badge_awards", "Awards of badges: badge, actor, created_at.", "SELECT target_id % 20 AS badge, actor, created_at FROM {acts} WHERE relation = 'repost'")
define("badge_acceptances", "Badges that their holders accepted, by a note after the award: badge, actor.", "SELECT DISTINCT b.badge, b.actor FROM {badge_awards} b JOIN {notes} n ON b.actor = n.pubkey AND n.created_at > b.created_at")
define("goals", "Goals of notes in sats: id, goal.", "SELECT id, 1000 * (1 + k % 5) AS goal FROM {notes} WHERE k % 4 = 0")
define("group_messages", "Messages in groups: grp, id, pubkey, created_at.", "SELECT pubkey % 12 AS grp, id, pubkey, created_at FROM {notes}")
define("token_payments", "Token payments: source_id, receiver, sats, unit, mint.", "SELECT source_id, author AS receiver, sats, CASE WHEN k % 2 = 0 THEN 'sat' ELSE 'msat' END AS unit, concat('mint', @str(k % 5)) AS mint FROM {acts} WHERE relation = 'zap'")
define("ln_queries", "Payment addresses that are looked up, in any case: address.", "SELECT DISTINCT concat('USER', @str(c_custkey), '@pay', @str(c_custkey % 7), '.EXAMPLE') AS address FROM {customer}")
define("direct_messages", "Messages between two users: sender, receiver, created_at.", "SELECT actor AS sender, author AS receiver, created_at FROM {acts} WHERE actor <> author")
define("profile_lookups", "Queries for profiles by name, and by the number in a name: q, token.", "SELECT DISTINCT lower(name) AS q, regexp_extract(lower(name), '([a-z0-9]+)$', 1) AS token FROM {attr_profile_fields} WHERE pubkey % 50 = 0 UNION SELECT DISTINCT regexp_extract(name, '([0-9]+)$', 1), regexp_extract(name, '([0-9]+)$', 1) FROM {attr_profile_fields} WHERE pubkey % 50 = 0")
define("reaction_contents", "Contents of reactions: source_id, content.", "SELECT source_id, CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN '+' WHEN 2 THEN '-' ELSE concat(':emoji_', @str(k % 60), ':') END AS content FROM {acts} WHERE relation = 'reaction'")
