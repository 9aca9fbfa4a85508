"""State, search, notifications, moderation and retention."""

from __future__ import annotations

from ..plans.template import define

define("ingest_dedup", "Each event once, with its first sighting.", "SELECT event_id, min(seen_at) AS first_seen_at, count(*) AS sightings FROM {sightings} GROUP BY event_id")
define("ingest_kind_census", "Events by day, kind and author, and the kinds that are only counted.", "SELECT @date(ts) AS day, kind, pubkey, count(*) AS n, kind IN (7, 1984) AS count_only FROM {ev} GROUP BY @date(ts), kind, pubkey")
define("ingest_recipient_budget", "At most three acts an hour on one author, first come.", """
SELECT source_id, author, rn FROM (SELECT source_id, author, row_number() OVER (PARTITION BY author, @trunc('hour', ts) ORDER BY created_at, source_id) AS rn FROM {acts}) r WHERE rn <= 3""")
define("ingest_gate", "Admission of each interaction, by the first rule that holds: its actor blocked, expired, bridged, actor trusted, its target known, target's author trusted; closed while nobody is trusted, else shadowed; and what the open mode would say.", """
SELECT source_id, decision, CASE WHEN decision IN ('closed', 'shadow') THEN 'accepted' ELSE decision END AS open_decision FROM (SELECT e.id AS source_id, CASE WHEN b.pubkey IS NOT NULL THEN 'blocked' WHEN x.expires_at <= @unix(p.as_of) THEN 'expired' WHEN x.protocol IS NOT NULL THEN 'bridged' WHEN g.n_trusted = 0 THEN 'closed' WHEN t.pubkey IS NOT NULL THEN 'trusted author'
  WHEN n.id IS NOT NULL THEN 'existing target' WHEN r.pubkey IS NOT NULL THEN 'trusted recipient' ELSE 'shadow' END AS decision
FROM {ev} e CROSS JOIN {present} p CROSS JOIN (SELECT count(*) AS n_trusted FROM {trusted_users}) g LEFT JOIN {blocked} b ON e.pubkey = b.pubkey LEFT JOIN {attr_event_attributes} x ON e.id = x.event_id LEFT JOIN {trusted_users} t ON e.pubkey = t.pubkey
LEFT JOIN {notes} n ON e.target = n.id AND e.id <> e.target LEFT JOIN (SELECT e2.id, e2.pubkey FROM {ev} e2) o ON e.target = o.id LEFT JOIN {trusted_users} r ON o.pubkey = r.pubkey) d""")
define("ingest_blocked_authors", "Interactions of authors that are not blocked.", "SELECT a.source_id, a.actor FROM {acts} a LEFT JOIN {blocked} b ON a.actor = b.pubkey WHERE b.pubkey IS NULL")
define("ingest_checkpoint_progress", "Per source: newest event and its time, rows, whether it is behind the others, and where to resume, ten minutes earlier.", """
SELECT s.relay, s.last_at, s.last_event, s.n, CASE WHEN s.last_at < m.as_of - INTERVAL 2 DAYS THEN 'behind' ELSE 'live' END AS status, @unix(s.last_at) - 600 AS resume_since FROM (SELECT relay, max(seen_at) AS last_at, max_by(event_id, @unix(seen_at) * 100000000 + event_id) AS last_event, count(*) AS n FROM {sightings} GROUP BY relay) s CROSS JOIN (SELECT max(seen_at) AS as_of FROM {sightings}) m""")
define("ingest_backfill_range", "Events of two kinds in a bounded range.", "SELECT id, kind, created_at FROM {ev} WHERE kind IN (1, 7) AND ts >= @time(2024-01-10 00:00:00) AND ts < @time(2024-01-17 00:00:00)")
define("qa_freshness", "Rows and newest time of each table, whether that is a week behind the newest of its kind, and its rows that no projection covers.", """
SELECT 'events' AS source, count(*) AS n, max(e.ts) AS newest, max(e.ts) < max(p.as_of) - INTERVAL 7 DAYS AS stale, @count_if(a.source_id IS NULL AND e.kind <> 1) AS uncovered FROM {ev} e CROSS JOIN {present} p LEFT JOIN {acts} a ON e.id = a.source_id
UNION ALL SELECT 'orders', count(*), max(o.o_orderdate), max(o.o_orderdate) < max(m.as_of) - INTERVAL 7 DAYS, @count_if(s.event_id IS NULL) FROM {orders} o CROSS JOIN (SELECT max(seen_at) AS as_of FROM {sightings}) m LEFT JOIN (SELECT DISTINCT event_id FROM {sightings}) s ON o.o_orderkey = s.event_id
UNION ALL SELECT 'profiles', count(*), max(f.updated_at), max(f.updated_at) < max(p.as_of) - INTERVAL 7 DAYS, @count_if(x.pubkey IS NULL) FROM {profiles} f CROSS JOIN {present} p LEFT JOIN {state_profiles_latest} x ON f.pubkey = x.pubkey AND f.doc = x.doc""")
define("src_by_ids", "Events for a table of ids, null where missing.", "SELECT w.id AS wanted, e.id, e.kind FROM (SELECT DISTINCT k * 37 AS id FROM {ev}) w LEFT JOIN {ev} e ON w.id = e.id")
define("state_replaceable", "Newest event of each replaceable kind and author, and of each addressable kind, author and identifier; ties by larger id.", """
SELECT pubkey, kind, d, id, created_at FROM (SELECT s.*, row_number() OVER (PARTITION BY pubkey, kind, d ORDER BY created_at DESC, id DESC) AS rn FROM {states} s WHERE kind IN (0, 3) OR (kind >= 10000 AND kind < 20000) OR (kind >= 30000 AND kind < 40000)) r WHERE rn = 1""")
define("state_superseded", "Replaceable and addressable events that a newer one displaced, and that one.", """
SELECT pubkey, kind, d, id, created_at, rn, by_id FROM (SELECT s.*, row_number() OVER (PARTITION BY pubkey, kind, d ORDER BY created_at DESC, id DESC) AS rn, lag(id) OVER (PARTITION BY pubkey, kind, d ORDER BY created_at DESC, id DESC) AS by_id
  FROM {states} s WHERE kind IN (0, 3) OR (kind >= 10000 AND kind < 20000) OR (kind >= 30000 AND kind < 40000)) r WHERE rn > 1""")
define("state_author_recent", "The newest 20 events of each author of at most 14 days.", """
SELECT pubkey, id, rn FROM (SELECT e.pubkey, e.id, row_number() OVER (PARTITION BY e.pubkey ORDER BY e.created_at DESC, e.id DESC) AS rn FROM {ev} e CROSS JOIN {present} a WHERE e.ts > a.as_of - INTERVAL 14 DAYS) r WHERE rn <= 20""")
define("state_contact_lists", "Newest contact list of each author: the distinct users that it follows.", "SELECT r.pubkey, r.id, r.created_at, count(c.followed) AS n, @joined(@str(c.followed)) AS followed FROM {state_replaceable} r LEFT JOIN {contact_items} c ON r.id = c.event_id WHERE r.kind = 3 GROUP BY r.pubkey, r.id, r.created_at")
define("state_deletions", "Ledger of deletions and their targets: the target's author, kind and time if it is known, and whether the deletion applies, that is by the same author.", """
SELECT s.id AS deletion_id, i.value AS target, @num(CASE WHEN i.name = 'e' THEN i.value END) AS target_id, e.pubkey AS target_author, e.kind AS target_kind, e.created_at AS target_at, coalesce(e.pubkey = s.pubkey, split_part(i.value, ':', 2) = @str(s.pubkey) AND i.name = 'a', false) AS applies
FROM {states} s JOIN {state_items} i ON s.id = i.event_id LEFT JOIN {ev} e ON i.name = 'e' AND i.value = @str(e.id) WHERE s.kind = 5""")
define("state_bookmarks", "Distinct users whose newest bookmark list names a note, by id or by an address that stands for its author's current article.", """
SELECT id, count(DISTINCT pubkey) AS users, count(DISTINCT CASE WHEN by_ = 'address' THEN pubkey END) AS by_address FROM (SELECT @num(i.value) AS id, i.pubkey, 'id' AS by_ FROM {state_items} i JOIN {state_replaceable} r ON i.event_id = r.id WHERE i.kind = 10003 AND i.name = 'e'
UNION ALL SELECT a.id, i.pubkey, 'address' FROM {state_items} i JOIN {state_replaceable} r ON i.event_id = r.id JOIN {state_replaceable} a ON i.value = concat(@str(a.kind), ':', @str(a.pubkey), ':', a.d) WHERE i.kind = 10003 AND i.name = 'a') b GROUP BY id""")
define("attr_content_shape", "Words, mentions, hashtags, characters and reading seconds of each post.", """
SELECT id, words, mentions, hashtags, chars, @div(words * 60, 200) AS reading_s FROM (SELECT id, @size(@extract_all(text, '[^ \\n\\t]+')) AS words, @size(@extract_all(text, '@[A-Za-z0-9_]+')) AS mentions, @size(@extract_all(text, '#[A-Za-z0-9_]+')) AS hashtags, length(text) AS chars FROM {posts}) s""")
define("norm_urls", "The first 20 distinct links of each page: without marks at their end, fragment and default port, with their domain.", """
SELECT id, url, lower(regexp_extract(url, '^https?://(?:www[.])?([^/?#:]+)', 1)) AS domain, pos FROM (SELECT id, url, pos, row_number() OVER (PARTITION BY id ORDER BY pos, url) AS rn FROM (SELECT id, url, min(pos) AS pos FROM (
  SELECT page_id AS id, e.pos, regexp_replace(regexp_replace(regexp_replace(regexp_replace(e.x, '#.*$', ''), '[])}.,;:!?]+$', ''), '^(http://[^/:?]+):80(/|$)', concat(chr(92), '1', chr(92), '2')), '^(https://[^/:?]+):443(/|$)', concat(chr(92), '1', chr(92), '2')) AS url
  FROM {pages}, @each_at(@extract_all(concat(coalesce(url, ''), ' ', coalesce(html, '')), 'https?://[^ <>"]+'), e)) u WHERE length(url) > 10 GROUP BY id, url) g) r WHERE rn <= 20""")
define("norm_domain", "Pages by canonical domain: a host of valid labels without www, and one name for a product's several hosts.", """
SELECT CASE WHEN domain IN ('youtu.be', 'm.youtube.com', 'music.youtube.com') THEN 'youtube.com' WHEN domain IN ('twitter.com', 'mobile.twitter.com', 'm.twitter.com') THEN 'x.com' ELSE domain END AS domain, count(DISTINCT id) AS pages FROM (SELECT id, regexp_replace(regexp_replace(domain, '[.]$', ''), '^www[.]', '') AS domain FROM {links}) l
WHERE length(domain) <= 253 AND @matches(domain, '^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?([.][a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)*$') GROUP BY 1""")
define("norm_hashtags", "Hashtags of each note, sorted.", "SELECT event_id AS id, count(*) AS n, @joined(tag) AS tags FROM {norm_tag_hashtags} GROUP BY event_id")
define("norm_content_fingerprint", "Fingerprint of each post that has 40 characters or more without links and mentions, in lower case, with one space between words.", """
SELECT id, @sha256(plain) AS fingerprint FROM (SELECT id, trim(@replace_all(lower(@replace_all(@replace_all(text, '(?i)https?://[^ \\n\\r\\t]+', ' '), '(?i)nostr:(?:npub|nprofile|note|nevent)1[a-z0-9]+', ' ')), '[ \\n\\r\\t]+', ' ')) AS plain FROM {posts}) p WHERE length(plain) >= 40""")
define("lang_chart_label", "Languages for charts, with a bucket for none.", "SELECT CASE WHEN lang IS NULL OR lang = '' THEN 'und' ELSE lang END AS label, count(*) AS n FROM {posts} GROUP BY 1")
define("note_preview_class", "Class of each post, and the first 80 characters of its first line with words for a list.", """
SELECT id, CASE WHEN trim(text) = '' THEN 'empty' WHEN @matches(trim(text), '^[{]') OR @matches(text, '(^|\\n)[A-Z_]{3,}=') THEN 'config' WHEN @size(@extract_all(text, 'https?://')) >= 3 THEN 'links' WHEN @size(@extract_all(text, '[0-9a-f]{32,}')) >= 1 THEN 'identifiers' WHEN @size(@extract_all(text, '[|]')) >= 20 THEN 'table' ELSE 'text' END AS class,
  substring(trim(split_part(trim(text), chr(10), 1)), 1, 80) AS preview, length(trim(split_part(trim(text), chr(10), 1))) > 80 AS cut FROM {posts}""")
# search
define("srch_documents", "Documents for search: posts, pages, profiles, identities, hashtags, relays; title, body's length, identity words, freshness, popularity.", """
SELECT 'post' AS kind, @str(p.id) AS key, trim(split_part(trim(p.text), chr(10), 1)) AS title, length(p.text) AS size, @no_text() AS alias, p.ts AS fresh_at, 0 AS popularity FROM {posts} p UNION ALL SELECT 'page', @str(page_id), url, length(coalesce(html, '')), lower(regexp_extract(url, '^https?://([^/]+)', 1)), @no_time(), 0 FROM {pages}
UNION ALL SELECT 'profile', @str(f.pubkey), f.name, length(f.name), f.ln_address, x.updated_at, coalesce(e.followers, 0) FROM {attr_profile_fields} f JOIN {state_profiles_latest} x ON f.pubkey = x.pubkey LEFT JOIN {fact_profile_edges} e ON f.pubkey = e.pubkey
UNION ALL SELECT 'identity', concat(platform, ':', identity), identity, length(identity), platform, @no_time(), count(*) FROM {attr_external_identities} GROUP BY platform, identity
UNION ALL SELECT 'hashtag', tag, tag, length(tag), concat('#', tag), max(ts), count(DISTINCT id) FROM {hashtags} GROUP BY tag UNION ALL SELECT 'relay', @str(relay), concat('relay ', @str(relay)), 0, @no_text(), max(seen_at), count(DISTINCT event_id) FROM {sightings} GROUP BY relay""")
define("srch_index", "Postings: word, post, occurrences; words of five letters or more.", "SELECT lower(e.x) AS term, p.id, count(*) AS n FROM {posts} p, @each_at(@extract_all(p.text, '[A-Za-z]{5,}'), e) GROUP BY lower(e.x), p.id")
define("srch_term_df", "Posts of each hashtag.", "SELECT tag, count(DISTINCT id) AS df FROM {hashtags} GROUP BY tag")
define("srch_notes", "For the benchmark items as queries the twenty posts of the last 30 days that share most distinct words with them, with whether they hold all of a query's first five words in one run.", """
SELECT s.item_id, s.id, s.shared, s.rn, position(q.phrase IN lower(p.text)) > 0 AS phrase FROM (SELECT item_id, id, shared, rn FROM (SELECT item_id, id, shared, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, id) AS rn FROM (
  SELECT q.item_id, i.id, count(*) AS shared FROM (SELECT DISTINCT b.item_id, lower(e.x) AS term FROM {benchmark} b, @each_at(@extract_all(b.text, '[A-Za-z]{5,}'), e)) q JOIN {srch_index} i ON q.term = i.term
  JOIN (SELECT p.id FROM {posts} p CROSS JOIN {post_now} n WHERE p.ts > n.as_of - INTERVAL 30 DAYS) w ON i.id = w.id GROUP BY q.item_id, i.id) g) r WHERE rn <= 20) s
JOIN {posts} p ON s.id = p.id JOIN (SELECT item_id, lower(regexp_extract(text, '^([^ ]+ [^ ]+ [^ ]+ [^ ]+ [^ ]+)', 1)) AS phrase FROM {benchmark}) q ON s.item_id = q.item_id""")
define("srch_query_terms", "Terms of each query: distinct words in lower case with their folded form, phrases of the words in capitals that follow each other, and its length.", """
SELECT item_id, @size(@extract_all(text, '[A-Za-z]+')) AS words, count(DISTINCT lower(e.x)) AS terms, @size(@extract_all(text, '[A-Z][a-z]+( [A-Z][a-z]+)+')) AS phrases, @sha256(trim(@replace_all(lower(text), '[^a-z0-9]+', ' '))) AS folded FROM {benchmark} b, @each_at(@extract_all(b.text, '[A-Za-z]+'), e) GROUP BY item_id, text""")
define("srch_suggest", "For each first three letters the three leading hashtags and profiles.", """
SELECT list, prefix, item, weight, rn FROM (SELECT list, prefix, item, weight, row_number() OVER (PARTITION BY list, prefix ORDER BY weight DESC, item) AS rn FROM (SELECT 'hashtag' AS list, substring(tag, 1, 3) AS prefix, tag AS item, df AS weight FROM {srch_term_df} WHERE length(tag) >= 3
UNION ALL SELECT 'profile', lower(substring(regexp_replace(f.name, '^[^#]*#0*', ''), 1, 3)), f.name, coalesce(e.followers, 0) FROM {attr_profile_fields} f LEFT JOIN {fact_profile_edges} e ON f.pubkey = e.pubkey) u) r WHERE rn <= 3""")
define("srch_correction", "For terms of five letters or more that fewer than ten posts have, the most frequent term within one edit (two from eight letters on) that at least 100 posts have, and eight times as many.", """
SELECT tag, better, df, distance FROM (SELECT c.tag, c.better, c.df, c.distance, row_number() OVER (PARTITION BY c.tag ORDER BY c.df DESC, c.distance, c.better) AS rn FROM (
  SELECT DISTINCT a.tag, b.tag AS better, b.df, levenshtein(a.tag, b.tag) AS distance FROM (SELECT tag, df, rest FROM {term_deletes} WHERE length(tag) >= 5 AND df < 10) a JOIN (SELECT tag, df, rest FROM {term_deletes} WHERE df >= 100) b ON a.rest = b.rest WHERE b.df >= 8 * a.df AND a.tag <> b.tag) c WHERE c.distance <= 1 OR (c.distance = 2 AND length(c.tag) >= 8)) r WHERE rn = 1""")
define("srch_profile_signals", "Followers, posts, engagement, last activity, trust and whether a bot, for ranking profiles.", """
SELECT f.pubkey, coalesce(e.followers, 0) AS followers, coalesce(p.posts, 0) AS posts, coalesce(p.engaged, 0) AS engaged, p.last_at, f.bot OR lower(concat(f.name, ' ', coalesce(f.display_name, ''))) LIKE '%rss feed%' AS bot, t.hops FROM {attr_profile_fields} f
LEFT JOIN {fact_profile_edges} e ON f.pubkey = e.pubkey LEFT JOIN {disc_profile_stats} p ON f.pubkey = p.pubkey LEFT JOIN {trusted_users} t ON f.pubkey = t.pubkey""")
# messages, notifications, moderation
define("dm_contacts", "Peers of each user by the last message either way, with what was sent and received.", """
SELECT who, peer, @isum(sent) AS sent, @isum(received) AS received, max(created_at) AS last_at FROM (SELECT sender AS who, receiver AS peer, 1 AS sent, 0 AS received, created_at FROM {direct_messages} UNION ALL SELECT receiver, sender, 0, 1, created_at FROM {direct_messages}) u GROUP BY who, peer""")
define("dm_messages", "Pages of four turns of each conversation, newest first, in a range of turns, with the cursor after which the next begins.", """
SELECT root, id, turn, rn, @div(rn - 1, 4) + 1 AS page, lag(id, 4) OVER (PARTITION BY root ORDER BY rn) AS after_id FROM (SELECT root, id, turn, row_number() OVER (PARTITION BY root ORDER BY turn DESC, id DESC) AS rn FROM {chat} WHERE turn >= 0 AND turn < 1000000) r""")
define("dm_unread", "Unread turns of each receiver and conversation after its cursor, its own last turn, those deleted left out; and the latest.", """
SELECT c.root, r.receiver, count(*) AS unread, max(c.turn) AS latest FROM {chat} c JOIN (SELECT DISTINCT root, author AS receiver FROM {chat}) r ON c.root = r.root AND c.author <> r.receiver LEFT JOIN (SELECT root, author, max(turn) AS seen FROM {chat} GROUP BY root, author) s ON r.root = s.root AND r.receiver = s.author
LEFT JOIN (SELECT DISTINCT target_id FROM {state_deletions} WHERE target_id IS NOT NULL) d ON c.id = d.target_id WHERE d.target_id IS NULL AND (s.seen IS NULL OR c.turn > s.seen) GROUP BY c.root, r.receiver""")
define("ntf_rows", "Notifications: recipient, type (1 payment, 2 reply, 3 repost, 4 like, 5 report, 6 follow, 7 mention, 8 quote, 9 comment), source and actor, of others' acts.", """
SELECT author AS recipient, CASE relation WHEN 'zap' THEN 1 WHEN 'reply' THEN 2 WHEN 'repost' THEN 3 WHEN 'reaction' THEN 4 ELSE 5 END AS type, source_id, actor, created_at FROM {acts} WHERE actor <> author
UNION ALL SELECT c.followed, 6, r.id, c.follower, c.since FROM {contacts} c JOIN {state_replaceable} r ON c.follower = r.pubkey AND r.kind = 3 WHERE c.follower <> c.followed UNION ALL SELECT @num(value), 7, event_id, pubkey, created_at FROM {tags} WHERE name = 'p' AND value <> @str(pubkey)
UNION ALL SELECT n.pubkey, 8, q.event_id, m.pubkey, m.created_at FROM {ref_quotes} q JOIN {notes} n ON q.target = @str(n.id) JOIN {notes} m ON q.event_id = m.id WHERE q.kind = 'id' AND n.pubkey <> m.pubkey
UNION ALL SELECT n.pubkey, 9, c.event_id, m.pubkey, m.created_at FROM {ref_comments} c JOIN {notes} n ON c.root = @str(n.id) JOIN {notes} m ON c.event_id = m.id WHERE c.root_by = 'id' AND n.pubkey <> m.pubkey""")
define("ntf_page", "The newest ten notifications of each recipient and the ten after that cursor, each source once a type.", """
SELECT recipient, type, source_id, rn, CASE WHEN rn <= 10 THEN 1 ELSE 2 END AS page FROM (SELECT recipient, type, source_id, row_number() OVER (PARTITION BY recipient ORDER BY created_at DESC, source_id DESC, type) AS rn FROM (SELECT recipient, type, source_id, max(created_at) AS created_at FROM {ntf_rows} GROUP BY recipient, type, source_id) n) r WHERE rn <= 20""")
define("ntf_counts", "Notifications by type since the recipient's last note.", "SELECT n.recipient, n.type, count(*) AS n FROM {ntf_rows} n LEFT JOIN (SELECT pubkey, max(created_at) AS seen FROM {notes} GROUP BY pubkey) s ON n.recipient = s.pubkey WHERE s.seen IS NULL OR n.created_at > s.seen GROUP BY n.recipient, n.type")
define("mod_mute_edges", "Who mutes whom in the newest mute list, and how many mute that user in all.", """
SELECT m.muter, m.muted, c.n AS muted_by FROM (SELECT DISTINCT i.pubkey AS muter, @num(i.value) AS muted FROM {state_items} i JOIN {state_replaceable} r ON i.event_id = r.id WHERE i.kind = 10000 AND i.name = 'p') m
JOIN (SELECT i.value, count(DISTINCT i.pubkey) AS n FROM {state_items} i JOIN {state_replaceable} r ON i.event_id = r.id WHERE i.kind = 10000 AND i.name = 'p' GROUP BY i.value) c ON @str(m.muted) = c.value""")
define("mod_hidden", "Replies that a mute list of the target's author hides: by author, by event, by a word of their text.", """
SELECT r.id, r.author AS viewer, max(CASE WHEN i.name = 'p' THEN 1 ELSE 0 END) = 1 AS by_author, max(CASE WHEN i.name = 'e' THEN 1 ELSE 0 END) = 1 AS by_event, max(CASE WHEN i.name = 'word' THEN 1 ELSE 0 END) = 1 AS by_word FROM {replies} r JOIN {state_replaceable} s ON s.pubkey = r.author AND s.kind = 10000
JOIN {state_items} i ON i.event_id = s.id AND ((i.name = 'p' AND i.value = @str(r.actor)) OR (i.name = 'e' AND i.value = @str(r.target_id)) OR (i.name = 'word' AND position(lower(i.value) IN lower(r.text)) > 0)) GROUP BY r.id, r.author""")
define("mod_lists", "Items of each author's newest moderation lists: mutes by kind, and follow sets by identifier.", "SELECT i.pubkey, i.kind, i.d, i.name, count(DISTINCT i.value) AS n, @joined(i.value) AS items FROM {state_items} i JOIN {state_replaceable} r ON i.event_id = r.id WHERE i.kind IN (10000, 30000) GROUP BY i.pubkey, i.kind, i.d, i.name")
define("soc_followers_page", "Pages of ten followers of each user, newest first, the first two, with whether the follow is mutual.", """
SELECT f.followed, f.follower, f.rn, CASE WHEN f.rn <= 10 THEN 1 ELSE 2 END AS page, b.follower IS NOT NULL AS mutual FROM (SELECT followed, follower, row_number() OVER (PARTITION BY followed ORDER BY since DESC, follower) AS rn FROM {contacts}) f LEFT JOIN {contacts} b ON f.followed = b.follower AND f.follower = b.followed WHERE f.rn <= 20""")
define("soc_mentions", "Notes that mention a user by a p tag, and addresses that a tags name, with their kind.", """
SELECT @num(value) AS mentioned, event_id, pubkey, 'p' AS by_, CAST(1 AS BIGINT) AS kind FROM {tags} WHERE name = 'p' AND value <> @str(pubkey) UNION ALL SELECT @num(split_part(value, ':', 2)), event_id, pubkey, 'a', @num(split_part(value, ':', 1)) FROM {tags} WHERE name IN ('a', 'A')""")
define("soc_kind_lists", "The newest three articles, notes with images, notes with videos, live chats and reports of each author.", """
SELECT pubkey, list, id, rn FROM (SELECT u.*, row_number() OVER (PARTITION BY pubkey, list ORDER BY created_at DESC, id DESC) AS rn FROM (SELECT pubkey, 'articles' AS list, id, created_at FROM {states} WHERE kind = 30023
UNION ALL SELECT pubkey, CASE WHEN lower(value) LIKE 'video/%' THEN 'videos' ELSE 'images' END, event_id, created_at FROM {tags} WHERE name = 'm' UNION ALL SELECT pubkey, 'live', event_id, created_at FROM {tags} WHERE name = 'a' UNION ALL SELECT pubkey, 'reports', id, created_at FROM {ev} WHERE kind = 1984) u) r WHERE rn <= 3""")
# retention
define("ret_engagement_age", "Interactions that stay: of at most 14 days, and payments; with the lifetime counts that the others leave behind.", """
SELECT a.target_id, a.relation, @count_if(a.relation = 'zap' OR a.ts > t.as_of - INTERVAL 14 DAYS) AS kept, count(*) AS lifetime, @isum(a.sats) AS lifetime_sats FROM {acts} a CROSS JOIN {present} t GROUP BY a.target_id, a.relation""")
define("ret_superseded", "Displaced events of a week or more, which go, with the one that displaced them.", "SELECT s.id, s.kind, s.by_id FROM {state_superseded} s CROSS JOIN {present} a WHERE s.created_at < @unix(a.as_of) - 604800")
define("ret_untrusted", "Notes that stay: of trusted authors, replies to them, those paid for; all while nobody is trusted.", """
SELECT n.id, CASE WHEN g.n_trusted = 0 THEN 'open' WHEN t.pubkey IS NOT NULL THEN 'author' WHEN u.pubkey IS NOT NULL THEN 'reply' ELSE 'paid' END AS reason FROM {notes} n CROSS JOIN (SELECT count(*) AS n_trusted FROM {trusted_users}) g LEFT JOIN {trusted_users} t ON n.pubkey = t.pubkey LEFT JOIN {thr_edges} e ON n.id = e.child LEFT JOIN {notes} p ON e.parent = p.id
LEFT JOIN {trusted_users} u ON p.pubkey = u.pubkey LEFT JOIN {cnt_zaps} z ON n.id = z.target_id WHERE g.n_trusted = 0 OR t.pubkey IS NOT NULL OR u.pubkey IS NOT NULL OR z.target_id IS NOT NULL""")
define("ret_provenance", "First sightings, and others of the last two years.", "SELECT p.event_id, p.relay FROM {ingest_provenance} p CROSS JOIN (SELECT max(seen_at) AS t FROM {sightings}) m WHERE p.is_first_seen OR p.seen_at > m.t - INTERVAL 730 DAYS")
define("ret_search_docs", "Search documents that go: of authors beyond trust that are older than 20 days and without popularity, and of posts of no words.", """
SELECT d.kind, d.key, CASE WHEN d.size = 0 THEN 'empty' ELSE 'old' END AS reason FROM {srch_documents} d CROSS JOIN {post_now} p WHERE d.kind IN ('post', 'hashtag') AND (d.size = 0 OR (d.fresh_at < p.as_of - INTERVAL 20 DAYS AND d.popularity <= 2))""")
# trust
define("trust_interaction_edges", "Weights between actors and authors: reaction 1, repost 2, reply 1.5, payment by its logarithm.", """
SELECT actor AS src, author AS dst, round(sum(CASE relation WHEN 'reaction' THEN 1.0 WHEN 'repost' THEN 2.0 WHEN 'reply' THEN 1.5 WHEN 'zap' THEN ln(1 + sats) ELSE 0 END), 6) AS weight FROM {acts} WHERE actor <> author AND relation <> 'report' GROUP BY actor, author""")
define("trust_summary", "Score, rank, percentile of all, hop and tier of the 100 most trusted.", """
SELECT t.pubkey, t.score, t.rank, round(1 - (t.rank - 1) / CAST(c.n AS DOUBLE), 6) AS percentile, h.hops, CASE WHEN h.hops <= 1 THEN 'high' WHEN h.hops = 2 THEN 'medium' WHEN t.rank <= 50 THEN 'low' ELSE 'none' END AS tier FROM {trust_top} t LEFT JOIN {trust_hops} h ON t.pubkey = h.pubkey CROSS JOIN (SELECT count(*) AS n FROM {trust_scores}) c""")
define("trust_qualify", "Whether each user is known, qualified (two hops, or the upper half by followers) and trusted (one hop), with hop and tier.", """
SELECT e.pubkey, t.pubkey IS NOT NULL AS known, coalesce(t.hops <= 2, false) OR coalesce(f.trusted_followers, 0) >= 5 AS qualified, coalesce(t.hops <= 1, false) AS trusted, coalesce(@str(t.hops), 'none') AS hop, CASE WHEN t.hops <= 1 THEN 'high' WHEN t.hops = 2 THEN 'medium' WHEN coalesce(f.trusted_followers, 0) >= 5 THEN 'low' ELSE 'none' END AS tier
FROM (SELECT DISTINCT pubkey FROM {ev}) e LEFT JOIN {trusted_users} t ON e.pubkey = t.pubkey LEFT JOIN {fact_profile_edges} f ON e.pubkey = f.pubkey""")
define("trust_trusted_followers", "Followers of each user within the hops of trust, and all; all count while the untrusted have a weight.", """
SELECT c.followed, count(*) AS followers, count(t.pubkey) AS trusted, round(sum(CASE WHEN t.pubkey IS NOT NULL THEN 1e0 ELSE s.untrusted END), 6) AS weighted FROM {contacts} c CROSS JOIN {settings} s LEFT JOIN {trusted_users} t ON c.follower = t.pubkey GROUP BY c.followed""")
define("trust_seeds", "Seeds in one form: those of the configuration are active; those of the last run that it doesn't list are not.", """
SELECT coalesce(n.pubkey, b.pubkey) AS pubkey, n.pubkey IS NOT NULL AS active, CASE WHEN n.pubkey IS NULL THEN CASE WHEN b.active THEN 'deactivated' ELSE 'kept' END WHEN b.pubkey IS NULL THEN 'added' WHEN b.active THEN 'kept' ELSE 'activated' END AS step
FROM (SELECT DISTINCT @num(trim(pubkey)) AS pubkey FROM {seed_config} WHERE @matches(trim(pubkey), '^[0-9]+$')) n FULL OUTER JOIN {seed_before} b ON n.pubkey = b.pubkey""")
define("trust_frontier", "The 100 users to fetch next: half by trust, the others the most followed; a user of both is fetched as a large account.", """
SELECT pubkey, min(list) AS list FROM (SELECT pubkey, 'trust' AS list FROM {trust_top} WHERE rank <= 50 UNION ALL SELECT pubkey, 'large' FROM (SELECT pubkey, row_number() OVER (ORDER BY trusted_followers DESC, pubkey) AS rn FROM (SELECT pubkey, trusted_followers FROM {fact_profile_edges} ORDER BY trusted_followers DESC, pubkey LIMIT 50) f) l) u GROUP BY pubkey""")
define("trust_crawl_frontier", "The 50 users to read lists of next: within the hops, without a newest contact list, nearest first.", """
SELECT pubkey, hops, rn FROM (SELECT t.pubkey, t.hops, row_number() OVER (ORDER BY t.hops, t.pubkey) AS rn FROM (SELECT h.pubkey, h.hops FROM {trust_hops} h LEFT JOIN (SELECT pubkey FROM {state_contact_lists} WHERE n >= 4) d ON h.pubkey = d.pubkey WHERE d.pubkey IS NULL ORDER BY h.hops, h.pubkey LIMIT 50) t) r""")
define("term_deletes", "Terms of four characters or more without one and, from eight on, without two of their characters, wherever they stand, and themselves: what terms within as many edits share.", """
SELECT DISTINCT tag, df, rest FROM (SELECT tag, df, tag AS rest FROM {search_terms} WHERE length(tag) >= 4
UNION ALL SELECT tag, df, concat(substring(tag, 1, one - 1), substring(tag, one + 1)) FROM (SELECT tag, df, @grid(1, length(tag)) AS one FROM {search_terms} WHERE length(tag) >= 4) o
UNION ALL SELECT tag, df, concat(substring(tag, 1, one - 1), substring(tag, one + 1, two - one - 1), substring(tag, two + 1)) FROM (SELECT tag, df, one, @grid(one + 1, length(tag)) AS two FROM (SELECT tag, df, @grid(1, length(tag) - 1) AS one FROM {search_terms} WHERE length(tag) >= 8) f) t) d""")

