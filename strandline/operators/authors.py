"""Analytics of all authors at once."""

from __future__ import annotations

from ..plans.template import define

define("auth_activity_daily", "Per author and day: notes, replies, engagement given and received (own left out).", """
SELECT coalesce(a.pubkey, b.pubkey) AS pubkey, coalesce(a.day, b.day) AS day, coalesce(a.notes, 0) AS notes, coalesce(a.replies, 0) AS replies, coalesce(b.given, 0) AS given, coalesce(b.received, 0) AS received
FROM (SELECT n.pubkey, @date(n.ts) AS day, count(*) AS notes, count(e.child) AS replies FROM {notes} n LEFT JOIN {edges} e ON n.id = e.child GROUP BY n.pubkey, @date(n.ts)) a
FULL OUTER JOIN (SELECT pubkey, day, @isum(given) AS given, @isum(received) AS received FROM (
  SELECT actor AS pubkey, @date(ts) AS day, 1 AS given, 0 AS received FROM {acts} WHERE actor <> author
  UNION ALL SELECT author, @date(ts), 0, 1 FROM {acts} WHERE actor <> author) u GROUP BY pubkey, day) b ON a.pubkey = b.pubkey AND a.day = b.day""")
for _days in (7, 30):
    define(f"auth_engagement_{_days}d", f"Sums, active days and cadence over {_days} days.", f"""
SELECT pubkey, @isum(notes) AS notes, @isum(given) AS given, @isum(received) AS received, @count_if(notes > 0) AS active_days, round(sum(notes) / {_days}e0, 6) AS per_day
FROM {{auth_activity_daily}} d CROSS JOIN {{present}} a WHERE @days(@date(a.as_of), d.day) < {_days} GROUP BY pubkey""")
define("auth_topics_window", "Hashtags of each author over 14 days, with days of use.", """
SELECT author, tag, count(*) AS n, count(DISTINCT @date(h.ts)) AS days FROM {hashtags} h CROSS JOIN {post_now} p WHERE h.ts > p.as_of - INTERVAL 14 DAYS GROUP BY author, tag""")
define("auth_media_mix", "Notes of each author with an image, a video, another attachment, or text only, by their media tags.", """
SELECT n.pubkey, count(*) AS notes, @count_if(m.kind = 'image') AS images, @count_if(m.kind = 'video') AS videos, @count_if(m.kind = 'other') AS others, @count_if(m.kind IS NULL) AS text_only FROM {notes} n
LEFT JOIN (SELECT event_id, CASE WHEN max(CASE WHEN lower(value) LIKE 'video/%' THEN 2 WHEN lower(value) LIKE 'image/%' THEN 1 ELSE 0 END) = 2 THEN 'video' WHEN max(CASE WHEN lower(value) LIKE 'image/%' THEN 1 ELSE 0 END) = 1 THEN 'image' ELSE 'other' END AS kind FROM {tags} WHERE name = 'm' GROUP BY event_id) m ON n.id = m.event_id GROUP BY n.pubkey""")
define("auth_timing", "Engagement received by weekday and hour.", "SELECT author, @dow(ts) AS dow, hour(ts) AS hour, count(*) AS n FROM {acts} WHERE actor <> author GROUP BY 1, 2, 3")
define("auth_posting_pattern", "Own notes by weekday and hour.", "SELECT pubkey, @dow(ts) AS dow, hour(ts) AS hour, count(*) AS n FROM {notes} GROUP BY 1, 2, 3")
define("auth_hourly", "Hours in which an author wrote two notes or more.", "SELECT pubkey, @trunc('hour', ts) AS hour, count(*) AS n FROM {notes} GROUP BY 1, 2 HAVING count(*) >= 2")
define("auth_summary", "Windows side by side, with reposts and quotes made in 30 days.", """
SELECT w.pubkey, coalesce(s.notes, 0) AS notes_7d, w.notes AS notes_30d, q.notes AS notes_90d, coalesce(s.received, 0) AS received_7d, w.received AS received_30d, q.received AS received_90d, coalesce(r.n, 0) AS reposts_30d, coalesce(u.n, 0) AS quotes_30d FROM {auth_engagement_30d} w
LEFT JOIN {auth_engagement_7d} s ON w.pubkey = s.pubkey LEFT JOIN {auth_engagement_90d} q ON w.pubkey = q.pubkey LEFT JOIN (SELECT a.actor, count(*) AS n FROM {acts} a CROSS JOIN {present} p WHERE a.relation = 'repost' AND a.created_at > @unix(p.as_of) - 2592000 GROUP BY a.actor) r ON w.pubkey = r.actor
LEFT JOIN (SELECT n.pubkey, count(*) AS n FROM {ref_quotes} q JOIN {notes} n ON q.event_id = n.id CROSS JOIN {present} p WHERE n.created_at > @unix(p.as_of) - 2592000 GROUP BY n.pubkey) u ON w.pubkey = u.pubkey""")
define("auth_weighted_notes", "Weighted engagement of each note: 3 replies, 2 reposts, 1 reaction, 2 payments, and sats over 100.", """
SELECT n.id, n.pubkey, n.ts, round(3 * c.replies + 2 * c.reposts + c.reactions + 2 * c.zaps + c.sats / 100e0, 6) AS value FROM {cnt_event_counts} c JOIN {notes} n ON c.id = n.id""")
define("auth_top_notes", "The three notes of each author with most weighted engagement.", "SELECT pubkey, id, value, rn FROM (SELECT w.*, row_number() OVER (PARTITION BY pubkey ORDER BY value DESC, id DESC) AS rn FROM {auth_weighted_notes} w) r WHERE rn <= 3")
define("auth_two_windows", "Weighted engagement of each author's notes of the last 14 days and of the 14 before, and the mean a note.", """
SELECT pubkey, round(sum(CASE WHEN d < 14 THEN value ELSE 0 END), 4) AS now, round(sum(CASE WHEN d >= 14 AND d < 28 THEN value ELSE 0 END), 4) AS before, round(avg(CASE WHEN d < 14 THEN value END), 6) AS per_note
FROM (SELECT w.pubkey, w.value, @days(@date(a.as_of), @date(w.ts)) AS d FROM {auth_weighted_notes} w CROSS JOIN {present} a) x GROUP BY pubkey""")
define("auth_levels", "Percentile of each value of engagement among all authors: 100 less the share, of the others, that have more. Values are counted once, within bands of their logarithm, of which there are a thousand at most.", """
SELECT v.now, round(100e0 - CASE WHEN t.n > 1 THEN 100e0 * (b.more + v.more) / (t.n - 1) ELSE 0 END, 6) AS level FROM (SELECT now, band, coalesce(sum(n) OVER (PARTITION BY band ORDER BY now DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS more FROM (
  SELECT now, count(*) AS n, CAST(floor(least(1000, 50 * ln(1 + now))) AS INT) AS band FROM {auth_two_windows} GROUP BY now) c) v
JOIN (SELECT band, coalesce(sum(n) OVER (ORDER BY band DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS more FROM (SELECT CAST(floor(least(1000, 50 * ln(1 + now))) AS INT) AS band, count(*) AS n FROM {auth_two_windows} GROUP BY 1) g) b ON v.band = b.band
CROSS JOIN (SELECT count(*) AS n FROM {auth_two_windows}) t""")
define("auth_performance", "Weighted engagement of the last 14 days against the 14 before: totals, mean a note, change in percent, and the author's percentile among all.", """
SELECT w.pubkey, w.now, w.before, w.per_note, round(CASE WHEN w.before > 0 THEN 100 * (w.now - w.before) / w.before END, 4) AS change_pct, l.level FROM {auth_two_windows} w JOIN {auth_levels} l ON w.now = l.now""")
define("auth_recycle", "Old notes of an author's upper fifth that were not reposted in the last week.", """
SELECT id, pubkey, value FROM (SELECT w.*, percent_rank() OVER (PARTITION BY pubkey ORDER BY value) AS pr FROM {auth_weighted_notes} w) r CROSS JOIN {present} a
WHERE pr >= 0.8 AND r.ts < a.as_of - INTERVAL 14 DAYS AND NOT EXISTS (SELECT 1 FROM {acts} x WHERE x.target_id = r.id AND x.relation = 'repost' AND x.created_at > (SELECT @unix(max(as_of)) - 604800 FROM {present}))""")
define("auth_grouped_notes", "Notes of each author and hashtag: totals, attachments, the best note and the hashtag that goes with it most.", """
SELECT g.pubkey, g.tag, g.notes, g.replies, g.reactions, g.sats, g.media, g.top_id, o.other FROM (SELECT n.pubkey, h.tag, count(*) AS notes, @isum(c.replies) AS replies, @isum(c.reactions) AS reactions, @isum(c.sats) AS sats, @count_if(s.has_media) AS media, @first_by(n.id, -w.value) AS top_id
  FROM {norm_tag_hashtags} h JOIN {notes} n ON h.event_id = n.id JOIN {cnt_event_counts} c ON n.id = c.id JOIN {auth_weighted_notes} w ON n.id = w.id JOIN {disc_note_stats} s ON n.id = s.id GROUP BY n.pubkey, h.tag) g
LEFT JOIN (SELECT pubkey, tag, other FROM (SELECT pubkey, tag, other, row_number() OVER (PARTITION BY pubkey, tag ORDER BY n DESC, other) AS rn FROM (SELECT n.pubkey, a.tag, b.tag AS other, count(*) AS n FROM {norm_tag_hashtags} a JOIN {norm_tag_hashtags} b ON a.event_id = b.event_id AND a.tag <> b.tag JOIN {notes} n ON a.event_id = n.id GROUP BY n.pubkey, a.tag, b.tag) x) r WHERE rn = 1) o ON g.pubkey = o.pubkey AND g.tag = o.tag""")
define("auth_languages", "The two leading languages of each author.", "SELECT author, lang, n, rn FROM (SELECT author, lang, n, row_number() OVER (PARTITION BY author ORDER BY n DESC, lang) AS rn FROM (SELECT author, lang, count(*) AS n FROM {posts} GROUP BY author, lang) g) r WHERE rn <= 2")
define("auth_relay_footprint", "Relays that carry each customer's events, with their share.", """
SELECT o.o_custkey AS author, s.relay, count(DISTINCT s.event_id) AS n, round(count(DISTINCT s.event_id) / sum(count(DISTINCT s.event_id)) OVER (PARTITION BY o.o_custkey), 6) AS share
FROM {sightings} s JOIN {orders} o ON s.event_id = o.o_orderkey GROUP BY o.o_custkey, s.relay""")
define("auth_public_stats", "Followers, following, notes, replies, notes with media, articles, payments in and out, first and last activity.", """
SELECT e.pubkey, coalesce(f.followers, 0) AS followers, coalesce(f.following, 0) AS following, e.notes, coalesce(r.replies, 0) AS replies, coalesce(m.media, 0) AS media, coalesce(a.articles, 0) AS articles, e.paid, e.sats_out, coalesce(z.sats, 0) AS sats_in, e.joined_at, e.last_at FROM (
  SELECT pubkey, @count_if(kind = 1) AS notes, @count_if(kind = 9735) AS paid, @isum(sats) AS sats_out, min(created_at) AS joined_at, max(created_at) AS last_at FROM {ev} GROUP BY pubkey) e
LEFT JOIN {fact_profile_edges} f ON e.pubkey = f.pubkey LEFT JOIN (SELECT author, count(*) AS replies FROM {thr_edges} GROUP BY author) r ON e.pubkey = r.author LEFT JOIN (SELECT pubkey, count(DISTINCT event_id) AS media FROM {tags} WHERE name = 'm' GROUP BY pubkey) m ON e.pubkey = m.pubkey
LEFT JOIN (SELECT pubkey, count(DISTINCT d) AS articles FROM {states} WHERE kind = 30023 GROUP BY pubkey) a ON e.pubkey = a.pubkey LEFT JOIN (SELECT author, @isum(sats) AS sats FROM {acts} GROUP BY author) z ON e.pubkey = z.author""")
define("auth_graph_stats", "Mutual follows, reciprocity, follow-back and ghost followers (without a note in 30 days) in hundredths of a percent.", """
SELECT p.pubkey, p.followers, p.following, coalesce(m.n, 0) AS mutual, CASE WHEN p.following > 0 THEN @div(10000 * coalesce(m.n, 0), p.following) END AS reciprocity_bps, CASE WHEN p.followers > 0 THEN @div(10000 * coalesce(m.n, 0), p.followers) END AS follow_back_bps, CASE WHEN p.followers > 0 THEN @div(10000 * coalesce(g.n, 0), p.followers) END AS ghost_bps FROM {fact_profile_edges} p
LEFT JOIN (SELECT a.follower, count(*) AS n FROM {contacts} a JOIN {contacts} b ON a.follower = b.followed AND a.followed = b.follower GROUP BY a.follower) m ON p.pubkey = m.follower
LEFT JOIN (SELECT c.followed, count(*) AS n FROM {contacts} c LEFT JOIN (SELECT DISTINCT n.pubkey FROM {notes} n CROSS JOIN {present} p WHERE n.ts > p.as_of - INTERVAL 30 DAYS) l ON c.follower = l.pubkey WHERE l.pubkey IS NULL GROUP BY c.followed) g ON p.pubkey = g.followed""")
define("auth_first_seen", "First event of each author.", "SELECT pubkey, min(created_at) AS first_at, @first_by(id, created_at) AS first_id FROM {ev} GROUP BY pubkey")
define("auth_account_state", "State of each account from its hops, profile, notes and engagement by the trusted; tracked ones have a floor and an override wins.", """
SELECT pubkey, derived, CASE WHEN override_ IS NOT NULL THEN override_ WHEN tracked AND derived IN ('unknown', 'observed', 'candidate') THEN 'tracked' ELSE derived END AS state FROM (
  SELECT s.pubkey, CASE WHEN b.pubkey IS NOT NULL THEN 'blocked' END AS override_, k.pubkey IS NOT NULL AS tracked, CASE WHEN t.hops <= 2 THEN 'trusted' WHEN p.pubkey IS NOT NULL AND s.notes >= 10 AND coalesce(g.n, 0) >= 3 THEN 'meaningful'
    WHEN coalesce(g.n, 0) >= 1 OR (p.pubkey IS NOT NULL AND s.seen >= 5) THEN 'candidate' WHEN s.seen >= 2 THEN 'observed' ELSE 'unknown' END AS derived FROM (SELECT pubkey, @count_if(kind = 1) AS notes, count(*) AS seen FROM {ev} GROUP BY pubkey) s LEFT JOIN {trusted_users} t ON s.pubkey = t.pubkey
  LEFT JOIN (SELECT DISTINCT pubkey FROM {states} WHERE kind = 0) p ON s.pubkey = p.pubkey LEFT JOIN (SELECT a.author, count(DISTINCT a.actor) AS n FROM {acts} a JOIN {trusted_users} u ON a.actor = u.pubkey WHERE a.actor <> a.author GROUP BY a.author) g ON s.pubkey = g.author LEFT JOIN {blocked} b ON s.pubkey = b.pubkey LEFT JOIN {tracked_accounts} k ON s.pubkey = k.pubkey) x""")
define("auth_completeness", "Coverage of each account: profile, notes and payments that were seen.", """
SELECT pubkey, CASE WHEN profiles > 0 AND notes > 0 AND paid > 0 THEN 'full' WHEN notes > 0 THEN 'partial' ELSE 'sparse' END AS coverage FROM (SELECT pubkey, @count_if(kind = 0) AS profiles, @count_if(kind = 1) AS notes, @count_if(kind = 9735) AS paid FROM {ev} GROUP BY pubkey) c""")
define("auth_state_transitions", "Weeks in which an account's state by what was seen until then changed: unknown, observed from two events on, candidate from five with a profile.", """
SELECT pubkey, week, before, state FROM (SELECT pubkey, week, state, lag(state) OVER (PARTITION BY pubkey ORDER BY week) AS before FROM (
  SELECT pubkey, week, CASE WHEN profiles > 0 AND seen >= 5 THEN 'candidate' WHEN seen >= 2 THEN 'observed' ELSE 'unknown' END AS state FROM (SELECT pubkey, week, sum(n) OVER (PARTITION BY pubkey ORDER BY week) AS seen, sum(p) OVER (PARTITION BY pubkey ORDER BY week) AS profiles FROM (
    SELECT pubkey, @week(ts) AS week, count(*) AS n, @count_if(kind = 0) AS p FROM {ev} GROUP BY pubkey, @week(ts)) g) s) t) l WHERE before IS NULL OR before <> state""")
define("auth_missing_metadata", "Authors of notes without a profile event in the last ten days.", """
SELECT DISTINCT n.pubkey FROM {notes} n WHERE NOT EXISTS (SELECT 1 FROM {ev} e CROSS JOIN {present} a WHERE e.pubkey = n.pubkey AND e.kind = 0 AND e.ts > a.as_of - INTERVAL 10 DAYS)""")
define("auth_feed", "For each viewer the ten newest notes of those it follows: all, top-level ones, replies, and with media; of each author only the newest ten of a sort are looked at.", """
SELECT viewer, sort, id, rn FROM (SELECT c.viewer, n.sort, n.id, row_number() OVER (PARTITION BY c.viewer, n.sort ORDER BY n.created_at DESC, n.id DESC) AS rn FROM {disc_personal_cohort} c JOIN (SELECT pubkey, sort, id, created_at FROM (SELECT u.*, row_number() OVER (PARTITION BY pubkey, sort ORDER BY created_at DESC, id DESC) AS rn FROM (
  SELECT pubkey, 'all' AS sort, id, created_at FROM {notes} UNION ALL SELECT n.pubkey, CASE WHEN e.child IS NULL THEN 'top' ELSE 'replies' END, n.id, n.created_at FROM {notes} n LEFT JOIN {thr_edges} e ON n.id = e.child
  UNION ALL SELECT n.pubkey, 'media', n.id, n.created_at FROM {notes} n JOIN (SELECT DISTINCT event_id FROM {tags} WHERE name = 'm') m ON n.id = m.event_id) u) a WHERE rn <= 10) n ON c.other = n.pubkey) r WHERE rn <= 10""")
define("auth_events_page", "Pages of five of each author's events, newest first: the first two of all, replies and reactions, each with the cursor that the next begins after.", """
SELECT pubkey, sort, id, kind, rn, @div(rn - 1, 5) + 1 AS page, lag(id, 5) OVER (PARTITION BY pubkey, sort ORDER BY rn) AS after_id FROM (SELECT u.*, row_number() OVER (PARTITION BY pubkey, sort ORDER BY created_at DESC, id DESC) AS rn FROM (
  SELECT pubkey, 'all' AS sort, id, kind, created_at FROM {ev} UNION ALL SELECT e.pubkey, CASE WHEN e.kind = 1 THEN 'replies' ELSE 'reactions' END, e.id, e.kind, e.created_at FROM {ev} e JOIN {acts} a ON e.id = a.source_id WHERE e.kind IN (1, 7)) u) r WHERE rn <= 10""")
define("auth_kind_counts", "Count and oldest time by author and kind.", "SELECT pubkey, kind, count(*) AS n, min(created_at) AS oldest FROM {ev} GROUP BY pubkey, kind")
define("auth_cohort_retention", "Authors by week of their first event and weeks since.", """
SELECT @week(f.first_ts) AS cohort, @div(@days(@week(e.ts), @week(f.first_ts)), 7) AS week, count(DISTINCT e.pubkey) AS authors FROM {ev} e JOIN (SELECT pubkey, min(ts) AS first_ts FROM {ev} GROUP BY pubkey) f ON e.pubkey = f.pubkey GROUP BY 1, 2""")
define("auth_account_stats", "Authors active in a day, a week and a month, dormant ones, new ones a day in the last week, share of follows that were dropped, and ages in four classes.", """
SELECT a.day, a.week, a.month, a.dormant, n.new_7d, CASE WHEN u.kept + u.lost > 0 THEN @div(10000 * u.lost, u.kept + u.lost) END AS unfollow_bps, g.age_1d, g.age_7d, g.age_30d, g.older FROM (
  SELECT @count_if(age < 86400) AS day, @count_if(age < 604800) AS week, @count_if(age < 2592000) AS month, @count_if(age >= 604800) AS dormant FROM (SELECT e.pubkey, @unix(max(a.as_of)) - max(e.created_at) AS age FROM {ev} e CROSS JOIN {present} a GROUP BY e.pubkey) x) a
CROSS JOIN (SELECT count(*) AS new_7d FROM {auth_first_seen} f CROSS JOIN {present} p WHERE f.first_at > @unix(p.as_of) - 604800) n
CROSS JOIN (SELECT @count_if(c.followed IS NOT NULL) AS kept, @count_if(c.followed IS NULL) AS lost FROM (SELECT DISTINCT v.pubkey, i.followed FROM {contact_versions} v JOIN {contact_items} i ON v.id = i.event_id) o LEFT JOIN {contacts} c ON o.pubkey = c.follower AND o.followed = c.followed) u
CROSS JOIN (SELECT @count_if(age < 86400) AS age_1d, @count_if(age >= 86400 AND age < 604800) AS age_7d, @count_if(age >= 604800 AND age < 2592000) AS age_30d, @count_if(age >= 2592000) AS older FROM (SELECT @unix(p.as_of) - f.first_at AS age FROM {auth_first_seen} f CROSS JOIN {present} p) y) g""")
define("auth_stat_reconcile", "Stored counters, as they stood a day ago, against a recount, on the newest notes and on a keyed sample of the others: those that differ.", """
SELECT s.id, s.part, s.stored, coalesce(c.n, 0) AS counted FROM (SELECT n.id, n.part, coalesce(o.n, 0) AS stored FROM (SELECT id, part FROM (SELECT n.id, CASE WHEN n.ts > p.as_of - INTERVAL 14 DAYS THEN 'recent' WHEN @sha256(@str(n.id)) < '8' THEN 'sample' END AS part FROM {notes} n CROSS JOIN {present} p) x WHERE part IS NOT NULL) n
  LEFT JOIN (SELECT a.target_id, count(DISTINCT a.source_id) AS n FROM {acts} a CROSS JOIN {present} p WHERE a.relation = 'reaction' AND a.ts <= p.as_of - INTERVAL 1 DAY GROUP BY a.target_id) o ON n.id = o.target_id) s
LEFT JOIN (SELECT target, count(*) AS n FROM {ev} WHERE kind = 7 AND id <> target GROUP BY target) c ON s.id = c.target WHERE s.stored <> coalesce(c.n, 0)""")
define("auth_engagement_90d", "Sums, active days and cadence over 90 days, per day and per active day.", """
SELECT pubkey, notes, given, received, active_days, round(notes / 90e0, 6) AS per_day, round(CASE WHEN active_days > 0 THEN notes / CAST(active_days AS DOUBLE) END, 6) AS per_active_day FROM (
  SELECT pubkey, @isum(notes) AS notes, @isum(given) AS given, @isum(received) AS received, @count_if(notes > 0) AS active_days FROM {auth_activity_daily} d CROSS JOIN {present} a WHERE @days(@date(a.as_of), d.day) < 90 GROUP BY pubkey) x""")
