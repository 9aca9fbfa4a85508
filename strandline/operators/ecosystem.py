"""Daily rollups of the network, and of its relays."""

from __future__ import annotations

from ..plans.template import define

define("eco_kind_activity", "Events and authors by kind, its family and day.", """
SELECT kind, family, day, count(*) AS n, count(DISTINCT pubkey) AS authors FROM (SELECT kind, pubkey, @date(ts) AS day, CASE WHEN kind >= 30000 AND kind < 40000 THEN 'addressable' WHEN kind >= 20000 AND kind < 30000 THEN 'ephemeral' WHEN kind IN (0, 3) OR (kind >= 10000 AND kind < 20000) THEN 'replaceable' ELSE 'regular' END AS family
  FROM (SELECT kind, pubkey, ts FROM {ev} UNION ALL SELECT kind, pubkey, ts FROM {states} WHERE kind > 0) e) x GROUP BY kind, family, day""")
define("eco_kind_engagement", "Posts, reactions, replies, reposts and payments by the kind of what they are about, and day.", """
SELECT day, kind, @isum(posts) AS posts, @isum(replies) AS replies, @isum(reactions) AS reactions, @isum(reposts) AS reposts, @isum(zaps) AS zaps FROM (SELECT @date(ts) AS day, kind, 1 AS posts, 0 AS replies, 0 AS reactions, 0 AS reposts, 0 AS zaps FROM {ev}
UNION ALL SELECT @date(a.ts), e.kind, 0, CASE WHEN a.relation = 'reply' THEN 1 ELSE 0 END, CASE WHEN a.relation = 'reaction' THEN 1 ELSE 0 END, CASE WHEN a.relation = 'repost' THEN 1 ELSE 0 END, CASE WHEN a.relation = 'zap' THEN 1 ELSE 0 END FROM {acts} a JOIN {ev} e ON a.target_id = e.id) u GROUP BY day, kind""")
define("eco_zap_daily", "Payments by day: count, sats, own payments, participants, and a histogram of sizes.", """
SELECT @date(ts) AS day, count(*) AS n, @isum(sats) AS sats, @count_if(sender = receiver) AS own, count(DISTINCT sender) AS senders, count(DISTINCT receiver) AS receivers, @count_if(sats < 100) AS under_100, @count_if(sats >= 100 AND sats < 1000) AS under_1k,
  @count_if(sats >= 1000 AND sats < 10000) AS under_10k, @count_if(sats >= 10000 AND sats < 100000) AS under_100k, @count_if(sats >= 100000) AS over_100k FROM {payments} GROUP BY @date(ts)""")
define("eco_zap_quantiles", "Median, ninth decile, mean and Gini (in hundredths of a percent) of payments by year, and the median hours until a paid note's first payment.", """
SELECT v.year, min(CASE WHEN 2 * v.upto >= t.n THEN v.sats END) AS p50, min(CASE WHEN 10 * v.upto >= 9 * t.n THEN v.sats END) AS p90, round(max(t.sats) / CAST(max(t.n) AS DOUBLE), 4) AS mean,
  round(greatest(0, 2.0 * sum(CAST(v.sats AS DOUBLE) * (v.n * (v.upto - v.n) + v.n * (v.n + 1) / 2.0)) / (max(t.n) * CAST(max(t.sats) AS DOUBLE)) - (max(t.n) + 1.0) / max(t.n)) * 10000, 2) AS gini_bps, max(f.p50_s) AS p50_first_zap_s
FROM {zap_values} v JOIN (SELECT year, @isum(n) AS n, @isum(n * sats) AS sats FROM {zap_values} GROUP BY year) t ON v.year = t.year
CROSS JOIN (SELECT round(@quantile(wait, 0.5), 4) AS p50_s FROM (SELECT min(a.created_at) - min(n.created_at) AS wait FROM {acts} a JOIN {notes} n ON a.target_id = n.id WHERE a.relation = 'zap' GROUP BY n.id) w) f GROUP BY v.year""")
define("eco_zap_leaderboard", "The 100 leading senders and receivers of each day.", """
SELECT day, side, who, sats, n, rn FROM (SELECT day, side, who, sats, n, row_number() OVER (PARTITION BY day, side ORDER BY sats DESC, who) AS rn FROM (
  SELECT @date(ts) AS day, 'sender' AS side, sender AS who, @isum(sats) AS sats, count(*) AS n FROM {payments} GROUP BY @date(ts), sender UNION ALL SELECT @date(ts), 'receiver', receiver, @isum(sats), count(*) FROM {payments} GROUP BY @date(ts), receiver) u) r WHERE rn <= 100""")
define("eco_zap_hourly", "Payments of notes by weekday and hour.", "SELECT @dow(ts) AS dow, hour(ts) AS hour, count(*) AS n, @isum(sats) AS sats FROM {acts} WHERE relation = 'zap' GROUP BY 1, 2")
define("eco_zap_edges", "Totals of each pair that paid twice or more, first and last time, and the pair's share of what the receiver got.", """
SELECT e.sender, e.receiver, e.n, e.sats, e.first_at, e.last_at, round(e.sats / CAST(r.sats AS DOUBLE), 6) AS share FROM (SELECT sender, receiver, count(*) AS n, @isum(sats) AS sats, min(ts) AS first_at, max(ts) AS last_at FROM {payments} GROUP BY sender, receiver HAVING count(*) >= 2) e
JOIN (SELECT receiver, @isum(sats) AS sats FROM {payments} GROUP BY receiver) r ON e.receiver = r.receiver""")
define("eco_content_shape_daily", "Histogram of posts' lengths by day, with their characters and hashtags.", """
SELECT @date(p.ts) AS day, count(*) AS n, @count_if(length(p.text) < 280) AS short, @count_if(length(p.text) >= 280 AND length(p.text) < 2000) AS medium, @count_if(length(p.text) >= 2000) AS long_, @isum(length(p.text)) AS chars, @isum(coalesce(h.n, 0)) AS hashtags, @count_if(h.n > 0) AS tagged
FROM {posts} p LEFT JOIN (SELECT id, count(*) AS n FROM {hashtags} GROUP BY id) h ON p.id = h.id GROUP BY @date(p.ts)""")
define("eco_hashtag_daily", "Events and authors by hashtag and day.", "SELECT tag, @date(ts) AS day, count(*) AS n, count(DISTINCT author) AS authors FROM {hashtags} GROUP BY tag, @date(ts)")
define("eco_hashtag_momentum", "Each hashtag's last week against the week before: emerging, fading or steady.", """
SELECT tag, recent, prior, CASE WHEN prior >= 20 AND recent >= 2 * prior THEN 'emerging' WHEN prior > 0 AND 2 * recent < prior THEN 'fading' ELSE 'steady' END AS state,
  round(CASE WHEN prior = 0 THEN recent ELSE (recent - prior) / greatest(prior, 1e0) END, 6) AS z
FROM (SELECT d.tag, @isum(CASE WHEN @days(@date(p.as_of), d.day) < 7 THEN d.n ELSE 0 END) AS recent, @isum(CASE WHEN @days(@date(p.as_of), d.day) BETWEEN 7 AND 13 THEN d.n ELSE 0 END) AS prior
  FROM {eco_hashtag_daily} d CROSS JOIN {post_now} p GROUP BY d.tag) x WHERE recent + prior >= 20""")
define("eco_domain_momentum", "Domains by the distinct trusted authors that link them in the last seven whole days, against the seven before; those that eight have in either.", """
SELECT domain, recent, prior, CASE WHEN prior >= 8 AND recent >= 2 * prior AND recent >= 8 THEN 'emerging' WHEN prior > 0 AND 2 * recent < prior THEN 'fading' ELSE 'steady' END AS state, round(CASE WHEN prior = 0 THEN recent ELSE (recent - prior) / greatest(prior, 1e0) END, 6) AS z FROM (
  SELECT d.domain, count(DISTINCT CASE WHEN @days(@date(p.as_of), d.day) BETWEEN 1 AND 7 THEN d.author END) AS recent, count(DISTINCT CASE WHEN @days(@date(p.as_of), d.day) BETWEEN 8 AND 14 THEN d.author END) AS prior
  FROM {domain_author_daily} d JOIN {trusted_users} t ON d.author = t.pubkey CROSS JOIN {present} p WHERE @days(@date(p.as_of), d.day) BETWEEN 1 AND 14 GROUP BY d.domain) x WHERE recent >= 8 OR prior >= 8""")
define("eco_author_daily", "Fine rollup: day, hashtag or domain, author, language.", """
SELECT @date(ts) AS day, 'hashtag' AS entity, tag, author, lang, count(*) AS n FROM {hashtags} GROUP BY @date(ts), tag, author, lang UNION ALL SELECT @date(ts), 'domain', domain, author, @no_text(), count(*) FROM {links} WHERE domain <> '' GROUP BY @date(ts), domain, author""")
define("eco_top_from_daily", "The leading 50 hashtags and domains of 30 days from the fine rollup, of all and of each language.", """
SELECT entity, lang, tag, authors, events, rn FROM (SELECT entity, lang, tag, authors, events, row_number() OVER (PARTITION BY entity, lang ORDER BY authors DESC, events DESC, tag) AS rn FROM (
  SELECT entity, l.lang, tag, count(DISTINCT author) AS authors, @isum(n) AS events FROM (SELECT entity, 'all' AS lang, tag, author, n, day FROM {eco_author_daily} UNION ALL SELECT entity, lang, tag, author, n, day FROM {eco_author_daily} WHERE lang IS NOT NULL) l
  CROSS JOIN {post_now} p WHERE @days(@date(p.as_of), l.day) < 30 GROUP BY entity, l.lang, tag) g) r WHERE rn <= 50""")
define("eco_entity_baseline", "Median of each hashtag's daily authors of three posts or more over 30 days, for those with seven days or more.", """
SELECT tag, count(*) AS days, round(@quantile(authors, 0.5), 4) AS typical FROM (SELECT d.tag, d.day, count(DISTINCT d.author) AS authors FROM {eco_author_daily} d JOIN (SELECT author FROM {posts} GROUP BY author HAVING count(*) >= 3) t ON d.author = t.author CROSS JOIN {post_now} p
  WHERE d.entity = 'hashtag' AND @days(@date(p.as_of), d.day) < 30 GROUP BY d.tag, d.day) a GROUP BY tag HAVING count(*) >= 7""")
define("eco_baseline_factor", "Each hashtag's newest day against its typical day.", """
SELECT b.tag, d.authors, round(d.authors / b.typical, 6) AS factor FROM {eco_entity_baseline} b JOIN (SELECT tag, authors FROM (SELECT tag, authors, row_number() OVER (PARTITION BY tag ORDER BY day DESC) AS rn FROM {eco_hashtag_daily}) r WHERE rn = 1) d ON b.tag = d.tag""")
define("eco_weekday_median", "Median of notes an hour on each weekday over 56 days, with the hours that it is of.", "SELECT dow, hour, @quantile(n, 0.5) AS typical, count(*) AS days FROM (SELECT @dow(n.ts) AS dow, hour(n.ts) AS hour, @date(n.ts) AS day, count(*) AS n FROM {notes} n CROSS JOIN {present} p WHERE n.ts > p.as_of - INTERVAL 56 DAYS GROUP BY 1, 2, 3) h GROUP BY dow, hour")
define("eco_spam_clusters", "Fingerprints of texts of 40 characters or more that two authors share, and authors of 30 posts or more in an hour.", """
SELECT 'fingerprint' AS cluster, fingerprint AS key, count(*) AS n, count(DISTINCT author) AS authors, min(id) AS first_id FROM (SELECT f.id, p.author, f.fingerprint FROM {norm_content_fingerprint} f JOIN {posts} p ON f.id = p.id) f GROUP BY fingerprint HAVING count(DISTINCT author) >= 2
UNION ALL SELECT 'burst', concat(author, ' ', @str(@unix(hour))), n, 1, first_id FROM (SELECT author, @trunc('hour', ts) AS hour, count(*) AS n, min(id) AS first_id FROM {posts} GROUP BY author, @trunc('hour', ts) HAVING count(*) >= 30) b""")
define("eco_network_graph", "Histogram of follower counts.", """
SELECT CASE WHEN followers = 0 THEN 0 ELSE CAST(floor(log10(followers)) AS BIGINT) + 1 END AS magnitude, count(*) AS profiles FROM {fact_follower_edges} GROUP BY 1""")
define("eco_label_stats", "Labels by namespace and value, and how far language labels agree with what is detected.", """
SELECT namespace, label, count(*) AS n, @count_if(d.detected IS NOT NULL) AS detected, @count_if(d.detected = label) AS agreed FROM (SELECT event_id, namespace, label FROM {attr_self_labels} UNION ALL SELECT doc_id, 'quality', @str(quality) FROM {labels} UNION ALL SELECT doc_id, 'lang', lang FROM {documents}) l
LEFT JOIN {lang_detect} d ON l.namespace = 'lang' AND l.event_id = d.id GROUP BY namespace, label""")
define("eco_deletion_daily", "Deletions that apply, by day and by the kind of what they delete, with the total time since.", "SELECT @date(s.ts) AS day, d.target_kind AS kind, count(*) AS n, @isum(greatest(s.created_at - d.target_at, 0)) AS latency_s FROM {state_deletions} d JOIN {states} s ON d.deletion_id = s.id WHERE d.applies GROUP BY @date(s.ts), d.target_kind")
define("eco_snapshot", "Notes and authors of a day, a week and a month, and the 15 leading languages of posts with the unmarked ones.", """
SELECT 'notes' AS part, @str(w.days) AS key, count(*) AS n, count(DISTINCT n.pubkey) AS authors FROM {notes} n CROSS JOIN {windows} w CROSS JOIN {present} p WHERE n.created_at > @unix(p.as_of) - w.days * 86400 GROUP BY w.days
UNION ALL SELECT 'language', lang, n, authors FROM (SELECT coalesce(d.detected, 'und') AS lang, count(*) AS n, count(DISTINCT p.author) AS authors, row_number() OVER (ORDER BY count(*) DESC, coalesce(d.detected, 'und')) AS rn FROM {posts} p LEFT JOIN {lang_detect} d ON p.id = d.id GROUP BY coalesce(d.detected, 'und')) l WHERE rn <= 15 OR lang = 'und'""")
define("eco_network_stats", "Totals of the network.", """
SELECT e.events, e.authors, h.hashtags, r.relays, l.languages FROM (SELECT count(*) AS events, count(DISTINCT pubkey) AS authors FROM {ev}) e CROSS JOIN (SELECT count(DISTINCT tag) AS hashtags FROM {hashtags}) h
CROSS JOIN (SELECT count(DISTINCT relay) AS relays FROM {sightings}) r CROSS JOIN (SELECT count(DISTINCT lang) AS languages FROM {documents}) l""")
define("eco_series", "Hourly counts of events.", "SELECT @trunc('hour', ts) AS hour, count(*) AS n, count(DISTINCT pubkey) AS authors, @isum(sats) AS sats FROM {ev} GROUP BY 1")
define("eco_media_hosts", "Links by host, type of file and day.", """
SELECT @date(ts) AS day, domain, CASE WHEN @matches(lower(url), '[.]png$') THEN 'image/png' WHEN @matches(lower(url), '[.]jpe?g$') THEN 'image/jpeg' WHEN @matches(lower(url), '[.](gif|webp)$') THEN 'image/other' WHEN @matches(lower(url), '[.](mp4|webm|mov)$') THEN 'video' ELSE 'page' END AS media, count(*) AS n, count(DISTINCT id) AS pages
FROM {links} WHERE domain <> '' GROUP BY 1, 2, 3""")
define("eco_dm_volume", "Turns that each side of a conversation receives by day (a conversation's number stands for its hours).", """
SELECT day, receiver, count(*) AS n, count(DISTINCT root) AS conversations FROM (SELECT @date(@hours_before(@time(2024-01-31 00:00:00), @div(root, 1000) % 720)) AS day, CASE WHEN author LIKE 'user%' THEN 'assistant' ELSE 'user' END AS receiver, root FROM {chat}) c GROUP BY day, receiver""")
# relays
define("rel_activity_hourly", "Sightings by relay and hour.", "SELECT relay, @trunc('hour', seen_at) AS hour, count(*) AS n, count(DISTINCT event_id) AS events FROM {sightings} GROUP BY 1, 2")
define("ingest_provenance", "One row an event and relay: first sighting, and whether it was the event's first.", """
SELECT event_id, relay, seen_at, row_number() OVER (PARTITION BY event_id ORDER BY seen_at, relay) = 1 AS is_first_seen FROM (SELECT event_id, relay, min(seen_at) AS seen_at FROM {sightings} GROUP BY event_id, relay) s""")
define("ingest_seen_on", "Relays of each event in order of time, and the one that saw it first; ties by number.", "SELECT event_id, @in_order(relay, seen_at) AS relays, @first_by(relay, seen_at) AS hint, count(*) AS n FROM {ingest_provenance} GROUP BY event_id")
define("rel_summary", "Relays, those active, events, sightings and authors of 30 days, a year and all.", """
SELECT w.days, count(DISTINCT s.relay) AS relays, count(DISTINCT s.event_id) AS events, count(*) AS sightings, count(DISTINCT o.o_custkey) AS authors, max(t.relays) AS known_relays FROM {sightings} s JOIN {orders} o ON s.event_id = o.o_orderkey CROSS JOIN (SELECT 30 AS days UNION ALL SELECT 365 UNION ALL SELECT 100000) w
CROSS JOIN (SELECT max(seen_at) AS as_of, count(DISTINCT relay) AS relays FROM {sightings}) t WHERE @days(@date(t.as_of), @date(s.seen_at)) < w.days GROUP BY w.days""")
define("rel_top", "Relays by events, first sightings and name.", "SELECT relay, count(*) AS events, @count_if(is_first_seen) AS first_seen FROM {ingest_provenance} GROUP BY relay ORDER BY events DESC, relay LIMIT 10")
define("rel_propagation", "Events, first and only sightings of relays, quantiles of the delay after the first, sightings before the event's own time, share of authors without votes, and the mix of priorities.", """
SELECT p.relay, count(*) AS events, @count_if(p.is_first_seen) AS first_seen, @count_if(p.n = 1) AS only_here, round(@quantile(p.delay, 0.5), 4) AS p50_s, round(@quantile(p.delay, 0.9), 4) AS p90_s, @count_if(p.seen_at < o.o_orderdate) AS future_dated, round(@count_if(l.pubkey IS NULL) / CAST(count(*) AS DOUBLE), 6) AS untrusted_share,
  @count_if(o.o_orderpriority LIKE '1%') AS urgent, @count_if(o.o_orderpriority LIKE '2%') AS high FROM (SELECT event_id, relay, seen_at, is_first_seen, count(*) OVER (PARTITION BY event_id) AS n, @unix(seen_at) - min(@unix(seen_at)) OVER (PARTITION BY event_id) AS delay FROM {ingest_provenance}) p
JOIN {orders} o ON p.event_id = o.o_orderkey LEFT JOIN (SELECT DISTINCT pubkey FROM {relay_lists}) l ON o.o_custkey = l.pubkey GROUP BY p.relay""")
define("rel_overlap", "Events that pairs of relays share, and their Jaccard similarity.", """
SELECT p.one, p.two, p.shared, round(p.shared / (a.n + b.n - p.shared), 6) AS jaccard FROM (
  SELECT x.relay AS one, y.relay AS two, count(*) AS shared FROM {ingest_provenance} x JOIN {ingest_provenance} y ON x.event_id = y.event_id AND x.relay < y.relay GROUP BY x.relay, y.relay) p
JOIN (SELECT relay, count(*) AS n FROM {ingest_provenance} GROUP BY relay) a ON a.relay = p.one JOIN (SELECT relay, count(*) AS n FROM {ingest_provenance} GROUP BY relay) b ON b.relay = p.two""")
define("rel_health_daily", "Probes by relay and day: success in hundredths of a percent, latency.", """
SELECT relay, @date(ts) AS day, count(*) AS probes, @div(10000 * @count_if(ok), count(*)) AS ok_bps, round(@quantile(latency_ms, 0.5), 4) AS p50_ms, round(@quantile(latency_ms, 0.9), 4) AS p90_ms FROM {probes} GROUP BY relay, @date(ts)""")
define("rel_score", "Admission score of each relay and its parts: popularity, probes, latency, yield, duplicates, failures, propagation, blocks.", """
SELECT relay, popularity, probe, latency, yield_, duplicates, failures, propagation, blocked, round(greatest(0, popularity + probe + latency + yield_ - duplicates - failures + propagation - blocked), 4) AS score FROM (
  SELECT h.relay, round(CASE WHEN coalesce(u.users, 0) = 0 THEN 0 ELSE least(150, 22 * log10(1 + u.users) + CASE WHEN u.users >= 1000 THEN 20 ELSE 0 END) END, 6) AS popularity, CASE WHEN h.last_ok THEN 20 WHEN h.ok_rate > 0 THEN 5 ELSE 0 END AS probe, CASE WHEN h.ms < 500 THEN 10 WHEN h.ms < 2000 THEN 5 ELSE 0 END AS latency,
    round(least(10, 10e0 * coalesce(p.first_seen, 0) / greatest(coalesce(p.events, 0), 1)), 6) AS yield_, round(CASE WHEN coalesce(d.ratio, 0) > 5e-1 THEN least(10, (d.ratio - 5e-1) * 20) ELSE 0 END, 6) AS duplicates, round(CASE WHEN 1 - h.ok_rate > 3e-1 THEN least(30, (1 - h.ok_rate) * 40) ELSE 0 END, 6) AS failures,
    round(least(12, 8e0 * coalesce(p.first_seen, 0) / greatest(coalesce(p.events, 0), 1) + 4e0 * coalesce(p.only_here, 0) / greatest(coalesce(p.events, 0), 1)), 6) AS propagation, least(coalesce(b.n, 0), 8) AS blocked
  FROM (SELECT relay, max_by(ok, @unix(ts) * 2 + CASE WHEN ok THEN 1 ELSE 0 END) AS last_ok, @count_if(ok) / CAST(count(*) AS DOUBLE) AS ok_rate, avg(latency_ms) AS ms FROM {probes} GROUP BY relay) h LEFT JOIN {rel_discovery} u ON h.relay = u.relay LEFT JOIN {rel_propagation} p ON h.relay = p.relay
  LEFT JOIN (SELECT relay, 1 - count(DISTINCT event_id) / CAST(count(*) AS DOUBLE) AS ratio FROM {sightings} GROUP BY relay) d ON h.relay = d.relay LEFT JOIN (SELECT l.relay, count(*) AS n FROM {relay_lists} l JOIN {blocked} b ON l.pubkey = b.pubkey GROUP BY l.relay) b ON h.relay = b.relay) s""")
define("rel_transition", "Next state of each relay from its state and score: admitted ones stay down to 50, others enter from 60, at most five in all; failing ones are held back, others wait or are rejected.", """
SELECT relay, score, before, CASE WHEN NOT eligible THEN CASE WHEN failures >= 12 THEN 'quarantined' WHEN score < 30 THEN 'rejected' ELSE 'candidate' END WHEN rn <= 5 THEN 'admitted' ELSE 'candidate' END AS state FROM (
  SELECT relay, score, failures, before, eligible, row_number() OVER (PARTITION BY eligible ORDER BY CASE WHEN before = 'admitted' THEN 0 ELSE 1 END, score DESC, relay) AS rn FROM (
    SELECT c.relay, c.score, c.failures, coalesce(b.before, 'candidate') AS before, c.failures < 12 AND c.score >= CASE WHEN b.before = 'admitted' THEN 50 ELSE 60 END AS eligible FROM {rel_score} c LEFT JOIN {relay_states} b ON c.relay = b.relay) s) r""")
define("rel_coverage", "Relays that carried events in only one of the last two years.", """
SELECT coalesce(a.relay, b.relay) AS relay, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS now FROM (SELECT relay, count(*) AS n FROM {sightings} CROSS JOIN (SELECT max(seen_at) AS t FROM {sightings}) m WHERE seen_at <= t - INTERVAL 365 DAYS GROUP BY relay) a
FULL OUTER JOIN (SELECT relay, count(*) AS n FROM {sightings} CROSS JOIN (SELECT max(seen_at) AS t FROM {sightings}) m WHERE seen_at > t - INTERVAL 365 DAYS GROUP BY relay) b ON a.relay = b.relay""")
define("rel_shares", "Share of first and only sightings on the newest day of the year.", """
SELECT relay, count(*) AS events, round(@count_if(is_first_seen) / CAST(count(*) AS DOUBLE), 6) AS first_share, round(@count_if(n = 1) / CAST(count(*) AS DOUBLE), 6) AS only_share FROM (SELECT p.relay, p.is_first_seen, p.seen_at, count(*) OVER (PARTITION BY p.event_id) AS n FROM {ingest_provenance} p) x
CROSS JOIN (SELECT max(seen_at) AS as_of FROM {sightings}) m WHERE @days(@date(m.as_of), @date(seen_at)) < 31 GROUP BY relay""")
define("zap_values", "Payments of each amount by year: the distribution that quantiles and the Gini come from, far smaller than the payments.", "SELECT year, sats, n, CAST(sum(n) OVER (PARTITION BY year ORDER BY sats) AS BIGINT) AS upto FROM (SELECT year(ts) AS year, sats, count(*) AS n FROM {payments} WHERE sats > 0 GROUP BY year(ts), sats) v")
define("eco_author_zaps", "Payments that each author received by week, with sats for a thousand followers.", """
SELECT a.author, a.week, a.n, a.sats, round(CASE WHEN f.followers > 0 THEN 1000e0 * a.sats / f.followers END, 4) AS sats_per_1k FROM (SELECT author, @week(ts) AS week, count(*) AS n, @isum(sats) AS sats FROM {acts} WHERE relation = 'zap' GROUP BY author, @week(ts)) a LEFT JOIN {fact_profile_edges} f ON a.author = f.pubkey""")
