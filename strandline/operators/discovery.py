"""Scores and rankings of notes, profiles, hashtags and domains."""

from __future__ import annotations

from ..plans.folders import cut
from ..plans.template import define
from .related import related_notes

define("disc_engager_weight", "Vote of each user by hops from the seeds: 1 within one, a half at two, else a quarter; others have the weight of the untrusted where they vote.", "SELECT pubkey, CASE WHEN hops <= 1 THEN 1e0 WHEN hops = 2 THEN 5e-1 ELSE 25e-2 END AS weight FROM {trusted_users}")
define("disc_weighted_engagement", "Weighted engagement of each note over a day, a week and a month: distinct actors by kind, never the author; replies by piles; reposts without those whose reply is in a pile.", """
SELECT a.days, a.target_id, coalesce(r.total, 0e0) AS reply_w, coalesce(r.substantive, 0e0) AS substantive, coalesce(r.unlock_share, 1e0) AS unlock_share, a.repost_w, a.react_w, a.zap_w, a.msats FROM (
  SELECT d.days, d.target_id, round(sum(CASE WHEN d.relation = 'repost' AND p.pile IS NULL THEN d.w ELSE 0e0 END), 6) AS repost_w, round(sum(CASE WHEN d.relation = 'reaction' THEN d.w ELSE 0e0 END), 6) AS react_w, round(sum(CASE WHEN d.relation = 'zap' THEN d.w ELSE 0e0 END), 6) AS zap_w, round(sum(CASE WHEN d.relation = 'zap' THEN d.msats * d.w ELSE 0e0 END), 6) AS msats
  FROM (SELECT w.days, a.target_id, a.relation, a.actor, coalesce(max(t.weight), max(s.untrusted)) AS w, sum(a.sats) * 1000 AS msats FROM {acts} a CROSS JOIN {windows} w CROSS JOIN {present} p CROSS JOIN {settings} s LEFT JOIN {disc_engager_weight} t ON a.actor = t.pubkey
    WHERE a.actor <> a.author AND a.created_at > @unix(p.as_of) - w.days * 86400 GROUP BY w.days, a.target_id, a.relation, a.actor) d
  LEFT JOIN {reply_piles} p ON p.target_id = concat(@str(d.days), ' ', @str(d.target_id)) AND p.actor = d.actor GROUP BY d.days, d.target_id) a
LEFT JOIN {disc_reply_discount} r ON a.days = r.days AND a.target_id = r.target_id""")
define("disc_note_score", "Trending score of each note over a day, a week and a month, with decay by age.", """
SELECT days, id, round((3 * reply_w + 2 * zap_w + ln(1 + msats / 100000.0) + CASE WHEN react_w <= 4 * unlock THEN react_w ELSE 4 * unlock + 12e-2 * (react_w - 4 * unlock) END
    + CASE WHEN repost_w <= unlock THEN 2 * repost_w ELSE 2 * unlock + 2e-1 * (repost_w - unlock) END) / (1 + CASE days WHEN 1 THEN 1e0 WHEN 7 THEN 3e0 / 17 ELSE 0e0 END * age_s / (days * 86400)), 3) AS score
FROM (SELECT w.days, n.id, w.reply_w, w.repost_w, w.react_w, w.zap_w, w.msats, w.substantive * w.unlock_share + w.zap_w AS unlock, @unix(a.as_of) - n.created_at AS age_s FROM {disc_weighted_engagement} w JOIN {notes} n ON w.target_id = n.id CROSS JOIN {present} a) s
WHERE age_s <= days * 86400""", kept=True)
define("disc_note_stats", "Counters, language, media and scores of each note.", """
SELECT c.id, c.replies, c.reactions, c.reposts, c.zaps, l.code AS lang, m.event_id IS NOT NULL AS has_media, coalesce(s.score_24h, 0) AS score_24h, coalesce(s.score_7d, 0) AS score_7d, coalesce(s.score_30d, 0) AS score_30d FROM {cnt_event_counts} c
LEFT JOIN (SELECT id, max(CASE WHEN days = 1 THEN score END) AS score_24h, max(CASE WHEN days = 7 THEN score END) AS score_7d, max(CASE WHEN days = 30 THEN score END) AS score_30d FROM {disc_note_score} GROUP BY id) s ON c.id = s.id
LEFT JOIN {lang_tags} l ON c.id = l.id LEFT JOIN (SELECT DISTINCT event_id FROM {tags} WHERE name = 'url') m ON c.id = m.event_id""")
define("disc_trending_notes", "The 50 notes of highest score over a week.", "SELECT id, score AS score_7d FROM {disc_note_score} WHERE days = 7 AND score > 0 ORDER BY score DESC, id DESC LIMIT 50")
define("disc_profile_stats", "Per author: posts, engagement received, payments, active days.", """
SELECT n.pubkey, n.posts, n.days, coalesce(e.engaged, 0) AS engaged, coalesce(e.sats, 0) AS sats, n.last_at FROM
  (SELECT pubkey, count(*) AS posts, count(DISTINCT @date(ts)) AS days, max(created_at) AS last_at FROM {notes} GROUP BY pubkey) n
LEFT JOIN (SELECT author, count(DISTINCT actor) AS engaged, @isum(sats) AS sats FROM {acts} WHERE actor <> author GROUP BY author) e ON n.pubkey = e.author""")
define("disc_profile_score", "Trending score of profiles in each window, by engagement per post, with decay since the last activity.", """
SELECT days, pubkey, round(CASE WHEN posts = 0 OR engaged = 0 THEN 0 ELSE (3 * ln(1 + engaged) + 0.35 * ln(1 + posts) + ln(1 + sats / 100.0) + 0.5 * ln(1 + active_days))
  * (1 + least(6, sqrt(engaged / (1.0 + posts)))) / (1 + greatest(0, posts / (1.0 + engaged + active_days) - 1)) / (1 + CASE days WHEN 1 THEN 1e0 WHEN 7 THEN 3e0 / 17 ELSE 0e0 END * (@unix(p.as_of) - last_at) / (days * 86400)) END, 6) AS score FROM {disc_profile_windows} CROSS JOIN {present} p""", kept=True)
define("disc_profile_rising", "Rising score of profiles in each window: credited new followers, and engagement against the audience, with penalties for large audiences, much posting and few days.", """
SELECT days, pubkey, CASE WHEN credited = 0 AND ce = 0 THEN 0e0 ELSE greatest(round(credited / audience + (0.2 * greatest(score, 0) + (0.4 * ln(1 + ce) + 3 * ln(1 + 100 * ce / (10.0 + followers)) * ce / (ce + 15)) * (1 + least(1, e / (1.0 + total))) / (1 + greatest(0, total / (1.0 + e + active_days) - 1)) * CASE WHEN active_days > 0 THEN least(1, active_days / 3.0) ELSE 1 END)
  / ((1 + 1.3 * log10(1 + followers)) * audience), 3), 0e0) END AS score
FROM (SELECT w.days, w.pubkey, w.active_days, CAST(w.posts AS DOUBLE) AS total, coalesce(f.followers, 0) AS followers, CASE WHEN coalesce(f.followers, 0) > 500 THEN f.followers / 500e0 ELSE 1e0 END AS audience, CASE WHEN coalesce(g.n, 0) - 2 >= 10 THEN g.n - 2e0 ELSE 0e0 END AS credited,
  coalesce(e.rising, 0e0) AS e, greatest(0e0, coalesce(e.rising, 0e0) - 1) AS ce, coalesce(s.score, 0e0) AS score
FROM {disc_profile_windows} w LEFT JOIN {fact_profile_edges} f ON w.pubkey = f.pubkey LEFT JOIN {new_followers} g ON w.days = g.days AND w.pubkey = g.followed LEFT JOIN {disc_profile_engagement} e ON w.days = e.days AND w.pubkey = e.author LEFT JOIN {disc_profile_score} s ON w.days = s.days AND w.pubkey = s.pubkey) x""")
define("disc_profile_engagement", "Engagement of each profile in each window counted once an actor, by the strongest kind of act; weighted by trust; and the part that rising counts: likes only where nothing stronger is there at a tenth.", """
SELECT days, author, @count_if(best = 4) AS zappers, @count_if(best = 3) AS repliers, @count_if(best = 2) AS reposters, @count_if(best = 1) AS reactors, round(sum(w), 6) AS weighted, round(sum(CASE WHEN best >= 3 THEN w WHEN best = 2 THEN w * 5e-1 ELSE w * 1e-1 END), 6) AS rising FROM (
  SELECT d.days, a.author, a.actor, max(CASE a.relation WHEN 'zap' THEN 4 WHEN 'reply' THEN 3 WHEN 'repost' THEN 2 ELSE 1 END) AS best, coalesce(max(t.weight), max(s.untrusted)) AS w FROM {acts} a CROSS JOIN {windows} d CROSS JOIN {present} p CROSS JOIN {settings} s LEFT JOIN {disc_engager_weight} t ON a.actor = t.pubkey
  WHERE a.actor <> a.author AND a.relation <> 'report' AND a.created_at > @unix(p.as_of) - d.days * 86400 GROUP BY d.days, a.author, a.actor) b GROUP BY days, author""")
define("disc_trending_profiles", "The 30 leading profiles of each window, by trending and by rising score.", """
SELECT days, list, pubkey, score, rn FROM (SELECT days, list, pubkey, score, row_number() OVER (PARTITION BY days, list ORDER BY score DESC, pubkey) AS rn FROM (SELECT days, 'trending' AS list, pubkey, score FROM {disc_profile_score} WHERE score > 0 UNION ALL SELECT days, 'rising', pubkey, score FROM {disc_profile_rising} WHERE score > 0) u) r WHERE rn <= 30""")
_rank = "count(DISTINCT author) AS authors, round(count(DISTINCT author) / count(*), 6) AS diversity, count(*) AS events"
define("disc_trending_hashtags", "Hashtags of the last week by authors, diversity, events and name.", f"""
SELECT tag, {_rank} FROM {{hashtags}} h CROSS JOIN {{post_now}} p WHERE h.ts > p.as_of - INTERVAL 7 DAYS GROUP BY tag ORDER BY authors DESC, diversity DESC, events DESC, tag LIMIT 50""")
define("disc_trending_domains", "Domains of links by authors, diversity, links and name, with links, pages and authors of a day, a week and a month.", """
SELECT domain, count(DISTINCT author) AS authors, round(count(DISTINCT author) / count(*), 6) AS diversity, count(*) AS events, count(DISTINCT id) AS notes, count(DISTINCT CASE WHEN ts > as_of - INTERVAL 1 DAY THEN id END) AS notes_24h, @count_if(ts > as_of - INTERVAL 7 DAYS) AS links_7d,
  count(DISTINCT CASE WHEN ts > as_of - INTERVAL 7 DAYS THEN id END) AS notes_7d, count(DISTINCT CASE WHEN ts > as_of - INTERVAL 7 DAYS THEN author END) AS authors_7d, count(DISTINCT CASE WHEN ts > as_of - INTERVAL 30 DAYS THEN id END) AS notes_30d
FROM {links} l CROSS JOIN (SELECT max(ts) AS as_of FROM {links}) a WHERE domain <> '' GROUP BY domain ORDER BY authors DESC, diversity DESC, events DESC, domain LIMIT 50""")
define("disc_per_language", "The five leading hashtags and linking hosts of each language, and its posts and authors.", """
SELECT lang, list, item, authors, events, rn FROM (SELECT lang, list, item, authors, events, row_number() OVER (PARTITION BY lang, list ORDER BY authors DESC, events DESC, item) AS rn FROM (
  SELECT lang, 'hashtag' AS list, tag AS item, count(DISTINCT author) AS authors, count(*) AS events FROM {hashtags} GROUP BY lang, tag
  UNION ALL SELECT p.lang, 'domain', k.domain, count(DISTINCT k.author), count(*) FROM {links} k JOIN {posts} p ON k.id = p.id WHERE k.domain <> '' GROUP BY p.lang, k.domain
  UNION ALL SELECT lang, 'volume', 'posts', count(DISTINCT author), count(*) FROM {posts} GROUP BY lang) g) r WHERE rn <= 5""")
define("disc_hashtag_summary", "Counts of each hashtag over a day, a week and all, first and last time.", """
SELECT tag, @count_if(h.ts > p.as_of - INTERVAL 1 DAY) AS day, @count_if(h.ts > p.as_of - INTERVAL 7 DAYS) AS week, count(*) AS n, min(h.ts) AS first_at, max(h.ts) AS last_at FROM {hashtags} h CROSS JOIN {post_now} p GROUP BY tag""")
define("disc_related_hashtags", "The five hashtags that go most often with each of the 20 leading ones, in its newest 500 posts of 30 days.", """
SELECT seed, tag, n, rn FROM (SELECT seed, tag, n, row_number() OVER (PARTITION BY seed ORDER BY n DESC, tag) AS rn FROM (
  SELECT a.seed, b.tag, count(*) AS n FROM (SELECT seed, id FROM (SELECT h.tag AS seed, h.id, row_number() OVER (PARTITION BY h.tag ORDER BY h.ts DESC, h.id DESC) AS rn FROM {hashtags} h JOIN (SELECT tag FROM {disc_trending_hashtags} ORDER BY authors DESC, diversity DESC, events DESC, tag LIMIT 20) s ON h.tag = s.tag CROSS JOIN {post_now} p
    WHERE h.ts > p.as_of - INTERVAL 30 DAYS) x WHERE rn <= 500) a JOIN {hashtags} b ON a.id = b.id AND a.seed <> b.tag GROUP BY a.seed, b.tag) g) r WHERE rn <= 5""")
define("disc_entity_notes", "The newest five posts of each hashtag and pages of each domain, and the five of each hashtag with most hashtags.", """
SELECT list, item, id, rn FROM (SELECT 'hashtag' AS list, tag AS item, id, row_number() OVER (PARTITION BY tag ORDER BY ts DESC, id DESC) AS rn FROM {hashtags}
UNION ALL SELECT 'domain', domain, id, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, id DESC) FROM (SELECT DISTINCT domain, id, ts FROM {links} WHERE domain <> '') d
UNION ALL SELECT 'top', h.tag, h.id, row_number() OVER (PARTITION BY h.tag ORDER BY n.n DESC, h.id DESC) FROM {hashtags} h JOIN (SELECT id, count(*) AS n FROM {hashtags} GROUP BY id) n ON h.id = n.id) r WHERE rn <= 5""")
define("disc_domain_summary", "Links, pages and hosts of each domain in all, in a week and in a month, its first and last time, and the host that links it most.", """
SELECT d.domain, d.links, d.pages, d.hosts, d.links_7d, d.links_30d, d.first_at, d.last_at, t.author AS top_host, t.n AS top_links FROM (SELECT domain, count(*) AS links, count(DISTINCT id) AS pages, count(DISTINCT author) AS hosts, @count_if(ts > as_of - INTERVAL 7 DAYS) AS links_7d, @count_if(ts > as_of - INTERVAL 30 DAYS) AS links_30d, min(ts) AS first_at, max(ts) AS last_at
  FROM {links} CROSS JOIN (SELECT max(ts) AS as_of FROM {links}) a WHERE domain <> '' GROUP BY domain) d JOIN (SELECT domain, author, n FROM (SELECT domain, author, n, row_number() OVER (PARTITION BY domain ORDER BY n DESC, author) AS rn FROM (SELECT domain, author, count(*) AS n FROM {links} GROUP BY domain, author) g) r WHERE rn = 1) t ON d.domain = t.domain""")
define("disc_related_profiles", "For each author the ten with the highest score of shared hashtags, replies, reactions and reposts either way in 30 days, each capped and the 150 strongest a reason; only of the trusted, if there are any.", """
SELECT one, two, topics, replies, reactions, reposts, reasons, score, rn FROM (SELECT g.*, row_number() OVER (PARTITION BY one ORDER BY score DESC, reposts DESC, replies DESC, topics DESC, reactions DESC, two) AS rn FROM (
  SELECT u.one, u.two, @isum(CASE WHEN reason = 'topics' THEN n ELSE 0 END) AS topics, @isum(CASE WHEN reason = 'replies' THEN n ELSE 0 END) AS replies, @isum(CASE WHEN reason = 'reactions' THEN n ELSE 0 END) AS reactions, @isum(CASE WHEN reason = 'reposts' THEN n ELSE 0 END) AS reposts, @joined(reason) AS reasons,
    @isum(CASE reason WHEN 'topics' THEN least(80, 6 * n) WHEN 'replies' THEN least(90, 10 * n) WHEN 'reactions' THEN least(70, 8 * n) ELSE least(100, 12 * n) END + 1) AS score
  FROM (SELECT one, two, reason, n FROM (SELECT one, two, reason, n, row_number() OVER (PARTITION BY one, reason ORDER BY n DESC, two) AS rn FROM (
    SELECT s.pubkey AS one, c.pubkey AS two, 'topics' AS reason, @isum(c.n) AS n FROM {author_tags} s JOIN {author_tags} c ON s.tag = c.tag AND s.pubkey <> c.pubkey WHERE s.side = 'seed' AND c.side = 'candidate' GROUP BY s.pubkey, c.pubkey
    UNION ALL SELECT one, two, reason, count(*) FROM (SELECT author AS one, actor AS two, created_at, CASE relation WHEN 'reply' THEN 'replies' WHEN 'reaction' THEN 'reactions' ELSE 'reposts' END AS reason FROM {acts} WHERE actor <> author AND relation IN ('reply', 'reaction', 'repost')
      UNION ALL SELECT actor, author, created_at, CASE relation WHEN 'reply' THEN 'replies' WHEN 'reaction' THEN 'reactions' ELSE 'reposts' END FROM {acts} WHERE actor <> author AND relation IN ('reply', 'reaction', 'repost')) b CROSS JOIN {present} p WHERE created_at > @unix(p.as_of) - 2592000 GROUP BY one, two, reason) n) r WHERE rn <= 150) u
  LEFT JOIN {trusted_users} t ON u.two = t.pubkey CROSS JOIN (SELECT count(*) AS n_trusted FROM {trusted_users}) g WHERE n_trusted = 0 OR t.pubkey IS NOT NULL GROUP BY u.one, u.two) g) r WHERE rn <= 10""")
define("disc_related_notes", "For each note the ten with the highest score of shared hashtags (with the newest 200 notes of each), same author, reposts and neighbours in its thread.", """
SELECT one, two, reasons, score, rn FROM (SELECT one, two, reasons, score, row_number() OVER (PARTITION BY one ORDER BY score DESC, two) AS rn FROM (SELECT one, two, @joined(reason) AS reasons, @isum(score) AS score FROM (
  SELECT a.event_id AS one, c.event_id AS two, 'hashtag' AS reason, 30 + 5 * count(*) AS score FROM {norm_tag_hashtags} a JOIN (SELECT tag, event_id FROM (SELECT h.tag, h.event_id, row_number() OVER (PARTITION BY h.tag ORDER BY n.created_at DESC, n.id DESC) AS rn FROM {norm_tag_hashtags} h JOIN {notes} n ON h.event_id = n.id) r WHERE rn <= 200) c ON a.tag = c.tag AND a.event_id <> c.event_id GROUP BY a.event_id, c.event_id
  UNION ALL SELECT n.id, b.id, 'author', 20 + least(20, b.engaged) FROM {notes} n JOIN {best_of_author} b ON n.pubkey = b.pubkey AND n.id <> b.id
  UNION ALL SELECT one, two, 'repost', max(score) FROM (SELECT target_id AS one, id AS two, 50 AS score FROM {repost_notes} UNION ALL SELECT id, target_id, 45 FROM {repost_notes}) l GROUP BY one, two
  UNION ALL SELECT one, two, 'thread', max(score) FROM (SELECT parent AS one, child AS two, 35 AS score FROM {thr_edges} WHERE NOT parent_missing UNION ALL SELECT child, parent, 30 FROM {thr_edges} WHERE NOT parent_missing) t GROUP BY one, two) u GROUP BY one, two) g) r WHERE rn <= 10""",
    ("notes", "norm_tag_hashtags", "best_of_author", "repost_notes", "thr_edges"), lambda **frames: cut(related_notes(**frames)))
define("disc_paid_rankings", "Support of each receiver in 30 days, a year and all time: at most 100000 sats a sender, own payments left out; with the largest supporter, ties by name.", """
SELECT days, receiver, @isum(least(sats, 100000)) AS support, count(*) AS senders, @isum(sats) AS sats, @first_by(sender, -sats) AS supporter FROM (
  SELECT w.days, p.receiver, p.sender, @isum(p.sats) AS sats FROM {payments} p CROSS JOIN (SELECT 30 AS days UNION ALL SELECT 365 UNION ALL SELECT 100000) w CROSS JOIN (SELECT max(ts) AS as_of FROM {payments}) m WHERE p.sender <> p.receiver AND @days(@date(m.as_of), @date(p.ts)) < w.days GROUP BY w.days, p.receiver, p.sender) s GROUP BY days, receiver""")
define("disc_most_followed", "The 30 profiles with most followers.", "SELECT profile, followers FROM {fact_follower_edges} ORDER BY followers DESC, profile LIMIT 30")
define("disc_trust_filter", "The week's trending notes in three modes: all in order, the trusted lifted by ten places, the trusted only.", """
SELECT mode, id, rn, trusted, row_number() OVER (PARTITION BY mode ORDER BY rn - CASE WHEN trusted AND mode = 'prefer_trusted' THEN 10 ELSE 0 END, rn) AS place FROM (
  SELECT m.mode, s.id, s.rn, t.pubkey IS NOT NULL AS trusted FROM (SELECT id, row_number() OVER (ORDER BY score_7d DESC, id DESC) AS rn FROM {disc_trending_notes}) s JOIN {notes} n ON s.id = n.id LEFT JOIN {trusted_users} t ON n.pubkey = t.pubkey CROSS JOIN (SELECT 'all' AS mode UNION ALL SELECT 'prefer_trusted' UNION ALL SELECT 'trusted_only') m) r WHERE mode <> 'trusted_only' OR trusted""")
define("disc_trust_candidates", "Scored notes and profiles with their author's trust.", """
SELECT 'note' AS entity, s.days, s.id AS key, s.score, t.hops, coalesce(w.weight, 0e0) AS weight FROM {disc_note_score} s JOIN {notes} n ON s.id = n.id LEFT JOIN {trusted_users} t ON n.pubkey = t.pubkey LEFT JOIN {disc_engager_weight} w ON n.pubkey = w.pubkey
UNION ALL SELECT 'profile', s.days, s.pubkey, s.score, t.hops, coalesce(w.weight, 0e0) FROM {disc_profile_score} s LEFT JOIN {trusted_users} t ON s.pubkey = t.pubkey LEFT JOIN {disc_engager_weight} w ON s.pubkey = w.pubkey""")
define("disc_personal_cohort", "Whom each viewer follows, at most 50: the newest edges first.", "SELECT viewer, other, rn FROM (SELECT follower AS viewer, followed AS other, row_number() OVER (PARTITION BY follower ORDER BY since DESC, followed) AS rn FROM {contacts} WHERE follower <> followed) r WHERE rn <= 50")
define("disc_personal_notes", "For each viewer the 20 notes with the highest engagement of the cohort: three a reply, two a repost or payment, one a reaction, each kind of act once an actor.", """
SELECT viewer, target_id, score, people, rn FROM (SELECT viewer, target_id, score, people, row_number() OVER (PARTITION BY viewer ORDER BY score DESC, people DESC, target_id DESC) AS rn FROM (
  SELECT viewer, target_id, CAST(sum(weight) AS DOUBLE) AS score, count(DISTINCT actor) AS people FROM (SELECT DISTINCT c.viewer, a.target_id, a.actor, CASE a.relation WHEN 'reply' THEN 3 WHEN 'repost' THEN 2 WHEN 'zap' THEN 2 WHEN 'reaction' THEN 1 ELSE 0 END AS weight, a.relation FROM {disc_personal_cohort} c JOIN {recent_acts} a ON a.actor = c.other WHERE a.author <> c.viewer) d GROUP BY viewer, target_id) g WHERE score > 0) r WHERE rn <= 20""")
define("disc_blend", "For each viewer the 20 best of the cohort's notes and the 50 trending ones: seven tenths of the cohort's score, three of the other, each over its maximum among them; ties by people, then id.", """
SELECT viewer, id, blended, people, rn FROM (SELECT viewer, id, round(blended, 6) AS blended, people, row_number() OVER (PARTITION BY viewer ORDER BY blended DESC, people DESC, id) AS rn FROM (
  SELECT m.viewer, m.id, m.people, 7e-1 * CASE WHEN x.cohort > 0 THEN m.cohort / x.cohort ELSE 0e0 END + 3e-1 * CASE WHEN x.global_ > 0 THEN m.global_ / x.global_ ELSE 0e0 END AS blended FROM (
    SELECT viewer, id, max(cohort) AS cohort, max(global_) AS global_, max(people) AS people FROM {blend_rows} GROUP BY viewer, id) m JOIN (SELECT viewer, max(cohort) AS cohort, max(global_) AS global_ FROM {blend_rows} GROUP BY viewer) x ON m.viewer = x.viewer) b) r WHERE rn <= 20""")
define("disc_home", "Leading notes, conversations, profiles, hashtags and domains of each window under one heading each.", """
SELECT days, 'notes' AS section, @str(id) AS item, CAST(score AS DOUBLE) AS value FROM {disc_trending_lists} WHERE list = 'all' AND rn <= 20 UNION ALL SELECT days, 'conversations', @str(root), CAST(velocity AS DOUBLE) FROM {thr_hot} WHERE rn <= 20 UNION ALL SELECT days, list, @str(pubkey), CAST(score AS DOUBLE) FROM {disc_trending_profiles} WHERE rn <= 20
UNION ALL SELECT 7, 'hashtags', tag, CAST(authors AS DOUBLE) FROM {disc_trending_hashtags} UNION ALL SELECT 30, 'domains', domain, CAST(authors AS DOUBLE) FROM {disc_trending_domains}""")
define("disc_bookmarked", "The 30 notes in most users' newest bookmark lists.", "SELECT id, users FROM {state_bookmarks} ORDER BY users DESC, id LIMIT 30")
define("disc_trending_lists", "Leading notes of each window: 50 of all, of each language and of those with media, with the score after which the next page begins.", """
SELECT days, list, id, score, rn, lag(score) OVER (PARTITION BY days, list ORDER BY rn) AS after_score FROM (SELECT days, list, id, score, row_number() OVER (PARTITION BY days, list ORDER BY score DESC, id DESC) AS rn FROM (
  SELECT days, 'all' AS list, id, score FROM {disc_note_score} WHERE score > 0 UNION ALL SELECT s.days, l.code, s.id, s.score FROM {disc_note_score} s JOIN {lang_tags} l ON s.id = l.id WHERE s.score > 0
  UNION ALL SELECT s.days, 'media', s.id, s.score FROM {disc_note_score} s JOIN (SELECT DISTINCT event_id FROM {tags} WHERE name = 'url') m ON s.id = m.event_id WHERE s.score > 0) u) r WHERE rn <= 50""")
define("disc_profile_windows", "Per author and window: posts, replies, active days, distinct others who engage, sats received, last activity.", """
SELECT n.days, n.pubkey, n.posts, n.replies, n.active_days, n.last_at, coalesce(e.engaged, 0) AS engaged, coalesce(e.sats, 0) AS sats FROM (
  SELECT w.days, n.pubkey, count(*) AS posts, count(x.child) AS replies, count(DISTINCT @date(n.ts)) AS active_days, max(n.created_at) AS last_at FROM {notes} n LEFT JOIN {thr_edges} x ON n.id = x.child CROSS JOIN {windows} w CROSS JOIN {present} p WHERE n.created_at > @unix(p.as_of) - w.days * 86400 GROUP BY w.days, n.pubkey) n
LEFT JOIN (SELECT w.days, a.author, count(DISTINCT a.actor) AS engaged, @isum(a.sats) AS sats FROM {acts} a CROSS JOIN {windows} w CROSS JOIN {present} p WHERE a.actor <> a.author AND a.created_at > @unix(p.as_of) - w.days * 86400 GROUP BY w.days, a.author) e ON n.days = e.days AND n.pubkey = e.author""", kept=True)
define("new_followers", "New followers of each profile in each window, by when the newest list that names it was made.", "SELECT w.days, c.followed, count(*) AS n FROM {contacts} c CROSS JOIN {windows} w CROSS JOIN {present} p WHERE c.since > @unix(p.as_of) - w.days * 86400 GROUP BY w.days, c.followed")
define("author_tags", "Uses of each author's hashtags in 30 days: its newest 200 notes' 30 most frequent as seeds, and the 150 authors that use a hashtag most as candidates.", """
SELECT side, tag, pubkey, n FROM (SELECT 'seed' AS side, tag, pubkey, n, row_number() OVER (PARTITION BY pubkey ORDER BY n DESC, tag) AS rn, 30 AS most FROM (SELECT h.tag, r.pubkey, count(*) AS n FROM {norm_tag_hashtags} h JOIN (SELECT id, pubkey FROM (SELECT n.id, n.pubkey, row_number() OVER (PARTITION BY n.pubkey ORDER BY n.created_at DESC, n.id DESC) AS rn FROM {notes} n CROSS JOIN {present} p WHERE n.ts > p.as_of - INTERVAL 30 DAYS) x WHERE rn <= 200) r ON h.event_id = r.id GROUP BY h.tag, r.pubkey) s
UNION ALL SELECT 'candidate', tag, pubkey, n, row_number() OVER (PARTITION BY tag ORDER BY n DESC, pubkey), 150 FROM (SELECT h.tag, n.pubkey, count(*) AS n FROM {norm_tag_hashtags} h JOIN {notes} n ON h.event_id = n.id CROSS JOIN {present} p WHERE n.ts > p.as_of - INTERVAL 30 DAYS GROUP BY h.tag, n.pubkey) c) u WHERE rn <= most""")
define("best_of_author", "The 30 notes of each author of highest weekly score, then the newest.", """
SELECT pubkey, id, engaged FROM (SELECT n.pubkey, n.id, s.replies + s.reposts + s.reactions + s.zaps AS engaged, row_number() OVER (PARTITION BY n.pubkey ORDER BY s.score_7d DESC, n.created_at DESC, n.id) AS rn FROM {notes} n JOIN {disc_note_stats} s ON n.id = s.id) r WHERE rn <= 30""")
define("repost_notes", "Notes that quote another one: id, target_id.", "SELECT DISTINCT q.event_id AS id, n.id AS target_id FROM {ref_quotes} q JOIN {notes} n ON q.target = @str(n.id) WHERE q.kind = 'id' AND q.event_id <> n.id")
define("disc_paid_notes", "The 50 notes of each window with most sats, ties by payments, then id.", """
SELECT days, target_id, sats, n, rn FROM (SELECT days, target_id, sats, n, row_number() OVER (PARTITION BY days ORDER BY sats DESC, n DESC, target_id) AS rn FROM (SELECT w.days, a.target_id, @isum(a.sats) AS sats, count(*) AS n FROM {acts} a CROSS JOIN {windows} w CROSS JOIN {present} p WHERE a.relation = 'zap' AND a.actor <> a.author AND a.created_at > @unix(p.as_of) - w.days * 86400 GROUP BY w.days, a.target_id) z) r WHERE rn <= 50""")
define("recent_acts", "Each actor's newest 200 acts of 30 days on others' notes: what a viewer's cohort is read from.", """
SELECT actor, author, target_id, relation, sats FROM (SELECT a.*, row_number() OVER (PARTITION BY actor ORDER BY a.created_at DESC, source_id DESC) AS rn FROM {acts} a CROSS JOIN {present} p WHERE a.actor <> a.author AND a.created_at > @unix(p.as_of) - 2592000) r WHERE rn <= 200""")
define("blend_rows", "Rows of both lists for each viewer: viewer, id, cohort, global_, people.", """
SELECT viewer, target_id AS id, score AS cohort, 0e0 AS global_, people FROM {disc_personal_notes} UNION ALL SELECT v.viewer, t.id, 0e0, t.score_7d, 0 FROM (SELECT DISTINCT viewer FROM {disc_personal_cohort}) v CROSS JOIN {disc_trending_notes} t""")
