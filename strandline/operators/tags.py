"""References, attributes and lists that tags carry, profiles' fields, relay lists and languages."""

from __future__ import annotations

from ..plans.template import define

define("ingest_expand_tags", "Tags of the allowed names with their places; contact lists' p tags and relay lists' r tags are left out.", """
SELECT event_id, kind, idx, name, value FROM (SELECT event_id, 1 AS kind, idx, name, value FROM {tags} UNION ALL SELECT event_id, kind, idx, name, value FROM {state_items}) t
WHERE name IN ('a', 'd', 'e', 'ends', 'g', 'group', 'image', 'imeta', 'm', 'p', 'r', 'series', 'starts', 'status', 'summary', 't', 'thumb', 'title', 'u', 'url', 'video', 'word') AND NOT (kind = 3 AND name = 'p') AND NOT (kind = 10002 AND name = 'r')""")
define("ingest_expired_filter", "Notes whose expiration has not come.", """
SELECT n.id FROM {notes} n LEFT JOIN (SELECT event_id, CAST(value AS BIGINT) AS until FROM {tags} WHERE name = 'expiration') x ON n.id = x.event_id CROSS JOIN {present} p WHERE x.until IS NULL OR x.until > @unix(p.as_of)""")
define("ref_etag_relations", "Relation of each e-tag: its marker in lower case; without one the first is root if no tag is, the last reply if no tag is and there are several, else mention.", """
SELECT event_id, target, idx, CASE WHEN marker <> '' THEN marker WHEN roots = 0 AND up = 1 THEN 'root' WHEN replies = 0 AND bare > 1 AND down = 1 THEN 'reply' ELSE 'mention' END AS relation FROM (
  SELECT event_id, value AS target, idx, lower(marker) AS marker, sum(CASE WHEN lower(marker) = 'root' THEN 1 ELSE 0 END) OVER (PARTITION BY event_id) AS roots,
    sum(CASE WHEN lower(marker) = 'reply' THEN 1 ELSE 0 END) OVER (PARTITION BY event_id) AS replies, sum(CASE WHEN marker = '' THEN 1 ELSE 0 END) OVER (PARTITION BY event_id) AS bare,
    row_number() OVER (PARTITION BY event_id, marker = '' ORDER BY idx) AS up, row_number() OVER (PARTITION BY event_id, marker = '' ORDER BY idx DESC) AS down FROM {tags} WHERE name = 'e') t""")
define("thr_parent", "Parent of each note: its first reply, else its first root; root, else the parent.", """
SELECT event_id, coalesce(reply, root) AS parent, coalesce(root, reply) AS root FROM (SELECT event_id, min_by(target, CASE WHEN relation = 'reply' THEN idx END) AS reply, min_by(target, CASE WHEN relation = 'root' THEN idx END) AS root FROM {ref_etag_relations} GROUP BY event_id) r WHERE coalesce(reply, root) IS NOT NULL""")
define("ref_address", "Parts of each address: kind, author, identifier.", "SELECT event_id, CAST(split_part(value, ':', 1) AS INT) AS kind, split_part(value, ':', 2) AS author, split_part(value, ':', 3) AS identifier FROM {tags} WHERE name = 'a' AND @matches(value, '^[0-9]+:[^:]+:')")
define("ref_quotes", "Quoted targets by id or by address.", "SELECT event_id, CASE WHEN @matches(value, '^[0-9]+$') THEN 'id' ELSE 'address' END AS kind, value AS target FROM {tags} WHERE name = 'q'")
define("cnt_quotes", "Distinct notes that quote each target.", "SELECT target, count(DISTINCT event_id) AS n FROM {ref_quotes} GROUP BY target")
define("ref_comments", "Comments: root by id or address of the first E or A tag, parent by that of the first e or a tag.", """
SELECT event_id, root, root_by, parent, parent_by FROM (SELECT event_id, @first_by(CASE WHEN name IN ('E', 'A') THEN value END, CASE WHEN name IN ('E', 'A') THEN idx ELSE 1000 + idx END) AS root, max(CASE WHEN name = 'A' THEN 'address' WHEN name = 'E' THEN 'id' END) AS root_by,
  @first_by(CASE WHEN name IN ('e', 'a') THEN value END, CASE WHEN name IN ('e', 'a') THEN idx ELSE 1000 + idx END) AS parent, CASE WHEN min(CASE WHEN name = 'e' THEN idx END) < coalesce(min(CASE WHEN name = 'a' THEN idx END), 1000) THEN 'id' ELSE 'address' END AS parent_by
  FROM {tags} WHERE name IN ('E', 'A', 'e', 'a') GROUP BY event_id) c WHERE root IS NOT NULL""")
define("cnt_comments", "Comments of each target by distinct source: as the root or the parent, by id or by address.", """
SELECT target, count(DISTINCT event_id) AS n, count(DISTINCT CASE WHEN side = 'root' THEN event_id END) AS as_root FROM (SELECT root AS target, event_id, 'root' AS side FROM {ref_comments} UNION ALL SELECT parent, event_id, 'parent' FROM {ref_comments} WHERE parent IS NOT NULL) u GROUP BY target""")
define("ref_reports", "Reports with target, its author and type.", "SELECT a.source_id, a.target_id, a.author, t.type FROM {acts} a JOIN {report_types} t ON a.source_id = t.source_id WHERE a.relation = 'report'")
define("attr_event_attributes", "What single tags of a note say: client, expiry, warning, bridge's protocol, work asked and done, target kind, subject, alternative text, publication, splits.", """
SELECT event_id, client, expires_at, warned, protocol, pow_target, 4 * zeros + CASE WHEN substring(hash, zeros + 1, 1) = '1' THEN 3 WHEN substring(hash, zeros + 1, 1) IN ('2', '3') THEN 2 WHEN substring(hash, zeros + 1, 1) IN ('4', '5', '6', '7') THEN 1 ELSE 0 END AS pow_bits, target_kind, subject, alt, published_at, splits FROM (
  SELECT event_id, max(CASE WHEN name = 'client' THEN value END) AS client, max(CASE WHEN name = 'expiration' AND @matches(value, '^[0-9]+$') THEN @num(value) END) AS expires_at, bool_or(name = 'content-warning') AS warned,
    max(CASE WHEN name = 'proxy' THEN lower(hint) END) AS protocol, max(CASE WHEN name = 'nonce' AND @matches(hint, '^[0-9]+$') THEN @num(hint) END) AS pow_target, max(CASE WHEN name = 'k' AND @matches(value, '^[0-9]+$') THEN @num(value) END) AS target_kind,
    max(CASE WHEN name = 'subject' THEN trim(value) END) AS subject, max(CASE WHEN name = 'alt' THEN value END) AS alt, max(CASE WHEN name = 'published_at' AND @matches(value, '^[0-9]+$') THEN @num(value) END) AS published_at, @count_if(name = 'zap') AS splits,
    @sha256(@str(event_id)) AS hash, length(regexp_extract(@sha256(@str(event_id)), '^(0*)', 1)) AS zeros FROM {tags} GROUP BY event_id) a""")
define("attr_self_labels", "Namespace and label that authors give their notes; a label without namespace has that of the note's only L tag, else ugc.", """
SELECT l.event_id, CASE WHEN l.hint <> '' THEN lower(l.hint) WHEN n.names = 1 THEN n.namespace ELSE 'ugc' END AS namespace, lower(trim(l.value)) AS label FROM {tags} l
LEFT JOIN (SELECT event_id, count(DISTINCT value) AS names, min(lower(value)) AS namespace FROM {tags} WHERE name = 'L' GROUP BY event_id) n ON l.event_id = n.event_id WHERE l.name = 'l'""")
define("attr_emoji", "Custom emoji by day, each once an event.", "SELECT @date(ts) AS day, @replace_all(value, ':', '') AS shortcode, count(DISTINCT event_id) AS n FROM {tags} WHERE name = 'emoji' GROUP BY 1, 2")
define("norm_relay_url", "Relay addresses in one form: scheme and host in lower case, no path of a single slash, no query, fragment or user; hosts of the machine itself and of private networks are none.", """
SELECT relay, key, n FROM (SELECT relay, substring(@sha256(relay), 1, 32) AS key, count(*) AS n FROM (
  SELECT concat(lower(regexp_extract(raw, '^([A-Za-z]+)://', 1)), '://', lower(regexp_extract(raw, '^[A-Za-z]+://([^/?#]+)', 1)), CASE WHEN regexp_extract(raw, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) = '/' THEN '' ELSE regexp_extract(raw, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) END) AS relay
  FROM (SELECT trim(hint) AS raw FROM {tags} WHERE name IN ('e', 'p')) h WHERE @matches(raw, '^([Ww][Ss][Ss]?)://[^/?#@]+[^?#]*$')) r
WHERE NOT @matches(relay, '^wss?://(localhost|127[.][0-9.]+|10[.][0-9.]+|192[.]168[.][0-9.]+|172[.](1[6-9]|2[0-9]|3[01])[.][0-9.]+|169[.]254[.][0-9.]+|0[.]0[.]0[.]0|.[:][:]1.)([:/]|$)') GROUP BY relay) g""")
define("attr_relay_hints", "Valid relay hints in e and p tags by day.", """
SELECT day, relay, count(*) AS n FROM (SELECT @date(ts) AS day, regexp_replace(lower(trim(hint)), '/$', '') AS relay FROM {tags} WHERE name IN ('e', 'p') AND @matches(lower(trim(hint)), '^wss?://[a-z0-9.-]+(:[0-9]+)?(/[^?#]*)?$')
  AND NOT @matches(lower(trim(hint)), '^wss?://(localhost|127[.]|10[.]|192[.]168[.]|169[.]254[.])')) h GROUP BY day, relay""")
define("norm_tag_hashtags", "Hashtags of tags: trimmed, lower case, without marks, of up to 64 letters, digits, underscores and hyphens, the first a letter or digit, and not of digits alone; each once an event.", "SELECT DISTINCT event_id, tag FROM (SELECT event_id, lower(@replace_all(trim(value), '^#+', '')) AS tag FROM {tags} WHERE name = 't') t WHERE @matches(tag, '^[a-z0-9][a-z0-9_-]{0,63}$') AND NOT @matches(tag, '^[0-9]+$')")
define("eco_client_daily", "Notes and authors by client and day.", "SELECT value AS client, @date(ts) AS day, count(*) AS n, count(DISTINCT pubkey) AS authors FROM {tags} WHERE name = 'client' GROUP BY value, @date(ts)")
define("eco_content_flags", "Notes by day: all, with a warning, expiring, from a bridge by its protocol, and with the work that they claim.", """
SELECT @date(n.ts) AS day, count(*) AS notes, @count_if(a.warned) AS warned, @count_if(a.expires_at IS NOT NULL) AS expiring, @count_if(a.protocol IN ('activitypub', 'atproto', 'rss', 'web')) AS bridged, @count_if(a.protocol = 'activitypub') AS activitypub, @count_if(a.protocol = 'rss') AS rss,
  @count_if(a.pow_target > 0 AND a.pow_bits >= a.pow_target) AS pow_met FROM {notes} n JOIN {attr_event_attributes} a ON n.id = a.event_id GROUP BY @date(n.ts)""")
define("eco_interests", "Authors whose newest interest list names each hashtag.", "SELECT lower(i.value) AS tag, count(DISTINCT i.pubkey) AS subscribers FROM {state_items} i JOIN {state_replaceable} r ON i.event_id = r.id WHERE i.kind = 10015 AND i.name = 't' GROUP BY lower(i.value)")
define("state_addressable", "Current event of each address: the newest of its kind, author and identifier, ties by larger id; with the addresses that notes name.", """
SELECT r.kind, r.pubkey, r.d, r.id, r.created_at, coalesce(t.n, 0) AS named FROM {state_replaceable} r LEFT JOIN (SELECT value, count(*) AS n FROM {tags} WHERE name = 'a' GROUP BY value) t ON t.value = concat(@str(r.kind), ':', @str(r.pubkey), ':', r.d) WHERE r.kind >= 30000""")
define("state_pins", "Items of each author's newest pin list, in order, with the event if it is known.", """
SELECT i.pubkey, row_number() OVER (PARTITION BY i.pubkey ORDER BY i.idx) AS place, i.value AS item, e.kind FROM {state_items} i JOIN {state_replaceable} r ON i.event_id = r.id LEFT JOIN {ev} e ON i.value = @str(e.id) WHERE i.kind = 10001 AND i.name = 'e'""")
define("state_user_status", "Newest status of each author and identifier that has not expired (a status lasts n days, without end if n is 0).", """
SELECT pubkey, d, id, created_at FROM (SELECT s.*, row_number() OVER (PARTITION BY s.pubkey, s.d ORDER BY s.created_at DESC, s.id DESC) AS rn FROM {states} s WHERE s.kind = 30315) r CROSS JOIN {present} p WHERE rn = 1 AND (n = 0 OR created_at + n * 86400 > @unix(p.as_of))""")
define("norm_zap_amount", "Sats of each receipt: the amount tag's, else the description's amount, else the invoice's prefix; of several the first above 0, in whole sats, else 0.", """
SELECT source_id, CASE WHEN tagged > 0 THEN tagged WHEN described > 0 THEN described WHEN billed > 0 THEN billed ELSE 0 END AS sats, CASE WHEN tagged > 0 THEN 'tag' WHEN described > 0 THEN 'description' WHEN billed > 0 THEN 'invoice' ELSE 'none' END AS source FROM (
  SELECT source_id, @div(CASE WHEN @matches(trim(amount), '^[0-9]{1,18}$') THEN CAST(trim(amount) AS BIGINT) ELSE 0 END, 1000) AS tagged,
    @div(CASE WHEN @matches(regexp_extract(description, '"amount", "([0-9]{1,18})"', 1), '^[0-9]+$') THEN CAST(regexp_extract(description, '"amount", "([0-9]{1,18})"', 1) AS BIGINT) ELSE 0 END, 1000) AS described,
    CASE unit WHEN 'm' THEN digits * 100000 WHEN 'u' THEN digits * 100 WHEN 'n' THEN @div(digits, 10) WHEN 'p' THEN @div(digits, 10000) ELSE digits * 100000000 END AS billed
  FROM (SELECT r.*, CASE WHEN @matches(lower(invoice), '^ln(bcrt|bc|tb)[0-9]{1,12}[munp]?1') THEN CAST(regexp_extract(lower(invoice), '^ln(bcrt|bc|tb)([0-9]+)[munp]?1', 2) AS BIGINT) ELSE 0 END AS digits, regexp_extract(lower(invoice), '^ln(bcrt|bc|tb)[0-9]+([munp]?)1', 2) AS unit FROM {receipts} r) i) a""")
define("norm_zap_sender", "Sender of each receipt: the description's author if it is a known key, else the P tag's, else the receipt's own.", """
SELECT source_id, CAST(CASE WHEN @matches(regexp_extract(description, '"pubkey": "([^"]*)"', 1), '^[0-9]+$') THEN regexp_extract(description, '"pubkey": "([^"]*)"', 1) WHEN @matches(p_tag, '^[0-9]+$') THEN p_tag ELSE @str(receipt_key) END AS BIGINT) AS sender,
  CASE WHEN @matches(regexp_extract(description, '"pubkey": "([^"]*)"', 1), '^[0-9]+$') THEN 'description' WHEN @matches(p_tag, '^[0-9]+$') THEN 'tag' ELSE 'receipt' END AS source FROM {receipts}""")
define("attr_profile_fields", "Fields of each newest profile document.", """
SELECT pubkey, trim(@json(doc, '$.name')) AS name, trim(@json(doc, '$.display_name')) AS display_name, lower(split_part(@json(doc, '$.nip05'), '@', 2)) AS nip05_domain, lower(trim(@json(doc, '$.lud16'))) AS ln_address, lower(split_part(@json(doc, '$.lud16'), '@', 2)) AS ln_domain,
  lower(regexp_extract(@json(doc, '$.website'), '^https?://(?:www[.])?([^/:]+)', 1)) AS site, coalesce(@json(doc, '$.bot'), 'false') = 'true' AS bot FROM {state_profiles_latest}""")
define("attr_ln_lookup", "For a table of payment addresses in any case the profile of each, the smallest if several have it, null if none.", """
SELECT q.address, min(f.pubkey) AS pubkey, count(f.pubkey) AS n FROM {ln_queries} q LEFT JOIN {attr_profile_fields} f ON lower(trim(q.address)) = f.ln_address GROUP BY q.address""")
define("attr_external_identities", "Platform and identity that notes' i tags claim, the first of a platform for each note.", """
SELECT event_id, platform, identity FROM (SELECT event_id, lower(split_part(value, ':', 1)) AS platform, regexp_replace(value, '^[^:]*:', '') AS identity, row_number() OVER (PARTITION BY event_id, lower(split_part(value, ':', 1)) ORDER BY idx) AS rn FROM {tags} WHERE name = 'i' AND @matches(value, '^[^:]+:.+')) r WHERE rn = 1""")
define("eco_identity", "The 50 leading domains of names, payment addresses and sites, with their share of the profiles that have one.", """
SELECT field, domain, n, round(n / all_, 6) AS share, rn FROM (SELECT d.field, d.domain, d.n, t.all_, row_number() OVER (PARTITION BY d.field ORDER BY d.n DESC, d.domain) AS rn FROM (
  SELECT field, domain, count(*) AS n FROM (SELECT 'nip05' AS field, nip05_domain AS domain FROM {attr_profile_fields} UNION ALL SELECT 'ln', ln_domain FROM {attr_profile_fields} UNION ALL SELECT 'site', site FROM {attr_profile_fields}) u WHERE domain <> '' GROUP BY field, domain) d
JOIN (SELECT 'nip05' AS field, @count_if(nip05_domain <> '') AS all_ FROM {attr_profile_fields} UNION ALL SELECT 'ln', @count_if(ln_domain <> '') FROM {attr_profile_fields} UNION ALL SELECT 'site', @count_if(site <> '') FROM {attr_profile_fields}) t ON d.field = t.field) r WHERE rn <= 50""")
define("state_profiles_latest", "Newest profile document of each author, ties by the larger document.", "SELECT pubkey, doc, updated_at FROM (SELECT p.*, row_number() OVER (PARTITION BY pubkey ORDER BY updated_at DESC, doc DESC) AS rn FROM {profiles} p) r WHERE rn = 1", kept=True)
define("srch_profiles", "For queries by names and numbers, the five best profiles: exact name, then prefix, then part.", """
SELECT q, pubkey, tier, rn FROM (SELECT q, pubkey, tier, row_number() OVER (PARTITION BY q ORDER BY tier, pubkey) AS rn FROM (
  SELECT w.q, f.pubkey, min(CASE WHEN lower(f.name) = w.q THEN 0 WHEN lower(f.name) LIKE concat(w.q, '%') THEN 1 ELSE 2 END) AS tier FROM (
    SELECT pubkey, name, e.x AS token FROM {attr_profile_fields}, @each_at(@words(@replace_all(lower(name), '[^a-z0-9]+', ' ')), e)) f JOIN {profile_lookups} w ON f.token = w.token GROUP BY w.q, f.pubkey) t) r WHERE rn <= 5""")
define("srch_identifier", "Events and profiles that an identifier names exactly: numbers, and hexadecimal digests of keys in any case.", """
SELECT q.q, 'event' AS entity, e.id, e.kind FROM (SELECT DISTINCT value AS q FROM {tags} WHERE name = 'q' AND @matches(value, '^[0-9]+$')) q JOIN {ev} e ON CAST(q.q AS BIGINT) = e.id
UNION ALL SELECT h.q, 'profile', p.pubkey, 0 FROM (SELECT DISTINCT upper(@sha256(@str(pubkey))) AS q FROM {notes}) h JOIN (SELECT pubkey, @sha256(@str(pubkey)) AS hex FROM {state_profiles_latest}) p ON lower(h.q) = p.hex""")
define("srch_query_class", "Class of each query: nothing to search, a single word, a host, words that are names, few matches, or text.", """
SELECT b.item_id, CASE WHEN trim(b.text) = '' OR NOT @matches(b.text, '[A-Za-z0-9]') THEN 'empty' WHEN NOT @matches(trim(b.text), '[ ]') AND @matches(lower(trim(b.text)), '^[a-z0-9-]+([.][a-z0-9-]+)+(/.*)?$') THEN 'host' WHEN NOT @matches(trim(b.text), '[ ]') THEN 'stub'
  WHEN @size(@extract_all(b.text, '[A-Z][a-z]+')) * 2 >= @size(@extract_all(b.text, '[A-Za-z]+')) THEN 'names' WHEN coalesce(m.found, 0) < 3 THEN 'weak' ELSE 'text' END AS class
FROM {benchmark} b LEFT JOIN (SELECT item_id, count(*) AS found FROM {srch_notes} WHERE shared >= 5 GROUP BY item_id) m ON b.item_id = m.item_id""")
define("rel_discovery", "Distinct users of each relay that newest lists name, ranked.", "SELECT relay, users, row_number() OVER (ORDER BY users DESC, relay) AS rank FROM (SELECT relay, count(DISTINCT pubkey) AS users FROM {relay_lists} GROUP BY relay) g")
define("rel_popular", "Relays that ten users or more list, by users, with whether the last quarter of the sightings' year saw them.", """
SELECT d.relay, d.users, s.last_at, coalesce(s.last_at > t.as_of - INTERVAL 90 DAYS, false) AS fresh FROM {rel_discovery} d LEFT JOIN (SELECT relay, max(seen_at) AS last_at FROM {sightings} GROUP BY relay) s ON d.relay = s.relay CROSS JOIN (SELECT max(seen_at) AS as_of FROM {sightings}) t WHERE d.users >= 10""")
define("rel_lists_daily", "Relay lists by day: how many, mean and median of their relays.", """
SELECT day, count(*) AS lists, round(avg(n), 6) AS mean, round(@quantile(n, 0.5), 6) AS p50 FROM (SELECT s.id, @date(s.ts) AS day, count(i.idx) AS n FROM {states} s LEFT JOIN {state_items} i ON s.id = i.event_id AND @matches(i.value, '^wss?://') WHERE s.kind = 10002 GROUP BY s.id, @date(s.ts)) l GROUP BY day""")
define("rel_software", "Relays by software and version, and those that support each feature.", """
SELECT d.software, d.version, count(*) AS relays, @isum(s.events) AS events, @count_if(d.features >= 2) AS searchable FROM {relay_documents} d JOIN (SELECT relay, count(*) AS events FROM {sightings} GROUP BY relay) s ON d.relay = s.relay GROUP BY d.software, d.version""")
define("state_relay_lists", "Newest relay list of each author: relays to read from, to write to, and all; a relay without marker is for both.", """
SELECT i.pubkey, count(*) AS n, @count_if(i.third IN ('', 'write')) AS writes, @count_if(i.third IN ('', 'read')) AS reads, @joined(CASE WHEN i.third IN ('', 'write') THEN i.value END) AS write_relays FROM {state_items} i JOIN {state_replaceable} r ON i.event_id = r.id
WHERE i.kind = 10002 AND i.name = 'r' AND @matches(i.value, '^wss?://') GROUP BY i.pubkey""")
define("eco_relay_refs", "Users whose newest list of each type names a relay.", """
SELECT relay, kind, count(DISTINCT pubkey) AS users FROM (SELECT regexp_replace(lower(i.value), '/$', '') AS relay, i.kind, i.pubkey FROM {state_items} i JOIN {state_replaceable} r ON i.event_id = r.id WHERE i.kind IN (10002, 10050) AND @matches(i.value, '^wss?://')) u GROUP BY relay, kind""")
define("trust_relay_votes", "Votes for relays of the 100 most trusted, weighted by score, with three supporters.", """
SELECT v.relay, v.score, v.voters, s.supporters FROM (SELECT relay, round(sum(score), 8) AS score, count(*) AS voters FROM (SELECT DISTINCT l.relay, t.pubkey, t.score FROM {relay_lists} l JOIN {trust_top} t ON l.pubkey = t.pubkey) d GROUP BY relay) v
JOIN (SELECT relay, @in_order(pubkey, rn) AS supporters FROM (SELECT relay, pubkey, row_number() OVER (PARTITION BY relay ORDER BY rank) AS rn FROM (SELECT DISTINCT l.relay, t.pubkey, t.rank FROM {relay_lists} l JOIN {trust_top} t ON l.pubkey = t.pubkey) d) r WHERE rn <= 3 GROUP BY relay) s ON v.relay = s.relay""")
define("trust_relay_suggestions", "Steps for relays: of those voted for, the five best that were seen for 180 days or more and are not popular are promoted; popular ones that nobody votes for are demoted.", """
SELECT relay, CASE WHEN popular AND score IS NULL THEN 'demote' WHEN popular THEN 'keep' WHEN age_days >= 180 AND rn <= 5 THEN 'promote' ELSE 'wait' END AS step, age_days FROM (
  SELECT coalesce(v.relay, p.relay) AS relay, v.score, p.relay IS NOT NULL AS popular, coalesce(a.age_days, 0) AS age_days, row_number() OVER (PARTITION BY p.relay IS NOT NULL, coalesce(a.age_days, 0) >= 180 ORDER BY coalesce(v.score, 0) DESC, coalesce(v.relay, p.relay)) AS rn
  FROM {trust_relay_votes} v FULL OUTER JOIN (SELECT relay FROM {rel_popular} WHERE users >= 150) p ON v.relay = p.relay LEFT JOIN (SELECT relay, @days(@date(max(seen_at)), @date(min(seen_at))) AS age_days FROM {sightings} GROUP BY relay) a ON a.relay = coalesce(v.relay, p.relay)) r""")
define("trust_merge_graph", "Follow edges, of weight 1, and interaction edges with their weights, summed.", "SELECT src, dst, round(sum(weight), 6) AS weight FROM (SELECT src, dst, weight FROM {trust_interaction_edges} UNION ALL SELECT follower, followed, 1e0 FROM {contacts} WHERE follower <> followed) u GROUP BY src, dst")
define("trust_compare_ranks", "Overlap of the first 50 of two rankings, by trust and by engagement, and Spearman's coefficient on users of both.", """
SELECT @count_if(a.rank <= 50 AND b.rank <= 50) / 50e0 AS overlap, round(1 - 6 * sum(CAST((a.rank - b.rank) * (a.rank - b.rank) AS DOUBLE)) / (count(*) * (CAST(count(*) AS DOUBLE) * count(*) - 1)), 6) AS spearman
FROM {trust_top} a JOIN (SELECT pubkey, row_number() OVER (ORDER BY engaged DESC, pubkey) AS rank FROM (SELECT pubkey, engaged FROM {disc_profile_stats} ORDER BY engaged DESC, pubkey LIMIT 100) p) b ON a.pubkey = b.pubkey""")
define("trust_latest", "Hops and scores of each user, whichever is known.", "SELECT coalesce(h.pubkey, s.pubkey) AS pubkey, h.hops, coalesce(s.score, 0) AS score FROM {trust_hops} h FULL OUTER JOIN {trust_scores} s ON h.pubkey = s.pubkey")
define("lang_detect", "Language of each post of 20 letters or more: each short word votes with its languages' shares in all other posts, and the first must have 0.6 of the votes and 0.25 more than the second.", """
SELECT id, detected, confidence FROM (SELECT id, lang AS detected, round(share, 4) AS confidence, round(share, 4) - round(coalesce(lead(share) OVER (PARTITION BY id ORDER BY round(share, 4) DESC, lang), 0), 4) AS gap, row_number() OVER (PARTITION BY id ORDER BY round(share, 4) DESC, lang) AS rn FROM (
  SELECT id, lang, votes / sum(votes) OVER (PARTITION BY id) AS share FROM (
    SELECT w.id, m.lang, sum(CASE WHEN m.all_ > w.n THEN CAST(w.n AS DOUBLE) * power(CAST(m.uses - CASE WHEN m.lang = w.lang THEN w.n ELSE 0 END AS DOUBLE) / (m.all_ - w.n), 4) ELSE 0e0 END) AS votes
    FROM {short_words} w JOIN {word_counts} m ON w.word = m.word GROUP BY w.id, m.lang) v WHERE votes > 0) s) r JOIN (SELECT id AS clean_id FROM {lang_clean_text} WHERE letters >= 20) c ON id = clean_id WHERE rn = 1 AND confidence >= 6e-1 AND gap >= 25e-2""")
define("short_words", "Words of at most four letters of each post's clean text, counted.", "SELECT p.id, p.lang, lower(e.x) AS word, count(*) AS n FROM {lang_clean_text} p, @each_at(@extract_all(p.clean, '[A-Za-zÀ-ÿ]+'), e) WHERE length(e.x) <= 4 GROUP BY p.id, p.lang, lower(e.x)")
define("lang_decide", "Language of each post and where it is from: its tag, its text, the post that it answers, its author's language; else why there is none.", """
SELECT c.id, coalesce(t.code, d.detected, a.detected, p.lang) AS lang, CASE WHEN t.code IS NOT NULL THEN 1e0 WHEN d.detected IS NOT NULL THEN d.confidence WHEN coalesce(a.detected, p.lang) IS NOT NULL THEN 4e-1 END AS confidence,
  CASE WHEN t.code IS NOT NULL THEN 'tag' WHEN d.detected IS NOT NULL THEN 'content' WHEN a.detected IS NOT NULL THEN 'thread' WHEN p.lang IS NOT NULL THEN 'author' WHEN c.letters < 20 THEN 'short' ELSE 'uncertain' END AS source
FROM {lang_clean_text} c LEFT JOIN {lang_tags} t ON c.id = t.id LEFT JOIN {lang_detect} d ON c.id = d.id LEFT JOIN {post_parents} x ON c.id = x.id LEFT JOIN {lang_detect} a ON a.id = x.parent LEFT JOIN {lang_prior} p ON c.author = p.author""")
# Fixed values, as surveyed: words that greet, and words that wishes add to them.
GREETINGS = "gm gn ge ga pv pura vida hi hey yo sup hello morning mornin night evening afternoon"
WISHES = "a and your enjoy have great wonderful lovely nice blessed pleasant beautiful awesome sweet dear soul day peace coffee rest hug hugs thanks thank wish wishing friend friends happy best luck one weekend dream dreams well"


def _with_greetings(sql: str) -> str:
    """sql with <greeting>, <opening> (good, too) and <any> (wishes, too) as alternatives of a pattern."""
    words = {"<greeting>": GREETINGS, "<opening>": f"{GREETINGS} good", "<any>": f"{GREETINGS} good {WISHES}"}
    for name, of in words.items():
        sql = sql.replace(name, of.replace(" ", "|"))
    return sql


define("norm_reply_phrase", "Phrase of each reply: its words in lower case without links, identifiers and marks, whole; a reply of media files only is its files; and whether it is a greeting.", _with_greetings("""
SELECT id, target_id, author, actor, created_at, phrase, phrase = '' OR @matches(phrase, '^(<opening>)( (<opening>))*$')
  OR @matches(phrase, '^(good )?(<greeting>)( (<opening>))*( [^ ]+){0,4}$')
  OR (length(rest) <= 64 AND @matches(rest, '^(<any>)( (<any>)){0,7}$')) AS greeting
FROM (SELECT id, target_id, author, actor, created_at, phrase, trim(regexp_replace(phrase, '^(good )?(<greeting>)( (<opening>))*( |$)', '')) AS rest FROM (
  SELECT id, target_id, author, actor, created_at, CASE WHEN plain = '' AND media <> '' THEN concat('media:', media) ELSE plain END AS phrase FROM (
    SELECT id, target_id, author, actor, created_at, trim(@replace_all(@spoken(@replace_all(lower(text), 'https?://[^ ]+|www[.][^ ]+|(npub|nprofile|nevent|naddr|note)1[0-9a-z]+', ' ')), '[ \\n\\t]+', ' ')) AS plain, regexp_extract(lower(text), 'https?://([^ ?#]+[.](?:png|jpe?g|gif|webp|mp4|webm))', 1) AS media FROM {replies}) r) p) q"""))
define("disc_reply_discount", "Reply weight of each window and target: each vote outside piles, the greatest of each pile once, of greetings by the root of their number; the substantive part, and the share that unlocks.", """
SELECT CAST(split_part(p.target_id, ' ', 1) AS INT) AS days, CAST(split_part(p.target_id, ' ', 2) AS BIGINT) AS target_id, @isum(people) AS repliers, @isum(CASE WHEN pile IS NULL THEN people ELSE 0 END) AS substantive_repliers, round(sum(CASE WHEN pile IS NULL THEN total WHEN pile = 'greeting' THEN sqrt(CAST(people AS DOUBLE)) * most ELSE most END), 6) AS total,
  round(sum(CASE WHEN pile IS NULL THEN total ELSE 0e0 END), 6) AS substantive, round(CASE WHEN sum(CASE WHEN pile IS NULL THEN 0 ELSE people END) <= sum(CASE WHEN pile IS NULL THEN people ELSE 0 END) THEN 1e0 ELSE sum(CASE WHEN pile IS NULL THEN people ELSE 0 END) / CAST(sum(people) AS DOUBLE) END, 6) AS unlock_share
FROM (SELECT target_id, pile, count(*) AS people, sum(weight) AS total, max(weight) AS most FROM {reply_piles} GROUP BY target_id, pile) p GROUP BY p.target_id""")
define("attr_media_flags", "Image, video, other links, article and number of attachments of each page.", """
SELECT p.page_id AS id, coalesce(l.images, 0) > 0 AS has_image, coalesce(l.videos, 0) > 0 AS has_video, coalesce(l.others, 0) > 0 AS has_link, @matches(lower(coalesce(p.html, '')), '<article|<h1') AS has_article, coalesce(l.images, 0) + coalesce(l.videos, 0) AS attachments FROM {pages} p
LEFT JOIN (SELECT id, @count_if(@matches(lower(url), '[.](png|jpe?g|gif|webp)$')) AS images, @count_if(@matches(lower(url), '[.](mp4|webm|mov)$')) AS videos, @count_if(NOT @matches(lower(url), '[.](png|jpe?g|gif|webp|mp4|webm|mov)$')) AS others FROM {links} GROUP BY id) l ON p.page_id = l.id""")
define("attr_media_segment", "Video before image before article before link before text.", "SELECT id, CASE WHEN has_video THEN 'video' WHEN has_image THEN 'image' WHEN has_article THEN 'article' WHEN has_link THEN 'link' ELSE 'text' END AS segment, attachments FROM {attr_media_flags}")
define("str_dirty_keys", "Authors that acts of the newest day touch, with their engagement counted anew from their own acts only.", """
SELECT d.author AS pubkey, count(DISTINCT a.actor) AS engaged, @isum(a.sats) AS sats FROM (SELECT DISTINCT x.author FROM {acts} x CROSS JOIN {present} t WHERE x.ts > t.as_of - INTERVAL 1 DAY) d JOIN {acts} a ON d.author = a.author WHERE a.actor <> a.author GROUP BY d.author""")
define("str_rebuild_scope", "Replies and reactions of the notes of the week before the newest, counted anew from the acts on them only.", """
SELECT n.id, @count_if(a.relation = 'reply') AS replies, @count_if(a.relation = 'reaction') AS reactions FROM (SELECT m.id FROM {notes} m CROSS JOIN {present} p WHERE m.ts > p.as_of - INTERVAL 14 DAYS AND m.ts <= p.as_of - INTERVAL 7 DAYS) n LEFT JOIN {acts} a ON a.target_id = n.id GROUP BY n.id""")
define("ret_deletions", "Deletion rows to prune: those whose target was never seen, and those that another's deletion names.", "SELECT deletion_id, target_id, CASE WHEN target_author IS NULL THEN 'orphan' ELSE 'foreign' END AS reason FROM {state_deletions} WHERE NOT applies")
define("ret_bridged_expired", "Notes that go: bridged ones older than a week, and expired ones.", """
SELECT n.id, CASE WHEN a.protocol IS NOT NULL AND n.ts < p.as_of - INTERVAL 7 DAYS THEN 'bridged' ELSE 'expired' END AS reason FROM {notes} n JOIN {attr_event_attributes} a ON n.id = a.event_id CROSS JOIN {present} p
WHERE (a.protocol IS NOT NULL AND n.ts < p.as_of - INTERVAL 7 DAYS) OR a.expires_at <= @unix(p.as_of)""")
define("ret_facts", "Rows of derived tables whose event is gone or too old, by table.", """
SELECT 'tags' AS source, count(*) AS n FROM {tags} WHERE name NOT IN ('e', 'p', 'a', 't', 'q') UNION ALL SELECT 'reactions', count(*) FROM {fact_reactions} f CROSS JOIN {present} p WHERE f.created_at < @unix(p.as_of) - 1209600
UNION ALL SELECT 'reposts', count(*) FROM {fact_reposts} f LEFT JOIN {notes} n ON f.target_id = n.id WHERE n.id IS NULL UNION ALL SELECT 'hashtags', count(*) FROM {norm_tag_hashtags} h LEFT JOIN {notes} n ON h.event_id = n.id CROSS JOIN {present} p WHERE n.id IS NULL OR n.ts < p.as_of - INTERVAL 21 DAYS
UNION ALL SELECT 'probes', count(*) FROM {probes} b CROSS JOIN (SELECT max(ts) AS as_of FROM {probes}) m WHERE b.ts < m.as_of - INTERVAL 730 DAYS""")
define("trust_top", "The 100 most trusted users by score, ties by id.", "SELECT pubkey, score, row_number() OVER (ORDER BY score DESC, pubkey) AS rank FROM (SELECT pubkey, score FROM {trust_scores} ORDER BY score DESC, pubkey LIMIT 100) t")
define("contacts", "Follow edges from newest contact lists: follower, followed, since.", "SELECT DISTINCT i.pubkey AS follower, @num(i.value) AS followed, i.created_at AS since FROM {state_items} i JOIN {state_replaceable} r ON i.event_id = r.id WHERE i.kind = 3 AND i.name = 'p'", kept=True)
define("lang_clean_text", "Text of each post for language detection: without links, identifiers, digests, references and long runs, spaces in one form; and its letters.", """
SELECT id, author, ts, lang, clean, length(@letters(clean)) AS letters FROM (SELECT id, author, ts, lang, trim(@replace_all(@replace_all(@replace_all(@replace_all(@replace_all(@replace_all(text, @re((?i)\\b(?:https?|wss?)://[^ ]+), ' '),
  @re((?i)\\b(?:npub|nsec|note|nevent|nprofile|naddr|nrelay|lnbc|lntb|lnbcrt)1[02-9ac-hj-np-z]{20}[02-9ac-hj-np-z]*\\b), ' '), @re(\\b[0-9a-fA-F]{32}[0-9a-fA-F]*\\b), ' '), @re(#\\[[0-9]+\\]), ' '), @re([A-Za-z0-9+/=_-]{48}[A-Za-z0-9+/=_-]*), ' '), @re(\\s+), ' ')) AS clean FROM {posts}) p""")
define("word_counts", "Uses of each short word in each language, for words that occur ten times or more.", "SELECT word, lang, uses, all_ FROM (SELECT word, lang, @isum(n) AS uses, CAST(sum(sum(n)) OVER (PARTITION BY word) AS BIGINT) AS all_ FROM {short_words} GROUP BY word, lang) w WHERE all_ >= 10")
define("lang_tags", "Language that a post's own tag gives: two letters in the namespace of language codes, the first of several.", """
SELECT event_id AS id, code FROM (SELECT event_id, lower(trim(value)) AS code, row_number() OVER (PARTITION BY event_id ORDER BY idx) AS rn FROM {tags}
WHERE (name = 'lang' OR (name = 'l' AND @replace_all(lower(trim(hint)), '[ _-]', '') IN ('', 'iso6391'))) AND @matches(lower(trim(value)), '^[a-z]{2}$')) r WHERE rn = 1""", kept=True)
define("lang_prior", "Language of each author: that of three detected posts or more in 30 days, and of twice as many as the next.", """
SELECT author, lang FROM (SELECT author, lang, n, coalesce(lead(n) OVER (PARTITION BY author ORDER BY n DESC, lang), 0) AS next_, row_number() OVER (PARTITION BY author ORDER BY n DESC, lang) AS rn FROM (
  SELECT c.author, d.detected AS lang, count(*) AS n FROM {lang_detect} d JOIN {lang_clean_text} c ON d.id = c.id CROSS JOIN {post_now} p WHERE c.ts > p.as_of - INTERVAL 30 DAYS GROUP BY c.author, d.detected) g) r WHERE rn = 1 AND n >= 3 AND n >= 2 * next_""")
define("reply_votes", "One vote for each window, target and replier (target_id: days and target): weight by trust, and the longest remark, or a greeting if there is none but greetings. The author doesn't vote.", """
SELECT concat(@str(d.days), ' ', @str(p.target_id)) AS target_id, p.actor, coalesce(max(w.weight), max(s.untrusted)) AS weight, bool_and(p.greeting) AS greeting, @first_by(p.phrase, CASE WHEN p.greeting THEN 1000000 ELSE 0 END - length(p.phrase)) AS phrase
FROM {norm_reply_phrase} p CROSS JOIN {windows} d CROSS JOIN {present} t CROSS JOIN {settings} s LEFT JOIN {disc_engager_weight} w ON p.actor = w.pubkey WHERE p.actor <> p.author AND p.created_at > @unix(t.as_of) - d.days * 86400 GROUP BY d.days, p.target_id, p.actor""", kept=True)
define("short_phrases", "Remarks of each target of at most five words and forty characters, with their number.", """
SELECT target_id, phrase, count(*) AS n FROM {reply_votes} WHERE NOT greeting AND phrase NOT LIKE 'media:%' AND length(phrase) <= 40 AND @size(@words(phrase)) <= 5 GROUP BY target_id, phrase""", kept=True)
define("phrase_keys", "What near phrases share: a phrase itself and others without one word or character (role del), or both without the one at the same place (role same).", """
SELECT target_id, phrase, n, concat('w', phrase) AS key, 'self' AS role FROM {short_phrases} UNION ALL SELECT target_id, phrase, n, concat('c', phrase), 'self' FROM {short_phrases} WHERE length(phrase) >= 3
UNION ALL SELECT s.target_id, s.phrase, s.n, concat('w', @without_word(@words(s.phrase), e.pos)), 'del' FROM {short_phrases} s, @each_at(@words(s.phrase), e) WHERE @size(@words(s.phrase)) >= 2
UNION ALL SELECT s.target_id, s.phrase, s.n, concat('W', @str(e.pos), ' ', @str(@size(@words(s.phrase))), ' ', @without_word(@words(s.phrase), e.pos)), 'same' FROM {short_phrases} s, @each_at(@words(s.phrase), e) WHERE @size(@words(s.phrase)) >= 2
UNION ALL SELECT s.target_id, s.phrase, s.n, concat('c', substring(s.phrase, 1, g.at - 1), substring(s.phrase, g.at + 1)), 'del' FROM {short_phrases} s CROSS JOIN (SELECT @grid(1, 40) AS at) g WHERE g.at <= length(s.phrase) AND length(s.phrase) >= 4
UNION ALL SELECT s.target_id, s.phrase, s.n, concat('C', @str(g.at), ' ', @str(length(s.phrase)), ' ', substring(s.phrase, 1, g.at - 1), substring(s.phrase, g.at + 1)), 'same' FROM {short_phrases} s CROSS JOIN (SELECT @grid(1, 40) AS at) g WHERE g.at <= length(s.phrase) AND length(s.phrase) >= 3""")
define("phrase_clusters", "For each short phrase the one of it and its near ones that most say, then the shortest, then the least. Of a key only its best phrase of either role is looked at.", """
SELECT target_id, phrase, cluster FROM (SELECT target_id, phrase, best AS cluster, row_number() OVER (PARTITION BY target_id, phrase ORDER BY best_n DESC, length(best), best) AS rn FROM (
  SELECT k.target_id, k.phrase, b.phrase AS best, b.n AS best_n FROM {phrase_keys} k JOIN (SELECT target_id, key, role, phrase, n, row_number() OVER (PARTITION BY target_id, key, role ORDER BY n DESC, length(phrase), phrase) AS rn FROM {phrase_keys}) b
    ON k.target_id = b.target_id AND k.key = b.key AND ((k.role = 'self' AND b.role = 'del') OR (k.role = 'del' AND b.role = 'self') OR (k.role = 'same' AND b.role = 'same')) WHERE b.rn = 1
  UNION ALL SELECT target_id, phrase, phrase, n FROM {short_phrases}) c) r WHERE rn = 1""")
define("reply_piles", "The pile of each vote, null if it is in none: greetings of two or more, near-identical short remarks, identical long ones and files.", """
SELECT target_id, actor, weight, CASE WHEN size >= 2 THEN pile END AS pile FROM (SELECT v.target_id, v.actor, v.weight, v.pile, count(*) OVER (PARTITION BY v.target_id, v.pile) AS size FROM (
  SELECT r.target_id, r.actor, r.weight, CASE WHEN r.greeting THEN 'greeting' WHEN c.cluster IS NOT NULL THEN concat('short ', c.cluster) ELSE concat('long ', r.phrase) END AS pile FROM {reply_votes} r LEFT JOIN {phrase_clusters} c ON r.target_id = c.target_id AND r.phrase = c.phrase AND NOT r.greeting) v) s""", kept=True)
