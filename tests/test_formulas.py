"""Operators on small frames with results worked out by hand: a change of a shared SELECT shows here, whatever DuckDB says."""

import math

import pytest
from pyspark.sql import functions as F

from strandline.operators import threads  # noqa: F401
from strandline.operators.graph import personalized
from strandline.operators.threads import ancestors
from strandline.plans import catalog  # noqa: F401
from strandline.plans.template import REGISTRY


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def run(name, **frames):
    return [r.asDict() for r in REGISTRY[name](**frames).collect()]


def test_a_chain_of_fifty_and_a_cycle(spark):
    edges = [(k, k - 1, False) for k in range(2, 52)] + [(101, 102, False), (102, 103, False), (103, 101, False), (104, 101, False), (200, 999, True)]
    found = {}
    for r in ancestors(frame(spark, "child long, parent long, parent_missing boolean", edges)).collect():
        found.setdefault(r["id"], {})[r["distance"]] = (r["ancestor"], r["missing"])
    assert [found[51][d][0] for d in range(1, 51)] == list(range(50, 0, -1))
    assert found[101] == {1: (102, False), 2: (103, False)} and found[104] == {1: (101, False), 2: (102, False), 3: (103, False)}
    assert found[200] == {1: (999, True)}


def test_levels_are_cut_where_asked(spark):
    edges = frame(spark, "child long, parent long, parent_missing boolean", [(k, k - 1, False) for k in range(2, 40)])
    assert ancestors(edges, 20).agg(F.max("distance")).first()[0] == 20


def test_tied_sightings_stay(spark):
    rows = frame(spark, "event_id long, relay long, seen_at timestamp, is_first_seen boolean", [])
    rows = rows.union(spark.sql("SELECT 1L, 7L, timestamp'2024-01-01', true UNION ALL SELECT 1L, 3L, timestamp'2024-01-01', false UNION ALL SELECT 1L, 5L, timestamp'2023-01-01', false"))
    assert run("ingest_seen_on", ingest_provenance=rows) == [{"event_id": 1, "relays": "5,3,7", "hint": 5, "n": 3}]


def piles(spark, texts, weights):
    """The discount of one target with a reply by each actor."""
    replies = frame(spark, "id long, target_id long, author long, actor long, created_at long, text string", [(i, 25, 0, actor, 1_700_000_000, text) for i, (actor, text) in enumerate(texts)])
    made = {"replies": replies, "settings": REGISTRY["settings"], "windows": frame(spark, "days int", [(7,)]), "present": spark.sql("SELECT timestamp_ntz'2023-11-15 00:00:00' AS as_of")}
    made["settings"] = spark.sql("SELECT 0.1e0 AS untrusted")
    made["disc_engager_weight"] = frame(spark, "pubkey long, weight double", list(weights.items()))
    for name in ("norm_reply_phrase", "reply_votes", "short_phrases", "phrase_keys", "phrase_clusters", "reply_piles", "disc_reply_discount"):
        made[name] = REGISTRY[name](**{k: made[k] for k in REGISTRY[name].inputs})
    (row,) = made["disc_reply_discount"].collect()
    return row["total"], row["substantive"], row["unlock_share"]


def test_reply_piles(spark):
    one = {k: 1.0 for k in range(1, 9)}
    # a pile of greetings counts by the root of its people, and unlocks nothing
    assert piles(spark, [(1, "gm"), (2, "Good morning!"), (3, "GM Gigi"), (4, "gn")], one) == (2.0, 0.0, 0.0)
    # a lone greeting is a reply like others
    assert piles(spark, [(1, "gm"), (2, "a remark about this very note that is long")], one) == (2.0, 2.0, 1.0)
    # near-copies: one word swapped, one character more; the strongest counts once
    assert piles(spark, [(1, "nice catch here"), (2, "nice catch there")], {1: 1.0, 2: 0.5}) == (1.0, 0.0, 0.0)
    assert piles(spark, [(1, "bitcoin"), (2, "bitcoins"), (3, "something else altogether is said here")], one) == (2.0, 1.0, pytest.approx(1 / 3, abs=1e-6))
    # "good point" is a remark; long sentences pile only when they are identical
    long_ = "the same sentence that is longer than a short reply may be"
    assert piles(spark, [(1, "good point"), (2, long_), (3, long_)], one) == (2.0, 1.0, pytest.approx(1 / 3, abs=1e-6))
    assert piles(spark, [(1, long_), (2, long_ + " now")], one) == (2.0, 2.0, 1.0)
    # a remark beside a greeting is what counts; an author's own reply doesn't
    assert piles(spark, [(1, "gm"), (1, "a remark about this very note that is long"), (0, "gm"), (2, "gm")], one) == (2.0, 2.0, 1.0)


def test_note_score(spark):
    w = frame(spark, "days int, target_id long, reply_w double, substantive double, unlock_share double, repost_w double, react_w double, zap_w double, msats double", [(7, 1, 2.0, 1.0, 0.5, 2.0, 10.0, 1.0, 100000.0), (1, 1, 2.0, 1.0, 0.5, 2.0, 10.0, 1.0, 100000.0)])
    notes = frame(spark, "id long, created_at long", [(1, 1_700_000_000 - 86400)])
    present = spark.sql("SELECT timestamp_ntz'2023-11-14 22:13:20' AS as_of")  # 1700000000
    found = {r["days"]: r["score"] for r in run("disc_note_score", disc_weighted_engagement=w, notes=notes, present=present)}
    unlock = 1.0 * 0.5 + 1.0
    base = 3 * 2 + 2 * 1 + math.log(2) + (4 * unlock + 0.12 * (10 - 4 * unlock)) + (2 * unlock + 0.2 * (2 - unlock))
    assert found[7] == pytest.approx(base / (1 + 3 / 17 / 7), abs=6e-4) and found[1] == pytest.approx(base / 2, abs=6e-4)


def rising(spark, followers, new, engaged, posts, days, score=0.0):
    frames = {
        "disc_profile_windows": frame(spark, "days int, pubkey long, posts long, active_days long", [(7, 1, posts, days)]),
        "fact_profile_edges": frame(spark, "pubkey long, followers long", [(1, followers)]),
        "new_followers": frame(spark, "days int, followed long, n long", [(7, 1, new)]),
        "disc_profile_engagement": frame(spark, "days int, author long, rising double", [(7, 1, engaged)]),
        "disc_profile_score": frame(spark, "days int, pubkey long, score double", [(7, 1, score)]),
    }
    return run("disc_profile_rising", **frames)[0]["score"]


def test_rising(spark):
    assert rising(spark, 100, 11, 1.0, 5, 3, 50.0) == 0  # nine credited followers are too few, one act is noise
    assert rising(spark, 100, 22, 0.0, 5, 3) == 20.0
    assert rising(spark, 1000, 22, 0.0, 5, 3) == 10.0  # twice the soft cap
    e, total, d = 21.0, 10, 2
    ce = e - 1
    engagement = (0.4 * math.log1p(ce) + 3 * math.log1p(100 * ce / 110) * ce / (ce + 15)) * (1 + min(1, e / (1 + total))) * min(1, d / 3)
    assert rising(spark, 100, 0, e, total, d, 4.0) == pytest.approx((0.2 * 4 + engagement) / (1 + 1.3 * math.log10(101)), abs=6e-4)


def test_blend(spark):
    rows = frame(spark, "viewer long, id long, cohort double, global_ double, people long", [(1, 10, 4.0, 0.0, 2), (1, 10, 0.0, 5.0, 0), (1, 11, 0.0, 10.0, 0), (1, 12, 2.0, 0.0, 1), (2, 11, 0.0, 10.0, 0)])
    found = [(r["viewer"], r["id"], r["blended"]) for r in sorted(run("disc_blend", blend_rows=rows), key=lambda r: (r["viewer"], r["rn"]))]
    assert found == [(1, 10, 0.85), (1, 12, 0.35), (1, 11, 0.3), (2, 11, 0.3)]


def test_amounts(spark):
    cases = [("21000", "", "lnbc1", 21), ("999", "", "lnbc10u1p", 1000), ("-5", '{"pubkey": "7", "tags": [["amount", "5500"]]}', "lnbc1m1p", 5), ("", "no json", "LNBC25M1p", 2_500_000), ("", "", "lnbcrt15n1p", 1), ("", "", "lntb9n1p", 0), ("", "", "lnbc21p", 200_000_000), ("", "", "bc1q", 0)]
    rows = [(i, 1, a, d, x, "") for i, (a, d, x, _) in enumerate(cases)]
    receipts = frame(spark, "source_id long, receipt_key long, amount string, description string, invoice string, p_tag string", rows)
    assert [r["sats"] for r in sorted(run("norm_zap_amount", receipts=receipts), key=lambda r: r["source_id"])] == [c[3] for c in cases]
    senders = frame(spark, "source_id long, receipt_key long, description string, p_tag string", [(1, 5, '{"pubkey": "7", "tags": []}', "8"), (2, 5, '{"pubkey": "x"}', "8"), (3, 5, "", "?")])
    assert {r["source_id"]: (r["sender"], r["source"]) for r in run("norm_zap_sender", receipts=senders)} == {1: (7, "description"), 2: (8, "tag"), 3: (5, "receipt")}


def test_newest_state_wins(spark):
    states = frame(spark, "id long, pubkey long, created_at long, kind int, d string", [(1, 1, 10, 0, ""), (2, 1, 10, 0, ""), (3, 1, 9, 0, ""), (4, 1, 5, 30023, "a"), (5, 1, 6, 30023, "b"), (6, 1, 1, 1, ""), (7, 2, 1, 10002, "")])
    assert sorted((r["pubkey"], r["kind"], r["d"], r["id"]) for r in run("state_replaceable", states=states)) == [(1, 0, "", 2), (1, 30023, "a", 4), (1, 30023, "b", 5), (2, 10002, "", 7)]
    assert sorted((r["id"], r["by_id"]) for r in run("state_superseded", states=states)) == [(1, 2), (3, 1)]


def test_correction(spark):
    df = frame(spark, "tag string, df long", [("bitcoin", 400), ("bitcion", 3), ("bitcoim", 9), ("nostrich", 200), ("nosttrch", 1), ("bitco", 2), ("coin", 1), ("bitcoyn", 60)])
    found = {r["tag"]: (r["better"], r["distance"]) for r in run("srch_correction", term_deletes=REGISTRY["term_deletes"](search_terms=df))}
    assert found == {"bitcoim": ("bitcoin", 1), "nosttrch": ("nostrich", 2)}


def test_momentum_and_gini(spark):
    daily = frame(spark, "tag string, day date, n long", [])
    for tag, recent, prior in (("up", 60, 20), ("down", 5, 20), ("same", 20, 15), ("new", 30, 0), ("small", 4, 4)):
        daily = daily.union(spark.sql(f"SELECT '{tag}', date'2024-01-30', {recent}L UNION ALL SELECT '{tag}', date'2024-01-20', {prior}L"))
    now = spark.sql("SELECT timestamp_ntz'2024-01-31 00:00:00' AS as_of")
    found = {r["tag"]: (r["state"], r["z"]) for r in run("eco_hashtag_momentum", eco_hashtag_daily=daily, post_now=now)}
    assert found == {"up": ("emerging", 2.0), "down": ("fading", -0.75), "same": ("steady", 0.333333), "new": ("steady", 30.0)}
    payments = spark.sql("SELECT 1L AS id, sats, timestamp_ntz'2024-01-01 00:00:00' AS ts FROM VALUES (1L), (1L), (2L), (4L), (0L) AS t(sats)")
    values = REGISTRY["zap_values"](payments=payments)
    acts = spark.sql("SELECT 5L AS target_id, 'zap' AS relation, 60L AS created_at")
    notes = spark.sql("SELECT 5L AS id, 0L AS created_at")
    (row,) = run("eco_zap_quantiles", zap_values=values, acts=acts, notes=notes)
    x = [1, 1, 2, 4]
    gini = 2 * sum(i * v for i, v in enumerate(x, 1)) / (4 * 8) - 5 / 4
    assert (row["p50"], row["p90"], row["mean"], row["p50_first_zap_s"]) == (1, 4, 2.0, 60.0) and row["gini_bps"] == pytest.approx(gini * 10000, abs=0.01)


def test_personalized_ranks(spark):
    edges = frame(spark, "src string, dst string, weight double", [("a", "b", 1.0), ("b", "c", 1.0), ("x", "y", 1.0), ("c", "a", 3.0), ("c", "d", 1.0)])
    teleport = frame(spark, "viewer string, node string, weight double", [("v", "a", 1.0), ("w", "x", 1.0), ("w", "nobody", 1.0)])
    restart, score = {"a": 1.0}, {"a": 1.0}
    for _ in range(30):
        new = {k: 0.15 * v for k, v in restart.items()}
        for s, d, share in (("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 0.75), ("c", "d", 0.25)):
            new[d] = new.get(d, 0) + 0.85 * score.get(s, 0) * share
        new["a"] += 0.85 * score.get("d", 0)
        score = new
    found = {(r["viewer"], r["node"]): r["score"] for r in personalized(edges, teleport, 3).collect()}
    assert {n for v, n in found if v == "v"} == set(sorted(score, key=score.get)[-3:]) and {n for v, n in found if v == "w"} == {"x", "y"}
    assert all(found["v", n] == pytest.approx(score[n], abs=1e-8) for v, n in found if v == "v")


def test_hashtags_of_tags(spark):
    values = ["##Go-Lang", " a_b ", "_x", "2024", "a" * 64, "a" * 65, "ok!", "-x", "é", "A_B"]
    tags = frame(spark, "event_id long, name string, value string", [(1, "t", v) for v in values] + [(1, "p", "go")])
    assert sorted(r["tag"] for r in run("norm_tag_hashtags", tags=tags)) == sorted(["a" * 64, "a_b", "go-lang"])


def test_domain_momentum_by_trusted_authors(spark):
    def linked(domain, authors, ago):
        return [(domain, a, ago) for a in authors]

    days = linked("rise", range(20), 3) + linked("rise", range(8), 10) + linked("fade", range(3), 2) + linked("fade", range(9), 9) + linked("few", range(7), 1) + linked("few", range(7), 9)
    days += linked("unknown", range(100, 130), 1) + linked("today", range(20), 0) + linked("steady", range(8), 7) + linked("steady", range(8), 1) + linked("steady", range(4), 14)
    daily = frame(spark, "domain string, author long, ago int", days).selectExpr("domain", "author", "date_sub(date'2024-03-15', ago) AS day")
    found = run("eco_domain_momentum", domain_author_daily=daily, trusted_users=spark.range(50).selectExpr("id AS pubkey"), present=spark.sql("SELECT timestamp_ntz'2024-03-15 12:00:00' AS as_of"))
    assert {r["domain"]: (r["recent"], r["prior"], r["state"], r["z"]) for r in found} == {"rise": (20, 8, "emerging", 1.5), "fade": (3, 9, "fading", -0.666667), "steady": (8, 4, "steady", 1.0)}


def test_percentile_of_performance(spark):
    values = [0.0, 0.0, 0.5, 3.0, 3.0, 3.0, 1000.0, 1e9]
    two = frame(spark, "pubkey long, now double, before double, per_note double", [(k, v, 0.0, 0.0) for k, v in enumerate(values)])
    found = {r["now"]: r["level"] for r in run("auth_levels", auth_two_windows=two)}
    assert found == {v: round(100 - 100 * sum(x > v for x in values) / 7, 6) for v in values}
    assert run("auth_levels", auth_two_windows=two.limit(1)) == [{"now": 0.0, "level": 100.0}]


def test_the_largest_supporter(spark):
    at = "timestamp_ntz'2024-01-01'"
    payments = spark.sql(f"SELECT * FROM VALUES ('b', 'r', 5L, {at}), ('a', 'r', 3L, {at}), ('a', 'r', 2L, {at}), ('r', 'r', 99L, {at}), ('long name', 's', 200000L, {at}), ('c', 's', 1L, {at}) AS t(sender, receiver, sats, ts)")
    found = {(r["receiver"], r["days"]): (r["supporter"], r["support"], r["senders"]) for r in run("disc_paid_rankings", payments=payments)}
    assert found["r", 30] == ("a", 10, 2) and found["s", 365] == ("long name", 100001, 2)


def test_fingerprints_without_links_and_mentions(spark):
    body = "forty characters of plain text are enough here"
    texts = [body, f"{body.upper()}\n\nHTTPS://x.example/a?b", f"nostr:npub1abc {body}  nostr:note1xyz", f"x {body}", "https://example.org/" + "a" * 60]
    found = {r["id"]: r["fingerprint"] for r in run("norm_content_fingerprint", posts=frame(spark, "id long, text string", list(enumerate(texts))))}
    assert found[0] == found[1] == found[2] != found[3] and 4 not in found


def test_copies_within_seven_days_of_the_one_before(spark):
    days = {1: 0, 2: 6, 3: 12, 4: 20, 5: 1}  # across calendar weeks; 5 is another author's
    posts = spark.createDataFrame([(k, "b" if k == 5 else "a", d) for k, d in days.items()], "id long, author string, d int").selectExpr("id", "author", "timestamp_ntz'2024-01-04' + make_interval(0, 0, 0, d) AS ts")
    score = frame(spark, "item_id long, id long, score double", [(1, k, 1.0) for k in days])
    prints = frame(spark, "id long, fingerprint string", [(k, "f") for k in days])
    assert {r["id"]: r["score"] for r in run("srch_note_rank", srch_note_score=score, posts=posts, norm_content_fingerprint=prints)} == {1: 1.0, 2: 0.02, 3: 0.02, 4: 1.0, 5: 1.0}


def test_edits_far_into_a_word_are_found(spark):
    word = "abcdefghijklmnopqrstuvwxyzabcdefghijklmnop"
    df = frame(spark, "tag string, df long", [(word, 500), (word[:38] + "z" + word[39:], 2), ("short", 2), ("shart", 300)])
    deletes = REGISTRY["term_deletes"](search_terms=df)
    assert {r["rest"] for r in deletes.where("tag = 'short'").collect()} == {"short", "hort", "sort", "shrt", "shot", "shor"}
    found = {(r["tag"], r["better"], r["distance"]) for r in run("srch_correction", term_deletes=deletes)}
    assert found == {(word[:38] + "z" + word[39:], word, 1), ("short", "shart", 1)}


def test_the_cursor_is_one_row(spark):
    notes = frame(spark, "pubkey long, created_at long, id long", [(1, 10, 900), (1, 20, 5)])  # the newest note has a small id
    acts = frame(spark, "author long, created_at long, source_id long", [(1, 20, 6), (1, 20, 5), (1, 20, 4), (1, 21, 1), (1, 19, 999), (2, 1, 1)])
    assert {r["author"]: r["unseen"] for r in run("join_temporal_cursor", acts=acts, notes=notes)} == {1: 2, 2: 1}


def test_muted_words_as_they_stand(spark):
    replies = frame(spark, "id long, author long, actor long, target_id long, text string", [(1, 7, 3, 50, "A sword POINT 4 here"), (2, 7, 3, 50, "nothing")])
    lists = frame(spark, "pubkey long, kind int, id long", [(7, 10000, 99)])
    items = frame(spark, "event_id long, name string, value string", [(99, "word", "Point 4"), (99, "word", "word x")])
    assert [(r["id"], r["by_word"], r["by_author"]) for r in run("mod_hidden", replies=replies, state_replaceable=lists, state_items=items)] == [(1, True, False)]
