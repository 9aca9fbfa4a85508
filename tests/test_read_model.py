"""From payload lines to counts, threads, profiles and lists, worked out by hand."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from strandline.plans import catalog  # noqa: F401
from strandline.sources.payloads import read_payloads, validate_events
from strandline.sources.read_model import ReadModel, clashes


def key(name):
    return hashlib.sha256(name.encode()).hexdigest()


def event(who, at, kind, tags=(), content=""):
    body = [key(who), at, kind, [list(t) for t in tags], content]
    text = json.dumps([0, *body], separators=(",", ":"), ensure_ascii=False)
    return {"id": hashlib.sha256(text.encode()).hexdigest(), "pubkey": body[0], "created_at": at, "kind": kind, "tags": body[3], "content": content, "sig": "0" * 128}


def n(hex_):
    return int(hex_[:15], 16)


@pytest.fixture(scope="module")
def story(spark, tmp_path_factory):
    root = event("ann", 100, 1, [("t", "Spark")], "hello")
    reply = event("bob", 110, 1, [("e", root["id"], "", "root"), ("p", key("ann"))], "hi")
    deep = event("cem", 120, 1, [("e", root["id"]), ("e", reply["id"])], "and me")  # by place: root, then reply
    mention = event("cem", 125, 1, [("e", root["id"], "", "mention")], "see this")
    like = event("bob", 130, 7, [("e", key("elsewhere")), ("e", root["id"])], "+")
    boost = event("dia", 140, 6, [("e", root["id"])])
    request = json.dumps({"pubkey": key("eve"), "kind": 9734, "tags": [["amount", "21000"]]}, separators=(",", ":"))
    zap = event("wallet", 150, 9735, [("e", root["id"]), ("description", request), ("bolt11", "lnbc50n1pdata")])
    bill = event("wallet", 160, 9735, [("e", reply["id"]), ("bolt11", "lnbc1u1pdata"), ("P", key("fay"))])
    report = event("dia", 170, 1984, [("e", reply["id"], "spam"), ("p", key("bob"))])
    old, new = (event("ann", at, 0, (), json.dumps({"name": name, "lud16": "Ann@Pay.example"})) for at, name in ((90, "old"), (180, "Ann")))
    follow = event("bob", 190, 3, [("p", key("ann")), ("p", key("cem"))])
    unfollow = event("bob", 195, 3, [("p", key("cem"))])
    relays = event("bob", 191, 10002, [("r", "wss://one.example"), ("r", "wss://two.example", "read")])
    lists = [event("ann", at, 30000, [("d", d), ("p", key("bob"))]) for at, d in ((200, "x"), (210, "x"), (205, "y"))]
    good = [root, reply, deep, mention, like, boost, zap, bill, report, old, new, follow, unfollow, relays, *lists]
    bad = dict(root, content="changed")
    path = str(tmp_path_factory.mktemp("lines"))
    lines = [json.dumps({"relay_url": f"wss://{k % 2}", "payload": json.dumps(e)}) for k, e in enumerate([*good, root, bad])]
    with open(f"{path}/a.ndjson", "w") as f:
        f.write("\n".join(lines) + "\n\n")
    checked = validate_events(read_payloads(spark, path))
    assert [r["error_code"] for r in checked.where("error_code is not null").collect()] == ["id_mismatch"]
    events = checked.where("error_code is null").select("e.*")
    return {"model": ReadModel(events), "events": events, "root": n(root["id"]), "reply": n(reply["id"]), "deep": n(deep["id"]), "mention": n(mention["id"]), "report": n(report["id"]), "like": n(like["id"]), "lists": [n(x["id"]) for x in lists]}


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_counts(story):
    model, root, reply = story["model"], story["root"], story["reply"]
    assert rows(model("cnt_replies"), "target_id", "n") == sorted([(root, 1), (reply, 1)])
    assert rows(model("cnt_reactions"), "target_id", "n") == [(root, 1)]
    assert rows(model("cnt_zaps"), "target_id", "n", "sats") == sorted([(root, 1, 21), (reply, 1, 100)])
    assert rows(model("acts").where("relation = 'zap'"), "target_id", "actor") == sorted([(root, n(key("eve"))), (reply, n(key("fay")))])
    assert rows(model("ref_reports"), "source_id", "type") == [(story["report"], "spam")]
    assert rows(model("norm_reaction_key"), "source_id", "reaction_key") == [(story["like"], "+")]


def test_threads(story):
    model, root = story["model"], story["root"]
    assert rows(model("thr_depth"), "id", "depth", "root") == sorted([(root, 0, root), (story["reply"], 1, root), (story["deep"], 2, root), (story["mention"], 0, story["mention"])])
    (found,) = model("thr_summary").collect()
    assert (found["root"], found["replies"], found["participants"], found["last_at"], found["direct"], found["first_reply_s"], found["depth"]) == (root, 2, 2, 120, 1, 10, 2)


def test_profiles_and_lists(story):
    model = story["model"]
    assert rows(model("attr_profile_fields"), "pubkey", "name", "ln_address") == [(n(key("ann")), "Ann", "ann@pay.example")]
    assert rows(model("contacts"), "follower", "followed") == [(n(key("bob")), n(key("cem")))]
    assert rows(model("state_replaceable").where("kind = 30000"), "d", "id") == [("x", story["lists"][1]), ("y", story["lists"][2])]
    assert rows(model("relay_lists"), "pubkey", "relay") == [(n(key("bob")), "wss://one.example"), (n(key("bob")), "wss://two.example")]
    assert rows(model("norm_tag_hashtags"), "event_id", "tag") == [(story["root"], "spark")]


def test_numbers_do_not_clash(story):
    assert clashes(story["events"]).count() == 0
    assert clashes(story["events"].withColumn("pubkey", F.concat(F.substring("pubkey", 1, 15), F.sha2(F.substring("id", 1, 9), 256).substr(1, 49)))).count() > 0


def test_no_events(spark):
    empty = spark.createDataFrame([], "id string, pubkey string, created_at long, kind int, tags array<array<string>>, content string")
    model = ReadModel(empty)
    assert all(f.count() == 0 for name, f in model.made.items() if name != "present") and model("cnt_replies").count() == 0


def test_read_model_reads_each_event_once(spark):
    from strandline.sources.payloads import EVENT
    from strandline.sources.read_model import frames

    events = spark.createDataFrame([("0" * 64, "1" * 64, 5, 1, [["t", "a"]], "x", "2" * 128)], EVENT)
    for name, frame in frames(events).items():  # tables of the model, not the events it was made from
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 0, name
