import json

import pytest
from pyspark.sql import functions as F

from strandline.sources.payloads import canonical_id, invalid_stats, payloads_of, quarantine, read_payloads, validate_events


def test_codes_in_order(spark):
    events = spark.createDataFrame([(i, 5, "view", f'{{"k": {i}}}') for i in range(20)], "event_id long, user_id long, event_type string, props string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    found = {r["event_id"]: r["error_code"] for r in validate_events(payloads_of(events)).collect()}
    want = [None, "empty", "invalid_json", "not_object", "missing_field", "field_type", "field_format", "field_range", "id_mismatch", "control_characters"]
    assert [found[i] for i in range(20)] == want + [None] * 10


def test_canonical_id(spark):
    import hashlib

    e = ("ab", 12, 1, [["e", "x\"y"], ["t", "é<&>"]], 'say "hi" \\ é <&>')
    text = json.dumps([0, e[0], e[1], e[2], e[3], e[4]], separators=(",", ":"), ensure_ascii=False)
    df = spark.createDataFrame([(e,)], "e struct<pubkey:string,created_at:long,kind:int,tags:array<array<string>>,content:string>")
    assert df.select(canonical_id(F.col("e")).alias("h")).first()["h"] == hashlib.sha256(text.encode()).hexdigest()


def test_reading_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.ndjson").write_text('{"relay_url": "wss://r", "payload": {"id": "x"}}\n\nnot json\n')
    found = {(r["relay_url"], r["payload"]) for r in read_payloads(spark, str(tmp_path)).collect()}
    assert found == {("wss://r", '{"id":"x"}'), (None, "not json")}


@pytest.mark.parametrize("made", [quarantine, invalid_stats])
def test_conditions_on_the_verdict_copy_no_check(spark, made):
    events = spark.createDataFrame([(1, 2, "view", '{"k": 3}', None)], "event_id long, user_id long, event_type string, props string, ts timestamp")
    plan = made(validate_events(payloads_of(events)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") <= 8
