"""From validated payloads to the frames that the operators read, so that real events take the adapters' place.

Ids and keys of 64 hexadecimal digits become numbers, their first 60 bits, in events, tags and addresses alike; clashes() tells
whether two of them became one, which a billion ids do about once in five times.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import cut
from ..plans.template import REGISTRY, build
from .payloads import canonical_id, driver_events, validate_events

#: Kinds of the event format.
NOTE, PROFILE, REPOST, REACTION, RECEIPT, REPORT, DELETION, RELAYS = 1, 0, 6, 7, 9735, 1984, 5, 10002
RELATIONS = {NOTE: "reply", REPOST: "repost", REACTION: "reaction", RECEIPT: "zap", REPORT: "report"}
_HEX = "^[0-9a-f]{64}$"


def number(hex_: Column) -> Column:
    """The number of an id or key; null for what is none."""
    return F.when(hex_.rlike(_HEX), F.conv(F.substring(hex_, 1, 15), 16, 10).cast("long"))


def clashes(events: DataFrame) -> DataFrame:
    """number, n: of ids and keys whose number others have too."""
    all_ = events.select(F.col("id").alias("x")).union(events.select("pubkey")).distinct()
    return all_.groupBy(number(F.col("x")).alias("number")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _rewritten(value: Column) -> Column:
    """A tag's value with its id or key, or the key of its address, as a number."""
    parts = F.split(value, ":", 3)
    address = F.concat(parts[0], F.lit(":"), number(parts[1]).cast("string"), F.lit(":"), F.coalesce(F.get(parts, 2), F.lit("")))
    return F.when(value.rlike(_HEX), number(value).cast("string")).when(value.rlike("^[0-9]+:[0-9a-f]{64}:"), address).otherwise(value)


def frames(events: DataFrame) -> dict[str, DataFrame]:
    """The frames present, ev, notes, acts, tags, states, state_items, receipts, profiles, relay_lists, reaction_contents, report_types and
    address_acts, of events (id, pubkey, created_at, kind, tags, content), as validate_events gives them.

    An event that comes several times counts once. Of a note's references the operators' rules choose its parent; reactions,
    reposts, receipts and reports are about their last e tag. An event without a target makes no interaction; a tag without
    a name or value makes no row, and neither does an unknown target.

    Events, tags and targets, which most frames read, are written to tables, so that they are made once.
    """
    once = cut(events.dropDuplicates(["id"]).select(F.col("id").alias("hex"), number(F.col("id")).alias("id"), number(F.col("pubkey")).alias("pubkey"), "created_at", F.timestamp_seconds("created_at").cast("timestamp_ntz").alias("ts"), "kind", "tags", "content"))
    at = lambda k: F.coalesce(F.get("tag", F.lit(k)), F.lit(""))
    each = once.select("id", "pubkey", "created_at", "ts", "kind", F.posexplode("tags").alias("idx", "tag")).where("size(tag) >= 2 and tag[0] <> ''")
    each = cut(each.select(F.col("id").alias("event_id"), "pubkey", "created_at", "ts", "kind", F.lit(0).cast("long").alias("k"), F.col("idx").cast("long").alias("idx"), at(0).alias("name"), F.trim(at(1)).alias("raw"), _rewritten(F.trim(at(1))).alias("value"), at(2).alias("hint"), at(3).alias("marker")))
    tags = each.where(F.col("kind") == NOTE).select("event_id", "pubkey", "created_at", "ts", "k", "idx", "name", "value", "hint", "marker")

    lists = F.col("kind").isin(PROFILE, 3, DELETION) | F.col("kind").between(10000, 19999) | F.col("kind").between(30000, 39999)
    d = each.where("name = 'd'").groupBy("event_id").agg(F.min_by("raw", "idx").alias("d"))
    states = once.where(lists).join(d, F.col("id") == F.col("event_id"), "left").select("id", "pubkey", "created_at", "ts", "kind", F.when(F.col("kind") >= 30000, F.coalesce("d", F.lit(""))).otherwise("").alias("d"), F.size("tags").cast("long").alias("n"))
    items = each.join(states.select(F.col("id").alias("event_id"), "d"), "event_id").where("name <> 'd'").select("event_id", "pubkey", "kind", "d", "created_at", "idx", "name", "value", F.col("hint").alias("third"))

    notes = once.where(F.col("kind") == NOTE).select("id", "pubkey", "created_at", "ts", F.lit(0).cast("long").alias("k"))
    parents = REGISTRY["thr_parent"](ref_etag_relations=REGISTRY["ref_etag_relations"](tags=tags)).select("event_id", F.expr("try_cast(parent as bigint)").alias("target"))
    about = each.where(F.col("kind").isin(REPOST, REACTION, RECEIPT, REPORT) & (F.col("name") == "e")).groupBy("event_id").agg(F.max_by(F.expr("try_cast(value as bigint)"), "idx").alias("target"))
    targets = cut(parents.union(about).where("target is not null"))

    first = lambda name: F.min_by(F.when(F.col("name") == name, F.col("raw")), F.when(F.col("name") == name, F.col("idx")))
    held = each.where(F.col("kind") == RECEIPT).groupBy("event_id").agg(*(F.coalesce(first(n), F.lit("")).alias(c) for n, c in (("amount", "amount"), ("description", "request"), ("bolt11", "invoice"), ("P", "payer"))))
    payer = number(F.get_json_object("request", "$.pubkey")).cast("string")
    asked = F.regexp_extract("request", r'"amount"\s*,\s*"([0-9]{1,18})"', 1)
    # the request in the one form that the operators read
    description = F.concat(F.lit('{"pubkey": "'), F.coalesce(payer, F.lit("")), F.lit('", "tags": [["amount", "'), asked, F.lit('"]]}'))
    receipts = once.where(F.col("kind") == RECEIPT).select("id", F.col("pubkey").alias("receipt_key"), "created_at").join(held, F.col("id") == F.col("event_id")).join(targets.withColumnRenamed("event_id", "source_id"), F.col("id") == F.col("source_id"))
    authors = once.select(F.col("id").alias("target"), F.col("pubkey").alias("author"))
    receipts = receipts.join(authors, "target").select("source_id", "receipt_key", F.col("target").alias("target_id"), "author", "created_at", "amount", description.alias("description"), "invoice", F.coalesce(number(F.col("payer")).cast("string"), F.lit("")).alias("p_tag"))

    sats = REGISTRY["norm_zap_amount"](receipts=receipts).select("source_id", "sats")
    payers = REGISTRY["norm_zap_sender"](receipts=receipts).select("source_id", "sender")
    relation = F.create_map(*(F.lit(x) for kv in RELATIONS.items() for x in kv))[F.col("kind")]
    acts = once.where(F.col("kind").isin(*RELATIONS)).join(targets, F.col("id") == F.col("event_id")).join(notes.select(F.col("id").alias("target_id"), F.col("pubkey").alias("author")), F.col("target") == F.col("target_id")).where("id <> target_id")
    acts = acts.join(sats, F.col("id") == F.col("source_id"), "left").drop("source_id").join(payers, F.col("id") == F.col("source_id"), "left")
    acts = acts.select(F.col("id").alias("source_id"), "target_id", relation.alias("relation"), F.coalesce("sender", "pubkey").alias("actor"), "author", "created_at", "ts", F.coalesce("sats", F.lit(0).cast("long")).alias("sats"), F.lit(0).cast("long").alias("k"))

    ev = once.join(targets, F.col("id") == F.col("event_id"), "left").join(sats, F.col("id") == F.col("source_id"), "left")
    ev = ev.select("id", "pubkey", "created_at", "ts", F.lit(0).cast("long").alias("k"), F.coalesce("target", F.lit(0).cast("long")).alias("target"), "kind", F.coalesce("sats", F.lit(0).cast("long")).alias("sats"))
    addressed = each.where(F.col("kind").isin(REPOST, RECEIPT) & (F.col("name") == "a")).groupBy("event_id").agg(F.max_by("value", "idx").alias("address"))
    return {
        "present": once.agg(F.max("ts").alias("as_of")),
        "ev": ev,
        "notes": notes.join(targets, F.col("id") == F.col("event_id"), "left").select("id", "pubkey", "created_at", "ts", "k", F.coalesce("target", F.lit(0).cast("long")).alias("target")),
        "acts": acts,
        "tags": tags,
        "states": states,
        "state_items": items,
        "receipts": receipts,
        "profiles": once.where((F.col("kind") == PROFILE) & F.try_parse_json("content").isNotNull()).select("pubkey", F.col("content").alias("doc"), F.col("ts").alias("updated_at")),
        "relay_lists": each.where((F.col("kind") == RELAYS) & (F.col("name") == "r")).select("pubkey", F.col("raw").alias("relay")).distinct(),
        "reaction_contents": once.where(F.col("kind") == REACTION).select(F.col("id").alias("source_id"), "content"),
        "report_types": each.where((F.col("kind") == REPORT) & (F.col("name") == "e") & (F.col("hint") != "")).groupBy(F.col("event_id").alias("source_id")).agg(F.max_by("hint", "idx").alias("type")),
        "address_acts": addressed.join(once, F.col("event_id") == F.col("id")).join(sats, F.col("id") == F.col("source_id"), "left").select(F.col("id").alias("source_id"), relation.alias("relation"), "address", F.coalesce("sats", F.lit(0).cast("long")).alias("sats")),
    }


class ReadModel:
    """Operators over the frames of events, and of others by name: model("thr_summary")."""

    def __init__(self, events: DataFrame, **more: DataFrame):
        self.spark, self.name = events.sparkSession, f"events-{uuid.uuid4().hex}"
        self.made = frames(events) | more

    def __call__(self, operator: str) -> DataFrame:
        return build(self.spark, self.name, operator, self.made)


def _payloads(events: DataFrame) -> DataFrame:
    """payload: of every ten of the driver's events the first is a note, and the others are about it, by their types."""
    rows = events.withColumn("g", F.floor(F.col("event_id") / 10))
    first = rows.groupBy("g").agg(F.min("event_id").alias("head"))
    rows = rows.join(first, "g").withColumn("is_head", F.col("event_id") == F.col("head"))

    def signed(df: DataFrame, kind: Column, tags: Column) -> DataFrame:
        e = F.struct(F.sha2(F.col("user_id").cast("string"), 256).alias("pubkey"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at"), kind.alias("kind"), tags.alias("tags"), F.concat(F.lit("number "), F.col("event_id").cast("string")).alias("content"))
        made = df.select("g", e.alias("e")).withColumn("hex", canonical_id(F.col("e")))
        return made.select("g", "hex", F.to_json(F.struct(F.col("hex").alias("id"), "e.*", F.repeat(F.lit("a"), 128).alias("sig"))).alias("payload"))

    none = F.array().cast("array<array<string>>")
    heads = signed(rows.where("is_head"), F.lit(NOTE), none)
    others = rows.where("not is_head").join(heads.select("g", "hex"), "g")
    kind = F.when(F.col("event_type") == "view", NOTE).when(F.col("event_type") == "click", REACTION).when(F.col("event_type") == "purchase", RECEIPT).otherwise(REPORT)
    amount = F.array(F.lit("amount"), (F.floor(F.col("value") * 100) * 1000).cast("string"))
    about = F.array(F.array(F.lit("e"), F.col("hex"), F.lit(""), F.lit("root")), amount)
    return heads.unionByName(signed(others, kind, about)).select("payload")


def _read_model_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads through validation and the read model to interactions and threads."""
    checked = validate_events(_payloads(driver_events(spark, sf_dir)))
    model = ReadModel(checked.where("error_code is null").select("e.*"))
    acts = model("acts").groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target_id").alias("targets"), F.countDistinct("actor").alias("actors"), F.sum("sats").alias("sats"))
    depth = model("thr_depth").agg(F.lit("depth").alias("relation"), F.sum("depth").cast("long").alias("n"), F.countDistinct("root").alias("targets"), F.lit(0).cast("long").alias("actors"), F.lit(0).cast("long").alias("sats"))
    return acts.unionByName(depth)


QUERIES = {"ingest_read_model": _read_model_query}
ORACLES = {
    "ingest_read_model": """
WITH e AS (SELECT *, event_id // 10 AS g, event_id = min(event_id) OVER (PARTITION BY event_id // 10) AS head FROM events),
r AS (SELECT *, CASE event_type WHEN 'view' THEN 'reply' WHEN 'click' THEN 'reaction' WHEN 'purchase' THEN 'zap' ELSE 'report' END AS relation FROM e WHERE NOT head)
SELECT relation, count(*) AS n, count(DISTINCT g) AS targets, count(DISTINCT user_id) AS actors, CAST(sum(CASE WHEN relation = 'zap' THEN CAST(floor(value * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS sats FROM r GROUP BY relation
UNION ALL SELECT 'depth', (SELECT count(*) FROM r WHERE relation = 'reply'), (SELECT count(*) FROM e WHERE head), 0, 0"""
}
