"""Raw payloads: reading them, and staged validation into events and a quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BYTES, MAX_CONTENT = 262_144, 131_072
FIELDS = ("id", "pubkey", "created_at", "kind", "tags", "content", "sig")
EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("pubkey", T.StringType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("tags", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("content", T.StringType()),
        T.StructField("sig", T.StringType()),
    ]
)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """relay_url, payload (text) and file of newline-delimited {relay_url, payload} files under path; blank lines are skipped.

    Files in the order of their names are what a replay reads; Spark reads them side by side, so order by file where that matters.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).where(F.trim("value") != "")
    return lines.select(F.get_json_object("value", "$.relay_url").alias("relay_url"), F.coalesce(F.get_json_object("value", "$.payload"), F.col("value")).alias("payload"), F.col("_metadata.file_path").alias("file"))


def canonical_id(e: Column) -> Column:
    """SHA-256 of the compact JSON of [0, pubkey, created_at, kind, tags, content]."""
    text = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    parts = [F.lit("0"), text(e["pubkey"]), e["created_at"].cast("string"), e["kind"].cast("string"), F.to_json(e["tags"]), text(e["content"])]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns, made once a row: by a generator of one row, as conditions on them would else be pushed below with copies of what
    they are made of, and those of copies of their own."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def validate_events(raw: DataFrame) -> DataFrame:
    """raw (payload and others) with the event's fields as struct e, error_code and error_stage; both are null for a valid event.

    Checks run in a fixed order and the first that fails is told: size, JSON, fields, their types, formats, ranges, the id as a hash of
    the content, then the content itself. Signatures are not checked.
    """
    p = F.coalesce(F.col("payload"), F.lit(""))
    raw = _once(raw, {"e": F.from_json(p, EVENT), "__keys": F.json_object_keys(p), "__json": F.try_parse_json(p).isNotNull()})
    e = F.col("e")
    missing = F.size(F.array_except(F.array(*map(F.lit, FIELDS)), F.col("__keys"))) > 0
    types = F.lit(False)
    for name in FIELDS:
        types = types | e[name].isNull()
    hex_ = lambda c, n: ~c.rlike(f"^[0-9a-f]{{{n}}}$")
    checks = [
        ("empty", "envelope", F.trim(p) == ""),
        ("too_large", "envelope", F.octet_length(p) > MAX_BYTES),
        ("invalid_json", "json", ~F.col("__json")),
        ("not_object", "json", F.col("__keys").isNull()),
        ("missing_field", "fields", missing),
        ("field_type", "fields", types | F.coalesce(F.get_json_object(p, "$.kind").rlike("[^0-9-]"), F.lit(False)) | p.rlike(r'"kind"\s*:\s*"')),
        ("field_format", "format", hex_(e["id"], 64) | hex_(e["pubkey"], 64) | hex_(e["sig"], 128)),
        ("field_range", "format", (e["created_at"] < 0) | ~e["kind"].between(0, 65535)),
        ("id_mismatch", "hash", e["id"] != canonical_id(e)),
        ("content_too_large", "content", F.octet_length(e["content"]) > MAX_CONTENT),
        ("control_characters", "content", e["content"].rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")),
    ]
    verdict = F
    for name, at, fails in checks:  # one chain, so that no check runs twice
        verdict = verdict.when(fails, F.struct(F.lit(name).alias("code"), F.lit(at).alias("stage")))
    none = F.lit(None).cast("struct<code:string,stage:string>")
    raw = _once(raw, {"__verdict": verdict.otherwise(none)})
    return raw.withColumn("error_code", F.col("__verdict.code")).withColumn("error_stage", F.col("__verdict.stage")).drop("__keys", "__json", "__verdict")


def quarantine(validated: DataFrame) -> DataFrame:
    return validated.where("error_code is not null").drop("e")


def invalid_stats(validated: DataFrame) -> DataFrame:
    return quarantine(validated).groupBy("error_code", "error_stage").agg(F.count(F.lit(1)).alias("n"))


def payloads_of(events: DataFrame) -> DataFrame:
    """Payload lines made from the driver's events: source id, relay_url, payload; nine kinds of damage by the number in props."""
    n = F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 20
    hexed = lambda c: F.sha2(F.concat_ws(":", c, F.col("event_id").cast("string")), 256)
    kind = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 7).otherwise(1984)
    tags = F.array(F.array(F.lit("e"), hexed(F.lit("target"))), F.array(F.lit("t"), F.col("event_type")))
    content = F.when(n == 9, F.lit("a\u0001b")).otherwise(F.concat(F.lit("é says \"hi\" \\ "), F.col("event_type")))
    e = F.struct(F.sha2(F.col("user_id").cast("string"), 256).alias("pubkey"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at"), F.when(n == 7, 70000).otherwise(kind).alias("kind"), tags.alias("tags"), content.alias("content"))
    rest = [c for c in ("again",) if c in events.columns]
    out = events.select("event_id", *rest, n.alias("n"), F.concat(F.lit("wss://relay"), (F.col("user_id") % 12).cast("string")).alias("relay_url"), e.alias("e"))
    made = canonical_id(F.col("e"))
    fields = F.struct(F.when(F.col("n") == 8, F.sha2(made, 256)).otherwise(made).alias("id"), "e.*", F.concat(F.when(F.col("n") == 6, F.lit("X")).otherwise(F.lit("a")), F.repeat(F.lit("b"), 127)).alias("sig"))
    good = F.to_json(fields)
    payload = (
        F.when(F.col("n") == 1, F.lit(" "))
        .when(F.col("n") == 2, F.expr("substring(good, 1, length(good) - 5)"))
        .when(F.col("n") == 3, F.lit("[1]"))
        .when(F.col("n") == 4, F.regexp_replace("good", r',"sig":"[^"]*"', ""))
        .when(F.col("n") == 5, F.regexp_replace("good", r'"kind":(\d+)', r'"kind":"$1"'))
        .otherwise(F.col("good"))
    )
    out = _once(out, {"good": good})
    return out.select("event_id", "relay_url", payload.alias("payload"), *rest)


def driver_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events, dealt anew: making and checking a row's payload takes far longer than its few bytes, and a file of many rows
    is read by few tasks."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").repartition("event_id")


def _validate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate_events(payloads_of(driver_events(spark, sf_dir))).select("event_id", "error_code", "error_stage")


def _stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_stats(validate_events(payloads_of(driver_events(spark, sf_dir))))


def _quarantine_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine(validate_events(payloads_of(driver_events(spark, sf_dir)))).select("event_id", "relay_url", "error_code")


def _fixture_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads written as files of lines and read back, by relay."""
    from ..streaming.jobs import folder

    path = folder(spark, "ndjson")
    lines = payloads_of(driver_events(spark, sf_dir)).select(F.to_json(F.struct("relay_url", "payload")).alias("value"))
    lines.union(spark.createDataFrame([("",), ("  ",)], "value string")).repartition(3).write.text(path)
    found = read_payloads(spark, path)
    return found.groupBy("relay_url").agg(F.count(F.lit(1)).alias("n"), (F.countDistinct("file") <= 3).alias("in_files"))


_EXPECTED = """
SELECT event_id, CASE n WHEN 1 THEN 'empty' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'not_object' WHEN 4 THEN 'missing_field' WHEN 5 THEN 'field_type' WHEN 6 THEN 'field_format'
  WHEN 7 THEN 'field_range' WHEN 8 THEN 'id_mismatch' WHEN 9 THEN 'control_characters' END AS error_code,
  CASE WHEN n = 1 THEN 'envelope' WHEN n IN (2, 3) THEN 'json' WHEN n IN (4, 5) THEN 'fields' WHEN n IN (6, 7) THEN 'format' WHEN n = 8 THEN 'hash' WHEN n = 9 THEN 'content' END AS error_stage
FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 20 AS n FROM events) e"""
QUERIES = {"ingest_quarantine": _quarantine_query, "src_ndjson_fixture": _fixture_query, "ingest_validate": _validate_query, "ingest_invalid_stats": _stats_query}
_RELAY = "SELECT event_id, concat('wss://relay', CAST(user_id % 12 AS VARCHAR)) AS relay_url, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 20 AS n FROM events"
ORACLES = {"ingest_quarantine": f"SELECT x.event_id, r.relay_url, x.error_code FROM ({_EXPECTED}) x JOIN ({_RELAY}) r ON x.event_id = r.event_id WHERE x.error_code IS NOT NULL",
    "src_ndjson_fixture": f"SELECT relay_url, count(*) AS n, true AS in_files FROM ({_RELAY}) r GROUP BY relay_url", "ingest_validate": _EXPECTED, "ingest_invalid_stats": f"SELECT error_code, error_stage, count(*) AS n FROM ({_EXPECTED}) x WHERE error_code IS NOT NULL GROUP BY error_code, error_stage"}
