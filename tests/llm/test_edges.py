"""Empty tables and very long inputs of the operators whose other tests don't have them."""

import base64
import hashlib

from pyspark.sql import functions as F

from strandline.llm.chat import format_chats, read_back
from strandline.llm.common import word_count
from strandline.llm.mixing import mix
from strandline.llm.quality import judged
from strandline.llm.warc import read_archive, write_archive

LABELS = "doc_id long, quality int, toxic int"


def test_no_conversations(spark):
    assert read_back(format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_quality_without_documents_or_labels(spark):
    schema = "doc_id long, text string, lang string, quality int"
    assert judged(spark.createDataFrame([], schema), spark.createDataFrame([(1, 1, 0)], LABELS)).count() == 0
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven", "en", 7), (2, None, None, 8)], schema)
    found = {r["doc_id"]: (r["__q_kept"], r["quality"]) for r in judged(docs, spark.createDataFrame([], LABELS)).collect()}
    assert found == {1: (True, 7), 2: (False, 8)}


def test_a_very_long_text_is_mixed_whole(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") == 1, F.repeat(F.lit("word "), 2_000_000)).otherwise("a b").alias("text"))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    found = {r["doc_id"]: (r["size"], r["taken"]) for r in mix(sized).collect()}
    assert found[1][0] == 2_000_000 and found[1][1] in (2_000_000, 4_000_000) and found[0][0] == 2
    assert mix(sized.limit(0)).count() == 0


def test_a_very_long_payload_is_read_back(spark):
    long_ = "<p>é</p>" * 1_500_000
    pages = spark.createDataFrame([(1, "http://a.example/", "x"), (2, "http://a.example/b", None)], "page_id long, url string, html string").withColumn("html", F.when(F.col("page_id") == 1, F.repeat(F.lit("<p>é</p>"), 1_500_000)).otherwise(F.col("html")))
    found = {r["page_id"]: r for r in read_archive(write_archive(pages, shards=2), pages.select("url")).collect()}
    assert found[1]["payload_bytes"] == len(long_.encode()) and found[2]["payload_bytes"] == 0
    assert found[1]["payload_digest"] == base64.b32encode(hashlib.sha1(long_.encode()).digest()).decode()
    assert read_archive(write_archive(pages.limit(0), shards=2), pages.limit(0).select("url")).count() == 0
