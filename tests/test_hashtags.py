"""Hashtags and words without rows of all words, and documents by equal prefixes, against the SQL that they stand for."""

import duckdb
from pyspark.sql import functions as F

from strandline.operators import hashtags
from strandline.plans import catalog  # noqa: F401
from strandline.plans.template import REGISTRY, Operator

from .helpers import rows_of_duckdb, rows_of_spark


def by_sql(name, **frames):
    return Operator(name, "", REGISTRY[name].sql)(**frames)


def test_hashtags_and_frequent_words_as_sql_has_them(spark):
    many = " ".join(f"{a}{b}only" for a in "abcdef" for b in "ghijkl")  # 36 words that one post has
    texts = [(1, f"{many} Shared other words stand here behind", "a"), (2, "shared OTHER words stand here behind", "b"), (3, "", "a"), (4, "lone", "b")]
    texts += [(5, "again behind here", "a"), (5, "again here stand twice", "b"), (None, "twice behind", "a"), (None, "none behind", "b")]
    posts = spark.createDataFrame([(i, a, t) for i, t, a in texts], "id long, author string, text string").selectExpr("id", "author", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts", "'en' AS lang", "text")
    post_words = by_sql("post_words", posts=posts)
    counts = hashtags.tag_counts(posts)
    assert rows_of_spark(hashtags.hashtags(posts, counts)) == rows_of_spark(by_sql("hashtags", post_words=post_words))
    assert rows_of_spark(counts.select("tag", "df")) == rows_of_spark(post_words.groupBy("tag").agg(F.count(F.lit(1)).alias("df")))


def test_documents_of_one_beginning_meet_only_their_queries(spark):
    terms = spark.createDataFrame([("customers", 2), ("cust", 2), ("abc", 2), ("zz_z", 2), ("nobody", 1)], "tag string, df long")
    fields = spark.createDataFrame([(50, "Customer#1", "u_1@pay"), (100, "Customer#10", None), (7, "Customer#12", "x@y"), (150, "ab c", "a%b")], "pubkey long, name string, ln_address string")
    documents = spark.createDataFrame([("profile", "50", "Customer#1", "u_1@pay", 3), ("profile", "7", "Customer#12", "ua1@pay", 0), ("hashtag", "abcd", "abcd", "#abcd", 1), ("hashtag", "zzaz", "zzaz", None, 1), ("relay", "1", None, None, 9), ("identity", "ab c:x", "ab c", "ab", 2), ("post", "cust", "cust", None, 1), ("profile", "9", "customers", None, 0)], "kind string, key string, title string, alias string, popularity long")
    found = REGISTRY["srch_documents_rank"](srch_term_df=terms, attr_profile_fields=fields, srch_documents=documents)
    assert rows_of_spark(found) == rows_of_spark(by_sql("srch_documents_rank", srch_term_df=terms, attr_profile_fields=fields, srch_documents=documents))


def test_all_names_and_hashtags_are_queries_on_all_documents(spark):
    terms = spark.createDataFrame([("once", 1), ("many", 9), ("abc", 3)], "tag string, df long")
    fields = spark.createDataFrame([(7, "Al Bo", "x@y"), (8, "my_a", None), (9, "a%b", "100%"), (10, "back\\s", "_c"), (11, "", "#once")], "pubkey long, name string, ln_address string")
    kinds = "kind string, key string, title string, alias string, popularity long"
    long_title = "Many " + "words " * 5000
    rows = [("post", "1", long_title, None, 0), ("post", "1", long_title, None, 0), ("post", "1", "many", None, 0), ("post", None, "Once", None, 2), ("page", "2", "abcd", "x@y", 0), ("hashtag", "once", "once", "#once", 1)]
    rows += [("profile", "7", "Al Bosco", "x@y", 3), ("identity", "myxab:q", "my_a", "100%", 1), ("identity", "a1b", "aXXbc", "a%b", 1), ("relay", "9", "back\\slash", None, 4), ("relay", "xcy", None, None, 0)]
    rows += [("profile", f"{n}", "manyfold", None, n) for n in range(30, 40)]
    documents = spark.createDataFrame(rows, kinds)
    found = REGISTRY["srch_documents_rank"](srch_term_df=terms, attr_profile_fields=fields, srch_documents=documents)
    firsts = {(r.q, r.kind, r.key) for r in found.collect() if r.q}
    assert firsts >= {("once", "post", None), ("once", "hashtag", "once"), ("many", "post", "1"), ("abc", "page", "2"), ("al bo", "profile", "7"), ("x@y", "page", "2"), ("back\\s", "relay", "9")}
    assert firsts >= {("my_a", "identity", "myxab:q"), ("a%b", "identity", "a1b"), ("100%", "identity", "myxab:q"), ("_c", "relay", "xcy"), ("#once", "hashtag", "once")}
    db = duckdb.connect()
    for name, frame in (("srch_term_df", terms), ("attr_profile_fields", fields), ("srch_documents", documents)):
        types = ", ".join(f"{f.name} {'BIGINT' if f.dataType.typeName() == 'long' else 'VARCHAR'}" for f in frame.schema)
        db.sql(f"CREATE TABLE {name} ({types})")
        db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(frame.columns))})", [tuple(r) for r in frame.collect()])
    assert rows_of_spark(found) == rows_of_duckdb(db.sql(REGISTRY["srch_documents_rank"].duckdb()))
