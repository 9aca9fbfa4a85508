import hashlib

from strandline.llm.exact_dedup import exact_groups


def test_brute_force(spark):
    texts = ["a", "a ", "A", "", None, "ß", "long " * 30000]
    rows = [(i, texts[i * i % 7], "c", i) for i in range(200)] + [(300, "a", "d", 1), (300, "a", "d", 1)]
    found = exact_groups(spark.createDataFrame(rows, "doc_id long, text string, digest string, n int").repartition(9)).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    want = sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)
    assert sorted(tuple(r) for r in found) == want


def test_nulls_and_empty(spark):
    assert exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (row,) = exact_groups(spark.createDataFrame([(None, "x")], "doc_id long, text string")).collect()
    assert row["keep_id"] is None and row["kept"] and row["group_size"] == 1
