"""The registered queries: against DuckDB where SQL can say it, else against small versions of the contract."""

import pytest

from strandline.llm.oracles import ORACLES
from strandline.llm.queries import QUERIES

from ..helpers import database, rows_of_duckdb, rows_of_spark

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, name):
    assert rows_of_spark(QUERIES[name](spark, SF)) == rows_of_duckdb(database(SF).sql(ORACLES[name]))


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    n = docs.count()
    for k, (_, stage) in enumerate(p.STAGES[:-1]):
        docs = stage(spark, docs, SF)
        assert docs.columns == names
        if k < 3:
            assert docs.count() <= n and docs.select("doc_id").distinct().count() == docs.count()
            n = docs.count()
    ids = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
    last = p.run(spark, SF)
    assert {r["doc_id"] for r in last.select("doc_id").distinct().collect()} == ids
    assert last.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
