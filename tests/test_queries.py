"""Every relational query against DuckDB at the smallest scale."""

import pytest

from strandline.plans.catalog import ADAPTERS, ORACLES, QUERIES
from strandline.plans.template import REGISTRY, expanded

from .helpers import database, rows_of_duckdb, rows_of_spark

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_duckdb(spark, db, name):
    assert rows_of_spark(QUERIES[name](spark, SF)) == rows_of_duckdb(db.sql(ORACLES[name]))


def test_every_operator_is_a_query():
    assert set(REGISTRY) - set(ADAPTERS) <= set(QUERIES)


def test_macros_nest():
    assert expanded("@isum(@div(a, 2))", 0) == "CAST(sum(((a) div (2))) AS BIGINT)"
    assert expanded("@matches(x, 'a,(b')", 1) == "regexp_matches(x, 'a,(b')"
