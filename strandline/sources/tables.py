"""Tables: reading with a fixed schema, and the derived tables and states that batches are merged into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store

#: Fixed schemas of the tables that jobs read; further columns of a file are left alone.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string",
    "events": "event_id long, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table of that name; raises ValueError if a column of its schema is missing or of another type."""
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    have = dict(found.dtypes)
    for field in SCHEMAS.get(name, "").split(", "):
        if field:
            column, type_ = field.split(" ")
            type_ = {"long": "bigint"}.get(type_, type_)
            if have.get(column) != type_:
                raise ValueError(f"{name}.{column} is {have.get(column)}, not {type_}")
    return found


def _tables_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [load(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name in SCHEMAS]
    out = counts[0]
    for other in counts[1:]:
        out = out.union(other)
    return out


def _sink_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily activity upserted by day and kind: a first run whose last days are wrong, then runs that hold those days in part, one of them twice."""
    from ..plans.folders import new_folder
    from ..plans.template import build

    store = Store(spark, new_folder(spark, "sink"), ("day", "kind"), ("-run",), bucket_by=("day",), buckets=16)
    daily = build(spark, sf_dir, "eco_kind_activity").select("day", "kind", "family", "n", "authors")
    late = daily.where("day > '2024-01-10'")
    runs = [daily.where("day < '2024-01-20'").withColumn("n", F.when(F.col("day") > "2024-01-10", F.lit(-1).cast("long")).otherwise(F.col("n"))), late.where("kind < 5"), late.where("kind >= 5")]
    for k in (0, 1, 2, 1):
        store.upsert(runs[k].withColumn("run", F.lit(k)), k)
    return store.read().drop("run")


def merged_states(states: DataFrame, store: Store, batch: int) -> None:
    """Take a batch of events (pubkey, kind, d, id, created_at) into the store of the newest event of each replaceable kind and
    author, and each addressable kind, author and identifier; ties by larger id."""
    replaceable = "kind IN (0, 3) OR (kind >= 10000 AND kind < 20000) OR (kind >= 30000 AND kind < 40000)"
    store.upsert(states.where(replaceable).select("pubkey", "kind", "d", "id", "created_at"), batch)


def state_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    return Store(spark, path, ("pubkey", "kind", "d"), ("-created_at", "-id"), buckets=buckets)


def _states_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest states by merging overlapping batches in any order of time, the second of them twice."""
    from ..plans.folders import new_folder
    from ..plans.template import build

    states = build(spark, sf_dir, "states")
    store = state_store(spark, new_folder(spark, "states"), 16)
    parts = [states.where("id % 3 <> 0"), states.where("id % 3 <> 1"), states.where("id % 4 = 0")]
    for k in (0, 1, 1, 2):
        merged_states(parts[k], store, k)
    return store.read()


def _sink_oracle() -> str:
    from ..plans.template import oracle

    return oracle("eco_kind_activity")


def _states_oracle() -> str:
    from ..plans.template import oracle

    return oracle("state_replaceable")


QUERIES = {"src_parquet_tables": _tables_query, "sink_tables": _sink_query, "state_replaceable_merged": _states_query}


def oracles() -> dict[str, str]:
    return {"src_parquet_tables": " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n FROM {name}" for name in SCHEMAS), "sink_tables": _sink_oracle(), "state_replaceable_merged": _states_oracle()}
