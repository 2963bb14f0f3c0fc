"""Shared pieces of the registered queries: table loading, derived inputs, SQL text builders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.operators.query import run_sql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# The SQL twins of footer queries read the files the check runs on.
CHECK_DIR = "/root/testdata/sf0.01"

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DATE = r"^\s*\d{4}-\d{1,2}(-\d{1,2}([T ].*)?)?\s*$"

COLUMNS = {
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment".split(),
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split(),
    "lineitem": (
        "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
        "l_returnflag l_linestatus l_shipdate"
    ).split(),
    "events": "event_id ts user_id event_type value props".split(),
    "documents": "doc_id text lang source n_chars".split(),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    return run_sql(spark, {t: load(spark, sf_dir, t) for t in tables}, text)


# Events with a text column that holds numbers, times, JSON and nulls, by event type.
MIXED = """
SELECT event_id, user_id, event_type,
       CASE event_type WHEN 'view' THEN CAST(value AS {text}) WHEN 'click' THEN CAST(ts AS {text})
                       WHEN 'error' THEN NULL WHEN 'signup' THEN '' ELSE props END AS mixed
FROM events
"""
MIXED_COLUMNS = ["event_id", "user_id", "event_type", "mixed"]


def mixed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, MIXED.format(text="STRING"), "events")


MIXED_TWIN = MIXED.format(text="VARCHAR")


# Orders with columns that are partly empty, constant, empty, or zero.
PATCHY = """
SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'N/A' WHEN o_orderpriority = '2-HIGH' THEN '' ELSE o_orderpriority END AS priority,
       CAST(NULL AS {text}) AS nothing, 'same' AS fixed, o_orderkey * 0 AS zero,
       CASE WHEN o_orderstatus = 'P' THEN o_totalprice END AS part_price, o_orderdate
FROM orders
"""
PATCHY_COLUMNS = ["o_orderkey", "status", "priority", "nothing", "fixed", "zero", "part_price", "o_orderdate"]
PATCHY_TWIN = PATCHY.format(text="VARCHAR")


def patchy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, PATCHY.format(text="STRING"), "orders")


# A later copy of orders: the 13th of each month is gone, prices of the 7th are raised by
# one, orders of the 21st come again under new keys, and one column has another spelling.
CHANGED = """
SELECT o_orderkey, o_custkey AS "oCustKey", o_orderstatus,
       CASE WHEN extract(day FROM o_orderdate) = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority
FROM orders WHERE extract(day FROM o_orderdate) <> 13
UNION ALL
SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE extract(day FROM o_orderdate) = 21
"""


def diff_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, sf_dir, "orders"), sql(spark, sf_dir, CHANGED, "orders")


def joined_issues(df: DataFrame) -> DataFrame:
    """Arrays as comma-separated text, so that both engines compare plain values."""
    return df.withColumn("issues", F.array_join("issues", ","))


def file_name(column: str):
    return F.regexp_extract(column, "[^/]+$", 0)


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def between_percentiles(value: str, estimate: str, low: float, high: float) -> str:
    """Spark SQL: whether an estimate lies between two percentiles of its group, from the ranks of the estimate and its neighbours; no values are kept.

    A percentile is the value at a rank, or between those at two ranks; it has to be worked out only where the estimate lies between these two.
    """
    last = f"(count({value}) - 1)"
    at_most, less = f"count_if({value} <= {estimate})", f"count_if({value} < {estimate})"
    least = f"max({value}) FILTER (WHERE {value} <= {estimate})", f"min({value}) FILTER (WHERE {value} > {estimate})"
    most = f"max({value}) FILTER (WHERE {value} < {estimate})", f"min({value}) FILTER (WHERE {value} >= {estimate})"

    def percentile(rank: str, pair: tuple[str, str]) -> str:
        return f"(ceil({rank}) - {rank}) * {pair[0]} + ({rank} - floor({rank})) * {pair[1]}"

    first, second = f"{low}D * {last}", f"{high}D * {last}"
    return f"""CASE WHEN {estimate} IS NOT NULL THEN CASE WHEN ceil({first}) < {at_most} THEN true WHEN floor({first}) >= {at_most} THEN false ELSE {percentile(first, least)} <= {estimate} END
                AND CASE WHEN floor({second}) >= {less} THEN true WHEN ceil({second}) < {less} THEN false ELSE {percentile(second, most)} >= {estimate} END END"""
