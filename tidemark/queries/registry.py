"""Registry of queries, and the views with planted defects they run on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query under a name, with its SQL over the same tables."""

    def register(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(run, sql)
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round doubles, so that engines that add in another order give equal results."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


# Views with planted defects: the same expressions in Spark and in SQL.

DIRTY_ORDERS = """
  with d as (
    select o_orderkey, o_custkey,
           case when o_orderkey % 11 = 0 then null else o_totalprice end as o_totalprice,
           case when o_orderkey % 13 = 0 then null else o_orderpriority end as o_orderpriority
    from orders),
  dirty as (select * from d union all select * from d where o_orderkey % 50 = 0)
"""


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_custkey",
        "case when o_orderkey % 11 = 0 then null else o_totalprice end as o_totalprice",
        "case when o_orderkey % 13 = 0 then null else o_orderpriority end as o_orderpriority",
    )
    return d.unionByName(d.where("o_orderkey % 50 = 0"))


DIRTY_CUSTOMER = """
  with dirty as (
    select c_custkey,
           case when c_custkey % 9 = 0 then null else c_acctbal / 1000 end as bal,
           case when c_custkey % 14 = 3 then null else cast(c_nationkey as double) end as nat,
           case when c_custkey % 7 = 2 then null else c_mktsegment end as segment
    from customer)
"""


def dirty_customer(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        "c_custkey",
        "case when c_custkey % 9 = 0 then null else c_acctbal / 1000 end as bal",
        "case when c_custkey % 14 = 3 then null else cast(c_nationkey as double) end as nat",
        "case when c_custkey % 7 = 2 then null else c_mktsegment end as segment",
    )


SPIKED = """
  with spiked as (
    select l_orderkey, l_linenumber, l_quantity,
           case when l_orderkey % 997 = 0 then l_extendedprice * 20 else l_extendedprice end as l_extendedprice
    from lineitem)
"""


def spiked_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_quantity",
        "case when l_orderkey % 997 = 0 then l_extendedprice * 20 else l_extendedprice end as l_extendedprice",
    )


STRINGLY = """
  with stringly as (
    select event_id,
           case when event_id % 17 = 0 then 'N/A' when event_id % 19 = 0 then 'abc'
                else cast(cast(floor(value * 100) as bigint) as varchar) end as value_txt
    from events)
"""


def stringly_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id",
        "case when event_id % 17 = 0 then 'N/A' when event_id % 19 = 0 then 'abc' "
        "else cast(cast(floor(value * 100) as bigint) as string) end as value_txt",
    )


TYPO_PARTS = """
  with typos as (
    select p_partkey, case when p_partkey % 10 = 0 then replace(p_type, 'O', '0') else p_type end as p_type
    from part)
"""


def typo_parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr(
        "p_partkey",
        "case when p_partkey % 10 = 0 then replace(p_type, 'O', '0') else p_type end as p_type",
    )
