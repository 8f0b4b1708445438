"""Selections and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import categorical_columns, numeric_columns
from ..operators import duplicates, missing, profile
from .registry import DIRTY_ORDERS, dirty_orders, query, table


@query(
    "p1_numeric_columns",
    """select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
       from lineitem""",
)
def p1(spark, folder):
    df = table(spark, folder, "lineitem")
    return df.select(*numeric_columns(df))


@query("p2_other_columns", "select c_name, c_mktsegment from customer")
def p2(spark, folder):
    df = table(spark, folder, "customer")
    return df.select(*categorical_columns(df))


@query(
    "p3_shape", "select count(*) as n_rows, cast(11 as bigint) as n_columns from lineitem"
)
def p3(spark, folder):
    return profile.shape(table(spark, folder, "lineitem"))


@query(
    "p4_drop_missing",
    DIRTY_ORDERS + "select * from dirty where o_totalprice is not null and o_orderpriority is not null",
)
def p4(spark, folder):
    return missing.drop_missing(dirty_orders(spark, folder), ["o_totalprice", "o_orderpriority"])


@query(
    "p5_any_missing",
    DIRTY_ORDERS + "select bool_or(o_totalprice is null or o_orderpriority is null) as any_missing from dirty",
)
def p5(spark, folder):
    return missing.any_missing(dirty_orders(spark, folder))


@query("d1_drop_duplicates", DIRTY_ORDERS + "select distinct * from dirty")
def d1(spark, folder):
    return duplicates.drop_duplicates(dirty_orders(spark, folder))


@query(
    "d2_dense_row_id",
    """select o_orderkey, o_totalprice,
              row_number() over (order by o_totalprice, o_orderkey) - 1 as row_id from orders""",
)
def d2(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return duplicates.dense_row_id(df, ["o_totalprice", "o_orderkey"])


@query(
    "d3_surplus_copies",
    DIRTY_ORDERS
    + """select o_orderkey, o_custkey, o_totalprice, o_orderpriority
         from (select *, row_number() over (partition by o_orderkey, o_custkey, o_totalprice, o_orderpriority) as k
               from dirty) where k > 1""",
)
def d3(spark, folder):
    return duplicates.surplus_copies(dirty_orders(spark, folder))


GROUPS = DIRTY_ORDERS + ", g as (select *, count(*) as n from dirty group by all) "


@query("d4_has_duplicates", GROUPS + "select sum(n) > count(*) as has_duplicates from g")
def d4(spark, folder):
    return duplicates.has_duplicates(dirty_orders(spark, folder))


@query(
    "d5_duplicate_report",
    GROUPS
    + """select cast(sum(n) as bigint) as total_rows, cast(sum(n - 1) as bigint) as duplicates_count,
                cast(sum(n - 1) as bigint) as removed_rows, count(*) as remaining_rows,
                false as has_duplicates from g""",
)
def d5(spark, folder):
    return duplicates.duplicate_report(dirty_orders(spark, folder))


@query(
    "d6_duplicate_examples",
    GROUPS + "select o_orderkey, o_custkey, o_totalprice, o_orderpriority from g where n > 1 order by o_orderkey limit 2",
)
def d6(spark, folder):
    return duplicates.duplicate_examples(dirty_orders(spark, folder), ["o_orderkey"], 2)


@query(
    "d7_duplicate_rate",
    GROUPS
    + """select cast(sum(case when n > 1 then 1 else 0 end) as bigint) as n_duplicates,
                round(sum(case when n > 1 then 1 else 0 end) / sum(n), 8) as p_duplicates from g""",
)
def d7(spark, folder):
    df = duplicates.duplicate_rate(dirty_orders(spark, folder))
    return df.select("n_duplicates", F.round("p_duplicates", 8).alias("p_duplicates"))
