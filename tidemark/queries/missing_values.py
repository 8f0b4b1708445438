"""Missing values."""

from __future__ import annotations


from ..operators import imputers, missing
from .registry import (
    DIRTY_CUSTOMER,
    DIRTY_ORDERS,
    dirty_customer,
    dirty_orders,
    query,
    rounded,
    table,
)

PRICES = "o_totalprice"
MODE = """(select o_orderpriority from dirty where o_orderpriority is not null
           group by 1 order by count(*) desc, o_orderpriority limit 1)"""
STRATEGIES = """
  select 'o_totalprice' as "column", 'double' as dtype, count(*) - count(o_totalprice) as missing,
         round((count(*) - count(o_totalprice)) / count(*) * 100, 2) as pct,
         case when skewness(o_totalprice) > 1 then 'median' else 'mean' end as suggested_strategy from dirty
  union all
  select 'o_orderpriority', 'string', count(*) - count(o_orderpriority),
         round((count(*) - count(o_orderpriority)) / count(*) * 100, 2),
         case when count(distinct o_orderpriority) + 1 < 20 then 'mode' else 'constant' end from dirty
"""


@query("m1_missing_report", DIRTY_ORDERS + STRATEGIES)
def m1(spark, folder):
    return missing.missing_report(dirty_orders(spark, folder))


@query(
    "m2_missing_cells",
    DIRTY_ORDERS
    + """select 2 * count(*) - count(o_totalprice) - count(o_orderpriority) as n_cells_missing,
                round((2 * count(*) - count(o_totalprice) - count(o_orderpriority)) / (count(*) * 4), 8)
                  as p_cells_missing from dirty""",
)
def m2(spark, folder):
    return rounded(missing.missing_cells(dirty_orders(spark, folder)), 8, "p_cells_missing")


@query(
    "m3_suggested_strategy",
    """with dirty as (
         select case when event_id % 7 = 0 then null else value end as value,
                case when event_id % 5 = 1 then null else event_type end as event_type,
                case when event_id % 3 = 1 then null else props end as props from events)
       select 'value' as "column", case when skewness(value) > 1 then 'median' else 'mean' end as strategy from dirty
       union all
       select 'event_type', case when count(distinct event_type) + 1 < 20 then 'mode' else 'constant' end from dirty
       union all
       select 'props', case when count(distinct props) + 1 < 20 then 'mode' else 'constant' end from dirty""",
)
def m3(spark, folder):
    df = table(spark, folder, "events").selectExpr(
        "case when event_id % 7 = 0 then null else value end as value",
        "case when event_id % 5 = 1 then null else event_type end as event_type",
        "case when event_id % 3 = 1 then null else props end as props",
    )
    rows = sorted(missing.suggest_strategies(df).items())
    return spark.createDataFrame(rows, "column string, strategy string")


def _filled(number: str, text: str, digits: int = 6) -> str:
    return DIRTY_ORDERS + f"""select o_orderkey, o_custkey,
        round(coalesce(o_totalprice, {number}), {digits}) as o_totalprice,
        coalesce(o_orderpriority, {text}) as o_orderpriority from dirty"""


def _fill(spark, folder, **options):
    df = missing.fill_missing(
        dirty_orders(spark, folder), columns=["o_totalprice", "o_orderpriority"], **options
    )
    return rounded(df, 6, "o_totalprice")


@query("m4_fill_mean", _filled("(select avg(o_totalprice) from dirty)", MODE))
def m4(spark, folder):
    return _fill(spark, folder, numeric_strategy="mean")


@query("m5_fill_median", _filled("(select quantile_cont(o_totalprice, 0.5) from dirty)", MODE))
def m5(spark, folder):
    return _fill(spark, folder, numeric_strategy="median")


@query("m6_fill_constant", _filled("-1.0", MODE))
def m6(spark, folder):
    return _fill(spark, folder, numeric_strategy="constant", fill_value={"o_totalprice": "-1"})


@query(
    "m7_fill_mode",
    DIRTY_CUSTOMER
    + """select c_custkey, bal, nat, coalesce(segment, (select segment from dirty where segment is not null
           group by 1 order by count(*) desc, segment limit 1)) as segment from dirty""",
)
def m7(spark, folder):
    df = dirty_customer(spark, folder)
    return missing.apply_fill(df, missing.fit_strategies(df.select("segment"), {"categorical": "mode"}))


@query("m8_fill_unknown", _filled("(select avg(o_totalprice) from dirty)", "'Unknown'"))
def m8(spark, folder):
    return _fill(spark, folder, numeric_strategy="mean", categorical_strategy="constant")


KNN = """, k as (select %(key)s as id, bal, nat from dirty),
  n_bal as (
    select q.id, d.bal as v, row_number() over (partition by q.id
             order by sqrt((q.nat - d.nat) * (q.nat - d.nat) * 2), d.bal) as r
    from k q join k d on q.bal is null and d.bal is not null and q.nat is not null and d.nat is not null),
  n_nat as (
    select q.id, d.nat as v, row_number() over (partition by q.id
             order by sqrt((q.bal - d.bal) * (q.bal - d.bal) * 2), d.nat) as r
    from k q join k d on q.nat is null and d.nat is not null and q.bal is not null and d.bal is not null),
  f_bal as (select id, avg(v) as v from n_bal where r <= 5 group by id),
  f_nat as (select id, avg(v) as v from n_nat where r <= 5 group by id)
  select k.id as %(key)s, round(coalesce(k.bal, f_bal.v, (select avg(bal) from k)), 6) as bal,
         round(coalesce(k.nat, f_nat.v, (select avg(nat) from k)), 6) as nat
  from k left join f_bal on f_bal.id = k.id left join f_nat on f_nat.id = k.id"""

DIRTY_SUPPLIER = """
  with dirty as (
    select s_suppkey,
           case when s_suppkey % 9 = 0 then null else s_acctbal / 1000 end as bal,
           case when s_suppkey % 14 = 3 then null else cast(s_nationkey as double) end as nat
    from supplier)
"""


def dirty_supplier(spark, folder):
    return table(spark, folder, "supplier").selectExpr(
        "s_suppkey",
        "case when s_suppkey % 9 = 0 then null else s_acctbal / 1000 end as bal",
        "case when s_suppkey % 14 = 3 then null else cast(s_nationkey as double) end as nat",
    )


@query("m9_fill_knn", DIRTY_CUSTOMER + KNN % {"key": "c_custkey"})
def m9(spark, folder):
    df = dirty_customer(spark, folder).drop("segment")
    return rounded(imputers.knn_fill(df, ["bal", "nat"]), 6, "bal", "nat")


@query("m9_fill_knn_supplier", DIRTY_SUPPLIER + KNN % {"key": "s_suppkey"})
def m9_supplier(spark, folder):
    return rounded(imputers.knn_fill(dirty_supplier(spark, folder), ["bal", "nat"]), 6, "bal", "nat")


ORDERS_KNN = """
  with k as (
    select o_orderkey, case when o_orderkey % 11 = 0 then null else o_totalprice / 1000 end as price,
           case when o_orderkey % 7 = 3 then null else cast(o_custkey as double) end as customer,
           cast(date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as double) as day from orders),
  n_price as (
    select q.o_orderkey, min({'d': sqrt((coalesce((q.customer - d.customer) * (q.customer - d.customer), 0)
        + (q.day - d.day) * (q.day - d.day)) * (3.0 / case when q.customer + d.customer is null then 1 else 2 end)),
        'v': d.price}, 5) as near
    from k q join k d on q.price is null and d.price is not null group by 1),
  n_customer as (
    select q.o_orderkey, min({'d': sqrt((coalesce((q.price - d.price) * (q.price - d.price), 0)
        + (q.day - d.day) * (q.day - d.day)) * (3.0 / case when q.price + d.price is null then 1 else 2 end)),
        'v': d.customer}, 5) as near
    from k q join k d on q.customer is null and d.customer is not null group by 1)
  select k.o_orderkey, round(coalesce(price, list_avg(list_transform(a.near, lambda x: x.v))), 6) as price,
         round(coalesce(customer, list_avg(list_transform(b.near, lambda x: x.v))), 6) as customer, day
  from k left join n_price a on a.o_orderkey = k.o_orderkey left join n_customer b on b.o_orderkey = k.o_orderkey"""


# three columns with several combinations of missing cells
@query("m9_fill_knn_orders", ORDERS_KNN)
def m9_orders(spark, folder):
    df = table(spark, folder, "orders").selectExpr(
        "o_orderkey",
        "case when o_orderkey % 11 = 0 then null else o_totalprice / 1000 end as price",
        "case when o_orderkey % 7 = 3 then null else cast(o_custkey as double) end as customer",
        "cast(datediff(o_orderdate, date'1992-01-01') as double) as day",
    )
    return rounded(imputers.knn_fill(df, ["price", "customer", "day"]), 6, "price", "customer")


@query(
    "m10_fill_regression",
    """with dirty as (
         select l_orderkey, l_partkey, l_linenumber, l_quantity,
                case when l_orderkey % 9 = 0 then null else l_extendedprice end as l_extendedprice from lineitem),
       f as (select regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a
             from dirty where l_extendedprice is not null)
       select l_orderkey, l_partkey, l_linenumber, l_quantity,
              round(coalesce(l_extendedprice, a + b * l_quantity), 4) as l_extendedprice from dirty, f""",
)
def m10_regression(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
        "case when l_orderkey % 9 = 0 then null else l_extendedprice end as l_extendedprice",
    )
    filled = imputers.iterative_fill(df, ["l_quantity", "l_extendedprice"], bayesian=False)
    return rounded(filled, 4, "l_extendedprice")


@query("m10_fill_iterative")
def m10(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey",
        "case when l_orderkey % 5 = 0 then null else l_quantity end as l_quantity",
        "case when l_orderkey % 9 = 0 then null else l_extendedprice end as l_extendedprice",
        "case when l_partkey % 7 = 0 then null else l_discount end as l_discount",
    )
    return imputers.iterative_fill(df, ["l_quantity", "l_extendedprice", "l_discount"])


@query("m11_strategy_map", _filled("(select quantile_cont(o_totalprice, 0.5) from dirty)", MODE))
def m11(spark, folder):
    df = missing.process_missing(
        dirty_orders(spark, folder), {"o_totalprice": "median", "numeric": "mean", "categorical": "mode"}
    )
    return rounded(df, 6, "o_totalprice")


@query("m12_fill_by_type", _filled("0.0", "'UNKNOWN'"))
def m12(spark, folder):
    df = missing.process_missing(
        dirty_orders(spark, folder), {"numeric": "constant", "categorical": "constant"}
    )
    return rounded(df, 6, "o_totalprice")


@query(
    "m13_drop_strategy",
    DIRTY_ORDERS
    + f"""select o_orderkey, o_custkey, o_totalprice, coalesce(o_orderpriority, {MODE}) as o_orderpriority
          from dirty where o_totalprice is not null""",
)
def m13(spark, folder):
    return missing.process_missing(
        dirty_orders(spark, folder), {"o_totalprice": "drop", "categorical": "mode"}
    )


@query(
    "m14_missing_summary",
    DIRTY_CUSTOMER
    + """select 'bal' as "column", round(min(bal), 6) as min, round(quantile_cont(bal, 0.25), 6) as q1,
                round(quantile_cont(bal, 0.5), 6) as median, round(quantile_cont(bal, 0.75), 6) as q3,
                round(max(bal), 6) as max from dirty
         union all
         select 'nat', min(nat), round(quantile_cont(nat, 0.25), 6), round(quantile_cont(nat, 0.5), 6),
                round(quantile_cont(nat, 0.75), 6), max(nat) from dirty""",
)
def m14(spark, folder):
    df = missing.missing_summary(dirty_customer(spark, folder))
    return rounded(df, 6, "min", "q1", "median", "q3", "max")


@query(
    "m15_verify_fill",
    DIRTY_ORDERS
    + """select count(*) as n_rows,
                2 * count(*) - count(o_totalprice) - count(o_orderpriority) as missing_before,
                cast(2 as bigint) as affected_columns, cast(0 as bigint) as missing_after from dirty""",
)
def m15(spark, folder):
    df = dirty_orders(spark, folder)
    return missing.verify_fill(df, missing.process_missing(df))


