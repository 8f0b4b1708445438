"""Jobs made of several operators."""

from __future__ import annotations


from ..functions import labels
from ..plans import diagnosis, prepare
from .outlier import counts_sql, report_sql
from .profiling import alerts_sql
from .registry import (
    DIRTY_ORDERS,
    SPIKED,
    dirty_orders,
    query,
    rounded,
    spiked_lineitem,
    table,
)

FLAGSHIP = """
  with d as (
    select o_orderkey, o_custkey,
           case when o_orderkey % 11 = 0 then null when o_orderkey % 101 = 0 then o_totalprice * 30
                else o_totalprice end as o_totalprice,
           case when o_orderkey % 13 = 0 then null else o_orderpriority end as o_orderpriority
    from orders),
  dirty as (select * from d union all select * from d where o_orderkey % 50 = 0),
  u as (select distinct * from dirty),
  f as (select o_orderkey, o_custkey,
               coalesce(o_totalprice, (select quantile_cont(o_totalprice, 0.5) from u)) as o_totalprice,
               coalesce(o_orderpriority, (select o_orderpriority from u where o_orderpriority is not null
                 group by 1 order by count(*) desc, o_orderpriority limit 1)) as o_orderpriority from u),
  b as (select quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.75) as q3 from f),
  k as (select f.* from f, b where o_totalprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))
"""


def spoiled_orders(spark, folder):
    """Orders with missing cells, extreme prices and copies."""
    d = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_custkey",
        "case when o_orderkey % 11 = 0 then null when o_orderkey % 101 = 0 then o_totalprice * 30 "
        "else o_totalprice end as o_totalprice",
        "case when o_orderkey % 13 = 0 then null else o_orderpriority end as o_orderpriority",
    )
    return d.unionByName(d.where("o_orderkey % 50 = 0"))


@query(
    "j1_auto_prepare",
    FLAGSHIP
    + """select o_orderkey, o_custkey, round((o_totalprice - lo) / (hi - lo), 6) as o_totalprice, o_orderpriority
         from k, (select min(o_totalprice) as lo, max(o_totalprice) as hi from k)""",
)
def j1(spark, folder):
    data, _ = prepare.auto_prepare(spoiled_orders(spark, folder), "median", "iqr", ["o_totalprice"])
    return rounded(data, 6, "o_totalprice")


# nearest neighbours and the choice among four removals
@query("j1_auto_prepare_defaults")
def j1_defaults(spark, folder):
    df = table(spark, folder, "customer").selectExpr(
        "c_custkey",
        "case when c_custkey % 9 = 0 then null when c_custkey % 97 = 1 then c_acctbal * 20 else c_acctbal end as bal",
        "case when c_custkey % 14 = 3 then null else cast(c_nationkey as double) end as nat",
        "case when c_custkey % 7 = 2 then null else c_mktsegment end as segment",
    )
    data, _ = prepare.auto_prepare(df.unionByName(df.where("c_custkey % 50 = 0")), columns=["bal", "nat"])
    return data



@query(
    "j2_prepare_by_number",
    DIRTY_ORDERS
    + """, u as (select distinct * from dirty),
  f as (select o_orderkey, o_custkey,
               coalesce(o_totalprice, (select avg(o_totalprice) from u)) as o_totalprice,
               coalesce(o_orderpriority, 'Unknown') as o_orderpriority from u)
  select o_orderkey, o_custkey, round((o_totalprice - m) / s, 6) + 0.0 as o_totalprice, o_orderpriority
  from f, (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as s from f)""",
)
def j2(spark, folder):
    df = prepare.prepare(
        dirty_orders(spark, folder),
        [
            0,
            (1, {"numeric_strategy": "mean", "categorical_strategy": "constant",
                 "columns": ["o_totalprice", "o_orderpriority"]}),
            (3, {"columns": ["o_totalprice"]}),
        ],
    )
    return rounded(df, 6, "o_totalprice")


@query(
    "j3_step_log",
    FLAGSHIP
    + """select 0 as place, 'drop_duplicates' as step, (select count(*) from dirty) as rows_in,
           (select count(*) from u) as rows_out, (select count(*) from dirty) > (select count(*) from u) as applied
  union all select 1, 'fill_missing', (select count(*) from u), (select count(*) from u), true
  union all select 2, 'remove_outliers', (select count(*) from u), (select count(*) from k), true
  union all select 3, 'normalize', (select count(*) from k), (select count(*) from k), true""",
)
def j3(spark, folder):
    _, log = prepare.auto_prepare(spoiled_orders(spark, folder), "median", "iqr", ["o_totalprice"])
    return log.drop("description")


COLUMNS = ["l_quantity", "l_extendedprice"]


def diagnosis_sql(view: str, columns: list[str], all_columns: list[str]) -> str:
    """The sections on missing cells, duplicates, outliers and scaling; follows a view definition."""
    cells = len(all_columns)
    lost = f"({cells} * count(*) - " + " - ".join(f"count({c})" for c in all_columns) + ")"
    return f""", {counts_sql(view, columns)}, report as ({report_sql()}),
  g as (select *, count(*) as k from {view} group by all),
  r as (select col, list_filter([
      case when lo < q1 - 1.5 * (q3 - q1) or hi > q3 + 1.5 * (q3 - q1) then '{labels.HAS_OUTLIERS}' end,
      case when not abs(mean - q2) < 0.1 * mean then '{labels.ASYMMETRIC}' end,
      case when mean <> 0 and std / mean > 0.5 then '{labels.HIGH_VARIATION}' end,
      case when abs(skew) > 1 then '{labels.STRONG_SKEW}' end], lambda x: x is not null) as reasons from st),
  found as (
  select 'missing' as section, '*' as "column", 'n_cells_missing' as item, cast({lost} as double) as value,
         null::varchar as text from {view}
  union all select 'missing', '*', 'p_cells_missing', {lost} / ({cells} * count(*)), null from {view}
  union all select 'duplicates', '*', 'n_duplicates', sum(case when k > 1 then 1 else 0 end), null from g
  union all select 'duplicates', '*', 'p_duplicates', sum(case when k > 1 then 1 else 0 end) / sum(k), null from g
  union all select 'outliers', "column", method, n, direction from report
  union all select 'scaling', col, case when len(reasons) > 0 then '{labels.STANDARDIZE}' else '{labels.NORMALIZE}' end,
      null, case when len(reasons) > 0 then array_to_string(reasons, ', ') else '{labels.EVEN}' end from r)"""


@query(
    "j4_diagnose",
    SPIKED
    + diagnosis_sql("spiked", COLUMNS, ["l_orderkey", "l_linenumber", *COLUMNS])
    + ' select section, "column", item, round(value, 6) as value, text from found',
)
def j4(spark, folder):
    df = diagnosis.diagnose(spiked_lineitem(spark, folder), COLUMNS, check_alerts=False)
    return rounded(df, 6, "value")


ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
ORDER_TEXTS = ["o_orderstatus", "o_orderdate", "o_orderpriority"]


@query(
    "j4_diagnose_all",
    "with v as (select * from orders)"
    + diagnosis_sql("v", ["o_totalprice"], ORDER_NUMBERS + ORDER_TEXTS)
    + """ select section, "column", item, round(value, 4) as value, text from (select * from found
        union all select 'alerts', col, alert, value, null from ("""
    + alerts_sql("v", ORDER_NUMBERS, ORDER_TEXTS)
    + "))",
)
def j4_all(spark, folder):
    return rounded(diagnosis.diagnose(table(spark, folder, "orders"), ["o_totalprice"]), 4, "value")
