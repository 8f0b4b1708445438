"""Profiles, chart data, types and expectations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.storage import settle
from ..operators import charts, dependencies, outliers, profile, profile_state, quality
from .outlier import stats_sql
from .registry import (
    DIRTY_CUSTOMER,
    DIRTY_ORDERS,
    SPIKED,
    STRINGLY,
    TYPO_PARTS,
    dirty_customer,
    dirty_orders,
    query,
    rounded,
    spiked_lineitem,
    stringly_events,
    table,
    typo_parts,
)

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def counts_sql(view: str, columns: list[str]) -> str:
    """Distinct values, values that occur once, and the smallest most frequent value, per column."""
    return " union all ".join(
        f"""select '{c}' as col, count(*) as n_distinct, cast(sum(case when k = 1 then 1 else 0 end) as bigint) as n_unique,
              max(k) as top, arg_min(v, (-k, v)) as mode
            from (select cast({c} as varchar) as v, count(*) as k from {view} where {c} is not null group by 1)"""
        for c in columns
    )


def numeric_sql(view: str, columns: list[str]) -> str:
    signs = " union all ".join(
        f"""select '{c}' as col, cast(sum(case when {c} = 0 then 1 else 0 end) as bigint) as zeros,
              cast(sum(case when {c} < 0 then 1 else 0 end) as bigint) as negatives from {view}"""
        for c in columns
    )
    return f"""st as ({stats_sql(view, columns)}), cn as ({counts_sql(view, columns)}), sg as ({signs})
  select st.col as "column", n, n_rows - n as missing, round(lo, 6) as min, round(hi, 6) as max, round(mean, 6) as mean,
         round(std, 6) as std, round(std / mean, 6) as cv, round(p5, 6) as p5, round(q1, 6) as p25,
         round(q2, 6) as p50, round(q3, 6) as p75, round(p95, 6) as p95, round(q3 - q1, 6) as iqr,
         round(mad, 6) as mad, round(skew, 5) as skewness, round(kurt, 5) as kurtosis, zeros, negatives,
         round(total, 2) as sum, n_distinct
  from st join cn on cn.col = st.col join sg on sg.col = st.col"""


def _numeric(df):
    df = rounded(
        df, 6, "min", "max", "mean", "std", "cv", "p5", "p25", "p50", "p75", "p95", "iqr", "mad"
    )
    return rounded(rounded(df, 5, "skewness", "kurtosis"), 2, "sum")


@query("r1_numeric_profile", "with " + numeric_sql("lineitem", NUMBERS))
def r1(spark, folder):
    return _numeric(profile.numeric_profile(table(spark, folder, "lineitem"), NUMBERS))


@query("r1_numeric_profile_with_missing", DIRTY_CUSTOMER + ", " + numeric_sql("dirty", ["bal", "nat"]))
def r1_missing(spark, folder):
    return _numeric(profile.numeric_profile(dirty_customer(spark, folder), ["bal", "nat"]))


def categorical_sql(view: str, columns: list[str]) -> str:
    lengths = " union all ".join(
        f"""select '{c}' as col, count({c}) as n, count(*) - count({c}) as missing, min(length({c})) as a,
              avg(length({c})) as b, max(length({c})) as c from {view}"""
        for c in columns
    )
    return f"""cn as ({counts_sql(view, columns)}), ln as ({lengths})
  select ln.col as "column", n, missing, n_distinct, n_unique, mode, round(top / n, 6) as mode_share,
         cast(a as integer) as min_length, round(b, 6) as mean_length, cast(c as integer) as max_length
  from ln join cn on cn.col = ln.col"""


@query("r2_categorical_profile", "with " + categorical_sql("part", ["p_name", "p_brand", "p_type"]))
def r2(spark, folder):
    df = profile.categorical_profile(table(spark, folder, "part"), ["p_name", "p_brand", "p_type"])
    return rounded(df, 6, "mode_share", "mean_length")


@query(
    "r3_date_profile",
    """select 'o_orderdate' as "column", count(o_orderdate) as n, count(*) - count(o_orderdate) as missing,
              cast(cast(min(o_orderdate) as date) as varchar) as min_day,
              cast(cast(max(o_orderdate) as date) as varchar) as max_day,
              cast(date_diff('day', cast(min(o_orderdate) as date), cast(max(o_orderdate) as date)) as bigint) as range_days,
              count(distinct o_orderdate) as n_distinct from orders""",
)
def r3(spark, folder):
    df = profile.date_profile(table(spark, folder, "orders"))
    return df.withColumns({c: F.col(c).cast("string") for c in ("min_day", "max_day")})


@query(
    "r4_overview",
    DIRTY_ORDERS
    + """, g as (select *, count(*) as n from dirty group by all),
  t as (select sum(case when n > 1 then 1 else 0 end) as d, sum(n) as rows_ from g)
  select count(*) as n_rows, cast(4 as bigint) as n_columns, cast(3 as bigint) as numeric_columns,
         cast(0 as bigint) as date_columns, cast(1 as bigint) as categorical_columns,
         2 * count(*) - count(o_totalprice) - count(o_orderpriority) as n_cells_missing,
         round((2 * count(*) - count(o_totalprice) - count(o_orderpriority)) / (4 * count(*)), 8) as p_cells_missing,
         cast(any_value(d) as bigint) as n_duplicates, round(any_value(d / rows_), 8) as p_duplicates
  from dirty, t""",
)
def r4(spark, folder):
    return rounded(profile.overview(dirty_orders(spark, folder)), 8, "p_cells_missing", "p_duplicates")


PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]


@query(
    "r5_correlations",
    " union all ".join(
        f"select '{a}' as column_a, '{b}' as column_b, round(corr({a}, {b}), 6) as correlation from lineitem"
        for a, b in PAIRS
    ),
)
def r5(spark, folder):
    return rounded(profile.correlations(table(spark, folder, "lineitem"), NUMBERS), 6, "correlation")


@query(
    "r5_rank_correlations",
    "with r as (select "
    + ", ".join(
        f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2 as {c}" for c in NUMBERS[:3]
    )
    + " from lineitem) "
    + " union all ".join(
        f"select '{a}' as column_a, '{b}' as column_b, round(corr({a}, {b}), 6) as correlation from r"
        for a, b in [(NUMBERS[0], NUMBERS[1]), (NUMBERS[0], NUMBERS[2]), (NUMBERS[1], NUMBERS[2])]
    ),
)
def r5_ranks(spark, folder):
    df = profile.correlations(table(spark, folder, "lineitem"), NUMBERS[:3], method="spearman")
    return rounded(df, 6, "correlation")


def top_sql(view: str, columns: list[str], k: int) -> str:
    return " union all ".join(
        f"""select * from (select '{c}' as "column", cast({c} as varchar) as value, count(*) as n,
              round(count(*) / (select count(*) from {view}), 6) as share,
              cast(row_number() over (order by count(*) desc, cast({c} as varchar) nulls first) as integer) as rank
            from {view} group by {c}) where rank <= {k}"""
        for c in columns
    )


@query("r6_top_values", DIRTY_CUSTOMER + top_sql("dirty", ["segment", "nat"], 5).replace("cast(nat as varchar)", "cast(cast(nat as decimal(9, 1)) as varchar)"))
def r6(spark, folder):
    return rounded(profile.top_values(dirty_customer(spark, folder), ["segment", "nat"], 5), 6, "share")


@query(
    "r7_missing_patterns",
    DIRTY_CUSTOMER
    + """select concat(case when c_custkey is null then '1' else '0' end, case when bal is null then '1' else '0' end,
                       case when nat is null then '1' else '0' end, case when segment is null then '1' else '0' end) as mask,
                count(*) as n_rows from dirty group by 1""",
)
def r7(spark, folder):
    return profile.missing_patterns(dirty_customer(spark, folder))


@query(
    "r8_sample_rows",
    """select o_orderkey, o_custkey, o_totalprice, 'first' as side
       from (select * from orders order by o_totalprice, o_orderkey limit 10)
       union all
       select o_orderkey, o_custkey, o_totalprice, 'last'
       from (select * from orders order by o_totalprice desc, o_orderkey desc limit 10)""",
)
def r8(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    order = ["o_totalprice", "o_orderkey"]
    first = profile.sample_rows(df, order).withColumn("side", F.lit("first"))
    return first.unionByName(profile.sample_rows(df, order, last=True).withColumn("side", F.lit("last")))


@query(
    "r9_frequent_duplicates",
    """select c_nationkey, c_mktsegment, count(*) as copies from customer group by all having count(*) > 1
       order by copies desc, c_nationkey, c_mktsegment limit 10""",
)
def r9(spark, folder):
    from ..operators.duplicates import frequent_duplicates

    df = table(spark, folder, "customer").select("c_nationkey", "c_mktsegment")
    return frequent_duplicates(df, 10)


ALERTS = """with v as (
    select o_orderkey, o_custkey, o_totalprice, o_totalprice * 2 + 1 as doubled, o_orderstatus,
           case when o_orderkey % 11 = 0 then null else o_orderpriority end as o_orderpriority,
           1 as flat, case when o_orderkey % 3 = 0 then 0 else o_custkey end as zeroed,
           case when o_orderkey % 10 = 0 then 'rare' else 'common' end as balance,
           case when o_orderkey % 100 = 0 then exp(o_orderkey % 29) else 1.5 end as tail from orders)"""


def alerts_sql(view: str, numbers: list[str], texts: list[str], constant: tuple[str, ...] = ()) -> str:
    """``col``, ``alert``, ``value``; columns known to be constant have no correlation."""
    parts = []
    for c in numbers + texts:
        counted = f"""(select count(*) as d, sum(case when k = 1 then 1 else 0 end) as u, max(k) as top
            from (select count(*) as k from {view} where {c} is not null group by {c}))"""
        basic = f"(select count(*) as n_rows, count({c}) as n from {view})"
        parts += [
            f"select '{c}' as col, 'constant' as alert, cast(d as double) as value from {counted} where d = 1",
            f"select '{c}', 'unique', cast(u as double) from {counted}, {basic} where n > 1 and u = n",
            f"select '{c}', 'missing', (n_rows - n) / n_rows from {basic} where (n_rows - n) / n_rows > 0.05",
        ]
        if c in numbers:
            parts += [
                f"""select '{c}', 'zeros', z from (select sum(case when {c} = 0 then 1 else 0 end) / count(*) as z
                    from {view}) where z > 0.1""",
                f"""select '{c}', 'skewed', s from (select skewness({c}) as s, min({c}) as a, max({c}) as b from {view})
                    where a < b and abs(s) > 5""",
            ]
        else:
            parts += [
                f"select '{c}', 'high_cardinality', d from {counted} where d > 50",
                f"select '{c}', 'imbalance', top / n from {counted}, {basic} where d > 1 and top / n > 0.75",
            ]
    for i, a in enumerate(numbers):
        for b in numbers[i + 1 :]:
            if a not in constant and b not in constant:
                parts.append(
                    f"""select '{a}~{b}', 'high_correlation', r from (select corr({a}, {b}) as r from {view})
                        where abs(r) > 0.9"""
                )
    parts.append(
        f"""select '*', 'duplicates', sum(case when k > 1 then 1 else 0 end) / sum(k)
            from (select *, count(*) as k from {view} group by all) having sum(case when k > 1 then 1 else 0 end) > 0"""
    )
    return " union all ".join(parts)


ALERT_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice", "doubled", "flat", "zeroed", "tail"]
ALERT_TEXTS = ["o_orderstatus", "o_orderpriority", "balance"]


@query(
    "r10_alerts",
    ALERTS
    + ' select col as "column", alert, round(value, 4) as value from ('
    + alerts_sql("v", ALERT_NUMBERS, ALERT_TEXTS, ("flat",))
    + ")",
)
def r10(spark, folder):
    df = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_totalprice", "o_totalprice * 2 + 1 as doubled", "o_orderstatus",
        "case when o_orderkey % 11 = 0 then null else o_orderpriority end as o_orderpriority",
        "1 as flat", "case when o_orderkey % 3 = 0 then 0 else o_custkey end as zeroed",
        "case when o_orderkey % 10 = 0 then 'rare' else 'common' end as balance",
        "case when o_orderkey % 100 = 0 then exp(o_orderkey % 29) else 1.5D end as tail",
    )
    return rounded(profile.alerts(df), 4, "value")


@query(
    "v1_histogram",
    """with l as (select min(l_extendedprice) as a, (max(l_extendedprice) - min(l_extendedprice)) / 20 as w from lineitem),
  b as (select cast(least(floor((l_extendedprice - a) / w), 19) as integer) as bin, count(*) as n from lineitem, l group by 1)
  select bin, round(a + bin * w, 4) as low, round(a + (bin + 1) * w, 4) as high, n from b, l""",
)
def v1(spark, folder):
    return rounded(charts.histogram(table(spark, folder, "lineitem"), "l_extendedprice"), 4, "low", "high")


@query(
    "v2_box_plot",
    SPIKED
    + ", b as ("
    + " union all ".join(
        f"""select '{c}' as col, quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.5) as q2,
              quantile_cont({c}, 0.75) as q3 from spiked"""
        for c in ("l_quantity", "l_extendedprice")
    )
    + """), x as (select 'l_quantity' as col, l_quantity as x from spiked
                  union all select 'l_extendedprice', l_extendedprice from spiked)
  select x.col as "column", round(any_value(q1), 6) as q1, round(any_value(q2), 6) as median, round(any_value(q3), 6) as q3,
         min(case when x between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then x end) as whisker_low,
         max(case when x between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then x end) as whisker_high,
         cast(sum(case when x between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then 0 else 1 end) as bigint) as outliers
  from x join b on b.col = x.col group by x.col""",
)
def v2(spark, folder):
    df = outliers.box_plot(spiked_lineitem(spark, folder), ["l_quantity", "l_extendedprice"])
    return rounded(df, 6, "q1", "median", "q3")


@query(
    "v3_scatter_grid",
    """with l as (select min(l_quantity) as a, (max(l_quantity) - min(l_quantity)) / 50 as w,
                       min(l_extendedprice) as b, (max(l_extendedprice) - min(l_extendedprice)) / 50 as h from lineitem)
  select cast(least(floor((l_quantity - a) / w), 49) as integer) as x_bin,
         cast(least(floor((l_extendedprice - b) / h), 49) as integer) as y_bin, count(*) as n from lineitem, l group by 1, 2""",
)
def v3(spark, folder):
    return charts.scatter_grid(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")


@query(
    "v4_line",
    """select l_quantity as x, round(avg(l_extendedprice), 6) as mean_y, min(l_extendedprice) as min_y,
              max(l_extendedprice) as max_y from lineitem group by 1 order by 1""",
)
def v4(spark, folder):
    return rounded(charts.line(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice"), 6, "mean_y")


@query(
    "v4_line_pixels",
    """with p as (select epoch(ts) as x, value as y from events where value is not null),
  r as (select min(x) as l, max(x) as h from p),
  c as (select cast(least(floor((x - l) / (h - l) * 200), 199) as integer) as pixel, x, y from p, r),
  f as (select pixel, min({'x': x, 'y': y}) as a, max({'x': x, 'y': y}) as b, min({'y': y, 'x': x}) as c, max({'y': y, 'x': x}) as d
        from c group by pixel)
  select pixel, a.x as x, a.y as y from f union select pixel, b.x, b.y from f union select pixel, c.x, c.y from f
  union select pixel, d.x, d.y from f""",
)
def v4_pixels(spark, folder):
    return charts.line_pixels(table(spark, folder, "events"), "ts", "value", 200)


@query(
    "v5_pie",
    """select l_returnflag as value, count(*) as n, round(count(*) / (select count(*) from lineitem), 6) as share
       from lineitem group by 1""",
)
def v5(spark, folder):
    return rounded(charts.pie(table(spark, folder, "lineitem"), "l_returnflag"), 6, "share")


@query(
    "g1_equal_width",
    """with l as (select min(p_retailprice) as a, (max(p_retailprice) - min(p_retailprice)) / 8 as w from part)
  select p_partkey, cast(least(floor((p_retailprice - a) / w), 7) as integer) as p_retailprice from part, l""",
)
def g1_width(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    return quality.discretize(df, "p_retailprice", bins=8)


@query(
    "g1_equal_frequency",
    """with l as (select quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) as e from lineitem)
  select l_quantity, cast((l_extendedprice > e[1])::int + (l_extendedprice > e[2])::int + (l_extendedprice > e[3])::int as integer) as quarter,
         count(*) as n from lineitem, l group by 1, 2""",
)
def g1_frequency(spark, folder):
    df = table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice")
    binned = quality.discretize(df, "l_extendedprice", bins=4, equal="frequency", name="quarter")
    return binned.groupBy("l_quantity", "quarter").agg(F.count("*").alias("n"))


@query("g1_round", "select o_orderkey, round(o_totalprice, -2) as o_totalprice from orders")
def g1_round(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return quality.discretize(df, "o_totalprice", round_to=-2)


@query("g2_convert_types", STRINGLY + "select event_id, try_cast(value_txt as double) as value_txt from stringly")
def g2(spark, folder):
    return quality.convert_types(stringly_events(spark, folder), {"value_txt": "double"}, on_error="null")


@query(
    "g3_wrong_types",
    STRINGLY
    + """, w as (select value_txt, count(*) as n from stringly
               where value_txt is not null and try_cast(value_txt as bigint) is null group by 1)
  select 'value_txt' as "column", 'bigint' as wanted, cast(sum(n) as bigint) as n_wrong, count(*) as n_values,
         string_agg(value_txt, ', ' order by value_txt) as examples from w""",
)
def g3(spark, folder):
    return quality.wrong_types(stringly_events(spark, folder), {"value_txt": "bigint"})


@query("g4_merge_misspelled", TYPO_PARTS + "select p_partkey, replace(p_type, '0', 'O') as p_type from typos")
def g4(spark, folder):
    df = typo_parts(spark, folder)
    right = df.where(~F.contains("p_type", F.lit("0"))).select("p_type").distinct()
    return quality.merge_misspelled(df, "p_type", right, distance=2)


@query(
    "g5_drop_incomplete_and_duplicates",
    DIRTY_ORDERS
    + "select distinct * from dirty where o_totalprice is not null and o_orderpriority is not null",
)
def g5(spark, folder):
    return quality.drop_incomplete_and_duplicates(dirty_orders(spark, folder))


@query(
    "g6_mean_error",
    " union all ".join(
        f"""select '{c}' as "column", count({c}) as n, round(avg({c}), 5) as mean,
              round(stddev_samp({c}) / sqrt(count({c})), 6) as std_error,
              round(avg({c}) - 1.96 * stddev_samp({c}) / sqrt(count({c})), 5) as low,
              round(avg({c}) + 1.96 * stddev_samp({c}) / sqrt(count({c})), 5) as high from lineitem"""
        for c in NUMBERS
    ),
)
def g6(spark, folder):
    df = quality.mean_error(table(spark, folder, "lineitem"), NUMBERS)
    return rounded(rounded(df, 5, "mean", "low", "high"), 6, "std_error")


@query(
    "g7_functional_dependency",
    """with p as (select c_mktsegment as a, count(distinct c_nationkey) as n from customer group by 1)
  select count(*) as n_values, cast(sum(case when n > 1 then 1 else 0 end) as bigint) as n_broken,
         max(n) <= 1 as holds from p""",
)
def g7_dependency(spark, folder):
    return quality.functional_dependency(table(spark, folder, "customer"), "c_mktsegment", "c_nationkey")


# Two parts of the orders, each read once; the second is added to the state of the first.  Quantiles and numbers of
# different values are sketches: they have to be within their bounds of the exact ones.
MERGED = "o_custkey o_totalprice o_orderstatus".split()


@query(
    "r1_merged_profile",
    """with t as (select * from orders),
  s as (select 'o_custkey' as "column", cast(o_custkey as double) as x, null as s from t
        union all select 'o_totalprice', o_totalprice, null from t union all select 'o_orderstatus', null, o_orderstatus from t)
  select "column", count(*) - count(*) filter (x is null and s is null) as n, count(*) filter (x is null and s is null) as missing,
         min(x) as min, max(x) as max, round(avg(x), 4) as mean, round(stddev_samp(x), 4) as std,
         round(case when count(x) > 2 then skewness(x) end, 4) as skewness, case when "column" <> 'o_orderstatus' then true end as quantiles_hold,
         true as distinct_holds, cast(min(length(s)) as bigint) as min_length, cast(max(length(s)) as bigint) as max_length
  from s group by 1""",
)
def r1_merged(spark, folder):
    orders = table(spark, folder, "orders")
    first = settle(profile_state.profile_state(orders.where("o_orderkey % 3 = 0"), MERGED), "state")
    second = profile_state.profile_state(orders.where("o_orderkey % 3 <> 0"), MERGED)
    told = settle(profile_state.state_report(profile_state.merge_states(first, second)), "profile")
    known = {r["column"]: r for r in told.collect()}  # a row for each column
    ranks, checks = [], {}
    for i, c in enumerate(MERGED):
        if known[c]["kind"] == "numeric":
            for q in profile_state.QUANTILES:
                value = F.lit(known[c][f"p{round(100 * q)}"])
                # the share of rows up to the value, and of those before it, enclose the share asked for but for the error
                ranks += [(F.avg((F.col(c) <= value).cast("double")) > q - 0.02) & (F.avg((F.col(c) < value).cast("double")) < q + 0.02)]
            checks[c] = len(ranks)
    row = orders.agg(*[r.alias(f"q{i}") for i, r in enumerate(ranks)], *[F.count_distinct(c).alias(f"d_{c}") for c in MERGED]).first()
    holds = {c: all(row[f"q{i}"] for i in range(end - len(profile_state.QUANTILES), end)) for c, end in checks.items()}
    near = {c: abs(known[c]["n_distinct"] - row[f"d_{c}"]) <= 0.04 * row[f"d_{c}"] for c in MERGED}
    pick = lambda found: F.create_map(*[x for c, v in found.items() for x in (F.lit(c), F.lit(v))])[F.col("column")]
    out = told.select("column", "n", "missing", "min", "max", "mean", "std", "skewness", pick(holds).alias("quantiles_hold"),
                      pick(near).alias("distinct_holds"), "min_length", "max_length")
    return rounded(out, 4, "mean", "std", "skewness")


# k3 is told by k1 and k2 together, state by status but for one row in a hundred; k4 is the same for all rows.
KEYED = """select o_orderkey % 7 as k1, o_orderkey % 5 as k2, (o_orderkey % 7 + 3 * (o_orderkey % 5)) % 11 as k3, 1 as k4,
  o_orderstatus as status, case when o_orderkey % 100 = 0 then null else concat('s', o_orderstatus) end as state,
  o_orderpriority as priority from orders"""
KEYED_COLUMNS = ["k1", "k2", "k3", "k4", "status", "state", "priority"]
KEYED_SHARE = 0.03


def _dependencies_sql() -> str:
    views = []
    for size in range(3):
        for x in combinations(KEYED_COLUMNS, size):
            for a in KEYED_COLUMNS:
                if a not in x:
                    by = ", ".join([*x, a])
                    group = f"group by {', '.join(x)}" if x else ""
                    views.append(
                        f"select {list(x)}::varchar[] as determinant, '{a}' as dependent, count(*) as groups, sum(s - m) as violating_rows "
                        f"from (select sum(n) as s, max(n) as m from (select {by}, count(*) as n from t group by {by}) {group})"
                    )
    return f"""
  with t as materialized ({KEYED}), c as materialized ({' union all '.join(views)}),
  d as (select determinant, dependent, groups, cast(violating_rows as bigint) as violating_rows,
               violating_rows / (select count(*) from t) as share from c where violating_rows <= {KEYED_SHARE} * (select count(*) from t))
  select array_to_string(determinant, ',') as determinant, dependent, groups, violating_rows, round(share, 6) as share from d
  where not exists (select 1 from d e where e.dependent = d.dependent and len(e.determinant) < len(d.determinant)
                    and list_has_all(d.determinant, e.determinant))"""


@query("g7_minimal_dependencies", _dependencies_sql())
def g7_minimal(spark, folder):
    rows = spark.sql(KEYED.replace("from orders", "from {orders}"), orders=table(spark, folder, "orders"))
    found = dependencies.minimal_dependencies(rows, KEYED_COLUMNS, 2, KEYED_SHARE)
    return rounded(found.withColumn("determinant", F.array_join("determinant", ",")), 6, "share")


@query(
    "g7_chi_square",
    """with c as (select l_returnflag as a, l_linestatus as b, count(*) as o from lineitem group by all),
  m as (select o, sum(o) over (partition by a) as r, sum(o) over (partition by b) as k, sum(o) over () as n from c),
  s as (select sum(o * 1.0::double * o / (r::double * k)) as share, any_value(n) as n from m),
  z as (select count(distinct a) as x, count(distinct b) as y from c)
  select cast(n as bigint) as n, round(greatest(n * (share - 1), 0), 4) as chi_square, (x - 1) * (y - 1) as dof,
         round(sqrt(greatest(n * (share - 1), 0) / (n * (least(x, y) - 1))), 5) as cramers_v from s, z""",
)
def g7_chi(spark, folder):
    df = quality.chi_square(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus")
    return rounded(rounded(df, 4, "chi_square"), 5, "cramers_v")


@query(
    "g8_expectations",
    STRINGLY
    + """, e as (select e.*, s.value_txt from events e join stringly s on s.event_id = e.event_id)
  select 'value_txt' as "column", 'type' as rule,
         cast(sum(case when try_cast(value_txt as bigint) is null then 1 else 0 end) as bigint) as failing_rows,
         sum(case when try_cast(value_txt as bigint) is null then 1 else 0 end) = 0 as passed from e
  union all
  select 'value', 'range', cast(sum(case when value < 1 or value > 100 then 1 else 0 end) as bigint),
         sum(case when value < 1 or value > 100 then 1 else 0 end) = 0 from e
  union all
  select 'event_type', 'allowed', cast(sum(case when event_type not in ('click', 'view') then 1 else 0 end) as bigint),
         sum(case when event_type not in ('click', 'view') then 1 else 0 end) = 0 from e
  union all
  select 'props', 'null_share', cast(sum(case when props is null then 1 else 0 end) as bigint),
         sum(case when props is null then 1 else 0 end) <= 0.1 * count(*) from e""",
)
def g8(spark, folder):
    df = table(spark, folder, "events").selectExpr(
        "*",
        "case when event_id % 17 = 0 then 'N/A' when event_id % 19 = 0 then 'abc' "
        "else cast(cast(floor(value * 100) as bigint) as string) end as value_txt",
    )
    return quality.check_expectations(
        df,
        [
            quality.Expectation("value_txt", of_type="bigint"),
            quality.Expectation("value", low=1, high=100),
            quality.Expectation("event_type", allowed=("click", "view")),
            quality.Expectation("props", max_null_share=0.1),
        ],
    )
