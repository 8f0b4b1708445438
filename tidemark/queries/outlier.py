"""Outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import spread
from ..operators import forest, lof, outliers
from .registry import SPIKED, query, rounded, spiked_lineitem, table

COLUMNS = ["l_quantity", "l_extendedprice"]


@query(
    "o1_remove_iqr",
    SPIKED
    + """, b1 as (select quantile_cont(l_quantity, 0.25) as q1, quantile_cont(l_quantity, 0.75) as q3 from spiked),
  s1 as (select spiked.* from spiked, b1
         where l_quantity between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)),
  b2 as (select quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.75) as q3 from s1)
  select s1.* from s1, b2 where l_extendedprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)""",
)
def o1(spark, folder):
    return outliers.remove_iqr(spiked_lineitem(spark, folder), COLUMNS)


@query(
    "o2_has_outliers",
    SPIKED
    + """, b as (select quantile_cont(l_quantity, 0.25) as a1, quantile_cont(l_quantity, 0.75) as a3,
                        quantile_cont(l_extendedprice, 0.25) as b1, quantile_cont(l_extendedprice, 0.75) as b3
                 from spiked)
  select bool_or(l_quantity < a1 - 1.5 * (a3 - a1) or l_quantity > a3 + 1.5 * (a3 - a1)
              or l_extendedprice < b1 - 1.5 * (b3 - b1) or l_extendedprice > b3 + 1.5 * (b3 - b1)) as has_outliers
  from spiked, b""",
)
def o2(spark, folder):
    return outliers.has_iqr_outliers(spiked_lineitem(spark, folder), COLUMNS)


@query(
    "o3_remove_zscore",
    SPIKED
    + """, b as (select avg(l_quantity) as m1, stddev_pop(l_quantity) as s1,
                        avg(l_extendedprice) as m2, stddev_pop(l_extendedprice) as s2 from spiked)
  select spiked.* from spiked, b
  where abs((l_quantity - m1) / s1) < 3 and abs((l_extendedprice - m2) / s2) < 3""",
)
def o3(spark, folder):
    return outliers.remove_zscore(spiked_lineitem(spark, folder), COLUMNS)


@query("o4_remove_isolated")
def o4(spark, folder):
    return forest.remove_isolated(spread(spiked_lineitem(spark, folder)), COLUMNS)


FOREST_TREES, FOREST_LEVELS = 10, 5  # nations are at most 2 to the 5th


def _forest_sql() -> str:
    """Trees over all points: draws are hashes of tree and way, so that SQL can make them too."""
    draw = lambda kind: f"cast('0x' || substr(md5('42|' || tree || '|' || way || '|{kind}'), 1, 13) as bigint) / pow(16, 13)"
    path = "case when n <= 1 then 0 when n = 2 then 1 else 2 * (ln(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n::double end"
    views, leaves = ["p0 as (select t.range as tree, '1' as way, id from range({}) t, x)".format(FOREST_TREES)], []
    for d in range(FOREST_LEVELS + 1):
        views.append(f"""s{d} as (select tree, way, count(*) as n, [min(x0), min(x1)] as low, [max(x0), max(x1)] as high,
            list_filter([1, 2], lambda i: ([max(x0), max(x1)])[i] > ([min(x0), min(x1)])[i]) as wide from p{d} join x using (id) group by all)""")
        views.append(f"""c{d} as (select *, ({d} >= (select deepest from size) or n <= 1 or len(wide) = 0) as leaf,
            wide[1 + cast(floor({draw('axis')} * len(wide)) as integer)] as axis, {draw('cut')} as share from s{d})""")
        leaves.append(f"select p{d}.tree, id, {d} + {path} as path from p{d} join c{d} on p{d}.tree = c{d}.tree and p{d}.way = c{d}.way where leaf")
        views.append(f"""p{d + 1} as (select p{d}.tree, p{d}.way || case when ([x0, x1])[axis] <= low[axis] + share * (high[axis] - low[axis])
            then 'L' else 'R' end as way, id from p{d} join c{d} on p{d}.tree = c{d}.tree and p{d}.way = c{d}.way join x using (id) where not leaf)""")
    return f"""with x as materialized (select c_nationkey as id, cast(count(*) as double) as x0, round(avg(c_acctbal), 2) as x1 from customer group by 1),
  size as (select ceil(log2(greatest(2, count(*)))) as deepest, cast(count(*) as double) as n from x), {', '.join(views)},
  leaves as ({' union all '.join(leaves)})
  select id, round(-pow(2, -avg(path) / any_value((select {path} from size))), 8) as isolation from leaves group by id"""


@query("o4_forest_scores", _forest_sql())
def o4_scores(spark, folder):
    points = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(
        F.count("*").cast("double").alias("x0"), F.round(F.avg("c_acctbal"), 2).alias("x1")
    )
    scored = forest.forest_scores(points, ["x0", "x1"], trees=FOREST_TREES)
    return scored.select("id", F.round("isolation", 8).alias("isolation"))


LOF = """
  with r as (select %(key)s as id, %(x)s as x, %(y)s as y from %(table)s),
  l as (select p.id as p, min({'dist': sqrt((p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y)),
                               'x': o.x, 'y': o.y, 'o': o.id}, 20) as near
        from r p join r o on p.id <> o.id group by 1),
  u as (select p, unnest(near) as e from l),
  n as (select p, e.o as o, e.dist as dist from u),
  radius as (select p, max(dist) as radius from n group by p),
  dens as (select n.p, 1.0 / (avg(greatest(n.dist, radius.radius)) + 1e-10) as density
           from n join radius on radius.p = n.o group by n.p),
  f as (select n.p as id, avg(b.density) / any_value(a.density) as lof
        from n join dens a on a.p = n.p join dens b on b.p = n.o group by n.p),
  t as (select quantile_cont(-lof, 0.05) as limit_ from f),
  flagged as (select f.id, round(lof, 5) as lof, -lof < limit_ as is_outlier from f, t)
"""
FLAGGED = " select id as %s, lof, is_outlier from flagged"


@query(
    "o5_lof",
    LOF % {"key": "c_custkey", "x": "c_acctbal / 1000", "y": "cast(c_nationkey as double)", "table": "customer"}
    + FLAGGED % "c_custkey",
)
def o5(spark, folder):
    df = table(spark, folder, "customer").selectExpr(
        "c_custkey", "c_acctbal / 1000 as x", "cast(c_nationkey as double) as y"
    )
    return rounded(lof.flag_lof(df, ["x", "y"]).drop("x", "y"), 5, "lof")


@query(
    "o5_lof_supplier",
    LOF % {"key": "s_suppkey", "x": "s_acctbal / 1000", "y": "cast(s_nationkey as double)", "table": "supplier"}
    + FLAGGED % "s_suppkey",
)
def o5_supplier(spark, folder):
    df = table(spark, folder, "supplier").selectExpr(
        "s_suppkey", "s_acctbal / 1000 as x", "cast(s_nationkey as double) as y"
    )
    return rounded(lof.flag_lof(df, ["x", "y"]).drop("x", "y"), 5, "lof")


@query(
    "o5_remove_lof_events",
    LOF % {"key": "event_id", "x": "value", "y": "cast(user_id as double)", "table": "events"}
    + """ select event_id, value, cast(user_id as double) as user_id from events
          where event_id in (select id from flagged where not is_outlier)""",
)
def o5_events(spark, folder):
    df = table(spark, folder, "events").selectExpr("event_id", "value", "cast(user_id as double) as user_id")
    return lof.remove_lof(df, ["value", "user_id"])


def _skew(x: str) -> str:
    """Population skewness."""
    return (
        f"abs((avg({x} * {x} * {x}) - 3 * avg({x}) * avg({x} * {x}) + 2 * power(avg({x}), 3)) "
        f"/ power(stddev_pop({x}), 3))"
    )


@query(
    "o6_skew_score",
    SPIKED
    + f"""select round(({_skew('l_quantity')} + {_skew('l_extendedprice')}) / 2, 4) as skew_score,
                 count(*) as n_rows from spiked""",
)
def o6(spark, folder):
    return rounded(outliers.skew_score(spiked_lineitem(spark, folder), COLUMNS), 4, "skew_score")


@query(
    "o7_compare_removals",
    SPIKED
    + f""", b1 as (select quantile_cont(l_quantity, 0.25) as q1, quantile_cont(l_quantity, 0.75) as q3 from spiked),
  s1 as (select spiked.* from spiked, b1
         where l_quantity between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)),
  b2 as (select quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.75) as q3 from s1),
  iqr as (select s1.* from s1, b2 where l_extendedprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)),
  b as (select avg(l_quantity) as m1, stddev_pop(l_quantity) as d1,
               avg(l_extendedprice) as m2, stddev_pop(l_extendedprice) as d2 from spiked),
  z as (select spiked.* from spiked, b
        where abs((l_quantity - m1) / d1) < 3 and abs((l_extendedprice - m2) / d2) < 3),
  scores as (
    select 'IQR' as method, 1 as place, ({_skew('l_quantity')} + {_skew('l_extendedprice')}) / 2 as s, count(*) as n
    from iqr
    union all
    select 'Z-Score', 2, ({_skew('l_quantity')} + {_skew('l_extendedprice')}) / 2, count(*) from z)
  select method, round(s, 4) as skew_score, n as rows_kept,
         row_number() over (order by s, place) = 1 as chosen from scores""",
)
def o7(spark, folder):
    df = spiked_lineitem(spark, folder)
    log = outliers.compare_removals(df, COLUMNS, methods=["IQR", "Z-Score"])[1]
    return rounded(log, 4, "skew_score")


@query("o7_remove_auto")
def o7_auto(spark, folder):
    df = table(spark, folder, "customer").selectExpr(
        "c_custkey",
        "case when c_custkey % 97 = 0 then c_acctbal * 20 else c_acctbal end as bal",
        "cast(c_nationkey as double) as nat",
    )
    return outliers.remove_outliers(df, "auto", ["bal", "nat"])


def stats_sql(view: str, columns: list[str]) -> str:
    """One row of statistics per column, adjusted skewness and kurtosis."""
    return " union all ".join(
        f"""select '{c}' as col, {i} as place, count(*) as n_rows, count({c}) as n, avg({c}) as mean,
              stddev_samp({c}) as std, min({c}) as lo, max({c}) as hi, sum({c}) as total,
              skewness({c}) as skew, kurtosis({c}) as kurt, quantile_cont({c}, 0.05) as p5,
              quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.5) as q2, quantile_cont({c}, 0.75) as q3,
              quantile_cont({c}, 0.95) as p95, mad({c}) as mad from {view}"""
        for i, c in enumerate(columns)
    )


def cells_sql(view: str, columns: list[str]) -> str:
    return " union all ".join(f"select '{c}' as col, {c} as x from {view}" for c in columns)


def far_sql(scale: str, limit: str) -> str:
    return f"case when mad = 0 then x <> q2 else abs({scale} * (x - q2) / mad) > {limit} end"


def rules_sql(shift: float = 0.0) -> dict[str, str]:
    """Predicate of each rule over a cell ``x`` and the statistics of its column."""
    iqr = f"(1.5 + 0.1 * {shift})"
    return {
        "IQR": f"(x < q1 - {iqr} * (q3 - q1) or x > q3 + {iqr} * (q3 - q1))",
        "Modified_Z_score": far_sql("0.6745", f"(3.0 + 0.2 * {shift})"),
        "Percentile": "(x < p5 or x > p95)",
        "Skewness_Method": f"""(abs(skew) > 2.0 + 0.14 * {shift}
            and case when skew > 0 then x > mean + 2 * std else x < mean - 2 * std end)""",
        "Kurtosis_Method": f"(kurt > 3.5 + 0.22 * {shift} and {far_sql('1.0', '3.5')})",
    }


def counts_sql(view: str, columns: list[str], shift: float = 0.0) -> str:
    """CTEs that end with ``counted``: flagged cells per column and rule."""
    sums = ", ".join(
        f"cast(sum(case when {rule} then 1 else 0 end) as bigint) as c{i}"
        for i, rule in enumerate(rules_sql(shift).values())
    )
    return f"""
  st as ({stats_sql(view, columns)}), cells as ({cells_sql(view, columns)}),
  counted as (select st.col, {sums} from cells join st on st.col = cells.col group by st.col)"""


def report_sql(shift: float = 0.0) -> str:
    """The outlier report from ``st`` and ``counted``."""
    facts = {
        "IQR": (f"1.5 + 0.1 * {shift}", f"q1 - (1.5 + 0.1 * {shift}) * (q3 - q1)", f"q3 + (1.5 + 0.1 * {shift}) * (q3 - q1)", "null"),
        "Modified_Z_score": (f"3.0 + 0.2 * {shift}", "null", "null", "null"),
        "Percentile": ("null", "p5", "p95", "null"),
        "Skewness_Method": (f"2.0 + 0.14 * {shift}", "null", "null", "case when skew > 0 then 'right' else 'left' end"),
        "Kurtosis_Method": (f"3.5 + 0.22 * {shift}", "null", "null", "null"),
    }
    return " union all ".join(
        f"""select st.col as "column", '{m}' as method, cast(round({t}, 6) as double) as threshold,
              round(cast({low} as double), 4) as lower, round(cast({high} as double), 4) as upper,
              cast({way} as varchar) as direction, c{i} as n, round(c{i} / n_rows * 100, 6) as pct
            from st join counted on counted.col = st.col"""
        for i, (m, (t, low, high, way)) in enumerate(facts.items())
    )


EVENTS = """with ev as (select value, cast(user_id as double) as user_id from events), """
SPIKED_REPORT = SPIKED + "," + counts_sql("spiked", COLUMNS) + ", report as (" + report_sql() + ") "
EVENT_REPORT = EVENTS + counts_sql("ev", ["value", "user_id"]) + ", report as (" + report_sql() + ") "


def _clean(df):
    return rounded(rounded(df, 6, "threshold", "pct"), 4, "lower", "upper")


def _events(spark, folder):
    return table(spark, folder, "events").selectExpr("value", "cast(user_id as double) as user_id")


def _rule(method: str, spiked: bool):
    def run(spark, folder):
        if spiked:
            report = outliers.outlier_report(spiked_lineitem(spark, folder), COLUMNS)
        else:
            report = outliers.outlier_report(_events(spark, folder))
        return _clean(report).where(F.col("method") == method)

    return run


for _name, _method, _spiked in [
    ("o8_iqr_count", outliers.IQR, True),
    ("o9_hampel_count", outliers.HAMPEL, True),
    ("o10_percentile_count", outliers.PERCENTILE, False),
    ("o11_skewness_count", outliers.SKEWNESS, True),
    ("o12_kurtosis_count", outliers.KURTOSIS, False),
]:
    _base = SPIKED_REPORT if _spiked else EVENT_REPORT
    query(_name, _base + f"select * from report where method = '{_method}'")(_rule(_method, _spiked))


@query("o13_outlier_report", SPIKED_REPORT + "select * from report")
def o13(spark, folder):
    return _clean(outliers.outlier_report(spiked_lineitem(spark, folder), COLUMNS))


ORDER = " ".join(f"when '{m}' then {i}" for i, m in enumerate(outliers.METHODS))


@query(
    "o14_rank_methods",
    EVENT_REPORT
    + f""", ranked as (select *, row_number() over (partition by "column"
             order by n desc, case method {ORDER} end) as rank from report)
  select "column", case when n = 0 then 'none' else method end as method, n, pct,
         case when n > 0 then threshold end as threshold, case when n > 0 then direction end as direction,
         cast(rank as integer) as rank
  from ranked where n > 0 or rank = 1""",
)
def o14(spark, folder):
    ranked = outliers.rank_methods(outliers.outlier_report(_events(spark, folder)))
    return rounded(ranked, 6, "threshold", "pct")


def _shift_sql(step: float, name: str) -> str:
    sums = ", ".join(
        f"cast(sum(case when {rule} then 1 else 0 end) as bigint) as c{i}"
        for i, rule in enumerate(rules_sql(step).values())
    )
    report = report_sql(step).replace("counted", name)
    return f"{name} as (select st.col, {sums} from cells join st on st.col = cells.col group by st.col), r{name} as ({report})"


STEPS = {"down": -2.0, "same": 0.0, "up": 2.0}


@query(
    "o15_shifted_thresholds",
    EVENTS
    + f"st as ({stats_sql('ev', ['value', 'user_id'])}), cells as ({cells_sql('ev', ['value', 'user_id'])}), "
    + ", ".join(_shift_sql(k, n) for n, k in STEPS.items())
    + " "
    + " union all ".join(f"select *, cast({k} as double) as steps from r{n}" for n, k in STEPS.items()),
)
def o15(spark, folder):
    return _clean(outliers.shifted_reports(_events(spark, folder), list(STEPS.values())))


def removal_sql(name: str) -> str:
    """Rows no cell of which is flagged; the statistics stand next to each row."""
    rule = rules_sql()[name]
    kept = " and ".join(
        f"not coalesce((select {rule} from (select s.{c} as x) v, st where st.col = '{c}'), false)" for c in COLUMNS
    )
    return SPIKED + f", st as ({stats_sql('spiked', COLUMNS)}) select s.* from spiked s where {kept}"


def _remove(rule: str):
    def run(spark, folder):
        return outliers.remove_outliers(spiked_lineitem(spark, folder), rule, COLUMNS)

    return run


for _rule_name, _method in [
    ("hampel", outliers.HAMPEL),
    ("percentile", outliers.PERCENTILE),
    ("skewness", outliers.SKEWNESS),
    ("kurtosis", outliers.KURTOSIS),
]:
    query(f"o16_remove_{_rule_name}", removal_sql(_method))(_remove(_rule_name))
