"""Scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import scaling
from .outlier import stats_sql
from .registry import DIRTY_CUSTOMER, dirty_customer, query, rounded, table

PART = ["p_size", "p_retailprice"]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "c1_normalize",
    """select p_partkey, round((p_size - a) / (b - a), 6) as p_size, round((p_retailprice - c) / (d - c), 6) as p_retailprice
       from part, (select min(p_size) as a, max(p_size) as b, min(p_retailprice) as c, max(p_retailprice) as d from part)""",
)
def c1(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", *PART)
    return rounded(scaling.normalize(df, PART), 6, *PART)


@query(
    "c1_normalize_range_with_missing",
    DIRTY_CUSTOMER
    + """select c_custkey, round((bal - a) / (b - a) * 2 - 1, 6) + 0.0 as bal, round((nat - c) / (d - c) * 2 - 1, 6) + 0.0 as nat
         from dirty, (select min(bal) as a, max(bal) as b, min(nat) as c, max(nat) as d from dirty)""",
)
def c1_range(spark, folder):
    df = dirty_customer(spark, folder).drop("segment")
    return rounded(scaling.normalize(df, ["bal", "nat"], (-1, 1)), 6, "bal", "nat")


@query(
    "c2_standardize",
    """select p_partkey, round((p_size - a) / b, 6) + 0.0 as p_size, round((p_retailprice - c) / d, 6) + 0.0 as p_retailprice
       from part, (select avg(p_size) as a, stddev_pop(p_size) as b, avg(p_retailprice) as c,
                          stddev_pop(p_retailprice) as d from part)""",
)
def c2(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", *PART)
    return rounded(scaling.standardize(df, PART), 6, *PART)


@query(
    "c3_normalize_report",
    " union all ".join(
        f"""select '{c}' as "column", cast(min({c}) as double) as before_min, cast(max({c}) as double) as before_max,
              cast(0 as double) as after_min, cast(1 as double) as after_max from part"""
        for c in PART
    ),
)
def c3(spark, folder):
    df = scaling.normalize_report(table(spark, folder, "part"), PART)
    return rounded(df, 6, "after_min", "after_max")


@query(
    "c4_standardize_report",
    " union all ".join(
        f"""select '{c}' as "column", round(avg({c}), 6) as before_mean, round(stddev_samp({c}), 6) as before_std,
              cast(0 as double) as after_mean, round(stddev_samp({c}) / stddev_pop({c}), 6) as after_std from part"""
        for c in PART
    ),
)
def c4(spark, folder):
    df = scaling.standardize_report(table(spark, folder, "part"), PART)
    return rounded(df, 6, "before_mean", "before_std", "after_mean", "after_std")


def advice_sql(view: str, columns: list[str]) -> str:
    return f"""with st as ({stats_sql(view, columns)}),
  r as (select col, list_filter([
      case when lo < q1 - 1.5 * (q3 - q1) or hi > q3 + 1.5 * (q3 - q1) then '{labels.HAS_OUTLIERS}' end,
      case when not abs(mean - q2) < 0.1 * mean then '{labels.ASYMMETRIC}' end,
      case when mean <> 0 and std / mean > 0.5 then '{labels.HIGH_VARIATION}' end,
      case when abs(skew) > 1 then '{labels.STRONG_SKEW}' end], lambda x: x is not null) as reasons from st)
  select col as "column", case when len(reasons) > 0 then '{labels.STANDARDIZE}' else '{labels.NORMALIZE}' end as advice,
         case when len(reasons) > 0 then array_to_string(reasons, ', ') else '{labels.EVEN}' end as reasons from r"""


@query("c5_scaling_advice", advice_sql("lineitem", NUMBERS))
def c5(spark, folder):
    df = scaling.scaling_advice(table(spark, folder, "lineitem"), NUMBERS)
    return df.withColumn("reasons", F.array_join("reasons", ", "))


@query(
    "c6_needs_normalizing",
    """select max(l_quantity) - min(l_quantity) > 1 or max(l_extendedprice) - min(l_extendedprice) > 1
           or max(l_discount) - min(l_discount) > 1 or max(l_tax) - min(l_tax) > 1 as needs_normalizing from lineitem""",
)
def c6(spark, folder):
    return scaling.needs_normalizing(table(spark, folder, "lineitem"), NUMBERS)
