"""A profile kept as mergeable state: a row per column, made in one pass, added to without reading old rows.

State of a part of a table (a day, a folder) has counts, sums of powers of deviations, a quantile sketch
and one of different values.  States of parts merge to that of the whole: counts,
extremes and moments are those of one pass over all rows, sketches keep their bounds of error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_double, check_columns, cleaned, is_numeric, unpivot_rows

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
KLL_SIZE = 400  # ranks are off by about 1 in 150
HLL_SIZE = 14  # different values are off by about 1 in 100
MOMENTS = ("m2", "m3", "m4")


def profile_state(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The state of a table, one row per column; a single pass over the rows."""
    columns = check_columns(df, columns or df.columns)
    aggregates, rows = [F.count("*").alias("rows")], []
    none = {"double": F.lit(None).cast("double"), "bigint": F.lit(None).cast("bigint"), "binary": F.lit(None).cast("binary")}
    for i, c in enumerate(columns):
        numeric = is_numeric(df.schema[c].dataType)
        x = as_double(df, c) if numeric else cleaned(df, c).cast("string")
        parts = {"n": F.count(x), "different": F.hll_sketch_agg(x.cast("string"), HLL_SIZE)}
        if numeric:
            parts |= {
                "low": F.min(x), "top": F.max(x), "mean": F.avg(x), "var": F.var_pop(x), "skew": F.skewness(x), "kurt": F.kurtosis(x),
                "zeros": F.count_if(x == 0), "negatives": F.count_if(x < 0), "quantiles": F.kll_sketch_agg_double(x, KLL_SIZE),
            }
        else:
            parts |= {"low_length": F.min(F.length(x)), "top_length": F.max(F.length(x)), "length": F.sum(F.length(x))}
        aggregates += [value.alias(f"{name}_{i}") for name, value in parts.items()]
        at = lambda name, kind="double", i=i, parts=parts: F.col(f"{name}_{i}") if name in parts else none[kind]
        n, var = at("n", "bigint"), at("var")
        flat = at("low") == at("top")
        rows.append(F.struct(
            F.lit(c).alias("column"), F.lit("numeric" if numeric else "text").alias("kind"), F.col("rows"), n.alias("n"),
            at("low").alias("min"), at("top").alias("max"), at("mean").alias("mean"), (var * n).alias("m2"),
            F.when(flat, 0.0).otherwise(at("skew") * n * F.pow(var, F.lit(1.5))).alias("m3"),
            F.when(flat, 0.0).otherwise((at("kurt") + 3) * n * var * var).alias("m4"),
            at("zeros", "bigint").alias("zeros"), at("negatives", "bigint").alias("negatives"),
            at("low_length", "bigint").cast("bigint").alias("min_length"), at("top_length", "bigint").cast("bigint").alias("max_length"),
            at("length", "bigint").alias("length"), at("quantiles", "binary").alias("quantiles"), at("different", "binary").alias("different"),
        ))
    return df.agg(*aggregates).select(unpivot_rows(rows))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all parts together, from their states alone."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    whole = Window.partitionBy("column")
    center = F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum(F.when(F.col("mean").isNotNull(), F.col("n"))).over(whole)
    moved = both.withColumn("center", center).withColumn("d", F.col("mean") - F.col("center"))
    n, d = F.col("n"), F.col("d")
    moments = {
        "m2": F.col("m2") + n * d * d,
        "m3": F.col("m3") + 3 * d * F.col("m2") + n * d * d * d,
        "m4": F.col("m4") + 4 * d * F.col("m3") + 6 * d * d * F.col("m2") + n * d * d * d * d,
    }
    moved = moved.withColumns({f"_{k}": v for k, v in moments.items()})
    sums = ["rows", "n", "zeros", "negatives", "length"]
    merged = moved.groupBy("column", "kind").agg(
        *[F.sum(c).alias(c) for c in sums], *[F.sum(f"_{k}").alias(k) for k in MOMENTS], F.first("center", ignorenulls=True).alias("mean"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("different").alias("different"),
    )
    return merged.select(*states[0].columns)


def state_report(state: DataFrame) -> DataFrame:
    """The profile that a state tells: exact counts, extremes and moments, quantiles and different values by sketches."""
    n, m2 = F.col("n").cast("double"), F.col("m2")
    skew = F.when((n > 2) & (m2 > 0), F.sqrt(n) * F.col("m3") / F.pow(m2, F.lit(1.5)) * F.sqrt(n * (n - 1)) / (n - 2))
    plain = n * F.col("m4") / (m2 * m2) - 3
    kurt = F.when((n > 3) & (m2 > 0), ((n + 1) * plain + 6) * (n - 1) / ((n - 2) * (n - 3)))
    some = F.col("n") > 0
    quantile: list[Column] = [
        F.when(some & (F.col("kind") == "numeric"), F.kll_sketch_get_quantile_double("quantiles", F.lit(q))).alias(f"p{round(100 * q)}")
        for q in QUANTILES
    ]
    return state.select(
        "column", "kind", "n", (F.col("rows") - F.col("n")).alias("missing"), "min", "max", "mean",
        F.when(n > 1, F.sqrt(m2 / (n - 1))).alias("std"), skew.alias("skewness"), kurt.alias("kurtosis"), *quantile,
        F.hll_sketch_estimate("different").alias("n_distinct"), "zeros", "negatives", "min_length",
        F.try_divide("length", "n").alias("mean_length"), "max_length",
    )
