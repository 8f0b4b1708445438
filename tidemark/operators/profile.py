"""Column profiles, overviews and alerts as result tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    as_double,
    categorical_columns,
    check_columns,
    cleaned,
    is_missing,
    numeric_columns,
    ref,
    tidy,
    unpivot_rows,
)
from ..functions.counts import value_counts
from ..functions.stats import fit_numeric
from ..functions.storage import settle
from ..functions.lookup import lookup_join
from .duplicates import duplicate_rate, running_total
from .missing import missing_cells

PAIRS_PER_JOB = 300


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"))


def _counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct and once-only values, and the smallest most frequent value, per column."""
    return (
        value_counts(df, columns)
        .where(F.col("value").isNotNull())
        .groupBy("column")
        .agg(
            F.count("*").alias("n_distinct"),
            F.count_if(F.col("n") == 1).alias("n_unique"),
            F.min(F.struct((-F.col("n")).alias("rank"), "value")).alias("best"),
        )
    )


NUMERIC_PROFILE = (
    "column string, n bigint, missing bigint, min double, max double, mean double, std double, "
    "cv double, p5 double, p25 double, p50 double, p75 double, p95 double, iqr double, mad double, "
    "skewness double, kurtosis double, zeros bigint, negatives bigint, sum double"
)


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """One row per numeric column."""
    columns = numeric_columns(df, columns)
    stats = fit_numeric(df, columns, mad=True, exact=exact)
    rows = [
        (
            s.column, s.count, s.missing, s.minimum, s.maximum, s.mean, s.std, s.cv, s.p5, s.q1, s.median,
            s.q3, s.p95, s.iqr, s.mad, s.skewness, s.kurtosis, s.zeros, s.negatives, s.total,
        )
        for s in stats.values()
    ]
    table = df.sparkSession.createDataFrame(rows, NUMERIC_PROFILE)
    return table.join(F.broadcast(_distinct(df, columns)), "column")


def _distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct present values per column, counted in their own type."""
    counts = df.agg(*[F.count_distinct(cleaned(df, c)).alias(f"d{i}") for i, c in enumerate(columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(columns)]
    return counts.select(unpivot_rows(rows))


def _column_rows(df: DataFrame, columns: Sequence[str], aggregates, fields) -> DataFrame:
    """One aggregation over all columns, one output row per column."""
    totals = df.agg(
        F.count("*").alias("rows"),
        *[agg.alias(f"{name}_{i}") for i, c in enumerate(columns) for name, agg in aggregates(c).items()],
    )
    rows = [
        F.struct(F.lit(c).alias("column"), *[expr.alias(name) for name, expr in fields(i).items()])
        for i, c in enumerate(columns)
    ]
    return totals.select(unpivot_rows(rows))


def categorical_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct, unique, mode, its share of present cells and text lengths per categorical column."""
    columns = categorical_columns(df) if columns is None else check_columns(df, columns)
    texts = {c: cleaned(df, c).cast("string") for c in columns}
    base = _column_rows(
        df,
        columns,
        lambda c: {
            "n": F.count(texts[c]),
            "low": F.min(F.length(texts[c])),
            "mid": F.avg(F.length(texts[c])),
            "top": F.max(F.length(texts[c])),
        },
        lambda i: {
            "n": F.col(f"n_{i}"),
            "missing": F.col("rows") - F.col(f"n_{i}"),
            "min_length": F.col(f"low_{i}"),
            "mean_length": F.col(f"mid_{i}"),
            "max_length": F.col(f"top_{i}"),
        },
    )
    return base.join(F.broadcast(_counts(df, columns)), "column", "left").select(
        "column", "n", "missing",
        F.coalesce("n_distinct", F.lit(0).cast("bigint")).alias("n_distinct"),
        F.coalesce("n_unique", F.lit(0).cast("bigint")).alias("n_unique"),
        F.col("best.value").alias("mode"),
        F.try_divide(-F.col("best.rank"), F.col("n")).alias("mode_share"),
        "min_length", "mean_length", "max_length",
    )


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]


def date_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """First and last day, days between, distinct and missing per date column."""
    columns = date_columns(df) if columns is None else check_columns(df, columns)
    base = _column_rows(
        df,
        columns,
        lambda c: {"n": F.count(ref(c)), "low": F.min(ref(c)), "top": F.max(ref(c))},
        lambda i: {
            "n": F.col(f"n_{i}"),
            "missing": F.col("rows") - F.col(f"n_{i}"),
            "min_day": F.to_date(F.col(f"low_{i}")),
            "max_day": F.to_date(F.col(f"top_{i}")),
            "range_days": F.datediff(F.to_date(F.col(f"top_{i}")), F.to_date(F.col(f"low_{i}"))).cast("bigint"),
        },
    )
    return base.join(F.broadcast(_distinct(df, columns)), "column")


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells, repeated rows and columns per kind in one row."""
    kinds = [
        F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric_columns"),
        F.lit(len(date_columns(df))).cast("bigint").alias("date_columns"),
        F.lit(len(categorical_columns(df)) - len(date_columns(df))).cast("bigint").alias("categorical_columns"),
    ]
    base = shape(df).select("*", *kinds)
    # three one-row tables
    return base.join(F.broadcast(missing_cells(df)), F.lit(True)).join(
        F.broadcast(duplicate_rate(df)), F.lit(True)
    )


def _pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def _correlation(a: Column, b: Column) -> Column:
    """Pearson correlation; NULL where a column is constant."""
    return F.try_divide(F.regr_sxy(a, b), F.sqrt(F.regr_sxx(a, b) * F.regr_syy(a, b)))


def correlations(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """``column_a``, ``column_b``, ``correlation`` for every pair of numeric columns.

    Pearson is one aggregation over the rows where both cells are present.  Spearman ranks each column
    over the rows that are complete, with ties at their mean rank.
    """
    columns = numeric_columns(df, columns)
    if method == "spearman":
        df = _ranks(df, columns)
    elif method != "pearson":
        raise ValueError(f"unknown method: {method}")
    pairs = _pairs(columns)
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, correlation double")
    if len(pairs) > PAIRS_PER_JOB:
        return _many_correlations(df, columns)
    totals = df.agg(*[_correlation(as_double(df, a), as_double(df, b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"r{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ]
    return totals.select(unpivot_rows(rows))


def _many_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairs of many columns in one pass: tasks add up products of whole batches, over the rows where both are present.

    Values are taken relative to some of the first rows, so that sums of squares stay exact where values are far from 0.
    """
    table = df.select(*[as_double(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    width = len(columns)
    some = table.limit(100).agg(*[F.first(c, ignorenulls=True) for c in table.columns]).first()  # no pass over the table
    shift = np.array([0.0 if v is None else v for v in some])
    sums = ["n", "a", "b", "aa", "bb", "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sums), width, width))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], axis=1) - shift
            there = (~np.isnan(x)).astype(np.float64)
            x = np.nan_to_num(x, nan=0.0)
            square = x * x
            total += [there.T @ there, x.T @ there, there.T @ x, square.T @ there, there.T @ square, x.T @ x]
        i, j = np.triu_indices(width, 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(t[i, j]) for t in total)], ["i", "j", *sums])

    parts = table.mapInArrow(run, "i int, j int, " + ", ".join(f"{s} double" for s in sums))
    whole = parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in sums])
    n = F.col("n")
    sxx, syy = F.col("aa") - F.try_divide(F.col("a") * F.col("a"), n), F.col("bb") - F.try_divide(F.col("b") * F.col("b"), n)
    # what is left of a constant column's sum of squares is rounding
    flat = (sxx <= 1e-12 * F.col("aa")) | (syy <= 1e-12 * F.col("bb"))
    found = F.when(~flat, F.try_divide(F.col("ab") - F.try_divide(F.col("a") * F.col("b"), n), F.sqrt(F.greatest(sxx * syy, F.lit(0.0)))))
    names = F.array(*[F.lit(c) for c in columns])
    return whole.select(F.get(names, F.col("i")).alias("column_a"), F.get(names, F.col("j")).alias("column_b"), found.alias("correlation"))


def _ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace values by mean ranks: count the values, add up the counts by range, and look them up."""
    table = df.select(*[as_double(df, c) for c in columns]).na.drop()
    cells = [F.struct(F.lit(i).alias("place"), ref(c).alias("value")) for i, c in enumerate(columns)]
    counted = table.select(unpivot_rows(cells)).groupBy("place", "value").agg(F.count("*").alias("n"))
    placed = settle(running_total(counted, ["place", "value"], "n", "start"), "ranks")
    first = {r["place"]: r["first"] for r in placed.groupBy("place").agg(F.min("start").alias("first")).collect()}
    for i, c in enumerate(columns):
        rank = F.col("start") - F.lit(first.get(i, 0)) + (F.col("n") + 1) / 2
        ranks = placed.where(F.col("place") == i).select(F.col("value").alias(c), rank.alias("__rank"))
        table = lookup_join(table, ranks, [c]).drop(c).withColumnRenamed("__rank", c)
    return table.select(*[ref(c) for c in columns])


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values per column with count and share of rows; ties by value.

    The row number is cut before the shuffle, so at most ``k`` values per column and task move.
    """
    columns = check_columns(df, columns or df.columns)
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    ranked = value_counts(df, columns).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    rows = df.agg(F.count("*").alias("rows"))
    return ranked.join(F.broadcast(rows), F.lit(True)).select(
        "column", "value", "n", (F.col("n") / F.col("rows")).alias("share"), "rank"
    )


def missing_patterns(df: DataFrame) -> DataFrame:
    """Rows per combination of missing cells, one character per column, 1 for missing."""
    mask = F.concat(*[F.when(is_missing(df, c), "1").otherwise("0") for c in df.columns])
    return df.groupBy(mask.alias("mask")).agg(F.count("*").alias("n_rows"))


def sample_rows(df: DataFrame, order: Sequence[str], n: int = 10, last: bool = False) -> DataFrame:
    """The first or last ``n`` rows by the given order."""
    keys = [ref(c) for c in check_columns(df, order)]
    return df.orderBy(*[k.desc() if last else k for k in keys]).limit(n)


@dataclass(frozen=True)
class AlertLimits:
    """Limits of the alerts."""

    missing_share: float = 0.05
    zero_share: float = 0.1
    skewness: float = 5.0
    correlation: float = 0.9
    cardinality: int = 50
    mode_share: float = 0.75


def alerts(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    limits: AlertLimits = AlertLimits(),
) -> DataFrame:
    """``column``, ``alert``, ``value`` for everything that stands out."""
    chosen = check_columns(df, columns or df.columns)
    table = tidy(df.select(*[ref(c) for c in chosen]))
    numbers, texts = numeric_columns(table), categorical_columns(table)
    nothing = F.lit(None).cast("double")
    parts = {
        c: {
            "n": F.count(ref(c)),
            "zeros": F.count_if(ref(c) == 0) if c in numbers else F.lit(0).cast("bigint"),
            "low": F.min(as_double(table, c)) if c in numbers else nothing,
            "top": F.max(as_double(table, c)) if c in numbers else nothing,
            "skew": F.skewness(as_double(table, c)) if c in numbers else nothing,
        }
        for c in chosen
    }
    base = _column_rows(
        table,
        chosen,
        lambda c: parts[c],
        lambda i: {
            "rows": F.col("rows"),
            "kind": F.lit("numeric" if chosen[i] in numbers else "categorical"),
            **{k: F.col(f"{k}_{i}") for k in ("n", "zeros", "low", "top", "skew")},
        },
    ).join(F.broadcast(_distinct(table, chosen)), "column")
    if texts:
        frequent = _counts(table, texts).select("column", (-F.col("best.rank")).alias("most"))
        base = base.join(F.broadcast(frequent), "column", "left")
    else:
        base = base.withColumn("most", F.lit(None).cast("bigint"))
    missing = F.try_divide(F.col("rows") - F.col("n"), F.col("rows"))
    adjusted = F.when(
        (F.col("n") > 2) & (F.col("low") < F.col("top")),
        F.col("skew") * F.sqrt((F.col("n") * (F.col("n") - 1)).cast("double")) / (F.col("n") - 2),
    )
    mode_share = F.try_divide(F.col("most"), F.col("n"))
    distinct = F.col("n_distinct")
    zeros = F.try_divide(F.col("zeros"), F.col("rows"))
    rules = [
        ("constant", distinct == 1, distinct),
        ("unique", (F.col("n") > 1) & (distinct == F.col("n")), distinct),
        ("missing", missing > limits.missing_share, missing),
        ("zeros", zeros > limits.zero_share, zeros),
        ("skewed", F.abs(adjusted) > limits.skewness, adjusted),
        ("high_cardinality", (F.col("kind") == "categorical") & (distinct > limits.cardinality), distinct),
        ("imbalance", (distinct > 1) & (mode_share > limits.mode_share), mode_share),
    ]
    found = F.array_compact(
        F.array(
            *[
                F.when(test, F.struct(F.lit(name).alias("alert"), value.cast("double").alias("value")))
                for name, test, value in rules
            ]
        )
    )
    result = base.select("column", F.inline(found))
    if len(numbers) > 1:
        high = correlations(table, numbers).where(F.abs("correlation") > limits.correlation)
        result = result.unionByName(
            high.select(
                F.concat("column_a", F.lit("~"), "column_b").alias("column"),
                F.lit("high_correlation").alias("alert"),
                F.col("correlation").alias("value"),
            )
        )
    repeated = duplicate_rate(table).where(F.col("n_duplicates") > 0)
    return result.unionByName(
        repeated.select(
            F.lit("*").alias("column"), F.lit("duplicates").alias("alert"), F.col("p_duplicates").alias("value")
        )
    )

