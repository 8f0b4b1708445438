"""The full diagnosis of a table in one result."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns
from ..functions.stats import fit_numeric
from ..operators.duplicates import duplicate_rate
from ..operators.missing import missing_cells
from ..operators.outliers import Thresholds, outlier_report
from ..operators.profile import AlertLimits, alerts
from ..operators.scaling import scaling_advice


def diagnose(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    check_alerts: bool = True,
    check_missing: bool = True,
    check_duplicates: bool = True,
    check_abnormal: bool = True,
    check_scaling: bool = True,
    thresholds: Thresholds = Thresholds(),
    limits: AlertLimits = AlertLimits(),
    exact: bool = True,
) -> DataFrame:
    """``section``, ``column``, ``item``, ``value``, ``text`` of all checks that are switched on.

    ``columns`` are the numeric columns for outliers and scaling; their statistics are fitted once.
    """
    numbers = numeric_columns(df, columns)
    none, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    parts = []
    if check_alerts:
        found = alerts(df, limits=limits)
        parts.append(found.select(F.lit("alerts").alias("section"), "column", F.col("alert").alias("item"), F.col("value"), no_text.alias("text")))
    if check_missing:
        row = missing_cells(df)
        for name in ("n_cells_missing", "p_cells_missing"):
            parts.append(_single(row, "missing", name, no_text))
    if check_duplicates:
        row = duplicate_rate(df)
        for name in ("n_duplicates", "p_duplicates"):
            parts.append(_single(row, "duplicates", name, no_text))
    stats = None
    if (check_abnormal or check_scaling) and numbers:
        stats = fit_numeric(df, numbers, mad=check_abnormal, exact=exact)
    if check_abnormal and stats:
        report = outlier_report(df, thresholds=thresholds, stats=stats)
        parts.append(
            report.select(
                F.lit("outliers").alias("section"), "column", F.col("method").alias("item"),
                F.col("n").cast("double").alias("value"), F.col("direction").alias("text"),
            )
        )
    if check_scaling and stats:
        advice = scaling_advice(df, stats=stats)
        parts.append(
            advice.select(
                F.lit("scaling").alias("section"), "column", F.col("advice").alias("item"),
                none.alias("value"), F.array_join("reasons", ", ").alias("text"),
            )
        )
    if not parts:
        schema = "section string, column string, item string, value double, text string"
        return df.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def _single(row: DataFrame, section: str, name: str, text) -> DataFrame:
    return row.select(
        F.lit(section).alias("section"), F.lit("*").alias("column"), F.lit(name).alias("item"),
        F.col(name).cast("double").alias("value"), text.alias("text"),
    )
