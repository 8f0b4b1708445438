"""Value counts of many columns in one job; the basis of modes and distinct counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import cleaned


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per cell: ``column``, ``value`` as text (NULL when missing)."""
    cells = [
        F.struct(F.lit(c).alias("column"), cleaned(df, c).cast("string").alias("value")) for c in columns
    ]
    return df.select(F.inline(F.array(*cells)))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column``, ``value``, ``n``; counted on the map side, so a frequent value is no hot spot."""
    return long_form(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent present value per column as text; the smallest one on ties."""
    if not columns:
        return {}
    best = (
        value_counts(df, columns)
        .where(F.col("value").isNotNull())
        .groupBy("column")
        .agg(F.min(F.struct((-F.col("n")).alias("rank"), "value")).alias("best"))
    )
    return {r["column"]: r["best"]["value"] for r in best.collect()}


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Distinct values per column, where missing counts as a value."""
    if not columns:
        return {}
    found = value_counts(df, columns).groupBy("column").agg(F.count("*").alias("n"))
    return {r["column"]: r["n"] for r in found.collect()}
