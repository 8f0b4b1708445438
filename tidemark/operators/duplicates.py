"""Exact duplicate rows: remove, extract, count, number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import check_columns, ref, tidy
from ..functions.storage import settle

COPIES = "__copies"
CHUNK = 100_000


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep one of each set of equal rows; missing cells are equal to each other."""
    return tidy(df).dropDuplicates()


def row_groups(df: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies, counted before the shuffle."""
    table = tidy(df)
    return table.groupBy(*[ref(c) for c in table.columns]).agg(F.count("*").alias(COPIES))


def surplus_copies(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Second and later copies of every row.

    The copies are counted, not moved.  A row with very many copies is first cut into chunks, which
    are spread over the cluster before they are written out again one row per copy.
    """
    repeated = row_groups(df).where(F.col(COPIES) > 1).withColumn("__left", F.col(COPIES) - 1)
    columns = [ref(c) for c in df.columns]
    few = repeated.where(F.col("__left") <= chunk)
    chunks = (
        repeated.where(F.col("__left") > chunk)
        .withColumn("__from", F.explode(F.sequence(F.lit(0), F.col("__left") - 1, F.lit(chunk))))
        .withColumn("__left", F.least(F.lit(chunk), F.col("__left") - F.col("__from")))
        .repartition(F.col("__from"), *columns)
    )
    parts = few.select(*columns, "__left").unionByName(chunks.select(*columns, "__left"))
    return parts.select(*columns, F.explode(F.sequence(F.lit(1), F.col("__left")))).drop("col")


def duplicate_report(df: DataFrame) -> DataFrame:
    """Rows in all, surplus copies, removed and remaining rows, and whether copies are left."""
    totals = row_groups(df).agg(
        F.coalesce(F.sum(COPIES), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0)).alias("duplicates_count"),
        F.count("*").alias("remaining_rows"),
    )
    return totals.select(
        "total_rows",
        "duplicates_count",
        F.col("duplicates_count").alias("removed_rows"),
        "remaining_rows",
        F.lit(False).alias("has_duplicates"),
    )


def has_duplicates(df: DataFrame) -> DataFrame:
    return duplicate_report(df).select((F.col("duplicates_count") > 0).alias("has_duplicates"))


def duplicate_rate(df: DataFrame) -> DataFrame:
    """Number of row values that occur more than once, and its share of all rows."""
    totals = row_groups(df).agg(
        F.count_if(F.col(COPIES) > 1).alias("n_duplicates"),
        F.coalesce(F.sum(COPIES), F.lit(0)).alias("n_rows"),
    )
    return totals.select(
        "n_duplicates",
        F.coalesce(F.try_divide(F.col("n_duplicates"), F.col("n_rows")), F.lit(0.0)).alias("p_duplicates"),
    )


def duplicate_examples(df: DataFrame, order: Sequence[str], n: int = 2) -> DataFrame:
    """The first ``n`` surplus copies by the given order."""
    groups = row_groups(df).where(F.col(COPIES) > 1)
    first = groups.orderBy(*[ref(c) for c in check_columns(df, order)]).limit(n)
    each = F.explode(F.sequence(F.lit(1), F.least(F.col(COPIES) - 1, F.lit(n))))
    return (
        first.select(*[ref(c) for c in df.columns], each.alias("__copy"))
        .orderBy(*[ref(c) for c in order])
        .limit(n)
        .drop("__copy")
    )


def frequent_duplicates(df: DataFrame, n: int = 10, order: Sequence[str] | None = None) -> DataFrame:
    """The ``n`` rows with the most copies; ties by the given order (default: all columns)."""
    order = check_columns(df, order or df.columns)
    return (
        row_groups(df)
        .where(F.col(COPIES) > 1)
        .orderBy(F.col(COPIES).desc(), *[ref(c) for c in order])
        .limit(n)
        .withColumnRenamed(COPIES, "copies")
    )


def _ordered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The table sorted over the cluster by range and written once, with range and place of each row.

    The arrival position is the last sort key, so that equal keys, however many, still spread over
    several ranges.
    """
    keys = [*[ref(c) for c in check_columns(df, order)], F.col("__arrival")]
    ranged = (
        df.withColumn("__arrival", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("__range", F.spark_partition_id())
        .withColumn("__spot", F.monotonically_increasing_id())
    )
    return settle(ranged.drop("__arrival"), "rows")


def _offsets(fixed: DataFrame, size: Column, shift: Column) -> DataFrame:
    """Per range: the sum of the sizes of the ranges before it, moved by ``shift``; one row per range."""
    parts = fixed.groupBy("__range").agg(size.alias("size"), shift.alias("shift")).orderBy("__range").collect()
    found, before = [], 0
    for row in parts:
        found.append((row["__range"], before + row["shift"]))
        before += row["size"]
    return F.broadcast(fixed.sparkSession.createDataFrame(found, "__range int, __before bigint"))


def dense_row_id(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Number the rows 0, 1, 2, ... by the given order, without a global window."""
    fixed = _ordered(df, order)
    offsets = _offsets(fixed, F.count("*"), -F.min("__spot"))
    return (
        fixed.join(offsets, "__range")
        .withColumn(name, F.col("__spot") + F.col("__before"))
        .select(*[ref(c) for c in df.columns], name)
    )


def running_total(df: DataFrame, order: Sequence[str], weight: str, name: str) -> DataFrame:
    """Sum of an integer column over all rows before each row, by the given order.

    Each range sums its own rows; the totals of the ranges before are added.
    """
    fixed = _ordered(df, order)
    offsets = _offsets(fixed, F.sum(ref(weight)), F.lit(0))
    before = Window.partitionBy("__range").orderBy("__spot").rowsBetween(Window.unboundedPreceding, -1)
    return (
        fixed.withColumn("__own", F.coalesce(F.sum(ref(weight)).over(before), F.lit(0)))
        .join(offsets, "__range")
        .withColumn(name, F.col("__own") + F.col("__before"))
        .select(*[ref(c) for c in df.columns], name)
    )
