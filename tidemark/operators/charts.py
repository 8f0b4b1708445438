"""The numbers behind charts.  Results are small whatever the table size, but ``line`` has a row per different x."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_double, cleaned, numeric_columns, ref


def _limits(df: DataFrame, columns: list[str]) -> list[tuple[float | None, float | None]]:
    row = df.agg(
        *[F.min(as_double(df, c)).alias(f"a{i}") for i, c in enumerate(columns)],
        *[F.max(as_double(df, c)).alias(f"b{i}") for i, c in enumerate(columns)],
    ).first()
    return [(row[f"a{i}"], row[f"b{i}"]) for i in range(len(columns))]


def equal_width_bin(df: DataFrame, column: str, low: float, high: float, bins: int):
    """Bin number from 0; the greatest value falls in the last bin."""
    width = (high - low) / bins or 1.0
    spot = F.floor((as_double(df, column) - F.lit(low)) / F.lit(width))
    return F.greatest(F.least(spot, F.lit(bins - 1)), F.lit(0)).cast("int")


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """``bin``, ``low``, ``high``, ``n`` of the bins that hold cells."""
    numeric_columns(df, [column])
    low, high = _limits(df, [column])[0]
    if low is None:
        low = high = 0.0
    width = (high - low) / bins or 1.0
    spot = equal_width_bin(df, column, low, high, bins)
    counted = df.where(as_double(df, column).isNotNull()).groupBy(spot.alias("bin")).agg(F.count("*").alias("n"))
    return counted.select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        "n",
    )


def scatter_grid(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """Rows per cell of a grid over two numeric columns."""
    numeric_columns(df, [x, y])
    (xl, xh), (yl, yh) = _limits(df, [x, y])
    if xl is None or yl is None:
        xl = xh = yl = yh = 0.0
    both = df.where(as_double(df, x).isNotNull() & as_double(df, y).isNotNull())
    return both.groupBy(
        equal_width_bin(df, x, xl, xh, bins).alias("x_bin"), equal_width_bin(df, y, yl, yh, bins).alias("y_bin")
    ).agg(F.count("*").alias("n"))


def line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean, least and greatest ``y`` per value of ``x``, in the order of ``x``."""
    value = as_double(df, y)
    return (
        df.where(cleaned(df, x).isNotNull())
        .groupBy(ref(x).alias("x"))
        .agg(F.avg(value).alias("mean_y"), F.min(value).alias("min_y"), F.max(value).alias("max_y"))
        .orderBy("x")
    )


def line_pixels(df: DataFrame, x: str, y: str, width: int = 800) -> DataFrame:
    """The points that a line chart of so many pixel columns shows: ``pixel``, ``x``, ``y``, at most 4 a column.

    Of each column the first, last, least and greatest point, whatever the number of different values of
    ``x``; the drawn line is that of all points.  ``x`` is a number or a time (in seconds).  One aggregation
    finds the range of ``x``, another the points; only these are sorted.
    """
    kind = df.schema[x].dataType
    if isinstance(kind, T.TimestampNTZType):
        across = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ref(x)) / 1_000_000
    elif isinstance(kind, T.TimestampType):
        across = ref(x).cast("double")
    else:
        across = F.unix_date(ref(x)).cast("double") * 86_400 if isinstance(kind, T.DateType) else as_double(df, x)
    points = df.select(across.alias("x"), as_double(df, y).alias("y")).where("x is not null and y is not null and not isnan(x)")
    low, high = points.agg(F.min("x"), F.max("x")).first()
    if low is None:
        low = high = 0.0
    span = F.lit(high - low if high > low else 1.0)
    pixel = F.least(F.floor((F.col("x") - F.lit(low)) / span * width), F.lit(width - 1)).cast("int")
    by_x, by_y = F.struct("x", "y"), F.struct("y", "x")
    shown = points.groupBy(pixel.alias("pixel")).agg(
        F.min(by_x).alias("first"), F.max(by_x).alias("last"), F.min(by_y).alias("least"), F.max(by_y).alias("most")
    )
    four = F.array(*[F.struct(F.col(f"{p}.x").alias("x"), F.col(f"{p}.y").alias("y")) for p in ("first", "least", "most", "last")])
    return shown.select("pixel", F.explode(F.array_distinct(four)).alias("p")).select("pixel", "p.x", "p.y").orderBy("pixel", "x", "y")


def pie(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    """Count and share of present cells per value; refused for more than ``most`` values."""
    counted = (
        df.where(cleaned(df, column).isNotNull())
        .groupBy(ref(column).cast("string").alias("value"))
        .agg(F.count("*").alias("n"))
    )
    rows = counted.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"column '{column}' has more than {most} values, too many for a pie")
    total = sum(r["n"] for r in rows)
    return counted.select("value", "n", (F.col("n") / F.lit(float(total or 1))).alias("share"))
