"""Min-max normalisation and standardisation; missing cells stay missing."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.columns import as_double, numeric_columns, unpivot_rows, zero_safe
from ..functions.stats import NumericStats, fit_numeric

Pairs = Mapping[str, tuple[float | None, float | None]]


def _fit_pairs(df, columns, first: Callable[[Column], Column], second: Callable[[Column], Column]) -> Pairs:
    columns = numeric_columns(df, columns)
    if not columns:
        return {}
    row = df.agg(
        *[first(as_double(df, c)).alias(f"a{i}") for i, c in enumerate(columns)],
        *[second(as_double(df, c)).alias(f"b{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(columns)}


def _replace(df: DataFrame, changed: Mapping[str, Column]) -> DataFrame:
    return df.withColumns({c: col.cast("double") for c, col in changed.items()}) if changed else df


def fit_min_max(df: DataFrame, columns: Sequence[str] | None = None) -> Pairs:
    return _fit_pairs(df, columns, F.min, F.max)


def apply_min_max(df: DataFrame, fitted: Pairs, feature_range: tuple[float, float] = (0, 1)) -> DataFrame:
    """Map the fitted range on the wanted one; a constant column becomes the lower end."""
    a, b = (float(v) for v in feature_range)
    if a >= b:
        raise ValueError(f"feature_range must grow, got {feature_range}")
    changed = {}
    for c, (low, high) in fitted.items():
        x = as_double(df, c)
        if low is not None:
            span = (high - low) or 1.0
            x = (x - F.lit(low)) / F.lit(span) * F.lit(b - a) + F.lit(a)
        changed[c] = x
    return _replace(df, changed)


def normalize(
    df: DataFrame, columns: Sequence[str] | None = None, feature_range: tuple[float, float] = (0, 1)
) -> DataFrame:
    return apply_min_max(df, fit_min_max(df, columns), feature_range)


def fit_standard(df: DataFrame, columns: Sequence[str] | None = None) -> Pairs:
    return _fit_pairs(df, columns, F.avg, F.stddev_pop)


def apply_standard(df: DataFrame, fitted: Pairs) -> DataFrame:
    """Subtract the mean and divide by the population deviation; a constant column becomes 0."""
    changed = {}
    for c, (mean, std) in fitted.items():
        x = as_double(df, c)
        if mean is not None:
            x = zero_safe((x - F.lit(mean)) / F.lit(std or 1.0))
        changed[c] = x
    return _replace(df, changed)


def standardize(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return apply_standard(df, fit_standard(df, columns))


def _before_after(df, after, columns, names, first, second) -> DataFrame:
    columns = numeric_columns(df, columns)

    def side(table: DataFrame, prefix: str) -> DataFrame:
        totals = table.agg(
            *[first(as_double(table, c)).alias(f"a{i}") for i, c in enumerate(columns)],
            *[second(as_double(table, c)).alias(f"b{i}") for i, c in enumerate(columns)],
        )
        rows = [
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"a{i}").alias(f"{prefix}_{names[0]}"),
                F.col(f"b{i}").alias(f"{prefix}_{names[1]}"),
            )
            for i, c in enumerate(columns)
        ]
        return totals.select(unpivot_rows(rows))

    return side(df, "before").join(F.broadcast(side(after, "after")), "column")


def normalize_report(
    df: DataFrame, columns: Sequence[str] | None = None, feature_range: tuple[float, float] = (0, 1)
) -> DataFrame:
    """Least and greatest value per column before and after normalising."""
    after = normalize(df, columns, feature_range)
    return _before_after(df, after, columns, ("min", "max"), F.min, F.max)


def standardize_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean and sample deviation per column before and after standardising."""
    after = standardize(df, columns)
    return _before_after(df, after, columns, ("mean", "std"), F.avg, F.stddev_samp)


def advise(stats: NumericStats) -> tuple[str, list[str]]:
    """Standardise a column with outliers, asymmetry, high variation or skew; else normalise.

    Symmetry compares with a tenth of the mean, so a negative mean is never symmetric.
    """
    if stats.count == 0:
        return labels.NORMALIZE, [labels.EVEN]
    low, high = stats.fence(1.5)
    reasons = []
    if stats.minimum < low or stats.maximum > high:
        reasons.append(labels.HAS_OUTLIERS)
    if not abs(stats.mean - stats.median) < 0.1 * stats.mean:
        reasons.append(labels.ASYMMETRIC)
    if stats.cv is not None and stats.cv > 0.5:
        reasons.append(labels.HIGH_VARIATION)
    if stats.skewness is not None and abs(stats.skewness) > 1:
        reasons.append(labels.STRONG_SKEW)
    return (labels.STANDARDIZE, reasons) if reasons else (labels.NORMALIZE, [labels.EVEN])


def scaling_advice(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    exact: bool = True,
    stats: Mapping[str, NumericStats] | None = None,
) -> DataFrame:
    """``column``, ``advice`` and ``reasons`` for every numeric column."""
    stats = stats or fit_numeric(df, columns, exact=exact)
    rows = [(c, *advise(s)) for c, s in stats.items()]
    return df.sparkSession.createDataFrame(rows, "column string, advice string, reasons array<string>")


def needs_normalizing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Whether some numeric column spans more than 1."""
    wide = F.lit(False)
    for c in numeric_columns(df, columns):
        x = as_double(df, c)
        wide = wide | F.coalesce(F.max(x) - F.min(x) > 1, F.lit(False))
    return df.agg(F.count("*").alias("n"), wide.alias("needs_normalizing")).select("needs_normalizing")
