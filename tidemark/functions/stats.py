"""Numeric column statistics, fitted for all columns together."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import as_double, numeric_columns, ref
from .quantiles import exact_quantiles

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


@dataclass(frozen=True)
class NumericStats:
    """Statistics of one column over its present cells; ``None`` where they are not defined."""

    column: str
    rows: int
    count: int
    missing: int
    mean: float | None
    std: float | None
    std_pop: float | None
    skewness_pop: float | None
    skewness: float | None
    kurtosis: float | None
    minimum: float | None
    maximum: float | None
    total: float | None
    zeros: int
    negatives: int
    p5: float | None
    q1: float | None
    median: float | None
    q3: float | None
    p95: float | None
    mad: float | None = None

    @property
    def iqr(self) -> float | None:
        return None if self.q1 is None else self.q3 - self.q1

    @property
    def cv(self) -> float | None:
        return self.std / self.mean if self.std is not None and self.mean else None

    def fence(self, factor: float) -> tuple[float, float] | None:
        """The interquartile fence around the middle half."""
        if self.q1 is None:
            return None
        return self.q1 - factor * self.iqr, self.q3 + factor * self.iqr


def sample_skewness(population: float | None, n: int) -> float | None:
    """Bias-adjusted skewness from the population value."""
    if population is None or n < 3:
        return None
    return population * math.sqrt(n * (n - 1)) / (n - 2)


def sample_kurtosis(population: float | None, n: int) -> float | None:
    """Bias-adjusted excess kurtosis from the population value."""
    if population is None or n < 4:
        return None
    return ((n + 1) * population + 6) * (n - 1) / ((n - 2) * (n - 3))


def fit_numeric(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    mad: bool = False,
    exact: bool = True,
) -> dict[str, NumericStats]:
    """Moments and quantiles of all columns in a few passes, whatever the number of columns."""
    columns = numeric_columns(df, columns)
    if not columns:
        return {}
    extra = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        x = ref(c)
        extra += [
            F.avg(x).alias(f"mean_{i}"),
            F.stddev_samp(x).alias(f"std_{i}"),
            F.stddev_pop(x).alias(f"stdp_{i}"),
            F.skewness(x).alias(f"skew_{i}"),
            F.kurtosis(x).alias(f"kurt_{i}"),
            F.min(x).alias(f"min_{i}"),
            F.max(x).alias(f"max_{i}"),
            F.sum(x).alias(f"sum_{i}"),
            F.count_if(x == 0).alias(f"zeros_{i}"),
            F.count_if(x < 0).alias(f"neg_{i}"),
        ]
    quantiles, row = exact_quantiles(df, columns, QUANTILES, extra, exact=exact)
    deviations: dict[str, float | None] = {}
    if mad:
        deviations = absolute_deviations(df, {c: quantiles[c][2] for c in columns}, exact)
    result = {}
    for i, c in enumerate(columns):
        n = row[f"__n_{i}"]
        flat = row[f"min_{i}"] == row[f"max_{i}"]
        skew = None if flat else row[f"skew_{i}"]
        kurt = None if flat else row[f"kurt_{i}"]
        p5, q1, median, q3, p95 = quantiles[c]
        result[c] = NumericStats(
            column=c,
            rows=row["rows"],
            count=n,
            missing=row["rows"] - n,
            mean=row[f"mean_{i}"],
            std=row[f"std_{i}"],
            std_pop=row[f"stdp_{i}"],
            skewness_pop=skew,
            skewness=sample_skewness(skew, n),
            kurtosis=sample_kurtosis(kurt, n),
            minimum=row[f"min_{i}"],
            maximum=row[f"max_{i}"],
            total=row[f"sum_{i}"],
            zeros=row[f"zeros_{i}"],
            negatives=row[f"neg_{i}"],
            p5=p5, q1=q1, median=median, q3=q3, p95=p95,
            mad=deviations.get(c),
        )
    return result


def absolute_deviations(
    df: DataFrame, centers: dict[str, float | None], exact: bool = True
) -> dict[str, float | None]:
    """Median of the distances to the given center, per column."""
    known = {c: m for c, m in centers.items() if m is not None}
    if not known:
        return {}
    distances = df.select(*[F.abs(as_double(df, c) - F.lit(m)).alias(c) for c, m in known.items()])
    medians, _ = exact_quantiles(distances, list(known), [0.5], exact=exact)
    return {c: values[0] for c, values in medians.items()}
