"""Missing values: reports, strategies and fills."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    as_double,
    check_columns,
    cleaned,
    is_missing,
    is_numeric,
    numeric_columns,
    ref,
    tidy,
    unpivot_rows,
)
from ..functions.counts import distinct_counts, modes
from ..functions.quantiles import exact_quantiles
from ..functions.stats import fit_numeric, sample_skewness

NUMERIC = ("mean", "median", "constant", "knn", "iterative")
CATEGORICAL = ("mode", "constant")
COLUMN_STRATEGIES = ("mean", "median", "mode", "constant", "drop")
UNKNOWN = "Unknown"
UNKNOWN_BY_TYPE = "UNKNOWN"


def missing_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows of the table and missing cells per column, in one pass."""
    row = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    ).first()
    return row["rows"], {c: row[f"m{i}"] for i, c in enumerate(df.columns)}


def any_missing(df: DataFrame) -> DataFrame:
    flags = [F.coalesce(F.bool_or(is_missing(df, c)), F.lit(False)) for c in df.columns]
    found = flags[0]
    for flag in flags[1:]:
        found = found | flag
    return df.agg(found.alias("any_missing"))


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose cells in the given columns are all present."""
    present = [~is_missing(df, c) for c in check_columns(df, columns or df.columns)]
    return tidy(df.where(reduce(and_, present)))


def missing_cells(df: DataFrame) -> DataFrame:
    """Missing cells of the table and their share of all cells."""
    total = sum((F.count_if(is_missing(df, c)) for c in df.columns), F.lit(0))
    cells = F.count("*") * len(df.columns)
    return df.agg(
        total.cast("bigint").alias("n_cells_missing"),
        F.coalesce(F.try_divide(total, cells), F.lit(0.0)).alias("p_cells_missing"),
    )


def missing_counts_table(df: DataFrame) -> DataFrame:
    """Per column with missing cells: type, count, percent; one pass and no shuffle of rows."""
    totals = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col(f"m{i}").alias("missing"),
            F.round(F.try_divide(F.col(f"m{i}"), F.col("rows")) * 100, 2).alias("pct"),
        )
        for i, f in enumerate(df.schema)
    ]
    return totals.select(unpivot_rows(rows)).where(F.col("missing") > 0)


def suggest_strategies(df: DataFrame) -> dict[str, str]:
    """Strategy per column with missing cells.

    Numbers: median where the adjusted skewness is above 1, else mean.  Others: mode where there
    are fewer than 20 values (missing is one of them), else constant.
    """
    numbers = numeric_columns(df)
    shapes = [
        F.struct(F.count(as_double(df, c)).alias("n"), F.skewness(as_double(df, c)).alias("skew")).alias(f"s{i}")
        for i, c in enumerate(numbers)
    ]
    lost = [F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]
    row = df.agg(*lost, *shapes).first()
    holes = [c for i, c in enumerate(df.columns) if row[f"m{i}"]]
    values = distinct_counts(df, [c for c in holes if c not in numbers])
    result = {}
    for c in holes:
        if c in numbers:
            shape = row[f"s{numbers.index(c)}"]
            skew = sample_skewness(shape["skew"], shape["n"])
            result[c] = "median" if skew is not None and skew > 1 else "mean"
        else:
            result[c] = "mode" if values[c] < 20 else "constant"
    return result


def missing_report(df: DataFrame) -> DataFrame:
    """Type, count, percent and suggested strategy of every column with missing cells."""
    table = missing_counts_table(df)
    choice = suggest_strategies(df)
    strategy = F.lit(None).cast("string")
    for c, s in choice.items():
        strategy = F.when(F.col("column") == c, s).otherwise(strategy)
    return table.withColumn("suggested_strategy", strategy)


def missing_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """Minimum, quartiles and maximum of the numeric columns that have missing cells."""
    schema = "column string, min double, q1 double, median double, q3 double, max double"
    stats = fit_numeric(df, exact=exact)
    rows = [
        (c, s.minimum, s.q1, s.median, s.q3, s.maximum) for c, s in stats.items() if s.missing > 0
    ]
    return df.sparkSession.createDataFrame(rows, schema)


def verify_fill(before: DataFrame, after: DataFrame) -> DataFrame:
    """Missing cells before and after, rows, and columns that had missing cells."""
    lost = [F.count_if(is_missing(before, c)) for c in before.columns]
    left = before.agg(
        F.count("*").alias("n_rows"),
        sum(lost, F.lit(0)).cast("bigint").alias("missing_before"),
        sum((F.when(n > 0, 1).otherwise(0) for n in lost), F.lit(0)).cast("bigint").alias("affected_columns"),
    )
    right = missing_cells(after).select(F.col("n_cells_missing").alias("missing_after"))
    # two one-row tables
    return left.join(F.broadcast(right), F.lit(True))


@dataclass(frozen=True)
class FillPlan:
    """What is put in the missing cells of each column, and which columns lose their rows."""

    values: dict[str, object] = field(default_factory=dict)
    drop_rows: tuple[str, ...] = ()


def apply_fill(df: DataFrame, plan: FillPlan) -> DataFrame:
    """Row-local; also works on a stream.  Filled numeric columns become doubles."""
    table = drop_missing(df, plan.drop_rows) if plan.drop_rows else df
    out = []
    for f in table.schema:
        if f.name not in plan.values:
            out.append(cleaned(table, f.name))
            continue
        value = plan.values[f.name]
        if is_numeric(f.dataType):
            col = as_double(table, f.name)
            filled = col if value is None else F.coalesce(col, F.lit(float(value)))
        elif isinstance(f.dataType, T.StringType) or value is None:
            filled = ref(f.name) if value is None else F.coalesce(ref(f.name), F.lit(str(value)))
        elif value in (UNKNOWN, UNKNOWN_BY_TYPE):
            filled = F.coalesce(ref(f.name).cast("string"), F.lit(value))
        else:
            filled = F.coalesce(ref(f.name), F.lit(value).cast(f.dataType))
        out.append(filled.alias(f.name))
    return table.select(*out)


def _number(value: object, column: str) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        raise ValueError(f"fill value {value!r} of column '{column}' is not a number") from None


def fit_values(df: DataFrame, strategies: Mapping[str, str], exact: bool = True) -> dict[str, object]:
    """Mean, median or mode of the named columns, with one job per kind of statistic."""
    result: dict[str, object] = {}
    means = [c for c, s in strategies.items() if s == "mean"]
    medians = [c for c, s in strategies.items() if s == "median"]
    common = [c for c, s in strategies.items() if s == "mode"]
    numeric_columns(df, means + medians)
    if means:
        row = df.agg(*[F.avg(as_double(df, c)).alias(f"m{i}") for i, c in enumerate(means)]).first()
        result |= {c: row[f"m{i}"] for i, c in enumerate(means)}
    if medians:
        found, _ = exact_quantiles(df, medians, [0.5], exact=exact)
        result |= {c: found[c][0] for c in medians}
    if common:
        found = modes(df, common)
        result |= {c: found.get(c) for c in common}
    return result


def fit_fill(
    df: DataFrame,
    numeric_strategy: str = "median",
    categorical_strategy: str = "mode",
    fill_value: Mapping[str, object] | None = None,
    columns: Sequence[str] | None = None,
    exact: bool = True,
) -> FillPlan:
    """Fit the fills that give a single value per column."""
    if numeric_strategy not in NUMERIC:
        raise ValueError(f"unknown numeric strategy: {numeric_strategy}")
    if categorical_strategy not in CATEGORICAL:
        raise ValueError(f"unknown categorical strategy: {categorical_strategy}")
    given = dict(fill_value or {})
    chosen = check_columns(df, columns if columns is not None else df.columns)
    numbers = [c for c in chosen if is_numeric(df.schema[c].dataType)]
    others = [c for c in chosen if c not in numbers]
    values: dict[str, object] = {}
    if numeric_strategy in ("mean", "median"):
        values |= fit_values(df, dict.fromkeys(numbers, numeric_strategy), exact)
    elif numeric_strategy == "constant":
        unnamed = [c for c in numbers if c not in given]
        if unnamed:
            _, lost = missing_counts(df.select(*[ref(c) for c in unnamed]))
            holes = [c for c, n in lost.items() if n]
            if holes:
                raise ValueError(f"strategy 'constant' needs a fill value for the columns {holes}")
        values |= {c: _number(given[c], c) if c in given else None for c in numbers}
    if categorical_strategy == "mode":
        values |= fit_values(df, dict.fromkeys(others, "mode"), exact)
    else:
        values |= {c: given.get(c, UNKNOWN) for c in others}
    return FillPlan(values)


def fill_missing(
    df: DataFrame,
    numeric_strategy: str = "knn",
    categorical_strategy: str = "mode",
    fill_value: Mapping[str, object] | None = None,
    columns: Sequence[str] | None = None,
    exact: bool = True,
) -> DataFrame:
    """Fill numeric and categorical columns, each kind with one strategy."""
    if numeric_strategy not in ("knn", "iterative"):
        plan = fit_fill(df, numeric_strategy, categorical_strategy, fill_value, columns, exact)
        return apply_fill(df, plan)
    from .imputers import iterative_fill, knn_fill

    chosen = check_columns(df, columns if columns is not None else df.columns)
    numbers = [c for c in chosen if is_numeric(df.schema[c].dataType)]
    others = [c for c in chosen if c not in numbers]
    plan = fit_fill(df, "median", categorical_strategy, fill_value, others, exact)
    filled = apply_fill(df, plan)
    if not numbers:
        return filled
    return knn_fill(filled, numbers) if numeric_strategy == "knn" else iterative_fill(filled, numbers)


def fit_strategies(
    df: DataFrame, strategies: Mapping[str, str] | None = None, exact: bool = True
) -> FillPlan:
    """Fit a strategy per column or per kind, for the columns with missing cells.

    ``strategies`` maps column names, ``numeric`` and ``categorical`` to mean, median, mode,
    constant or drop.  The constant is ``'UNKNOWN'`` for texts and 0 for the rest.
    """
    strategies = dict(strategies or {"numeric": "median", "categorical": "mode"})
    _, lost = missing_counts(df)
    chosen = {}
    for c in [c for c, n in lost.items() if n]:
        kind = "numeric" if is_numeric(df.schema[c].dataType) else "categorical"
        strategy = strategies.get(c, strategies.get(kind))
        if strategy not in COLUMN_STRATEGIES:
            raise ValueError(f"unknown strategy for column '{c}': {strategy}")
        chosen[c] = strategy
    values = fit_values(df, {c: s for c, s in chosen.items() if s in ("mean", "median", "mode")}, exact)
    for c, s in chosen.items():
        if s == "constant":
            values[c] = UNKNOWN_BY_TYPE if isinstance(df.schema[c].dataType, T.StringType) else 0
    return FillPlan(values, tuple(c for c, s in chosen.items() if s == "drop"))


def process_missing(
    df: DataFrame, strategies: Mapping[str, str] | None = None, exact: bool = True
) -> DataFrame:
    return apply_fill(df, fit_strategies(df, strategies, exact))


def describe_fill(numeric_strategy: str, categorical_strategy: str) -> str:
    return f"fill missing cells: numeric by {numeric_strategy}, categorical by {categorical_strategy}"
