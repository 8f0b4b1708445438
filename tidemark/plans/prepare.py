"""Run operators in a row, and the automatic preparation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.columns import numeric_columns, ref, tidy
from ..functions.storage import settle, settle_counted
from ..operators import duplicates, missing, outliers, scaling

Step = int | str | tuple[int | str, Mapping[str, object]]


@dataclass(frozen=True)
class LogLine:
    """What a step did."""

    step: str
    description: str
    rows_in: int
    rows_out: int
    applied: bool


LOG = "place int, step string, description string, rows_in bigint, rows_out bigint, applied boolean"


def log_table(df: DataFrame, lines: Sequence[LogLine]) -> DataFrame:
    rows = [(i, x.step, x.description, x.rows_in, x.rows_out, x.applied) for i, x in enumerate(lines)]
    return df.sparkSession.createDataFrame(rows, LOG)


def _value(df: DataFrame) -> object:
    return df.first()[0]


def auto_prepare(
    df: DataFrame,
    impute: str = "knn",
    outlier_method: str = "auto",
    columns: Sequence[str] | None = None,
    exact: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Drop duplicates, fill missing cells, remove outliers, normalise; each only where needed.

    ``columns`` are the numeric columns that are filled, searched for outliers and normalised.
    Returns the prepared table and a log of the steps.  The table is written once after each step
    that changed it, as the next decisions read it several times.
    """
    lines: list[LogLine] = []
    numbers = numeric_columns(df, columns)
    others = [c for c in df.columns if c not in numeric_columns(df)]
    data = tidy(df)
    before = data.count()
    unique, after = settle_counted(duplicates.drop_duplicates(data), "unique")
    if before > after:
        data = unique
    lines.append(LogLine("drop_duplicates", "remove duplicate rows", before, after, before > after))

    holes = _value(missing.any_missing(data.select(*[ref(c) for c in [*numbers, *others]])))
    if holes:
        data = settle(missing.fill_missing(data, impute, "mode", columns=[*numbers, *others], exact=exact), "filled")
    lines.append(LogLine("fill_missing", missing.describe_fill(impute, "mode"), after, after, bool(holes)))

    far = bool(numbers) and _value(outliers.has_iqr_outliers(data, numbers, exact=exact))
    kept = after
    if far:
        if outlier_method.lower() == "auto":
            data, tried = outliers.compare_removals(data, numbers, exact=exact)
            for r in tried.collect():  # one row per method
                told = f"{r['method']}: skew score {r['skew_score']:.6g}" + (", chosen" if r["chosen"] else "")
                lines.append(LogLine("compare_removals", told, after, r["rows_kept"], r["chosen"]))
        else:
            data = outliers.remove_outliers(data, outlier_method, numbers, exact=exact)
        data, kept = settle_counted(data, "kept")
    lines.append(LogLine("remove_outliers", f"remove outliers by {outlier_method}", after, kept, bool(far)))

    wide = bool(numbers) and _value(scaling.needs_normalizing(data, numbers))
    if wide:
        data = scaling.normalize(data, numbers)
    lines.append(LogLine("normalize", "map numeric columns to (0, 1)", kept, kept, bool(wide)))
    return data, log_table(df, lines)


def _auto(df: DataFrame, **options) -> DataFrame:
    return auto_prepare(df, **options)[0]


# The numbers of the operators are their places in this list.
OPERATORS: dict[str, Callable[..., DataFrame]] = {
    "drop_duplicates": duplicates.drop_duplicates,
    "fill_missing": missing.fill_missing,
    "normalize": scaling.normalize,
    "standardize": scaling.standardize,
    "remove_outliers": outliers.remove_outliers,
    "auto_prepare": _auto,
}


def resolve(step: Step) -> tuple[str, Callable[..., DataFrame], dict[str, object]]:
    name, options = step if isinstance(step, tuple) else (step, {})
    names = list(OPERATORS)
    if isinstance(name, int):
        if not 0 <= name < len(names):
            raise ValueError(f"unknown operator number {name}; there are 0 to {len(names) - 1}")
        name = names[name]
    if name not in OPERATORS:
        raise ValueError(f"unknown operator {name}; known are {names}")
    return name, OPERATORS[name], dict(options)


# What each operator does; the options are shown after it.
MEANINGS = {
    "drop_duplicates": "remove duplicate rows",
    "fill_missing": "fill missing cells",
    "normalize": "map numeric columns to a range",
    "standardize": "bring numeric columns to mean 0 and deviation 1",
    "remove_outliers": "remove outliers",
    "auto_prepare": "remove duplicates, fill missing cells, remove outliers and normalise where needed",
}


def describe(step: Step) -> str:
    """What a step does, with its parameters."""
    name, _, options = resolve(step)
    told = ", ".join(f"{k}={v}" for k, v in options.items())
    return MEANINGS[name] + (f" ({told})" if told else "")


def prepare(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Apply operators, given by name or by number, optionally with parameters, in order."""
    for step in steps:
        _, run, options = resolve(step)
        df = run(df, **options)
    return df


def prepare_logged(df: DataFrame, steps: Sequence[Step]) -> tuple[DataFrame, DataFrame]:
    """As ``prepare``, with a log of the rows before and after each step, read from the footers of what was written."""
    lines = []
    rows = df.count()
    for step in steps:
        name, run, options = resolve(step)
        df, left = settle_counted(run(df, **options), name)
        lines.append(LogLine(name, describe(step), rows, left, True))
        rows = left
    return df, log_table(df, lines)
