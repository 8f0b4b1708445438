"""Outlier rules on single columns: report, rank and remove."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_double, numeric_columns, ref, unpivot_rows
from ..functions.quantiles import exact_quantiles
from ..functions.stats import NumericStats, fit_numeric

# Names of the rules, in the order that breaks ties.
IQR = "IQR"
HAMPEL = "Modified_Z_score"
PERCENTILE = "Percentile"
SKEWNESS = "Skewness_Method"
KURTOSIS = "Kurtosis_Method"
METHODS = (IQR, HAMPEL, PERCENTILE, SKEWNESS, KURTOSIS)


@dataclass(frozen=True)
class Thresholds:
    """Thresholds of the rules; larger values flag fewer cells."""

    hampel: float = 3.0
    iqr: float = 1.5
    skewness: float = 2.0
    kurtosis: float = 3.5

    def shift(self, steps: float) -> Thresholds:
        return Thresholds(
            self.hampel + 0.2 * steps,
            self.iqr + 0.1 * steps,
            self.skewness + 0.14 * steps,
            self.kurtosis + 0.22 * steps,
        )


def _never() -> Column:
    return F.lit(False)


def _far(x: Column, s: NumericStats, scale: float, limit: float) -> Column:
    """Scaled distance from the median in deviations beyond a limit; any distance if they are 0."""
    if s.mad == 0:
        return x != F.lit(s.median)
    return F.abs(F.lit(scale) * (x - F.lit(s.median)) / F.lit(s.mad)) > F.lit(limit)


def rule_flags(df: DataFrame, s: NumericStats, t: Thresholds) -> dict[str, Column]:
    """Predicate per rule on one column; NULL for missing cells, which are never flagged."""
    x = as_double(df, s.column)
    if s.count == 0:
        return {m: _never() for m in METHODS}
    low, high = s.fence(t.iqr)
    skewed = s.skewness is not None and abs(s.skewness) > t.skewness
    if not skewed:
        tail = _never()
    elif s.skewness > 0:
        tail = x > F.lit(s.mean + 2 * s.std)
    else:
        tail = x < F.lit(s.mean - 2 * s.std)
    heavy = s.kurtosis is not None and s.kurtosis > t.kurtosis
    return {
        IQR: (x < F.lit(low)) | (x > F.lit(high)),
        HAMPEL: _far(x, s, 0.6745, t.hampel),
        PERCENTILE: (x < F.lit(s.p5)) | (x > F.lit(s.p95)),
        SKEWNESS: tail,
        KURTOSIS: _far(x, s, 1.0, 3.5) if heavy else _never(),
    }


def _facts(s: NumericStats, t: Thresholds, method: str) -> tuple:
    """Threshold, bounds and direction shown with a rule."""
    if method == IQR:
        return (t.iqr, *(s.fence(t.iqr) or (None, None)), None)
    if method == HAMPEL:
        return (t.hampel, None, None, None)
    if method == PERCENTILE:
        return (None, s.p5, s.p95, None)
    if method == SKEWNESS:
        return (t.skewness, None, None, "right" if (s.skewness or 0) > 0 else "left")
    return (t.kurtosis, None, None, None)


def outlier_report(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    thresholds: Thresholds = Thresholds(),
    exact: bool = True,
    stats: Mapping[str, NumericStats] | None = None,
) -> DataFrame:
    """Flagged cells per column and rule, with threshold, bounds, direction and percent of rows.

    The number of passes does not depend on the number of columns or rules.
    """
    stats = stats or fit_numeric(df, columns, mad=True, exact=exact)
    schema = (
        "struct<column:string,method:string,threshold:double,lower:double,upper:double,"
        "direction:string,n:bigint,pct:double>"
    )
    if not stats:
        return df.sparkSession.createDataFrame([], schema[7:-1].replace(":", " "))
    rows, counts = [], [F.count("*").alias("rows")]
    for s in stats.values():
        for method, flag in rule_flags(df, s, thresholds).items():
            name = f"n{len(rows)}"
            counts.append(F.count_if(flag).alias(name))
            facts = [F.lit(v) for v in (s.column, method, *_facts(s, thresholds, method))]
            pct = F.coalesce(F.try_divide(F.col(name), F.col("rows")) * 100, F.lit(0.0))
            rows.append(F.struct(*facts, F.col(name), pct).cast(schema))
    return df.agg(*counts).select(unpivot_rows(rows))


def shifted_reports(
    df: DataFrame, steps: Sequence[float], columns: Sequence[str] | None = None, exact: bool = True
) -> DataFrame:
    """The outlier report at several shifts of the thresholds, fitted once."""
    stats = fit_numeric(df, columns, mad=True, exact=exact)
    parts = [
        outlier_report(df, thresholds=Thresholds().shift(k), stats=stats).withColumn(
            "steps", F.lit(float(k))
        )
        for k in steps
    ]
    return reduce(DataFrame.unionByName, parts)


def rank_methods(report: DataFrame) -> DataFrame:
    """Rules per column, most flagged cells first; one row ``none`` where nothing is flagged."""
    place = F.lit(len(METHODS))
    for i, m in enumerate(METHODS):
        place = F.when(F.col("method") == m, i).otherwise(place)
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), place)
    ranked = report.withColumn("rank", F.row_number().over(order))
    empty = F.col("n") == 0
    return ranked.where(~empty | (F.col("rank") == 1)).select(
        "column",
        F.when(empty, "none").otherwise(F.col("method")).alias("method"),
        "n",
        "pct",
        F.when(~empty, F.col("threshold")).alias("threshold"),
        F.when(~empty, F.col("direction")).alias("direction"),
        "rank",
    )


def has_iqr_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, factor: float = 1.5, exact: bool = True
) -> DataFrame:
    """Whether some cell lies outside the fence of its own column."""
    columns = numeric_columns(df, columns)
    found, _ = exact_quantiles(df, columns, [0.25, 0.75], exact=exact)
    flag = _never()
    for c in columns:
        q1, q3 = found[c]
        if q1 is not None:
            x, reach = as_double(df, c), factor * (q3 - q1)
            outside = F.bool_or((x < F.lit(q1 - reach)) | (x > F.lit(q3 + reach)))
            flag = flag | F.coalesce(outside, F.lit(False))
    return df.agg(F.count("*").alias("n"), flag.alias("has_outliers")).select("has_outliers")


def remove_iqr(
    df: DataFrame, columns: Sequence[str] | None = None, factor: float = 1.5, exact: bool = True
) -> DataFrame:
    """Column after column, keep the rows inside the fence of the rows that are left.

    Bounds become literals, so each next fit and the final scan push them down to the files.  Rows
    whose cell is missing go.
    """
    kept = df
    for c in numeric_columns(df, columns):
        found, _ = exact_quantiles(kept, [c], [0.25, 0.75], exact=exact)
        q1, q3 = found[c]
        if q1 is None:
            return kept.where(F.lit(False))
        reach = factor * (q3 - q1)
        # NaN is above every number, so the bare column can be compared, and that filter is pushed down
        kept = kept.where((ref(c) >= F.lit(q1 - reach)) & (ref(c) <= F.lit(q3 + reach)))
    return kept


def remove_zscore(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 3.0) -> DataFrame:
    """Keep rows less than ``limit`` population deviations from the mean in all columns.

    Missing cells and constant columns flag nothing.
    """
    columns = numeric_columns(df, columns)
    if not columns:
        return df
    row = df.agg(
        *[F.avg(as_double(df, c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(as_double(df, c)).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    tests = []
    for i, c in enumerate(columns):
        mean, std = row[f"m{i}"], row[f"s{i}"]
        if std:
            z = (as_double(df, c) - F.lit(mean)) / F.lit(std)
            tests.append(F.coalesce(F.abs(z) < F.lit(limit), F.lit(True)))
    return df.where(reduce(and_, tests)) if tests else df


def remove_flagged(
    df: DataFrame,
    method: str,
    columns: Sequence[str] | None = None,
    thresholds: Thresholds = Thresholds(),
    exact: bool = True,
) -> DataFrame:
    """Remove the rows that one of the report's rules flags in some column."""
    if method not in METHODS:
        raise ValueError(f"unknown rule: {method}; known are {METHODS}")
    stats = fit_numeric(df, columns, mad=method in (HAMPEL, KURTOSIS), exact=exact)
    tests = [
        ~F.coalesce(rule_flags(df, s, thresholds)[method], F.lit(False)) for s in stats.values()
    ]
    return df.where(reduce(and_, tests)) if tests else df


def skew_score(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean absolute population skewness over the columns, rows; infinity for an empty table.

    A constant column counts as not skewed.
    """
    columns = numeric_columns(df, columns)
    parts = [
        F.coalesce(
            F.when(F.min(as_double(df, c)) < F.max(as_double(df, c)), F.abs(F.skewness(as_double(df, c)))),
            F.lit(0.0),
        )
        for c in columns
    ]
    mean = sum(parts, F.lit(0.0)) / F.lit(float(max(1, len(parts))))
    return df.agg(
        F.when(F.count("*") == 0, F.lit(float("inf"))).otherwise(mean).alias("skew_score"),
        F.count("*").alias("n_rows"),
    )


# The candidates of the automatic choice, in order.
CANDIDATES = ("IQR", "Z-Score", "IsolationForest", "LOF")


def _candidate(df, name, columns, factor, contamination, exact) -> DataFrame:
    if name == "IQR":
        return remove_iqr(df, columns, factor, exact)
    if name == "Z-Score":
        return remove_zscore(df, columns)
    if name == "IsolationForest":
        from .forest import remove_isolated

        return remove_isolated(df, columns, contamination)
    from .lof import remove_lof

    return remove_lof(df, columns, contamination)


def compare_removals(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    factor: float = 1.5,
    contamination: float = 0.05,
    methods: Sequence[str] = CANDIDATES,
    exact: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Try the removals and keep the one that leaves the least skew, the earlier one on ties.

    Returns the kept table and a log with one row per method.
    """
    unknown = [m for m in methods if m not in CANDIDATES]
    if unknown:
        raise ValueError(f"unknown methods {unknown}; known are {CANDIDATES}")
    log, best = [], None
    for name in methods:
        kept = _candidate(df, name, columns, factor, contamination, exact)
        row = skew_score(kept, columns).first()
        log.append((name, row["skew_score"], row["n_rows"]))
        if row["skew_score"] < float("inf") and (best is None or row["skew_score"] < best[1]):
            best = (name, row["skew_score"], kept)
    chosen = best[0] if best else None
    rows = [(m, score, n, m == chosen) for m, score, n in log]
    schema = "method string, skew_score double, rows_kept bigint, chosen boolean"
    return best[2] if best else df.where(F.lit(False)), df.sparkSession.createDataFrame(rows, schema)


def remove_outliers(
    df: DataFrame,
    method: str = "iqr",
    columns: Sequence[str] | None = None,
    factor: float = 1.5,
    contamination: float = 0.05,
    thresholds: Thresholds = Thresholds(),
    exact: bool = True,
) -> DataFrame:
    """Remove outliers by iqr, zscore, isolation_forest, lof, auto or a rule of the report."""
    name = method.lower()
    if name == "auto":
        return compare_removals(df, columns, factor, contamination, exact=exact)[0]
    simple = {"iqr": "IQR", "zscore": "Z-Score", "isolation_forest": "IsolationForest", "lof": "LOF"}
    if name in simple:
        return _candidate(df, simple[name], columns, factor, contamination, exact)
    rules = {"hampel": HAMPEL, "percentile": PERCENTILE, "skewness": SKEWNESS, "kurtosis": KURTOSIS}
    if name in rules:
        return remove_flagged(df, rules[name], columns, thresholds, exact)
    raise ValueError(f"method '{method}' is not supported")


def box_plot(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Quartiles, whiskers at the last cells inside the fence, and cells beyond it."""
    columns = numeric_columns(df, columns)
    found, _ = exact_quantiles(df, columns, [0.25, 0.5, 0.75], exact=exact)
    totals, rows = [], []
    for i, c in enumerate(columns):
        q1, q2, q3 = found[c]
        if q1 is None:
            continue
        x, reach = as_double(df, c), 1.5 * (q3 - q1)
        inside = x.between(F.lit(q1 - reach), F.lit(q3 + reach))
        totals += [
            F.min(F.when(inside, x)).alias(f"l{i}"),
            F.max(F.when(inside, x)).alias(f"h{i}"),
            F.count_if(~inside).alias(f"n{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(q1).alias("q1"),
                F.lit(q2).alias("median"),
                F.lit(q3).alias("q3"),
                F.col(f"l{i}").alias("whisker_low"),
                F.col(f"h{i}").alias("whisker_high"),
                F.col(f"n{i}").alias("outliers"),
            )
        )
    return df.agg(*totals).select(unpivot_rows(rows))
