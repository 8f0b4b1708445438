"""Fills that look at several columns at once: nearest neighbours and iterative regression."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.columns import as_double, numeric_columns, ref
from ..functions.lookup import lookup_join
from ..functions.storage import settle
from .neighbors import nearest

MAX_PATTERNS = 4096  # combinations of missing cells that are summed apart; beyond, a regression is an aggregation


def _as_doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: as_double(df, c) for c in columns})


def _column_means(df: DataFrame, columns: Sequence[str]) -> list[float | None]:
    row = df.agg(*[F.avg(ref(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [row[f"m{i}"] for i in range(len(columns))]


def knn_fill(
    df: DataFrame, columns: Sequence[str] | None = None, k: int = 5, leaf_points: int | None = None
) -> DataFrame:
    """Fill each missing number with the mean of its ``k`` nearest rows that have it.

    The distance of two rows is Euclidean over the columns present in both, scaled up by all columns
    over those columns.  Equal distances are ordered by the value that would be taken.  A row
    without any common column gets the column mean.  Only distinct rows are compared, so copies cost
    nothing; the result is exact at any size (see ``neighbors``).
    """
    columns = numeric_columns(df, columns)
    table = _as_doubles(df, columns)
    means = _column_means(table, columns)
    holes = reduce(or_, [ref(c).isNull() for c in columns], F.lit(False))
    names = [f"c{i}" for i in range(len(columns))]
    slim = table.select(*[ref(c).alias(n) for c, n in zip(columns, names)])
    distinct = settle(
        slim.groupBy(*names)
        .agg(F.count("*").cast("bigint").alias("n"))
        .withColumn("id", F.monotonically_increasing_id()),
        "distinct",
    )
    incomplete = distinct.where(reduce(or_, [F.col(n).isNull() for n in names], F.lit(False)))
    row = incomplete.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names]).first()
    if not any(row[n] for n in names):
        return table
    fills = incomplete.select("id", *names)
    targets = [i for i, n in enumerate(names) if row[n] and means[i] is not None]
    if targets and len(names) > 1:
        xs = [F.col(n).alias(f"x{j}") for j, n in enumerate(names)]
        taken = nearest(
            incomplete.select("id", *xs), distinct.select("id", *xs, "n"), len(names), k, leaf_points=leaf_points, targets=targets
        )
        mean_of = (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("near")
        found = taken.groupBy("id", "set").agg(mean_of).groupBy("id").pivot("set", list(range(len(targets)))).agg(F.first("near"))
        found = found.select("id", *[F.col(str(s)).alias(f"near{i}") for s, i in enumerate(targets)])
        fills = fills.join(found, "id", "left")
    else:
        fills = fills.withColumns({f"near{i}": F.lit(None).cast("double") for i in targets})
    for i, target in enumerate(names):
        if row[target]:
            near = F.col(f"near{i}") if i in targets else F.lit(None).cast("double")
            fills = fills.withColumn(f"f{i}", F.coalesce(F.col(target), near, F.lit(means[i]).cast("double")))
    lost = [i for i, n in enumerate(names) if row[n]]
    keys = [f"__k{i}" for i in range(len(names))]
    # distinct rows differ in their values or in which cells are missing, so the keys are unique
    filled = settle(
        fills.select(
            *[F.col(n).alias(key) for n, key in zip(names, keys)],
            *[F.col(f"f{i}").alias(f"__f{i}") for i in lost],
        ),
        "fills",
    )
    whole = table.where(~holes)
    open_rows = table.where(holes).withColumns({key: ref(c) for key, c in zip(keys, columns)})
    joined = lookup_join(open_rows, filled, keys, null_safe=True)
    mended = joined.select(
        *[
            (F.col(f"__f{columns.index(c)}") if c in columns and columns.index(c) in lost else ref(c)).alias(c)
            for c in df.columns
        ]
    )
    return whole.unionByName(mended)


def iterative_fill(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    rounds: int = 10,
    bayesian: bool = True,
) -> DataFrame:
    """Fill by regressing each column on the others in turn, for a number of rounds.

    Every fill is a linear function of the row's present cells that depends only on which cells are
    missing.  One aggregation per such pattern (counts, sums and cross products) is therefore enough
    to run all rounds on small matrices; the table is read once to fit and once to fill.  Columns go
    from fewest to most missing cells; cells start from the column mean.
    """
    columns = numeric_columns(df, columns)
    table = _as_doubles(df, columns)
    p = len(columns)
    if p < 2:
        means = _column_means(table, columns)
        return table.withColumns({c: F.coalesce(ref(c), F.lit(m).cast("double")) for c, m in zip(columns, means)})
    patterns = table.groupBy(*[ref(c).isNull() for c in columns]).agg(F.count("*").alias("n")).limit(MAX_PATTERNS + 1).count()
    if patterns > MAX_PATTERNS or p > 62:
        return _fill_by_rounds(table, columns, rounds, bayesian)
    bits = sum((ref(c).isNull().cast("bigint") * (1 << i) for i, c in enumerate(columns)), F.lit(0).cast("bigint"))
    # sums are taken around the means, which keeps the cross products accurate
    centers = [m if m is not None else 0.0 for m in _column_means(table, columns)]
    x = [F.coalesce(ref(c) - F.lit(m), F.lit(0.0)) for c, m in zip(columns, centers)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(p)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(p) for j in range(i, p)]
    grouped = table.groupBy(bits.alias("gaps")).agg(F.count("*").alias("n"), *sums, *products)
    rows = grouped.collect()  # at most MAX_PATTERNS
    moments = {}
    for r in rows:
        moments[r["gaps"]] = _moment_matrix(r, p)
    maps = _regress(moments, p, rounds, bayesian)
    if not maps:
        return table
    out = {}
    for i, c in enumerate(columns):
        filled = ref(c)
        cases = [(g, a[i + 1]) for g, a in maps.items() if g >> i & 1]
        if not cases:
            continue
        guess = F.lit(None).cast("double")
        for gaps, weights in cases:
            terms = [F.lit(float(weights[0] + centers[i]))]
            terms += [F.lit(float(weights[j + 1])) * x[j] for j in range(p) if weights[j + 1] != 0]
            guess = F.when(bits == gaps, sum(terms[1:], terms[0])).otherwise(guess)
        out[c] = F.coalesce(filled, guess)
    return table.withColumns(out)


def _fill_by_rounds(table: DataFrame, columns: Sequence[str], rounds: int, bayesian: bool) -> DataFrame:
    """The same fill for tables with many combinations of missing cells: one aggregation per regression.

    The current values are written after each round, which keeps plans short.
    """
    p = len(columns)
    centers = [m if m is not None else 0.0 for m in _column_means(table, columns)]
    names, lost = [f"__x{i}" for i in range(p)], [f"__lost{i}" for i in range(p)]
    row = table.agg(*[F.count_if(ref(c).isNull()).alias(n) for c, n in zip(columns, lost)], F.count("*").alias("all")).first()
    order = sorted((i for i in range(p) if row[lost[i]]), key=lambda i: row[lost[i]])
    now = table.withColumns(
        {n: F.coalesce(ref(c) - F.lit(m), F.lit(0.0)) for n, c, m in zip(names, columns, centers)}
        | {n: ref(c).isNull() for n, c in zip(lost, columns)}
    )
    sums = [F.sum(n).alias(f"s{i}") for i, n in enumerate(names)]
    products = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i in range(p) for j in range(i, p)]
    for _ in range(rounds if order else 0):
        now = settle(now, "round")
        for i in order:
            if row[lost[i]] == row["all"]:
                continue
            known = now.where(~F.col(lost[i])).agg(F.count("*").alias("n"), *sums, *products).first()
            weights = _fit_line(_moment_matrix(known, p), i + 1, [j + 1 for j in range(p) if j != i], bayesian)
            terms = [F.lit(float(weights[0]))] + [F.lit(float(weights[j + 1])) * F.col(names[j]) for j in range(p) if weights[j + 1] != 0]
            now = now.withColumn(names[i], F.when(F.col(lost[i]), sum(terms[1:], terms[0])).otherwise(F.col(names[i])))
    filled = {c: F.coalesce(ref(c), F.col(n) + F.lit(m)) for c, n, m in zip(columns, names, centers)}
    return now.withColumns(filled).drop(*names, *lost)


def _moment_matrix(row: Row, p: int) -> np.ndarray:
    """Counts, sums and products as a symmetric matrix over [1, columns]."""
    m = np.zeros((p + 1, p + 1))
    m[0, 0] = row["n"]
    for i in range(p):
        m[0, i + 1] = m[i + 1, 0] = row[f"s{i}"]
        for j in range(i, p):
            m[i + 1, j + 1] = m[j + 1, i + 1] = row[f"p{i}_{j}"]
    return m


def _regress(moments: dict[int, np.ndarray], p: int, rounds: int, bayesian: bool) -> dict[int, np.ndarray]:
    """Affine map per pattern from [1, present cells (0 where missing)] to the filled row."""
    maps = {g: np.eye(p + 1) for g in moments}
    missing = [sum(m[0, 0] for g, m in moments.items() if g >> i & 1) for i in range(p)]
    order = sorted((i for i in range(p) if missing[i]), key=lambda i: missing[i])
    for _ in range(rounds):
        for i in order:
            whole = [g for g in moments if not g >> i & 1]
            if not whole:
                continue
            known = sum(maps[g] @ moments[g] @ maps[g].T for g in whole)
            others = [j + 1 for j in range(p) if j != i]
            weights = _fit_line(known, i + 1, others, bayesian)
            for g in maps:
                if g >> i & 1:
                    maps[g][i + 1] = weights @ maps[g]
    return {g: a for g, a in maps.items() if g}


def _fit_line(m: np.ndarray, y: int, xs: list[int], bayesian: bool) -> np.ndarray:
    """Regression weights over [1, all columns] from the sums and products in ``m``."""
    n = m[0, 0]
    mean_x, mean_y = m[0, xs] / n, m[0, y] / n
    gram = m[np.ix_(xs, xs)] - n * np.outer(mean_x, mean_x)
    cross = m[xs, y] - n * mean_x * mean_y
    square = max(m[y, y] - n * mean_y * mean_y, 0.0)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    values = np.clip(values, 0.0, None)
    turned = vectors.T @ cross
    if bayesian:
        slope = _evidence(values, vectors, turned, gram, cross, square, n)
    else:
        usable = values > values.max() * 1e-12
        slope = vectors @ np.where(usable, turned / np.where(usable, values, 1.0), 0.0)
    weights = np.zeros(len(m))
    weights[xs] = slope
    weights[0] = mean_y - slope @ mean_x
    return weights


def _evidence(values, vectors, turned, gram, cross, square, n) -> np.ndarray:
    """Ridge regression whose penalty follows from the data (evidence maximisation)."""
    prior = 1e-6
    noise = 1.0 / (square / n + np.finfo(float).eps)
    decay = 1.0
    slope = np.zeros(len(values))
    for _ in range(300):
        before = slope
        slope = vectors @ (turned / (values + decay / noise))
        rest = max(square - 2 * slope @ cross + slope @ gram @ slope, 0.0)
        used = np.sum(noise * values / (decay + noise * values))
        decay = (used + 2 * prior) / (slope @ slope + 2 * prior)
        noise = (n - used + 2 * prior) / (rest + 2 * prior)
        if np.abs(before - slope).sum() < 1e-3 * max(1e-12, np.abs(slope).sum()):
            break
    return vectors @ (turned / (values + decay / noise))
