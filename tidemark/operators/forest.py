"""Isolation forest (Liu, Ting, Zhou 2008).

Each tree needs only 256 rows, so the sample is bounded whatever the table size.  Which rows are
drawn, and the column and cut of a node, come from hashes of the rows and of the node's place.  So the forest depends on the rows alone,
not on files or partitions.  Copies count: a row with n copies is drawn n times as often.  Trees are built in
parallel; the nodes are broadcast as arrays and score batches of rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_double, numeric_columns, ref
from ..functions.quantiles import exact_quantiles
from ..functions.storage import settle

TREES = 100
SAMPLE = 256
NODES = "tree int, node int, axis int, cut double, left int, right int, path double"


def mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def chance(*parts: object) -> float:
    """A number from 0 to 1 by the hash of some values."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 16.0**13


def _isolate(points: np.ndarray, tree: int, seed: int) -> list[tuple]:
    """Nodes of one tree; ``path`` is the expected depth at a leaf.  A node's way (1, then L and R) names its draws."""
    deepest = math.ceil(math.log2(max(2, len(points))))
    nodes: list[list] = []
    todo = [(points, "1", -1, 0)]
    while todo:
        part, way, parent, side = todo.pop()
        at, depth = len(nodes), len(way) - 1
        if parent >= 0:
            nodes[parent][4 + side] = at
        low, high = part.min(axis=0), part.max(axis=0)
        wide = np.flatnonzero(high > low)
        if depth >= deepest or len(part) <= 1 or not len(wide):
            nodes.append([tree, at, -1, 0.0, -1, -1, depth + mean_path(len(part))])
            continue
        axis = int(wide[int(chance(seed, tree, way, "axis") * len(wide))])
        cut = float(low[axis] + chance(seed, tree, way, "cut") * (high[axis] - low[axis]))
        nodes.append([tree, at, axis, cut, -1, -1, 0.0])
        goes_left = part[:, axis] <= cut
        todo += [(part[~goes_left], way + "R", at, 1), (part[goes_left], way + "L", at, 0)]
    return [tuple(n) for n in nodes]


def _paths(points: np.ndarray, trees: list[dict[str, np.ndarray]]) -> np.ndarray:
    """Mean path length of each row over all trees."""
    total = np.zeros(len(points))
    for t in trees:
        node = np.zeros(len(points), dtype=np.int64)
        active = np.flatnonzero(t["axis"][node] >= 0)
        while len(active):
            at = node[active]
            left = points[active, t["axis"][at]] <= t["cut"][at]
            node[active] = np.where(left, t["left"][at], t["right"][at])
            active = active[t["axis"][node[active]] >= 0]
        total += t["path"][node]
    return total / len(trees)


def fit_forest(
    df: DataFrame, columns: Sequence[str] | None = None, seed: int = 42, trees: int = TREES, sample: int = SAMPLE
) -> tuple[list[dict[str, np.ndarray]], float]:
    """Trees as node arrays, and the path length that scores are scaled with."""
    columns = numeric_columns(df, columns)
    xs = [f"x{i}" for i in range(len(columns))]
    rows = df.select(*[as_double(df, c).alias(x) for c, x in zip(columns, xs)]).na.drop()
    spark = df.sparkSession
    counted = settle(rows.groupBy(*xs).agg(F.count("*").alias("n")), "rows")
    total = counted.agg(F.sum("n")).first()[0] or 0
    if total == 0:
        return [], 0.0
    pool = _draw(counted, xs, seed, 3.0 * trees * sample / total)
    size = min(sample, len(pool))
    shared = spark.sparkContext.broadcast(pool)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        names = [part.split()[0] for part in NODES.split(", ")]
        for batch in batches:
            for tree in batch["id"]:
                # the drawn rows are in the order of their values, so that this draw depends on them alone
                mine = np.random.default_rng([seed, int(tree)]).choice(len(known), size, replace=False)
                yield pd.DataFrame(_isolate(known[mine], int(tree), seed), columns=names)

    nodes = spark.range(trees).repartition(min(trees, 64)).mapInPandas(build, NODES).toPandas()
    grown = []
    for _, part in nodes.groupby("tree"):
        part = part.sort_values("node")
        grown.append({c: part[c].to_numpy() for c in ("axis", "cut", "left", "right", "path")})
    return grown, mean_path(size)


def _draw(counted: DataFrame, xs: list[str], seed: int, share: float) -> np.ndarray:
    """About the given share of all rows (all, from 1 on), in the order of their values; a bounded number.

    The copies of a row that are drawn are a binomial number, whose draw is seeded by the row's hash.
    """
    if share < 1:
        code = F.xxhash64(F.lit(seed), *xs).alias("h")

        def copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                first = batch["h"].to_numpy().view(np.uint64) >> np.uint64(11)
                # a single row needs no generator of its own
                drawn = (first / 2.0**53 < share).astype(np.int64)
                n = batch["n"].to_numpy()
                for i in np.flatnonzero(n > 1):
                    drawn[i] = np.random.default_rng([seed, int(first[i])]).binomial(n[i], share)
                yield batch.assign(n=drawn)[drawn > 0].drop(columns="h")

        schema = ", ".join([*(f"{x} double" for x in xs), "n bigint"])
        counted = counted.select(*xs, "n", code).mapInPandas(copies, schema)
    drawn = counted.toPandas()  # about three rows for each that the trees take
    rows = np.repeat(drawn[xs].to_numpy(dtype=float), drawn["n"].to_numpy(), axis=0)
    return rows[np.lexsort(rows.T[::-1])]


def forest_scores(df: DataFrame, columns: Sequence[str] | None = None, seed: int = 42, trees: int = TREES) -> DataFrame:
    """The table with ``isolation``: minus the anomaly score, lower is more isolated; NULL if cells are missing."""
    columns = numeric_columns(df, columns)
    grown, scale = fit_forest(df, columns, seed, trees)
    if not grown:
        return df.withColumn("isolation", F.lit(None).cast("double"))
    shared = df.sparkSession.sparkContext.broadcast(grown)

    @F.pandas_udf(T.DoubleType())
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            points = part.to_numpy(dtype=float)
            whole = ~np.isnan(points).any(axis=1)
            result = np.full(len(points), np.nan)
            if whole.any():
                paths = _paths(points[whole], shared.value)
                result[whole] = -(2.0 ** (-paths / scale)) if scale else -1.0
            yield pd.Series(result)

    scored = df.withColumn("isolation", score(F.struct(*[as_double(df, c) for c in columns])))
    return scored.withColumn("isolation", F.when(~F.isnan("isolation"), F.col("isolation")))


def flag_isolated(
    df: DataFrame, columns: Sequence[str] | None = None, contamination: float = 0.05, seed: int = 42
) -> DataFrame:
    """The table with ``isolation`` and ``is_outlier``: the given share of most isolated rows."""
    scored = settle(forest_scores(df, columns, seed), "isolation")
    limit = exact_quantiles(scored, ["isolation"], [contamination])[0]["isolation"][0]
    flag = F.lit(False) if limit is None else F.coalesce(F.col("isolation") < F.lit(limit), F.lit(False))
    return scored.withColumn("is_outlier", flag)


def remove_isolated(
    df: DataFrame, columns: Sequence[str] | None = None, contamination: float = 0.05, seed: int = 42
) -> DataFrame:
    """Remove the flagged rows; rows with missing cells stay."""
    flagged = flag_isolated(df, columns, contamination, seed)
    return flagged.where(~F.col("is_outlier")).select(*[ref(c) for c in df.columns])
