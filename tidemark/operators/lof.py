"""Local outlier factor over distinct rows, exact at any size."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_double, numeric_columns, ref
from ..functions.lookup import lookup_join
from ..functions.quantiles import exact_quantiles
from ..functions.storage import release, settle
from .duplicates import dense_row_id
from .neighbors import BLOCK_POINTS, nearest_others

EPSILON = 1e-10


def _density(distances: np.ndarray, values: np.ndarray, n: np.ndarray, row: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of each row, by the radius of its neighbours: the inverse of the mean reachable distance."""
    reached = np.bincount(row, np.fmax(distances, values) * n, len(own))
    return 1.0 / (reached / np.bincount(row, n, len(own)) + EPSILON)


def _factor(distances: np.ndarray, values: np.ndarray, n: np.ndarray, row: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of each row: the mean density of its neighbours over its own."""
    return np.bincount(row, values * n, len(own)) / np.bincount(row, n, len(own)) / own


def _from_neighbours(near: DataFrame, values: DataFrame, formula: Callable[..., np.ndarray]) -> DataFrame:
    """``node``, ``id`` and a new ``value`` of each point, from the ``value`` of its neighbours and its own.

    The values of a block's own points are met by block; only those of points that other blocks hold are
    looked up, once for each block that needs them.
    """
    away = near.select(F.col("node").alias("block"), F.explode("foreign").alias("point")).distinct()
    here = values.select(F.col("node").alias("block"), F.col("id").alias("point"), "value")
    known = here.unionByName(away.join(here.drop("block"), "point"))

    def compute(near: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("point")
        points, values = known["point"].to_numpy(), known["value"].to_numpy()
        lists = [near[c].combine_chunks() for c in ("points", "distances", "counts")]
        row = np.repeat(np.arange(len(near)), lists[0].value_lengths().to_numpy())
        others, distances, n = (a.flatten().to_numpy() for a in lists)
        own = values[np.searchsorted(points, near["id"].to_numpy())]
        with np.errstate(divide="ignore", invalid="ignore"):
            out = formula(distances, values[np.searchsorted(points, others)], n, row, own)
        some = np.bincount(row, minlength=len(near)) > 0  # values that are not finite have no neighbours
        return pa.table([near["node"], near["id"], pa.array(out, mask=~some)], names=["node", "id", "value"])

    lists = near.select("node", "id", "points", "distances", "counts").groupBy("node")
    return lists.cogroup(known.groupBy("block")).applyInArrow(compute, "node bigint, id bigint, value double")


def lof_scores(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    neighbors: int = 20,
    leaf_points: int = BLOCK_POINTS,
) -> DataFrame:
    """The table with ``lof``: density of the neighbours over the own density.

    A row has exactly ``neighbors`` neighbours; equal distances are ordered by the columns.  Copies of
    a row are neighbours of each other and share one score.  Rows with missing cells get NULL.
    """
    columns = numeric_columns(df, columns)
    xs = [f"x{i}" for i in range(len(columns))]
    rows = df.select(*[as_double(df, c).alias(x) for c, x in zip(columns, xs)])
    distinct = rows.na.drop().groupBy(*xs).agg(F.count("*").cast("bigint").alias("n"))
    points = dense_row_id(distinct, xs, "id")
    total = points.agg(F.sum("n")).first()[0] or 0
    k = min(neighbors, total - 1)
    if k < 1:
        return df.withColumn("lof", F.lit(None).cast("double"))
    points = settle(points, "points")
    near = nearest_others(points, len(xs), k, leaf_points)
    radius = near.select("node", "id", F.array_max("distances").alias("value"))
    density = settle(_from_neighbours(near, radius, _density), "density")
    score = _from_neighbours(near, density, _factor)
    scores = points.join(score, "id").select(*[F.col(x).alias(f"__k{i}") for i, x in enumerate(xs)], F.col("value").alias("lof"))
    keys = [f"__k{i}" for i in range(len(xs))]
    keyed = df.withColumns({key: as_double(df, c) for key, c in zip(keys, columns)})
    scores = settle(scores, "scores")
    release(near, density)
    return lookup_join(keyed, scores, keys).select(*[ref(c) for c in df.columns], "lof")


def flag_lof(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    contamination: float = 0.05,
    neighbors: int = 20,
    leaf_points: int = BLOCK_POINTS,
) -> DataFrame:
    """The table with ``lof`` and ``is_outlier``: the given share of rows with the highest factor."""
    scored = settle(lof_scores(df, columns, neighbors, leaf_points), "lof")
    signed = scored.select((-F.col("lof")).alias("s"))
    limit = exact_quantiles(signed, ["s"], [contamination])[0]["s"][0]
    flag = F.lit(False) if limit is None else F.coalesce(-F.col("lof") < F.lit(limit), F.lit(False))
    return scored.withColumn("is_outlier", flag)


def remove_lof(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    contamination: float = 0.05,
    neighbors: int = 20,
    leaf_points: int = BLOCK_POINTS,
) -> DataFrame:
    """Remove the flagged rows; rows with missing cells stay."""
    flagged = flag_lof(df, columns, contamination, neighbors, leaf_points)
    return flagged.where(~F.col("is_outlier")).drop("lof", "is_outlier")

