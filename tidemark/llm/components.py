"""Connected components by alternating stars; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, settle

MOST_ROUNDS = 60


def _minimum(pairs: DataFrame) -> DataFrame:
    """For each u the smallest v."""
    return settle(pairs.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m")), "stars")


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of an edge (u, v) but the roots; the root is a component's smallest node."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = settle(e, "edges")
    print_ = None
    for _ in range(MOST_ROUNDS):
        # all neighbours that are larger than a node go to the smallest of its neighbours and itself
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = lookup(both, _minimum(both), F.col("u") == F.col("_u"), "inner")
        large = near.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        large = settle(large, "edges")
        # a node and its smaller neighbours go to the smallest of them
        near = lookup(large, _minimum(large), F.col("u") == F.col("_u"), "inner")
        small = near.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("s"))
        e = settle(small.select("s.u", F.col("s.m").alias("v")).where("u <> v").distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == print_:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        print_ = now
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
