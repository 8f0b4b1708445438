"""Boosted trees, the search for a classifier, and importances, on planted targets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting, features


def accuracy(model, df, target="y"):
    return model.predict(df).agg(F.avg((F.col("prediction") == F.col(target).cast("string")).cast("double"))).first()[0]


def planted(spark, rows=3000, seed=1):
    """Three classes by an interaction of a and b; c is noise, some cells are missing."""
    rng = np.random.default_rng(seed)
    a, b, c = rng.random(rows), rng.random(rows), rng.random(rows)
    y = np.where(a < 0.3, "low", np.where(b > 0.5, "mid", "high"))
    cell = lambda v: None if rng.random() < 0.02 else float(v)
    return spark.createDataFrame([(i, cell(a[i]), cell(b[i]), float(c[i]), str(y[i])) for i in range(rows)], "id long, a double, b double, c double, y string")


def test_boosting_recovers_an_interaction(spark):
    df = planted(spark)
    train, test = features.split_by_key(df, ["id"])
    model = features.fit_target(train, "y", ["id"], names=["boosted"])
    assert accuracy(model, test) > 0.93
    weight = {r["feature"]: r["importance"] for r in model.importances(spark).collect()}
    assert weight["a"] > 0.3 and weight["b"] > 0.3 and weight["c"] < 0.02 and abs(sum(weight.values()) - 1) < 1e-9


def test_scores_equal_those_of_whole_arrays(spark):
    """The first tree's cuts and leaves, from one process and from many tasks."""
    rng = np.random.default_rng(3)
    x, y = rng.random((400, 3)), rng.integers(0, 2, 400)
    y[x[:, 1] > 0.6] = 1
    df = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, y)], "a double, b double, c double, y int").repartition(7)
    model = boosting.fit_boosted(df, "y", 2, ["a", "b", "c"], rounds=1, depth=1, rate=1.0)
    bins, share = model.bins(x), np.bincount(y, minlength=2) + 0.5
    chance = share / share.sum()
    slope = np.eye(2)[y] - chance
    best = max(
        ((sum((s := slope[m].sum(axis=0)) @ s / (m.sum() + 1) for m in (left, ~left)) - slope.sum(axis=0) @ slope.sum(axis=0) / 401), j, b)
        for j in range(3) for b in range(32) for left in [bins[:, j] <= b] if min(left.sum(), (~left).sum()) >= boosting.LEAST_LEAF
    )
    (feature, last), tree = model.trees[0].cuts[0], model.trees[0]
    assert (feature[0], last[0]) == best[1:] == (1, last[0])
    left = bins[:, 1] <= last[0]
    for node, mine in ((0, left), (1, ~left)):
        want = slope[mine].sum(axis=0) / (mine.sum() * chance * (1 - chance) + 0.5)
        np.testing.assert_allclose(tree.values[node], np.clip(want, -4, 4), rtol=1e-9)


def test_more_than_a_thousand_labels(spark):
    """1,200 labels by two columns: far better than chance (1 in 1,200)."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 40, 6000), rng.integers(0, 30, 6000)
    df = spark.createDataFrame([(i, int(p), int(q), f"k{p * 30 + q}") for i, (p, q) in enumerate(zip(a, b))], "id long, a int, b int, y string")
    model = features.fit_target(df, "y", ["id"], budget=0.0)
    assert {t.name for t in model.trials} == {"boosted", "boosted_deep"}
    assert model.labels.count() > 1100 and accuracy(model, df) > 0.05


def test_halving_keeps_to_rungs_and_budget(spark, monkeypatch):
    monkeypatch.setattr(features, "FIRST_ROWS", 200)
    df = planted(spark, 1500)
    whole = features.fit_target(df, "y", ["id"], budget=600.0)
    sizes = [t.rows for t in whole.trials]
    assert sizes[:5] == [200] * 5 and sizes == sorted(sizes) and sizes.count(sizes[-1]) == 1
    assert whole.name == whole.trials[-1].name and accuracy(whole, df) > 0.9
    short = features.fit_target(df, "y", ["id"], budget=0.0)
    assert len(short.trials) == 5 and short.name in {t.name for t in short.trials}
    assert max(t.accuracy for t in short.trials) == next(t.accuracy for t in short.trials if t.name == short.name)


def test_missing_and_empty_columns(spark):
    df = planted(spark, 600).withColumn("none", F.lit(None).cast("double"))
    df = df.withColumn("y", F.when(F.col("id") % 50 != 0, F.col("y")))  # rows without a target take no part
    model = features.fit_target(df, "y", ["id"], names=["decision_tree", "boosted"])
    assert "none" not in model.features and model.predict(df).where("prediction is null").count() == 0


def test_a_key_is_no_target(spark, monkeypatch):
    monkeypatch.setattr("tidemark.functions.lookup.BROADCAST_ROWS", 100)
    with pytest.raises(ValueError, match="as many values as a key"):
        features.fit_target(spark.range(500).selectExpr("id", "id * 2 as y", "id % 7 as x"), "y", ["id"])
