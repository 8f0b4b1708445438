import numpy as np
import pytest
from helpers import rows

from tidemark.operators import missing as m
from tidemark.operators.imputers import iterative_fill, knn_fill


def sample(spark):
    data = [
        (1, 1.0, "a", None), (2, float("nan"), "b", None), (3, None, None, None), (4, 4.0, "b", None),
        (5, 10.0, "a", None),
    ]
    return spark.createDataFrame(data, "k int, x double, s string, empty string")


def test_report(spark):
    assert rows(m.missing_report(sample(spark)), "column") == [
        ("empty", "string", 5, 100.0, "mode"), ("s", "string", 1, 20.0, "mode"), ("x", "double", 2, 40.0, "mean"),
    ]
    assert rows(m.missing_cells(sample(spark))) == [(8, 0.4)]
    assert m.any_missing(sample(spark)).first()[0] is True
    assert m.any_missing(sample(spark).select("k")).first()[0] is False


def test_mean_median_and_mode_of_ties(spark):
    df = m.fill_missing(sample(spark), "mean", "mode")
    assert rows(df.select("x", "s", "empty"), "x")[0] == (1.0, "a", None)
    assert [r["x"] for r in df.orderBy("k").collect()] == [1.0, 5.0, 5.0, 4.0, 10.0]
    assert [r["s"] for r in df.orderBy("k").collect()] == ["a", "b", "a", "b", "a"]
    df = m.fill_missing(sample(spark), "median", "constant", {"s": "zz"})
    assert [r["x"] for r in df.orderBy("k").collect()] == [1.0, 4.0, 4.0, 4.0, 10.0]
    assert [(r["s"], r["empty"]) for r in df.where("k = 3").collect()] == [("zz", "Unknown")]


def test_constant_needs_a_number(spark):
    with pytest.raises(ValueError, match="fill value for the columns"):
        m.fill_missing(sample(spark), "constant")
    with pytest.raises(ValueError, match="not a number"):
        m.fill_missing(sample(spark), "constant", fill_value={"x": "many"})
    df = m.fill_missing(sample(spark), "constant", fill_value={"x": "7"})
    assert [r["x"] for r in df.orderBy("k").collect()] == [1.0, 7.0, 7.0, 4.0, 10.0]


def test_unknown_strategies(spark):
    with pytest.raises(ValueError, match="unknown numeric strategy"):
        m.fill_missing(sample(spark), "best")
    with pytest.raises(ValueError, match="unknown strategy for column"):
        m.process_missing(sample(spark), {"numeric": "best", "categorical": "mode"})


def test_strategy_map(spark):
    df = m.process_missing(sample(spark).drop("empty"), {"x": "drop", "categorical": "constant"})
    assert rows(df, "k") == [(1, 1.0, "a"), (4, 4.0, "b"), (5, 10.0, "a")]
    df = m.process_missing(sample(spark), {"numeric": "constant", "categorical": "constant"})
    assert [tuple(r) for r in df.where("k = 3").collect()] == [(3, 0.0, "UNKNOWN", "UNKNOWN")]
    assert rows(m.verify_fill(sample(spark), df)) == [(5, 8, 3, 0)]


def test_present_cells_never_change(spark):
    before = {r["k"]: r for r in sample(spark).na.drop(subset=["x"]).collect()}
    for how in ("mean", "median", "knn", "iterative"):
        after = m.fill_missing(sample(spark), how)
        assert after.where("x is null or isnan(x)").count() == 0
        assert all(before[r["k"]]["x"] == r["x"] for r in after.collect() if r["k"] in before and before[r["k"]]["x"] == before[r["k"]]["x"])


def brute_knn(x, k):
    out = x.copy()
    n, p = x.shape
    means = np.nanmean(x, axis=0)
    for i, j in zip(*np.nonzero(np.isnan(x))):
        found = []
        for o in range(n):
            both = ~np.isnan(x[i]) & ~np.isnan(x[o])
            if o != i and not np.isnan(x[o, j]) and both.any():
                d = np.sqrt(sum((x[i, c] - x[o, c]) ** 2 for c in np.flatnonzero(both)) * (p / both.sum()))
                found.append((d, x[o, j]))
        found.sort()
        out[i, j] = np.mean([v for _, v in found[:k]]) if found else means[j]
    return out


@pytest.mark.parametrize("leaf_points", [4, 1024])
def test_knn_equals_brute_force(spark, leaf_points):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(160, 3)) * [1, 5, 2], 2)
    x[rng.random(x.shape) < 0.15] = np.nan
    x[:50] = x[0]  # a third of the rows are copies
    x[0:50, 1] = 0.5
    x[155:] = np.nan  # no common column at all
    data = [(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(data, "i int, a double, b double, c double").repartition(3)
    got = knn_fill(df, ["a", "b", "c"], k=5, leaf_points=leaf_points).orderBy("i").toPandas()
    np.testing.assert_allclose(got[["a", "b", "c"]].to_numpy(), brute_knn(x, 5), rtol=1e-9)


def test_iterative_recovers_a_line(spark):
    data = [(float(i), None if i % 4 == 0 else 2.0 * i + 1) for i in range(100)]
    got = iterative_fill(spark.createDataFrame(data, "x double, y double")).collect()
    assert max(abs(r["y"] - 2 * r["x"] - 1) for r in got) < 1e-3


def test_iterative_three_columns(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=400), rng.normal(size=400)
    full = np.column_stack([a, b, 3 * a - 2 * b + 1])
    holed = full.copy()
    holed[rng.random(full.shape) < 0.1] = np.nan
    holed[np.isnan(holed).sum(axis=1) > 1] = full[np.isnan(holed).sum(axis=1) > 1]
    data = [(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(holed)]
    df = spark.createDataFrame(data, "i int, a double, b double, c double")
    got = iterative_fill(df, ["a", "b", "c"]).orderBy("i").toPandas()[["a", "b", "c"]].to_numpy()
    assert np.abs(got - full).max() < 0.05


def test_iterative_ways_agree(spark, monkeypatch):
    import random

    from tidemark.operators import imputers

    rng = random.Random(9)
    cell = lambda: None if rng.random() < 0.3 else rng.gauss(0, 1)
    data = [(i, *(cell() for _ in range(4)), None) for i in range(80)]
    df = spark.createDataFrame(data, "i long, a double, b double, c double, d double, e double")
    want = iterative_fill(df, list("abcde"), rounds=3).orderBy("i").toPandas().to_numpy(dtype=float)
    monkeypatch.setattr(imputers, "MAX_PATTERNS", 1)
    got = iterative_fill(df, list("abcde"), rounds=3)
    assert got.columns == df.columns
    assert got.orderBy("i").toPandas().to_numpy(dtype=float) == pytest.approx(want, abs=1e-8)


def test_knn_with_one_hot_coordinate(spark):
    data = [(1.0, float(i % 50)) for i in range(400)] + [(1.0, None), (2.0, 7.0), (2.0, None)]
    got = knn_fill(spark.createDataFrame(data, "x double, y double"), k=3, leaf_points=16).collect()
    values = [r["y"] for r in got]
    assert sorted(values)[:3] == [0.0, 0.0, 0.0] and None not in values and len(values) == len(data)
