import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark.operators import forest, lof, outliers as o


def test_sequential_and_independent_fences_differ(spark):
    # the far x row also holds the y value that widens the fence of y
    data = [(float(i % 5), float(i % 7)) for i in range(40)] + [(100.0, 14.0), (2.0, 13.0)]
    df = spark.createDataFrame(data, "x double, y double")
    kept = o.remove_iqr(df)
    assert kept.where("x = 100").count() == 0
    assert o.has_iqr_outliers(df).first()[0] is True
    assert o.has_iqr_outliers(spark.createDataFrame([(1.0,), (2.0,)], "x double")).first()[0] is False


def test_iqr_removal_of_a_small_table(spark):
    df = spark.createDataFrame([("Peter", 12), ("Ivan", 13), ("Old", 950), ("Ann", 12), ("Tom", 13)], "name string, age bigint")
    assert rows(o.remove_outliers(df, "IQR")) == [("Ann", 12), ("Ivan", 13), ("Peter", 12), ("Tom", 13)]


def test_iqr_drops_rows_with_missing_cells(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),)], "x double")
    assert o.remove_iqr(df).count() == 2
    assert o.remove_iqr(df.where("x is null")).count() == 0


def test_bounds_reach_the_files(spark, tmp_path):
    spark.range(100).selectExpr("cast(id as double) x", "id y").write.parquet(str(tmp_path / "t"))
    plan = o.remove_iqr(spark.read.parquet(str(tmp_path / "t")), ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x" in plan and "LessThanOrEqual(x" in plan


def test_zscore_keeps_missing_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0)] * 30 + [(None, 5.0), (500.0, 5.0)], "x double, c double")
    kept = o.remove_zscore(df)
    assert kept.count() == 31 and kept.where("x = 500").count() == 0


def test_mad_zero_flags_everything_off_the_median(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(1.5,), (None,)], "x double")
    counts = {r["method"]: r["n"] for r in o.outlier_report(df).collect()}
    assert counts["Modified_Z_score"] == 1
    assert o.remove_outliers(df, "hampel").count() == 10


def test_rules_on_skewed_data(spark):
    x = np.random.default_rng(2).lognormal(0, 1.5, 500)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    report = {r["method"]: r for r in o.outlier_report(df).collect()}
    assert report["Skewness_Method"]["direction"] == "right"
    assert report["Skewness_Method"]["n"] == int((x > x.mean() + 2 * x.std(ddof=1)).sum())
    mad = np.median(np.abs(x - np.median(x)))
    assert report["Kurtosis_Method"]["n"] == int((np.abs(x - np.median(x)) / mad > 3.5).sum())
    ranked = o.rank_methods(o.outlier_report(df)).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1))
    assert [r["n"] for r in ranked] == sorted((r["n"] for r in ranked), reverse=True)


def test_nothing_flagged_ranks_none(spark):
    df = spark.createDataFrame([(1.0,)] * 5, "x double")
    assert [r["method"] for r in o.rank_methods(o.outlier_report(df)).collect()] == ["none"]


def test_thresholds_shift():
    t = o.Thresholds().shift(2)
    assert (t.hampel, t.iqr, round(t.skewness, 6), round(t.kurtosis, 6)) == (3.4, 1.7, 2.28, 3.94)
    back = t.shift(-2)
    assert back.hampel == pytest.approx(3.0) and back.kurtosis == pytest.approx(3.5)


def test_skew_score_of_empty_table(spark):
    row = o.skew_score(spark.createDataFrame([], "x double")).first()
    assert row["skew_score"] == float("inf") and row["n_rows"] == 0


def test_unknown_method(spark):
    with pytest.raises(ValueError, match="not supported"):
        o.remove_outliers(spark.range(3), "magic")


def far_points():
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(size=(190, 2)), rng.normal(size=(10, 2)) * 0.5 + 12])
    x[190:] += np.arange(10)[:, None] * 3
    return x


@pytest.mark.parametrize("remove", [forest.remove_isolated, lof.remove_lof])
def test_planted_extremes_are_removed(spark, remove):
    x = far_points()
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i int, a double, b double")
    kept = {r["i"] for r in remove(df, ["a", "b"]).collect()}
    assert 185 <= len(kept) <= 192
    assert len([i for i in range(190, 200) if i in kept]) <= 2


def brute_lof(x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    n = len(x)
    near = [sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], tuple(x[j])))[:k] for i in range(n)]
    radius = np.array([d[i, near[i][-1]] for i in range(n)])
    density = np.array([1 / (np.mean([max(radius[j], d[i, j]) for j in near[i]]) + 1e-10) for i in range(n)])
    return np.array([np.mean(density[near[i]]) / density[i] for i in range(n)])


@pytest.mark.parametrize("leaf_points", [8, 1024])
def test_lof_equals_brute_force_with_copies(spark, leaf_points):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(150, 2)), 2)
    x[:40] = x[0]
    x[40:45] = x[45]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i int, a double, b double")
    got = lof.lof_scores(df, ["a", "b"], 10, leaf_points).orderBy("i").toPandas()["lof"]
    np.testing.assert_allclose(got, brute_lof(x, 10), rtol=1e-6)


def test_scores_of_rows_with_missing_cells(spark):
    data = [(float(i), float(i % 3)) for i in range(30)] + [(None, 1.0)]
    df = spark.createDataFrame(data, "a double, b double")
    assert lof.lof_scores(df).where("lof is null").count() == 1
    assert forest.forest_scores(df).where("isolation is null").count() == 1
    assert lof.remove_lof(df).where("a is null").count() == 1


def test_auto_choice_log(spark):
    data = [(float(i % 10),) for i in range(100)] + [(400.0,)]
    kept, log = o.compare_removals(spark.createDataFrame(data, "x double"), methods=["IQR", "Z-Score"])
    assert kept.count() == 100
    assert [(r["method"], r["chosen"]) for r in log.collect()] == [("IQR", True), ("Z-Score", False)]


def test_forest_does_not_depend_on_the_layout(spark):
    """The same forest from 1 and from 40 partitions, also where rows are drawn and a third of them are copies."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 2))
    x[:300] = x[0]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    made = [forest.fit_forest(d, ["a", "b"], trees=4, sample=32)[0] for d in (df.repartition(1), df.orderBy("b").repartition(40))]
    for one, other in zip(*made):
        assert all((one[k] == other[k]).all() for k in one)
    pool = forest._draw(df.groupBy(F.col("a").alias("x0"), F.col("b").alias("x1")).agg(F.count("*").alias("n")), ["x0", "x1"], 42, 0.4)
    copies = (pool == x[0]).all(axis=1).mean()
    assert 280 < len(pool) < 440 and 0.25 < copies < 0.42
