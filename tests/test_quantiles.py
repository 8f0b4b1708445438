import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.quantiles import exact_quantiles
from tidemark.functions.stats import fit_numeric
from tidemark.functions.storage import shared_dir

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def values():
    rng = np.random.default_rng(7)
    smooth = rng.lognormal(3, 2, 4000)
    hot = np.where(rng.random(4000) < 0.4, 5.0, rng.normal(5, 3, 4000))
    few = rng.integers(0, 4, 4000).astype(float)
    return {"smooth": smooth, "hot": hot, "few": few}


@pytest.fixture(scope="module")
def frame(spark):
    data = values()
    rows = [tuple(float(v) for v in row) for row in zip(*data.values())]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)


@pytest.mark.parametrize("options", [
    {},
    {"direct_rows": 10},
    {"direct_rows": 10, "accuracy": 50, "sliver_rows": 5},
    {"direct_rows": 10, "accuracy": 20, "sliver_rows": 100},
    {"direct_rows": 10, "accuracy": 1000, "steps": 20, "sliver_rows": 20},
])
def test_equal_to_sorting(frame, options):
    found, _ = exact_quantiles(frame, frame.columns, PROBS, **options)
    for c, x in values().items():
        np.testing.assert_allclose(found[c], np.quantile(x, PROBS), rtol=1e-12)


def test_sketch_alone_is_close(frame):
    found, _ = exact_quantiles(frame, ["smooth"], [0.25, 0.5, 0.75], exact=False, direct_rows=10)
    x = np.sort(values()["smooth"])
    ranks = np.searchsorted(x, found["smooth"]) / len(x)
    np.testing.assert_allclose(ranks, [0.25, 0.5, 0.75], atol=0.002)


def test_extra_aggregates_share_the_pass(frame):
    _, row = exact_quantiles(frame, ["few"], [0.5], [F.max("few").alias("top")])
    assert row["top"] == 3.0


def test_missing_and_nan_are_ignored(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,), (3.0,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5])[0] == {"x": [2.0]}
    s = fit_numeric(df)["x"]
    assert (s.rows, s.count, s.missing, s.mean, s.maximum) == (4, 2, 2, 2.0, 3.0)


def test_empty_and_all_missing(spark):
    df = spark.createDataFrame([(None, 1)], "x double, y int")
    assert exact_quantiles(df, ["x"], [0.5])[0] == {"x": [None]}
    s = fit_numeric(df.where("y > 1"), mad=True)
    assert s["x"].median is None and s["y"].mad is None and s["x"].rows == 0


def test_constant_column(spark):
    s = fit_numeric(spark.createDataFrame([(2.0,)] * 5, "x double"), mad=True)["x"]
    assert (s.std, s.skewness, s.kurtosis, s.mad, s.iqr) == (0.0, None, None, 0.0, 0.0)


def test_adjusted_moments(spark):
    import pandas as pd

    x = np.random.default_rng(1).exponential(size=200)
    s = fit_numeric(spark.createDataFrame([(float(v),) for v in x], "x double"), mad=True)["x"]
    p = pd.Series(x)
    assert s.skewness == pytest.approx(p.skew()) and s.kurtosis == pytest.approx(p.kurtosis())
    assert s.mad == pytest.approx((p - p.median()).abs().median())


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == "file:" + spark.conf.get("spark.checkpoint.dir")


def test_only_the_needed_columns_are_read(spark, tmp_path):
    from tidemark.operators.charts import histogram

    spark.range(50).selectExpr("cast(id as double) x", "id y", "'a' s").write.parquet(str(tmp_path / "t"))
    plan = histogram(spark.read.parquet(str(tmp_path / "t")), "x")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<x:double>" in plan


def test_both_ways_agree_to_the_last_bit(spark):
    """``percentile`` for few cells, and brackets for many, on values whose last bits differ by the formula."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(float(x),) for x in rng.lognormal(3, 2, 1013) / 7], "x double")
    probs = [0.05, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.95, 0.999]
    direct = exact_quantiles(df, ["x"], probs)[0]["x"]
    bracketed = exact_quantiles(df, ["x"], probs, direct_rows=10, sliver_rows=40)[0]["x"]
    assert direct == bracketed
