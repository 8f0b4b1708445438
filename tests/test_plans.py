import pytest
from helpers import rows

from tidemark.plans import diagnosis, prepare


def sample(spark):
    data = [(i, float(i % 10), "ab"[i % 2]) for i in range(60)] + [(100, 500.0, "a"), (101, None, None), (0, 0.0, "a")]
    return spark.createDataFrame(data, "k int, x double, s string")


def test_auto_prepare(spark):
    data, log = prepare.auto_prepare(sample(spark), "median", "iqr", ["x"])
    steps = [(r["step"], r["rows_in"], r["rows_out"], r["applied"]) for r in log.orderBy("place").collect()]
    assert steps == [
        ("drop_duplicates", 63, 62, True), ("fill_missing", 62, 62, True),
        ("remove_outliers", 62, 61, True), ("normalize", 61, 61, True),
    ]
    assert data.where("x < 0 or x > 1 or x is null or s is null").count() == 0


def test_auto_prepare_leaves_good_data_alone(spark):
    df = spark.createDataFrame([(0.1 * i, "a") for i in range(9)], "x double, s string")
    data, log = prepare.auto_prepare(df)
    assert [r["applied"] for r in log.collect()] == [False] * 4 and rows(data) == rows(df)


def test_auto_prepare_with_defaults(spark):
    data, log = prepare.auto_prepare(sample(spark), columns=["x"])
    steps = [r["step"] for r in log.where("applied").orderBy("place").collect()]
    assert steps == ["drop_duplicates", "fill_missing", "compare_removals", "remove_outliers", "normalize"]
    assert data.where("x is null").count() == 0


def test_by_number_and_by_name(spark):
    df = sample(spark).select("k", "x")
    by_number = prepare.prepare(df, [0, (1, {"numeric_strategy": "mean", "columns": ["x"]}), (2, {"columns": ["x"]})])
    by_name = prepare.prepare(
        df, ["drop_duplicates", ("fill_missing", {"numeric_strategy": "mean", "columns": ["x"]}), ("normalize", {"columns": ["x"]})]
    )
    assert rows(by_number) == rows(by_name)
    for wrong in (9, -1, "fold"):
        with pytest.raises(ValueError, match="unknown operator"):
            prepare.prepare(df, [wrong])


def test_describe():
    assert prepare.describe(0) == "remove duplicate rows"
    assert prepare.describe((2, {"columns": ["x"]})) == "map numeric columns to a range (columns=['x'])"


def test_logged(spark):
    data, log = prepare.prepare_logged(sample(spark), [0, (4, {"method": "iqr", "columns": ["x"]})])
    assert [(r["rows_in"], r["rows_out"]) for r in log.collect()] == [(63, 62), (62, 60)] and data.count() == 60


def test_diagnosis_honours_flags(spark):
    df = sample(spark)
    whole = diagnosis.diagnose(df, ["x"])
    assert {r["section"] for r in whole.collect()} == {"alerts", "missing", "duplicates", "outliers", "scaling"}
    only = diagnosis.diagnose(df, ["x"], check_alerts=False, check_missing=False, check_abnormal=False, check_scaling=False)
    assert {r["section"] for r in only.collect()} == {"duplicates"}
    none = diagnosis.diagnose(df, check_alerts=False, check_missing=False, check_abnormal=False, check_scaling=False, check_duplicates=False)
    assert none.count() == 0


def test_the_log_reads_no_cells(spark):
    """Rows are counted without reading a column, and a model of pyspark.ml can still be used in the session."""
    from tidemark.functions.storage import settle_counted
    from tidemark.operators import features

    written, rows_ = settle_counted(sample(spark))
    plan = written.groupBy().count()._jdf.queryExecution().executedPlan().toString()
    assert rows_ == 63 and "ReadSchema: struct<>" in plan
    prepare.prepare_logged(sample(spark), [0, 0])
    df = spark.range(300).selectExpr("id", "cast(id % 5 as double) as x", "id % 5 > 2 as y")
    model = features.fit_target(df, "y", ["id"], names=["random_forest"])
    assert model.predict(df).where("prediction <> cast(y as string)").count() == 0
