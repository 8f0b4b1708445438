"""Scaling, profiles, chart data, types and expectations."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.functions.columns import categorical_columns, numeric_columns
from tidemark.functions.lookup import lookup_join
from tidemark.operators import charts, features, profile, quality, scaling


def test_column_kinds(spark):
    df = spark.sql("select 1 as i, 1.5D as d, cast(1 as decimal(9,2)) as m, true as b, 'x' as s, date'2020-01-01' as t")
    assert numeric_columns(df) == ["i", "d", "m"] and categorical_columns(df) == ["b", "s", "t"]
    with pytest.raises(ValueError, match="unknown columns"):
        numeric_columns(df, ["zz"])
    with pytest.raises(ValueError, match="not numeric"):
        numeric_columns(df, ["s"])


def test_scaling_of_constant_and_missing(spark):
    df = spark.createDataFrame([(1.0, 7, None), (3.0, 7, None), (None, 7, None)], "x double, c int, e double")
    assert rows(scaling.normalize(df, feature_range=(2, 4)), "x") == [(None, 2.0, None), (2.0, 2.0, None), (4.0, 2.0, None)]
    assert rows(scaling.standardize(df), "x") == [(None, 0.0, None), (-1.0, 0.0, None), (1.0, 0.0, None)]
    with pytest.raises(ValueError, match="must grow"):
        scaling.normalize(df, feature_range=(1, 1))


def test_scaling_advice(spark):
    df = spark.createDataFrame([(float(100 + i % 3), float(i % 2 * 100 - 80)) for i in range(30)], "even double, wild double")
    got = {r["column"]: r for r in scaling.scaling_advice(df).collect()}
    assert got["even"]["advice"] == labels.NORMALIZE and got["even"]["reasons"] == [labels.EVEN]
    assert got["wild"]["advice"] == labels.STANDARDIZE and labels.ASYMMETRIC in got["wild"]["reasons"]
    assert scaling.needs_normalizing(df).first()[0] is True


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "x double, s string")
    row = profile.numeric_profile(df).first()
    assert (row["n"], row["mean"], row["n_distinct"]) == (0, None, 0)
    assert profile.categorical_profile(df).first()["mode"] is None
    assert profile.alerts(df).count() == 0
    assert profile.overview(df).first()["n_rows"] == 0


def test_correlation_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.5, 5.0)], "a double, b double, c double")
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in profile.correlations(df).collect()}
    assert got[("a", "b")] > 0.99 and got[("a", "c")] is None
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in profile.correlations(df, ["a", "b"], "spearman").collect()}
    assert got[("a", "b")] == pytest.approx(1.0)


def test_top_values_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "s string")
    top = profile.top_values(df, k=2)
    assert rows(top, "rank") == [("s", "a", 2, 0.5, 1), ("s", None, 1, 0.25, 2)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_histogram_puts_the_greatest_value_in_the_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(21)], "x double")
    got = rows(charts.histogram(df, "x").select("bin", "n"), "bin")
    assert got[-1] == (19, 2) and sum(n for _, n in got) == 21
    assert rows(charts.histogram(df.where("x = 3"), "x").select("bin", "n")) == [(0, 1)]


def test_pie_refuses_many_values(spark):
    with pytest.raises(ValueError, match="too many"):
        charts.pie(spark.range(11), "id")


def test_types(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,), ("x",)], "v string")
    assert rows(quality.convert_types(df, {"v": "int"}, "null"), "v") == [(None,), (None,), (None,), (1,)]
    with pytest.raises(Exception, match="not of type int"):
        quality.convert_types(df, {"v": "int"}).collect()
    assert rows(quality.wrong_types(df, {"v": "int"})) == [("v", "int", 2, 1, "x")]


def test_misspelled_values(spark):
    df = spark.createDataFrame([("moscow",), ("mosow",), ("paris",), ("berlin",), (None,), ("parys",)], "c string")
    got = quality.merge_misspelled(df, "c", ["moscow", "paris"], 1, "fixed")
    assert {r["c"]: r["fixed"] for r in got.collect()} == {
        "moscow": "moscow", "mosow": "moscow", "paris": "paris", "berlin": "berlin", None: None, "parys": "paris",
    }


def test_misspelled_values_equal_brute_force(spark):
    import random

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    right = sorted({word(rng.randrange(1, 9)) for _ in range(30)})
    values = [word(rng.randrange(0, 10)) for _ in range(150)]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    got = quality.merge_misspelled(df, "c", spark.createDataFrame([(r,) for r in right], "r string"), 2, "fixed").collect()
    assert len(got) == len(values)
    for r in got:
        best = min((edits(r["c"], v), v) for v in right)
        assert r["fixed"] == (r["c"] if r["c"] in right or best[0] > 2 else best[1])


def test_expectations(spark):
    df = spark.createDataFrame([(1, "a"), (50, "b"), (None, None)], "x int, s string")
    got = quality.check_expectations(
        df, [quality.Expectation("x", low=0, high=10, max_null_share=0.5), quality.Expectation("s", allowed=("a", "b"))]
    )
    assert rows(got) == [("s", "allowed", 0, True), ("x", "null_share", 1, True), ("x", "range", 1, False)]


def test_dependency_and_chi_square(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", 2)], "k string, v int")
    assert rows(quality.functional_dependency(df, "k", "v")) == [(3, 0, True)]
    assert rows(quality.functional_dependency(df, "v", "k")) == [(2, 1, False)]
    row = quality.chi_square(df, "k", "v").first()
    assert row["chi_square"] == pytest.approx(4.0) and row["dof"] == 2 and row["cramers_v"] == pytest.approx(1.0)


def test_bins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(8)], "x double")
    got = quality.discretize(df, "x", bins=4, equal="frequency", name="b").groupBy("b").count()
    assert rows(got, "b") == [(0, 2), (1, 2), (2, 2), (3, 2)]
    assert [r["x"] for r in quality.discretize(df.limit(1), "x", round_to=0).collect()] == [0.0]


def test_salted_lookup_equals_broadcast(spark):
    big = spark.range(600).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"))
    keys = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small = lookup_join(big, keys, ["k"])
    salted = lookup_join(big, keys, ["k"], rows=0, salt_rows=2)
    assert rows(small) == rows(salted) and salted.count() == 600
    odd = F.when(F.col("k") % 2 == 0, F.col("k"))
    for null_safe in (False, True):
        small = lookup_join(big.withColumn("k", odd), keys.withColumn("k", F.when(F.col("k") != 1, F.col("k"))), ["k"], null_safe=null_safe)
        salted = lookup_join(big.withColumn("k", odd), keys.withColumn("k", F.when(F.col("k") != 1, F.col("k"))), ["k"], null_safe=null_safe, rows=0, salt_rows=3)
        assert rows(small) == rows(salted) and salted.count() == 600
    small = lookup_join(big, keys, ["k"])
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(1000)
    a, b = features.split_by_key(df, ["id"])
    c, _ = features.split_by_key(df.repartition(9), ["id"])
    assert rows(a) == rows(c) and a.count() + b.count() == 1000 and 680 < a.count() < 820


def test_target_model(spark):
    df = spark.range(300).select(
        "id", (F.col("id") % 17).cast("double").alias("noise"), (F.col("id") % 5).cast("double").alias("x"),
        F.when(F.col("id") % 5 > 2, "yes").otherwise("no").alias("y"),
    )
    model = features.fit_target(df, "y", ["id"], names=["decision_tree"])
    assert model.predict(df).where("prediction <> y").count() == 0
    assert model.importances(spark).first()["feature"] == "x"


def test_line_pixels(spark):
    import random

    rng = random.Random(1)
    data = [(float(i) if i % 50 else None, rng.gauss(0, 1) if i % 31 else None) for i in range(1, 2000)] + [(5.0, 99.0), (float("nan"), 1.0)]
    df = spark.createDataFrame(data, "x double, y double")
    shown = charts.line_pixels(df, "x", "y", 40)
    got = rows(shown)
    assert len(got) <= 160 and (0, 5.0, 99.0) in got
    points = [(x, y) for x, y in data if x is not None and y is not None and x == x]
    low, high = min(points)[0], max(points)[0]
    want = set()
    for p in range(40):
        mine = [q for q in points if min(int((q[0] - low) / (high - low) * 40), 39) == p]
        if mine:
            want |= {(p, *q) for q in (min(mine), max(mine), min(mine, key=lambda q: (q[1], q[0])), max(mine, key=lambda q: (q[1], q[0])))}
    assert set(got) == want
    dates = spark.sql("select date'2024-01-01' + cast(id as int) as d, id as v from range(10)")
    assert charts.line_pixels(dates, "d", "v", 5).count() <= 20
    assert charts.line_pixels(df.limit(0), "x", "y").count() == 0
    assert rows(charts.line_pixels(spark.createDataFrame([(2, 3)], "x int, y int"), "x", "y")) == [(0, 2.0, 3.0)]


def test_correlations_of_many_columns_in_one_pass(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 30)) + rng.normal(size=(300, 30)) + 1e6
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:, 7], x[:, 8] = 5.0, np.nan
    names = [f"c{j}" for j in range(30)]
    rows_ = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    df = spark.createDataFrame(rows_, ", ".join(f"{c} double" for c in names)).repartition(5)
    want = pd.DataFrame(x, columns=names).corr()
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in profile.correlations(df, names).collect()}
    assert len(got) == 435
    for (a, b), value in got.items():
        if np.isnan(want.loc[a, b]) or "c7" in (a, b):
            assert value is None
        else:
            assert value == pytest.approx(want.loc[a, b], abs=1e-9)
