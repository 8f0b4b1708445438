from helpers import rows
from pyspark.sql import functions as F

from tidemark.operators import duplicates as d


def sample(spark):
    data = [(1, "a", None), (1, "a", None), (1, "a", None), (2, "b", 1.0), (2, "b", float("nan")), (2, "b", None)]
    return spark.createDataFrame(data, "k int, s string, x double")


def test_missing_cells_are_equal(spark):
    df = sample(spark)
    assert rows(d.drop_duplicates(df)) == [(1, "a", None), (2, "b", 1.0), (2, "b", None)]
    assert rows(d.surplus_copies(df)) == [(1, "a", None), (1, "a", None), (2, "b", None)]


def test_report(spark):
    assert rows(d.duplicate_report(sample(spark))) == [(6, 3, 3, 3, False)]
    assert rows(d.duplicate_rate(sample(spark))) == [(2, 2 / 6)]
    assert rows(d.duplicate_report(sample(spark).where("k > 9"))) == [(0, 0, 0, 0, False)]
    assert not d.has_duplicates(sample(spark).where("k > 9")).first()[0]


def test_examples_and_frequent(spark):
    assert rows(d.duplicate_examples(sample(spark), ["k"], 2)) == [(1, "a", None), (1, "a", None)]
    assert rows(d.frequent_duplicates(sample(spark), 1)) == [(1, "a", None, 3)]


def test_many_copies_are_written_in_chunks(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"))
    out = d.surplus_copies(df, chunk=50)
    assert {r["k"]: r["count"] for r in out.groupBy("k").count().collect()} == {0: 333, 1: 332, 2: 332}


def test_dense_row_id_with_ties(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id").repartition(7)
    got = d.dense_row_id(df, ["k"]).collect()
    assert sorted(r["row_id"] for r in got) == list(range(500))
    ordered = [r["k"] for r in sorted(got, key=lambda r: r["row_id"])]
    assert ordered == sorted(ordered)
    assert d.dense_row_id(df.where("id < 0"), ["k"]).count() == 0


def test_running_total(spark):
    df = spark.range(1, 101).select("id", (F.col("id") * 2).alias("w")).repartition(5)
    got = {r["id"]: r["before"] for r in d.running_total(df, ["id"], "w", "before").collect()}
    assert got == {i: i * (i - 1) for i in range(1, 101)}
