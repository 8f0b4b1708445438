"""Which columns tell a target column."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import new_path
from ..operators import features
from ..sources.tables import read_table, write_table
from .registry import query, table


def vectors(spark, folder):
    """Each number of an embedding as a column."""
    df = table(spark, folder, "embeddings")
    width = df.select(F.max(F.size("embedding"))).first()[0]
    return df.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(width)])


@query(
    "l1_split",
    """select o_orderkey, case when cast('0x' || substr(md5(cast(o_orderkey as varchar)), 1, 7) as bigint) % 10000 < 7500
         then 'train' else 'test' end as part from orders""",
)
def l1(spark, folder):
    train, test = features.split_by_key(table(spark, folder, "orders"), ["o_orderkey"])
    parts = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return parts.select("o_orderkey", "part")


@query("l2_predict_target")
def l2(spark, folder):
    train, test = features.split_by_key(vectors(spark, folder), ["vec_id"])
    model = features.fit_target(train, "label", ["vec_id"])
    return model.predict(test).select("vec_id", "label", "prediction")


@query("l3_feature_importance")
def l3(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    rows = docs.select(
        "doc_id", "quality", F.col("n_chars").cast("double").alias("n_chars"),
        (letters / F.greatest(F.length("text"), F.lit(1))).alias("letter_share"),
        F.size(F.split("text", "\n")).cast("double").alias("lines"),
    )
    train, _ = features.split_by_key(rows, ["doc_id"])
    model = features.fit_target(train, "quality", ["doc_id"], names=["random_forest", "decision_tree"])
    path = new_path(spark, "weights") + ".csv"
    write_table(model.importances(spark), path)
    return read_table(spark, path, schema="feature string, importance double")
