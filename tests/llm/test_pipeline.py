import re

import corpus_pipeline
from pyspark.sql import functions as F

from tidemark.llm import queries


def test_stages_in_order(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    total = docs.count()
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        sizes.append(after.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
            docs = after
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "decontamination", "pii_surrogates", "best_two_fit"]
    assert total >= sizes[0] > sizes[1] > sizes[2] == sizes[3] <= sizes[4]
    texts = [r["text"] for r in docs.select("text").collect()]
    assert not any(re.search(r"@mail\d\.example\.com", t) for t in texts)
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0


def test_every_operator_has_a_query():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES)
    assert numbers == list(range(1, len(numbers) + 1))


def test_stages_take_any_table(spark, folder):
    """Null ids, null and empty texts, repeated rows, columns named like those that stages make, and an empty table."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    odd = docs.limit(6).withColumn("doc_id", F.lit(None).cast("long")).unionByName(
        docs.limit(3).withColumn("text", F.lit(None).cast("string"))
    ).unionByName(docs.limit(2).withColumn("text", F.lit(""))).unionByName(docs.limit(10))
    named = docs.unionByName(odd).withColumns({c: F.lit(c) for c in ("length", "piece", "class", "score", "n", "component")}).cache()
    for table in (named, named.limit(0)):
        rows = table
        for name, stage in corpus_pipeline.STAGES:
            before, rows = rows, stage(spark, rows, folder)
            if name != corpus_pipeline.STAGES[-1][0]:
                rows = rows.cache()
                assert rows.columns == before.columns and rows.count() <= before.count()
        packed = rows.toPandas()
        assert (len(packed) > 0) == (table is named)
        for _, part in packed.groupby("sequence_id"):
            part = part.sort_values("offset")
            assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() <= 4096
