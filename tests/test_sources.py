import gzip
import json

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark.sources import tables, texts, variants
from tidemark.streaming.apply import filling, normalizing, on_stream
from tidemark.operators import missing, scaling


def sample(spark):
    return spark.createDataFrame([(1, "a", 1.5), (2, None, None), (3, "c,d", -2.0)], "k int, s string, x double")


@pytest.mark.parametrize("fmt", tables.FORMATS)
def test_round_trip(spark, tmp_path, fmt):
    path = str(tmp_path / f"t.{fmt}")
    tables.write_table(sample(spark).repartition(3), path)  # several files, several rows in one
    back = tables.read_table(spark, path).select("k", "s", "x")
    assert rows(back) == rows(sample(spark))


def test_format_dispatch():
    assert tables.format_of("/x/a.CSV") == "csv" and tables.format_of("/x/a", "parquet") == "parquet"
    with pytest.raises(ValueError, match="unsupported file type"):
        tables.format_of("/x/a.xlsx")


def test_null_tokens(spark, tmp_path):
    (tmp_path / "t.csv").write_text('n,s\n1,a\nN/A,\nnull,NA\n4," "\n')
    df = tables.read_csv(spark, str(tmp_path / "t.csv"), null_tokens=tables.NULL_TOKENS)
    assert dict(df.dtypes) == {"n": "bigint", "s": "string"}
    assert rows(df, "n") == [(None, None), (None, None), (1, "a"), (4, None)]
    df = tables.read_csv(spark, str(tmp_path / "t.csv"), schema="n double, s string", null_tokens=["N/A", "null"])
    assert sorted(r["n"] for r in df.collect() if r["n"]) == [1.0, 4.0]


def test_nested_json(spark, tmp_path):
    cases = {
        "list.json": [{"a": 1, "b": {"c": 2}}, {"a": 3, "b": {"c": 4}}],
        "key.json": {"meta": 1, "readings": [{"a": 1, "b": {"c": 2}}, {"a": 3, "b": {"c": 4}}]},
    }
    for name, content in cases.items():
        (tmp_path / name).write_text(json.dumps(content))
        df = tables.read_nested_json(spark, str(tmp_path / name))
        assert df.columns == ["a", "b.c"] and rows(df) == [(1, 2), (3, 4)]
    (tmp_path / "one.json").write_text(json.dumps({"a": 1, "b": {"c": {"d": "x"}}}))
    df = tables.read_nested_json(spark, str(tmp_path / "one.json"))
    assert df.columns == ["a", "b.c.d"] and rows(df) == [(1, "x")]


def test_json_by_columns(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"plant": {"7": "fern", "9": "moss"}, "cm": {"7": 40, "9": 3}}')
    df = tables.read_json_columns(spark, str(tmp_path / "c.json"), {"plant": "string", "cm": "bigint"})
    assert rows(df) == [("fern", 40), ("moss", 3)]


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo ёж")
    assert texts.read_documents(spark, str(tmp_path / "a.txt")).first()["text"] == "one\ntwo ёж"
    texts.write_text(sample(spark).where("s is not null"), "s", str(tmp_path / "out"))
    assert rows(spark.read.text(str(tmp_path / "out"))) == [("a",), ("c,d",)]


def test_files_in_named_folders(spark, tmp_path):
    df = spark.createDataFrame([(n, n % 3, f"text {n}") for n in range(12)], "a int, b int, text string").repartition(4)
    texts.write_files(df, str(tmp_path / "out"), ["a", "b"])
    assert not list((tmp_path / "out").rglob("_temporary"))
    texts.write_files(df.limit(1).withColumnRenamed("a", "other").drop("b"), str(tmp_path / "out" / "more"), ["other"])
    found = rows(texts.read_documents(spark, str(tmp_path / "out"), nested=True).selectExpr("regexp_extract(path, '/(a=.*)/part', 1)", "text"))
    assert [r for r in found if r[0]] == sorted((f"a={n}/b={n % 3}", f"text {n}\n") for n in range(12)) and len(found) == 13


def test_files_of_odd_rows_as_spark_writes_them(spark, tmp_path):
    # missing, empty, repeated and odd names and texts: the same folders and lines as by Spark's own writer
    names = [None, "", "a b", "x/y=z", "%41", "ё#?", "a b", "q[1]{2}^\"'", "new\nline", "é:*\\", "\x7f"]
    df = spark.createDataFrame([(n, i % 2, None if i == 3 else f"t{n}" * (i % 5)) for i, n in enumerate(names)], "`n m` string, k int, text string")
    df = df.unionByName(df).coalesce(1)
    texts.write_files(df, str(tmp_path / "own"), ["n m", "k"])
    df.write.partitionBy("n m", "k").text(str(tmp_path / "theirs"))
    lines = lambda top: {str(f.parent.relative_to(top)): sorted(f.read_bytes().split(b"\n")) for f in top.rglob("part-*")}
    assert lines(tmp_path / "own") == lines(tmp_path / "theirs")
    assert (tmp_path / "own" / "_SUCCESS").exists()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        texts.write_files(df, str(tmp_path / "own"), ["n m", "k"])


def test_documents_below_a_folder_as_spark_reads_them(spark, tmp_path, monkeypatch):
    for name, content in {
        "a.txt": b"one\n\ntwo\r\n", "n=1/b c%20#.txt": b"x", "n=1/_p=2/ё+&.txt": "ё".encode(), "n=1/empty": b"", "_hidden/a": b"no",
        ".hidden": b"no", "_metadata.txt": b"no", "_metadata/x": b"seen", "n=2/c._COPYING_": b"no", "n=2/bad \u2028^`~!": b"\xff\xfe\x00a", "n=2/_no": b"no", "n=2/deep/er/x": b"\xef\xbb\xbfz",
    }.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    (tmp_path / "none").mkdir()
    raw = lambda df: rows(df.selectExpr("path", "hex(cast(text as binary))"))
    read = lambda name: raw(texts.read_documents(spark, str(tmp_path / name), nested=True))
    own = read("in"), read("none")
    monkeypatch.setattr(texts, "_files_below", lambda *_: None)
    assert own == (read("in"), read("none")) and len(own[0]) == 6


def test_packed_documents_below_a_folder(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.gz").write_bytes(gzip.compress(b"packed"))
    (tmp_path / "x" / "b").write_text("plain")
    assert rows(texts.read_documents(spark, str(tmp_path), nested=True).select("text")) == [("packed",), ("plain",)]


def test_many_files_cost_no_process_and_no_task_each(spark, tmp_path):
    # before, Hadoop's local writer ran several processes for each file, and a listing task each folder
    df = spark.range(400).selectExpr("id % 200 as a", "id as b", "concat('text ', id) as text").repartition(4, "b")
    group = "many files"
    spark.sparkContext.setJobGroup(group, group)
    try:
        texts.write_files(df, str(tmp_path / "out"), ["a", "b"])
        found = texts.read_documents(spark, str(tmp_path / "out"), nested=True)
        assert rows(found.select("text")) == sorted(((f"text {n}\n",) for n in range(400)), key=repr)
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds]
        assert sum(s.numTasks for s in stages if s) < 200
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not list((tmp_path / "out").rglob(".part-*"))


def test_collapse_in_parts(spark):
    df = spark.range(25).select(F.format_string("w%02d", "id").alias("w"), "id")
    parts = texts.collapse_column(df, "w", ["id"], rows_per_part=10).orderBy("part").collect()
    assert [len(p["text"].split()) for p in parts] == [10, 10, 5]
    assert " ".join(p["text"] for p in parts) == " ".join(f"w{i:02d}" for i in range(25))


def test_json_to_text(spark):
    df = spark.createDataFrame([('{"a": "x", "b": 2}',), ('["p", "q"]',)], "j string")
    got = df.select(texts.json_values(F.col("j")), texts.json_lines(F.col("j"))).collect()
    assert [tuple(r) for r in got] == [("x 2", "a: x\nb: 2"), ("p q", "p\nq")]


def test_row_lines(spark):
    assert texts.header_line(sample(spark)) == "Columns: k | s | x"
    assert rows(texts.row_lines(sample(spark))) == [("1 | a | 1.5",), ("2 | nan | nan",), ("3 | c,d | -2.0",)]


def test_fitted_changes_on_a_stream(spark, tmp_path):
    df = sample(spark)
    df.write.parquet(str(tmp_path / "in"))
    changes = [
        filling(missing.fit_fill(df, "mean", "mode", columns=["s", "x"])),
        normalizing(scaling.fit_min_max(df, ["k"])),
    ]
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = on_stream(stream, changes).writeStream.format("memory").queryName("prepared").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("prepared")) == rows(on_stream(df, changes))


def test_json_of_changing_shape_keeps_all_fields(spark, tmp_path):
    lines = [
        {"a": 1, "b": {"c": "x", "d": {"e": True}}}, {"a": 2.5, "b": {"f": [1, 2]}, "it's": "q"}, {"b": "flat"}, {}, {"z z": None, "a": 3},
        {"g": [{"h": 1}, {"i": "two"}]},
    ]
    path = tmp_path / "shapes.json"
    path.write_text("\n".join([*(json.dumps(x) for x in lines), "no json {"]))
    rows_ = variants.read_variants(spark, str(path))
    whole = [None if r[0] is None else json.loads(r[0]) for r in rows_.select(F.to_json("value")).collect()]
    assert whole == [*lines, None]  # a round trip
    flat = variants.flatten_variants(rows_)
    assert set(flat.columns) == {"a", "b", "g", "it's", "z z"}  # b is an object in some rows and a text in one
    got = [r.asDict() for r in flat.collect()]
    assert [g["a"] for g in got] == [1.0, 2.5, None, None, 3.0, None, None] and got[1]["it's"] == "q"
    assert [None if g["b"] is None else json.loads(g["b"]) for g in got[:3]] == [x["b"] for x in lines[:3]]
    deep = variants.flatten_variants(rows_.limit(2))
    assert {"a", "b.c", "b.d.e", "b.f", "it's"} == set(deep.columns)
    inner = variants.flatten_variants(variants.unnest_variants(rows_, "g"))
    assert sorted(map(tuple, inner.collect()), key=repr) == [(1, None), (None, "two")]


def test_no_variants(spark):
    df = spark.createDataFrame([(1, "no json")], "k int, value string").withColumn("value", variants.to_variants(F.col("value")))
    assert rows(variants.flatten_variants(df)) == [(1, None)]
