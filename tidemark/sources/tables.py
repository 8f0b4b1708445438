"""Tables in CSV, JSON and Parquet files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ref

FORMATS = ("csv", "json", "parquet")

# Tokens that stand for a missing cell.
NULL_TOKENS = ("", " ", "NA", "N/A", "null")


def format_of(path: str, fmt: str | None = None) -> str:
    """The given format, or the one of the extension."""
    name = (fmt or path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1]).lower()
    if name not in FORMATS:
        raise ValueError(f"unsupported file type: {name}; supported are {FORMATS}")
    return name


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None,
    null_tokens: Sequence[str] | None = None, **options,
) -> DataFrame:
    """CSV with a header.  A schema saves the pass over the files that finds the types.

    With ``null_tokens`` cells are read as text, the tokens become NULL, and then the types are
    found or the schema is applied.
    """
    reader = spark.read.option("header", True).options(**options)
    if null_tokens is None:
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    texts = normalize_nulls(reader.csv(path), null_tokens)
    if schema is None:
        return infer_types(texts)
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return texts.select(*[ref(f.name).try_cast(f.dataType).alias(f.name) for f in wanted])


def normalize_nulls(
    df: DataFrame, tokens: Sequence[str] = NULL_TOKENS, columns: Sequence[str] | None = None
) -> DataFrame:
    """Turn the tokens into NULL in text columns."""
    chosen = [
        f.name for f in df.schema
        if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)
    ]
    return df.withColumns({c: F.when(~ref(c).isin(list(tokens)), ref(c)) for c in chosen})


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn text columns into bigint or double where that fits every present cell."""
    chosen = [
        f.name for f in df.schema
        if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)
    ]
    if not chosen:
        return df
    kinds = ("bigint", "double")
    tests = [
        F.count_if(ref(c).isNotNull() & ref(c).try_cast(kind).isNull()).alias(f"{kind}_{i}")
        for i, c in enumerate(chosen) for kind in kinds
    ]
    present = [F.count(ref(c)).alias(f"n_{i}") for i, c in enumerate(chosen)]
    row = df.agg(*tests, *present).first()
    changed: dict[str, Column] = {}
    for i, c in enumerate(chosen):
        fitting = [kind for kind in kinds if row[f"n_{i}"] and row[f"{kind}_{i}"] == 0]
        if fitting:
            changed[c] = ref(c).try_cast(fitting[0])
    return df.withColumns(changed) if changed else df


def _leaves(dtype: T.StructType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
    found = []
    for f in dtype:
        here = (*path, f.name)
        found += _leaves(f.dataType, here) if isinstance(f.dataType, T.StructType) else [here]
    return found


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs to columns with dotted names; arrays stay."""
    out = []
    for path in _leaves(df.schema, ()):
        col = ref(path[0])
        for name in path[1:]:
            col = col.getField(name)
        out.append(col.alias(".".join(path)))
    return df.select(*out)


def record_lists(df: DataFrame) -> list[str]:
    """Columns that hold lists of objects."""
    return [
        f.name for f in df.schema
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)
    ]


def unnest(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows of the list of objects under ``key`` (default: the first such column), flattened.

    Without such a column the objects themselves are flattened.
    """
    lists = record_lists(df)
    if key is None and not lists:
        return flatten(df)
    return flatten(df.select(F.inline(ref(key or lists[0]))))


def read_json(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = True, **options
) -> DataFrame:
    """JSON lines, which can be split; with ``lines=False`` files that hold one list of objects or one object."""
    reader = spark.read.options(**options).option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def read_nested_json(spark: SparkSession, path: str, key: str | None = None, lines: bool = False, **options) -> DataFrame:
    return unnest(read_json(spark, path, lines=lines, **options), key)


def read_json_columns(spark: SparkSession, path: str, types: Mapping[str, str]) -> DataFrame:
    """JSON of the form {column: {row: value}}, one object per file."""
    whole = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "map<string,map<string,string>>").alias("table"),
        F.col("_metadata.file_path").alias("file"),
    )
    cells = whole.select("file", F.explode("table").alias("column", "cells")).select(
        "file", "column", F.explode("cells").alias("row", "value")
    )
    wide = cells.groupBy("file", "row").pivot("column", list(types)).agg(F.first("value"))
    return wide.select(*[ref(c).cast(t).alias(c) for c, t in types.items()])


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read by extension or by the given format."""
    name = format_of(path, fmt)
    if name == "csv":
        return read_csv(spark, path, **options)
    if name == "json":
        return read_json(spark, path, **options)
    return spark.read.options(**options).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "error", **options) -> None:
    """Write a folder of files by extension or by the given format; JSON as one object per line."""
    name = format_of(path, fmt)
    writer = df.write.mode(mode).options(**options)
    if name == "csv":
        writer.option("header", True).csv(path)
    elif name == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.parquet(path)
