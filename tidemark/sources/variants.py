"""JSON whose shape changes from row to row, by the VARIANT type.

A row is parsed once and kept whole; the fields of all rows are found by an aggregation of their schemas, and
only then become columns.  No row's field is lost because other rows lack it, and a line that is no JSON is null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ref

VALUE = "value"


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as one column of variants."""
    return spark.read.text(path).select(F.try_parse_json("value").alias(VALUE))


def to_variants(text: Column) -> Column:
    """Parsed JSON texts; null where a text is no JSON."""
    return F.try_parse_json(text)


def common_schema(df: DataFrame, column: str = VALUE) -> T.DataType:
    """The type that holds the fields of all rows; a field with several kinds of values is a variant."""
    told = df.agg(F.schema_of_variant_agg(ref(column)).alias("s")).first()["s"]
    schema = T.StructType.fromDDL(f"v {re.sub(r'OBJECT<', 'STRUCT<', told)}") if told and told != "VOID" else None
    return schema["v"].dataType if schema else T.NullType()


def _path(names: tuple[str, ...]) -> str:
    return "$" + "".join(f"['{n}']" if "'" not in n else f'["{n}"]' for n in names)


def _leaves(kind: T.DataType, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    if isinstance(kind, T.StructType) and kind.fields:
        return [leaf for f in kind for leaf in _leaves(f.dataType, (*path, f.name))]
    return [(path, kind)]


def _column(value: Column, path: tuple[str, ...], kind: T.DataType) -> Column:
    """A field as a number, text, truth value or list; as JSON text where rows differ in its kind."""
    if isinstance(kind, T.DecimalType):
        kind = T.DoubleType()
    if isinstance(kind, T.NullType):
        return F.lit(None).cast("string")
    if isinstance(kind, (T.VariantType, T.StructType)) or "variant" in kind.simpleString():
        found = F.try_variant_get(value, _path(path), "variant") if path else value
        return F.when(~F.is_variant_null(found), F.to_json(found))
    return F.try_variant_get(value, _path(path), kind.simpleString())


def flatten_variants(df: DataFrame, column: str = VALUE, schema: T.DataType | None = None) -> DataFrame:
    """All other columns, and one with a dotted name for each field that any row has.

    ``schema`` is that of ``common_schema``, which is found with one aggregation if it is not given.
    """
    schema = schema or common_schema(df, column)
    others = [ref(c) for c in df.columns if c != column]
    return df.select(*others, *[_column(ref(column), p, k).alias(".".join(p) or column) for p, k in _leaves(schema)])


def unnest_variants(df: DataFrame, key: str, column: str = VALUE) -> DataFrame:
    """A row for each element of the list under ``key`` of each row, with all other columns; elements stay variants."""
    elements = F.try_variant_get(ref(column), _path((key,)), "array<variant>")
    return df.select(*[ref(c) for c in df.columns if c != column], F.explode(elements).alias(column))
