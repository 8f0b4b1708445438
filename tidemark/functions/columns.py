"""Column kinds and the null model.

Spark has SQL NULL and the floating point NaN; both mean "missing" here.  Operators first turn NaN
into NULL (``tidy``) and then rely on Spark's NULL handling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ref(name: str) -> Column:
    """Column reference that also works for dotted names."""
    return F.col("`" + name.replace("`", "``") + "`")


def check_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}; the table has {df.columns}")
    return list(columns)


def is_numeric(dtype: T.DataType) -> bool:
    """Integers, floats and decimals; booleans, dates and texts are categorical."""
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """The chosen columns, or every numeric column of the schema."""
    if columns is None:
        return [f.name for f in df.schema if is_numeric(f.dataType)]
    chosen = check_columns(df, columns)
    wrong = [c for c in chosen if not is_numeric(df.schema[c].dataType)]
    if wrong:
        raise ValueError(f"columns {wrong} are not numeric")
    return chosen


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not is_numeric(f.dataType)]


def is_missing(df: DataFrame, name: str) -> Column:
    col = ref(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def cleaned(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(ref(name)), ref(name)).alias(name)
    return ref(name)


def as_double(df: DataFrame, name: str) -> Column:
    return cleaned(df, name).cast("double").alias(name)


def tidy(df: DataFrame) -> DataFrame:
    """The table with NaN turned into NULL in every floating point column."""
    if not any(isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in df.schema):
        return df
    return df.select(*[cleaned(df, c) for c in df.columns])


def unpivot_rows(rows: Sequence[Column]) -> Column:
    """Turn a few struct columns of one row into that many rows."""
    return F.inline(F.array(*rows))


def zero_safe(col: Column) -> Column:
    """Turn negative zero into zero, so that equal results also print equal."""
    return col + F.lit(0.0)
