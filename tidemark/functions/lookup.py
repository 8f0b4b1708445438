"""Joining a table with a table of unique keys, safe for hot keys on the big side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import ref
from .storage import settle

BROADCAST_ROWS = 500_000
BROADCAST_CHARS = 64 * 1024 * 1024
SALT_ROWS = 1_000_000
MOST_HOT = 100_000


def fits_broadcast(df: DataFrame, rows: int | None = None, chars: int | None = None) -> bool:
    """Measure rows and characters of a table with one aggregation."""
    rows = BROADCAST_ROWS if rows is None else rows
    chars = BROADCAST_CHARS if chars is None else chars
    width = F.lit(0)
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.length(ref(f.name)), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width = width + F.length(F.to_json(F.struct(ref(f.name))))
        else:
            width = width + F.lit(8)
    seen = df.agg(F.count("*").alias("n"), F.sum(width.cast("bigint")).alias("chars")).first()
    return seen["n"] <= rows and (seen["chars"] or 0) <= chars


def hot_keys(big: DataFrame, on: Sequence[str], salt_rows: int = SALT_ROWS) -> DataFrame:
    """Keys with more than ``salt_rows`` rows, at most ``MOST_HOT`` of them, and their number of salts ``__hot``."""
    counted = settle(big.groupBy(*[ref(c) for c in on]).agg(F.count("*").alias("__n")), "keys")
    total = counted.agg(F.sum("__n")).first()[0] or 0
    each = max(salt_rows, total // MOST_HOT)
    return counted.where(F.col("__n") > each).withColumn("__hot", F.ceil(F.col("__n") / each).cast("int")).drop("__n")


def _has_map(dtype: T.DataType) -> bool:
    return "map<" in dtype.simpleString() or "variant" in dtype.simpleString()


def lookup_join(
    big: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    null_safe: bool = False,
    rows: int | None = None,
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """Join ``big`` with ``lookup``, whose keys are unique.

    A lookup of measured small size is broadcast, so ``big`` is not shuffled.  With a larger one both
    are shuffled by key, except that the rows of a hot key get salts, one per ``salt_rows`` rows, and its
    lookup row a copy per salt: a key that holds a third of all rows is spread over many tasks.  The salt
    is a hash of the row, so a task that runs again gives the same rows.
    """
    on = list(on)
    keys = [f"__key_{i}" for i in range(len(on))]
    other = lookup.select(
        *[ref(c).alias(key) for c, key in zip(on, keys)], *[ref(c) for c in lookup.columns if c not in on]
    )

    def same(left: Sequence[str], right: Sequence[str]) -> Column:
        pairs = [ref(a).eqNullSafe(ref(b)) if null_safe else ref(a) == ref(b) for a, b in zip(left, right)]
        return reduce(and_, pairs)

    if fits_broadcast(lookup, rows):
        return big.join(F.broadcast(other), same(on, keys), how).drop(*keys)
    marks = [f"__hot_{i}" for i in range(len(on))]
    hot = settle(hot_keys(big, on, salt_rows).select(*[ref(c).alias(m) for c, m in zip(on, marks)], "__hot"), "hot")
    is_hot = [reduce(and_, [ref(c).eqNullSafe(ref(m)) for c, m in zip(cols, marks)]) for cols in (on, keys)]
    spread = F.coalesce(F.pmod(F.xxhash64(*[ref(f.name) for f in big.schema if not _has_map(f.dataType)]), F.col("__hot")), F.lit(0))
    copies = F.coalesce(F.col("__hot") - 1, F.lit(0))
    salted = big.join(F.broadcast(hot), is_hot[0], "left").withColumn("__salt", spread.cast("int")).drop("__hot", *marks)
    copied = (
        other.join(F.broadcast(hot), is_hot[1], "left")
        .withColumn("__copy", F.explode(F.sequence(F.lit(0), copies)))
        .drop("__hot", *marks)
    )
    match = same(on, keys) & (F.col("__salt") == F.col("__copy"))
    return salted.join(copied, match, how).drop(*keys, "__salt", "__copy")


def looked_up(words: Column, table: DataFrame) -> Column:
    """For each word of an array its value in a table of two text columns, NULL where the table lacks it.

    The table is broadcast as it is, so it must be of measured small size; the words are looked up in place.
    """
    word, value = table.columns
    pairs = table.where(ref(word).isNotNull()).toArrow()
    shared = table.sparkSession.sparkContext.broadcast(dict(zip(*[c.to_pylist() for c in pairs.columns])))

    def look(words: pa.Array) -> pa.Array:
        known = shared.value
        coded = words.flatten().dictionary_encode()
        found = pa.array([known.get(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), found, mask=words.is_null())

    return F.arrow_udf(look, "array<string>")(words)
