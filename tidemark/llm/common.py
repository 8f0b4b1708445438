"""What the operators of this folder share: passes over whole rows, measured lookups, worker caches.

A *pass* sends chosen columns of each row through Python in Arrow batches and adds columns, one row
out for each row in.  Batches are cut so that a slice holds a bounded number of bytes (or one row).
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.storage import new_path, release, settle

__all__ = ["new_path", "release", "settle"]

# Executors get the functions of this folder by value: they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

SLICE_BYTES = 4 << 20
ANNOTATED_BYTES = 2 << 20  # of a slice that a pass works on
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
# A lookup table is broadcast up to this measured size; beyond it the join shuffles both sides.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of the table has (compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def small_batches(spark: SparkSession) -> None:
    """Have the session send at most ``BATCH_BYTES`` of rows (or one row) to a worker at once.

    Spark's own bound is 64 MB, which an executor holds several times over for each of its tasks.
    """
    now = spark.conf.get(_BATCH_SETTING, None)
    if now is not None and (not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES or int(now.rstrip("b")) <= 0):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def worker_cache() -> dict:
    """A dictionary that outlives a task in a Python worker that is used again."""
    return sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker")).__dict__


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """Have a task's function give memory back to the system when it ends: its worker may idle beside the next stage."""

    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def row_bytes(column: pa.Array) -> np.ndarray:
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.full(len(column), 8, np.int64)


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes of text, or one row."""
    if not batch.num_rows:
        return
    total = np.cumsum(sum(row_bytes(c) for c in batch.columns))
    at = 0
    while at < len(total):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end


Worker = Callable[[list[pa.Array]], list[pa.Array]]


def annotate(
    df: DataFrame, inputs: dict[str, Column | str], added: StructType, make: Callable[[], Worker], keep: list[str]
) -> DataFrame:
    """Keep the columns ``keep`` and add those that the worker computes from the inputs.

    An input is an expression, or the name of a kept column, which is sent once.  ``make`` runs once in each task; its result gets the input arrays of a slice and returns the
    added arrays.  Names of added columns must not be among the kept ones.
    """
    small_batches(df.sparkSession)
    more = [x for x in inputs.values() if not isinstance(x, str)]
    names = fresh(df, *(f"_in{i}" for i in range(len(more))))
    source = df.select(*(col(c) for c in keep), *(x.alias(n) for n, x in zip(names, more, strict=True)))
    kept = len(keep)
    after = iter(range(kept, kept + len(more)))
    places = [keep.index(x) if isinstance(x, str) else next(after) for x in inputs.values()]
    out = StructType([df.schema[c] for c in keep] + list(added.fields))
    titles = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = make()
        for batch in batches:
            for part in slices(batch, ANNOTATED_BYTES):
                columns = part.columns
                yield pa.RecordBatch.from_arrays([*columns[:kept], *worker([columns[i] for i in places])], titles)

    return source.mapInArrow(lean(run), out)


def measured_bytes(df: DataFrame) -> int:
    """Rows and characters of a small table, as bytes of a broadcast (an upper estimate)."""
    text = [F.coalesce(F.sum(F.octet_length(c.name)), F.lit(0)) for c in df.schema if c.dataType.typeName() in ("string", "binary")]
    row = df.agg(F.count(F.lit(1)).alias("n"), sum(text, F.lit(0)).alias("b")).first()
    return int(row["n"]) * (64 + 16 * len(df.columns)) + 2 * int(row["b"])


def lookup(left: DataFrame, right: DataFrame, on: Column, how: str = "left") -> DataFrame:
    """Join with a table that is read more than once; broadcast it only after it was measured.

    Beyond the bound both sides are shuffled, and Spark splits partitions of hot keys on the left.
    """
    small = measured_bytes(right) <= BROADCAST_BYTES
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
