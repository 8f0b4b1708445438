"""Texts from files and from tables."""

from __future__ import annotations

import itertools
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ref
from ..functions.storage import release, settle
from ..operators.duplicates import dense_row_id

ROWS_PER_PART = 1000
BATCH_BYTES = 4 * 1024 * 1024
TASK_BYTES = 64 * 1024 * 1024  # of files that a task reads; opening one counts as OPEN_BYTES
OPEN_BYTES = 64 * 1024

# The folder of missing and empty cells, and the characters of folders that Spark escapes.
NO_NAME = "__HIVE_DEFAULT_PARTITION__"
SPECIAL = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
# Characters of a path that make it a pattern, those that are escaped in the name of a file, and names of files that Hadoop unpacks.
PATTERN = re.compile(r"[*?\[\]{}\\]")
UNSAFE = re.compile(r"""[\x00-\x20"#%<>?\[\\\]^`{|}\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]""")
PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".passthrough")


def read_documents(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """One row per file: ``path``, ``text``.

    ``nested`` takes the files of all folders below, and works out no columns from folders named ``name=value``.
    Those of ``file:`` are listed and read by tasks of many files each; Spark's reader lists each folder in a task
    and looks up all codecs for each file.
    """
    files = _files_below(spark, path) if nested else None
    if files is not None:
        return files
    files = spark.read.option("recursiveFileLookup", nested).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _local(spark: SparkSession, path: str) -> tuple[Any, Any, str | None]:
    """The file system of a path and the path in it, as Hadoop has them, and its name on the machines if it is ``file:``."""
    context = spark.sparkContext
    top = context._jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(context._jsc.hadoopConfiguration())
    top = system.makeQualified(top)
    return system, top, top.toUri().getPath() if top.toUri().getScheme() == "file" else None


def _files_below(spark: SparkSession, path: str) -> DataFrame | None:
    """The documents of a local folder; None if it is none, or if files are packed and need a codec."""
    top = None if PATTERN.search(path) else _local(spark, path)[2]
    if top is None or not os.path.isdir(top):
        return None
    cores = spark.sparkContext.defaultParallelism
    found = settle(spark.range(0, 4 * cores, 1, 4 * cores).mapInArrow(_lister(top, 4 * cores), "file string, bytes bigint, packed boolean"), "files")
    seen = found.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.count_if("packed").alias("packed")).first()
    if seen["packed"]:
        release(found)
        return None
    tasks = max(cores, -(-((seen["bytes"] or 0) + OPEN_BYTES * seen["n"]) // TASK_BYTES))
    read = found.select("file").repartition(tasks).mapInArrow(_reader(), "path string, text binary")
    return read.select("path", F.col("text").cast("string").alias("text"))


def _lister(top: str, tasks: int):
    """Files below a folder, without those that Spark's readers skip: hidden and empty ones.  A task has a share of the folder's entries."""
    packed = PACKED

    def hidden(name: str, folder: bool) -> bool:
        if folder and name.startswith(("_metadata", "_common_metadata")):
            return False
        return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")

    def below(share: int) -> Iterator[tuple[str, int, bool]]:
        folders = [top]
        while folders:
            here = folders.pop()
            with os.scandir(here) as entries:
                for entry in entries:
                    folder = entry.is_dir()
                    if here == top and zlib.crc32(os.fsencode(entry.name)) % tasks != share or hidden(entry.name, folder):
                        continue
                    if folder:
                        folders.append(entry.path)
                    elif size := entry.stat().st_size:
                        yield entry.path, size, entry.name.lower().endswith(packed)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = (f for batch in batches for share in batch.column(0).to_pylist() for f in below(share))
        while some := list(itertools.islice(files, 10_000)):
            yield pa.RecordBatch.from_pydict(dict(zip(("file", "bytes", "packed"), zip(*some))))

    return put


def _reader():
    """Whole files, with their names as Spark writes them."""
    unsafe, most = UNSAFE, BATCH_BYTES
    escape = lambda m: "".join(f"%{b:02X}" for b in m[0].encode())

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, texts, held = [], [], 0
        for file in (f for batch in batches for f in batch.column(0).to_pylist()):
            with open(file, "rb") as source:
                texts.append(source.read())
            paths.append("file:" + unsafe.sub(escape, file))
            held += len(texts[-1]) + len(paths[-1])
            if held >= most:
                yield pa.RecordBatch.from_pydict({"path": paths, "text": texts})
                paths, texts, held = [], [], 0
        if paths:
            yield pa.RecordBatch.from_pydict({"path": paths, "text": texts})

    return put


def write_files(df: DataFrame, path: str, folders: list[str]) -> None:
    """Texts into files of folders that are named by some columns.

    Tasks put their files in place themselves; else the driver would move one file after the other at the end.
    Hadoop's writer for ``file:`` starts several processes for each file and folder where its native library is
    missing; there tasks write the same files without it.
    """
    system, top, name = _local(df.sparkSession, path)
    rest = [f for f in df.schema if f.name not in folders]
    plain = len(rest) == 1 and isinstance(rest[0].dataType, T.StringType) and set(folders) < set(df.columns)
    if name is None or not plain or system.exists(top):  # the writer says what is wrong
        df.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*folders).text(path)
        return
    system.mkdirs(top)
    names = [F.coalesce(F.nullif(ref(c).cast("string"), F.lit("")), F.lit(NO_NAME)).alias(f"n{i}") for i, c in enumerate(folders)]
    named = df.select(*names, ref(rest[0].name).cast("binary").alias("text")).sortWithinPartitions(*[f"n{i}" for i in range(len(folders))])
    named.mapInArrow(_putter(name, folders), "files bigint").write.format("noop").mode("overwrite").save()
    system.create(df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(top, "_SUCCESS")).close()


def _putter(top: str, folders: list[str]):
    """Writes the lines of a task, sorted by folder, into a file for each folder.

    A file gets its name when it is whole, and the same one if the task is tried again.
    """
    job, special = uuid.uuid4().hex, SPECIAL
    escape = lambda name: special.sub(lambda m: f"%{ord(m[0]):02X}", name)
    starts = [f"{escape(c)}=" for c in folders]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{job}.txt"
        hidden = f".{name}.{task.taskAttemptId()}"
        at = file = folder = None
        files = 0
        for batch in batches:
            *named, texts = batch.columns
            for *here, text in zip(*(c.to_pylist() for c in named), texts):
                if here != at:
                    if file:
                        file.close()
                        os.replace(f"{folder}/{hidden}", f"{folder}/{name}")
                    at, folder = here, "/".join([top, *(s + escape(n) for s, n in zip(starts, here))])
                    os.makedirs(folder, exist_ok=True)
                    file = open(f"{folder}/{hidden}", "wb")
                    files += 1
                file.write((text.as_py() or b"") + b"\n")
        if file:
            file.close()
            os.replace(f"{folder}/{hidden}", f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"files": [files]})

    return put


def write_text(df: DataFrame, column: str, path: str, mode: str = "error") -> None:
    df.select(ref(column)).write.mode(mode).text(path)


def collapse_column(
    df: DataFrame,
    column: str,
    order: list[str],
    key: list[str] | None = None,
    rows_per_part: int = ROWS_PER_PART,
    position: str | None = None,
) -> DataFrame:
    """Join the texts of a column with blanks, in order, per key.

    A text is cut into parts of at most ``rows_per_part`` rows, so that no key, and no whole table
    without a key, has to fit in one row; the parts in order, joined with blanks, are the text.
    ``position`` names a column that already numbers the rows of a key; without it the rows of the
    table are numbered by key and order.
    """
    keys = list(key or [])
    if position is None:
        numbered = dense_row_id(df, [*keys, *order], "__spot")
        spot = F.col("__spot")
    else:
        numbered, spot = df, ref(position)
    placed = numbered.select(
        *[ref(c) for c in keys],
        F.floor(spot / rows_per_part).cast("bigint").alias("part"),
        spot.cast("bigint").alias("__at"),
        F.coalesce(ref(column).cast("string"), F.lit("nan")).alias("__text"),
    )
    rows = F.sort_array(F.collect_list(F.struct("__at", "__text")))
    return placed.groupBy(*[ref(c) for c in keys], "part").agg(
        F.array_join(F.transform(rows, lambda r: r["__text"]), " ").alias("text")
    )


def json_values(text: Column) -> Column:
    """The values of a JSON object or list, joined with blanks."""
    as_map = F.map_values(F.from_json(text, "map<string,string>"))
    as_list = F.from_json(text, "array<string>")
    return F.array_join(F.when(F.ltrim(text).startswith("["), as_list).otherwise(as_map), " ")


def json_lines(text: Column) -> Column:
    """A JSON object as lines ``key: value``, a list as one line per item."""
    pairs = F.transform(
        F.map_entries(F.from_json(text, "map<string,string>")),
        lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None"))),
    )
    items = F.from_json(text, "array<string>")
    return F.array_join(F.when(F.ltrim(text).startswith("["), items).otherwise(pairs), "\n")


def header_line(df: DataFrame) -> str:
    return "Columns: " + " | ".join(df.columns)


def row_lines(df: DataFrame, name: str = "line") -> DataFrame:
    """Every row as one line, cells joined with `` | ``; missing cells read ``nan``."""
    cells = [F.coalesce(ref(c).cast("string"), F.lit("nan")) for c in df.columns]
    return df.select(F.concat_ws(" | ", *cells).alias(name))
