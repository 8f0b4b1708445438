"""Exact top-k search with multi-resolution segment statistics.

Components are scaled and floored to integers.  With means m and deviations s of segments of length n,
the squared distance of q and x is at least the sum of n * ((mq - mx)^2 + (sq - sx)^2) over segments, so
their inner product is at most the sum of n * (mq * mx + sq * sx).  A tile of candidates is tested from
one segment to finer ones; rows and queries whose bound stays below the query's k-th score leave the
tile, and the rest gets exact products.  Queries are cut into blocks of a bounded size, each broadcast
and compared with all rows; a task returns k rows per query.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id,
take no part; only vectors of the same length are compared; empty vectors have products of 0; rows with
the query's own id are not its candidates; repeated candidates each count; products beyond the range of
a long are cut to it; an empty table has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import col, fresh, table, union_all

SCALE = 256
TOP = 5
QUERY_EVERY = 50
BLOCK_BYTES = 8 << 20
TILE = 2048
LEVELS = (1, 4, 16)
_LONG = (-(1 << 63), (1 << 63) - 1)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad


def statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of segments, each times the root of the segment's length."""
    parts = []
    for cut in np.array_split(np.arange(v.shape[1]), min(segments, max(1, v.shape[1]))):
        x = v[:, cut]
        n = max(1, x.shape[1])
        mean = x.sum(axis=1) / n
        parts += [mean * math.sqrt(n), np.sqrt(((x - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(parts, axis=1)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of integers that are held as doubles."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q @ v.T).astype(np.int64)
    if most < 2.0**63:
        return q.astype(np.int64) @ v.astype(np.int64).T
    exact = lambda a: np.array([[int(x) for x in row] for row in a], object).reshape(a.shape)
    return np.clip(exact(q) @ exact(v).T, *_LONG).astype(np.int64)


class Search:
    """Best rows so far of a block of queries of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: int) -> None:
        self.ids, self.vectors, self.top = ids, vectors, top
        self.levels = [statistics(vectors, s) for s in LEVELS]
        self.norm = np.sqrt((vectors**2).sum(axis=1))
        self.score = np.full((len(ids), top), _LONG[0], np.int64)
        self.row = np.full((len(ids), top), _LONG[1], np.int64)
        self.found = np.zeros(len(ids), np.int64)

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        queries, rows = np.arange(len(self.ids)), np.arange(len(ids))
        norm = np.sqrt((vectors**2).sum(axis=1))
        floor = np.where(self.found >= self.top, self.score[:, -1].astype(np.float64), -np.inf)
        for k, segments in enumerate(LEVELS):
            stats = statistics(vectors[rows], segments)
            bound = self.levels[k][queries] @ stats.T
            slack = 1e-9 * np.outer(self.norm[queries], norm[rows]) + 1e-6
            open_ = bound + slack >= floor[queries][:, None]
            queries, rows = queries[open_.any(axis=1)], rows[open_.any(axis=0)]
            if not len(queries) or not len(rows):
                return
        score = products(self.vectors[queries], vectors[rows])
        score_f = score.astype(np.float64)
        hit = (score_f >= floor[queries][:, None]) & (self.ids[queries][:, None] != ids[rows][None, :])
        for i in np.flatnonzero(hit.any(axis=1)):
            q, mine = queries[i], hit[i]
            s = np.concatenate([self.score[q, : self.found[q]], score[i, mine]])
            r = np.concatenate([self.row[q, : self.found[q]], ids[rows[mine]]])
            best = np.lexsort((r, -s.astype(object) if s.min(initial=0) == _LONG[0] else -s))[: self.top]
            self.found[q] = len(best)
            self.score[q, : len(best)], self.row[q, : len(best)] = s[best], r[best]


def matrix(column: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and floored vectors of a list column, by vector length."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(offsets)
    out = {}
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        out[int(n)] = rows, np.floor(scale * values[offsets[rows][:, None] + np.arange(n)])
    return out


def top_products(
    rows: DataFrame, id_: str, vector: str, queries: Column, top: int = TOP, scale: int = SCALE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """query_id, rank, id, score: the best rows of each row for which ``queries`` holds."""
    spark = rows.sparkSession
    flag = fresh(rows, "_query")[0]
    good = rows.withColumn(flag, F.coalesce(queries, F.lit(False))).where(usable(col(vector)) & col(id_).isNotNull())
    good = good.select(col(id_).cast("long").alias("id"), col(vector).cast("array<double>").alias("vector"), col(flag).alias("query"))
    asked = good.where("query").select("id", "vector")
    size = asked.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks = max(1, math.ceil(size[0] * ((size[1] or 0) + 8) * 8 / block_bytes))
    schema = StructType().add("query_id", LongType()).add("vec_id", LongType()).add("score", LongType())
    parts = []
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow().combine_chunks()  # about block_bytes
        ids = mine.column("id").to_numpy()
        lists = mine.column("vector").combine_chunks() if mine.num_rows else pa.array([], pa.list_(pa.float64()))
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        block = spark.sparkContext.broadcast({n: (ids[r], v) for n, (r, v) in matrix(lists, scale).items()})

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            searches = {n: Search(i, v, top) for n, (i, v) in block.value.items()}
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for n, (r, v) in matrix(batch.column(1), scale).items():
                    for a in range(0, len(r) if n in searches else 0, TILE):
                        searches[n].offer(ids[r[a : a + TILE]], v[a : a + TILE])
            for s in searches.values():
                there = np.arange(top) < s.found[:, None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(s.ids, s.found)), pa.array(s.row[there]), pa.array(s.score[there])], schema.names
                )

        parts.append(good.select("id", "vector").mapInArrow(run, schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = union_all(parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return top_products(rows, "vec_id", "embedding", F.col("vec_id") % QUERY_EVERY == 0)


SQL = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % {QUERY_EVERY} = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= {TOP}
"""
