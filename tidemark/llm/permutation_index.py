"""Approximate nearest neighbours by a permutation index.

Pivots are rows drawn by hash.  A vector is represented by the order of its nearest pivots (a prefix of
``PREFIX`` of them).  Its nearest pivot is its cell; cells are kept on *shelves* of a bounded number of rows,
large cells in several.  On a shelf each pivot has an inverted file: the position it has in the prefix of each
row.  A query visits the cells of its nearest pivots, adds up over its first ``COMPARED`` pivots how far each
is from its own place (the footrule distance), and compares the vectors of the rows whose footrule is small.

How many cells a query visits and which footrule is small are fitted: ``PROBES`` queries, drawn by hash, are
compared with all rows, and the bounds are set so that they take in ``TARGET`` of the true neighbours.
The sample of the fit, the pivots and the probes have bounded sizes; every row is indexed.

Nearness is the inner product.  For rows a component is added that makes all norms equal, so that the order of
pivots is that of distances whatever the norms.  Equal vectors are one class, which keeps its ``top`` + 1
smallest ids: no other id of it can be among the results of any query.

Defined results: vectors that are null, zero or empty or hold null or non-finite components, and rows without
an id, take no part; vectors of different lengths are not compared; rows with the query's own id are not its
candidates; each row that is a query gets its results, also where ids repeat; ties go to the smaller id; a
query that finds fewer rows has fewer; an empty table has no rows.  Columns of any further names may be there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructType

from .common import col, fresh, settle, slices, table, union_all
from .vector_search import usable

TOP = 20
QUERY_EVERY = 20
PIVOTS = (16, 1024)  # least and most; between them the root of the number of different vectors
PREFIX = 128
COMPARED = 64
PROBES = 128
TARGET = 0.985
SHELF_ROWS = 16_384
VISITS = 4096  # queries that meet a shelf at once
BLOCK = 64


@dataclass
class Pivots:
    """Pivots of vectors of one length, each with the component that makes norms equal."""

    vectors: np.ndarray
    norm: float  # the largest norm of a row

    def prefix(self) -> int:
        return min(PREFIX, len(self.vectors))

    def order(self, x: np.ndarray, query: bool) -> np.ndarray:
        """The nearest pivots of rows, nearest first."""
        near = x @ self.vectors[:, :-1].T
        if not query:
            near += np.outer(self.lift(x), self.vectors[:, -1])
        return np.argsort(-near, axis=1, kind="stable")[:, : self.prefix()].astype(np.int32)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.norm**2 - (x**2).sum(axis=1), 0))


def positions(order: np.ndarray, pivots: int) -> np.ndarray:
    """The inverted files: for each pivot the place it has in each row's prefix; the prefix's length where it has none."""
    n, length = order.shape
    out = np.full((pivots, n), length, np.uint8)
    out[order, np.arange(n)[:, None]] = np.arange(length, dtype=np.uint8)
    return out


def footrule(files: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Footrule distances of queries (by their pivots' order) and the rows of inverted files, over the queries' first pivots."""
    asked = order[:, :COMPARED]
    place = np.arange(asked.shape[1], dtype=np.uint8)[None, :, None]
    there = files[asked]
    return (np.maximum(there, place) - np.minimum(there, place)).sum(axis=1, dtype=np.int32)


def unpack(column: pa.Array, kind: type, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _keyed(rows: DataFrame, id_: str, vector: str, queries: Column) -> DataFrame:
    """id, vector, query, and two hashes that tell different vectors."""
    flag = fresh(rows, "_query")[0]
    good = rows.withColumn(flag, F.coalesce(queries, F.lit(False))).where(usable(col(vector)) & col(id_).isNotNull())
    good = good.where(F.exists(col(vector), lambda x: x != 0))
    good = good.select(col(id_).cast("long").alias("id"), col(vector).cast("array<double>").alias("vector"), col(flag).alias("query"))
    return good.withColumns({"k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit(7), "vector"), "dim": F.size("vector")})


def classes_of(keyed: DataFrame, top: int) -> DataFrame:
    """k1, k2, dim, vector, ids: different vectors with their smallest ids."""
    first = Window.partitionBy("k1", "k2").orderBy("id")
    few = keyed.drop("query").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= top + 1)
    return few.groupBy("k1", "k2").agg(
        F.first("dim").alias("dim"), F.first("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids")
    )


def draw_pivots(classes: DataFrame, dim: int) -> Pivots:
    """Pivots of the vectors of one length, with the least hashes."""
    own = classes.where(F.col("dim") == dim)
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    n, norm = own.agg(F.count(F.lit(1)), F.max(size)).first()
    count = min(max(int(math.sqrt(n)), PIVOTS[0]), PIVOTS[1], n)
    drawn = own.orderBy("k1", "k2").limit(count).select("vector").toArrow()  # at most PIVOTS[1] rows
    pivots = Pivots(np.zeros((0, dim + 1)), norm)
    v = np.array(drawn.column("vector").to_pylist(), np.float64).reshape(-1, dim)
    pivots.vectors = np.concatenate([v, pivots.lift(v)[:, None]], axis=1)
    return pivots


def build(classes: DataFrame, dim: int, pivots: Pivots) -> DataFrame:
    """The index: cell, k1, ids, vector and prefix (packed numbers) of each different vector."""
    schema = (
        StructType().add("cell", IntegerType()).add("k1", LongType()).add("ids", ArrayType(LongType()))
        .add("vector", BinaryType()).add("prefix", BinaryType())
    )
    sent = classes.sparkSession.sparkContext.broadcast((pivots.vectors, pivots.norm))  # arrays: workers may lack this module

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pivots(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                v = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                order = p.order(v, False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order[:, 0]), part.column(0), part.column(1), _binary(v), _binary(order.astype(np.uint16))], schema.names
                )

    own = classes.where(F.col("dim") == dim).select("k1", "ids", "vector")
    return settle(own.mapInArrow(run, schema), "permutations")


@dataclass
class Reach:
    """How many cells a query visits, and the largest footrule of a row that is compared."""

    cells: int
    footrule: int


def fit(index: DataFrame, probes: np.ndarray, pivots: Pivots, top: int, target: float) -> Reach:
    """Bounds that take in ``target`` of the true neighbours of the probes, which are compared with all rows."""
    schema = StructType().add("probe", IntegerType()).add("score", DoubleType()).add("rank", IntegerType()).add("footrule", IntegerType())
    dim = probes.shape[1]
    order = pivots.order(probes, True)
    sent = index.sparkSession.sparkContext.broadcast((pivots.vectors, pivots.norm, probes, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, (q, asked) = Pivots(*sent.value[:2]), sent.value[2:]
        best = [np.zeros((0, 3)) for _ in q]
        rank = _ranks(p, q)
        for batch in batches:
            for part in slices(batch):
                v = unpack(part.column(1), np.float64, part.num_rows).reshape(-1, dim)
                prefix = unpack(part.column(2), np.uint16, part.num_rows)
                files = positions(prefix, len(p.vectors))
                score = q @ v.T
                score[(q[:, None, :] == v[None, :, :]).all(axis=2) if len(v) * len(q) * dim < 1 << 20 else _same(q, v)] = -np.inf
                for at in range(0, len(q), BLOCK):
                    far = footrule(files, asked[at : at + BLOCK])
                    for i in range(len(far)):
                        cut = np.argpartition(-score[at + i], min(top, len(v) - 1))[:top]
                        rows = np.stack([score[at + i, cut], rank[at + i, prefix[cut, 0]], far[i, cut]], axis=1)
                        rows = np.concatenate([best[at + i], rows[np.isfinite(rows[:, 0])]])
                        best[at + i] = rows[np.argsort(-rows[:, 0], kind="stable")[:top]]
        found = np.concatenate(best) if best else np.zeros((0, 3))
        probe = np.repeat(np.arange(len(q), dtype=np.int32), list(map(len, best)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(probe), pa.array(found[:, 0]), pa.array(found[:, 1].astype(np.int32)), pa.array(found[:, 2].astype(np.int32))], schema.names
        )

    near = index.select("cell", "vector", "prefix").mapInArrow(run, schema)
    nth = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "rank", "footrule"))
    true = near.withColumn("nth", nth).where(F.col("nth") <= top).toArrow()  # at most PROBES * top rows
    if not true.num_rows:
        return Reach(len(pivots.vectors), 255 * COMPARED)
    share = (1 + target) / 2  # each of the two bounds loses half of what may be lost
    at = lambda name: int(np.quantile(true.column(name).to_numpy(), share, method="higher"))
    return Reach(at("rank") + 1, at("footrule"))


def _same(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which rows equal which queries."""
    known = {x.tobytes(): i for i, x in enumerate(v)}
    out = np.zeros((len(q), len(v)), bool)
    for i, x in enumerate(q):
        if x.tobytes() in known:
            out[i, known[x.tobytes()]] = True
    return out


def _ranks(pivots: Pivots, queries: np.ndarray) -> np.ndarray:
    """The place of each pivot in the whole order of each query."""
    near = queries @ pivots.vectors[:, :-1].T
    order = np.argsort(-near, axis=1, kind="stable")
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), 1)
    return out


def shelves(index: DataFrame, pivots: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each cell its first shelf and how many it is spread over; and the number of shelves."""
    count = np.zeros(pivots, np.int64)
    for r in index.groupBy("cell").count().collect():  # a row for each pivot
        count[r["cell"]] = r["count"]
    cores = index.sparkSession.sparkContext.defaultParallelism
    most = min(SHELF_ROWS, max(1024, -(-int(count.sum()) // (2 * cores))))
    first, spread = np.zeros(pivots, np.int32), np.ones(pivots, np.int32)
    shelf, room = 0, most
    for c in np.flatnonzero(count):
        if count[c] > room and room < most:
            shelf, room = shelf + 1, most
        first[c], spread[c] = shelf, -(-count[c] // most)
        if spread[c] > 1:
            shelf, room = shelf + int(spread[c]), most
        else:
            room -= int(count[c])
    return first, spread, shelf + 1


def _visits(asked: DataFrame, dim: int, pivots: Pivots, reach: Reach, places: tuple[np.ndarray, np.ndarray, int]) -> DataFrame:
    """shelf, k1, k2, vector, order, cells: each query at each shelf that has a cell it visits."""
    schema = (
        StructType().add("shelf", IntegerType()).add("k1", LongType()).add("k2", LongType()).add("vector", BinaryType())
        .add("order", BinaryType()).add("cells", BinaryType())
    )
    sent = asked.sparkSession.sparkContext.broadcast((pivots.vectors, pivots.norm, *places[:2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, (first, spread) = Pivots(*sent.value[:2]), sent.value[2:]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                v = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                order = p.order(v, True).astype(np.uint16)
                cells = _ranks(p, v) < reach.cells
                for i in range(part.num_rows):
                    mine = np.flatnonzero(cells[i])
                    on = np.unique(np.concatenate([first[mine], *(np.arange(first[c], first[c] + spread[c]) for c in mine[spread[mine] > 1])]))
                    same = pa.array(np.full(len(on), i))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(on.astype(np.int32)), *(part.column(k).take(same) for k in (0, 1)),
                         *(pa.array([x.tobytes()] * len(on), pa.binary()) for x in (v[i], order[i], np.packbits(cells[i])))], schema.names)

    return settle(asked.where(F.col("dim") == dim).select("k1", "k2", "vector").mapInArrow(run, schema), "visits")


HITS = StructType().add("k1", LongType()).add("k2", LongType()).add("vec_id", LongType()).add("score", DoubleType())


def _search(index: DataFrame, asked: DataFrame, dim: int, pivots: Pivots, reach: Reach, top: int) -> DataFrame:
    """k1, k2 of a query's vector, and its nearest rows found on each shelf."""
    places = shelves(index, len(pivots.vectors))
    first, spread, _ = places
    visits = _visits(asked, dim, pivots, reach, places)
    busy = visits.groupBy("shelf").count().select("shelf", F.ceil(F.col("count") / VISITS).cast("int").alias("parts"))
    parts = settle(busy, "busy")
    number = len(pivots.vectors)
    cells = index.sparkSession.createDataFrame(
        [(int(c), int(first[c]), int(spread[c])) for c in range(number)], "of int, first int, spread int"
    )  # a row for each pivot
    shelved = index.join(F.broadcast(cells), F.col("cell") == F.col("of"))
    shelved = shelved.withColumn("shelf", F.col("first") + F.pmod(F.col("k1"), F.col("spread")).cast("int"))
    rows = shelved.join(parts.withColumnRenamed("shelf", "busy"), F.col("shelf") == F.col("busy"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    queries = visits.join(parts.withColumnRenamed("shelf", "busy"), F.col("shelf") == F.col("busy"))
    queries = queries.withColumn("part", F.pmod(F.col("k1"), F.col("parts")).cast("int"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({f.name: pa.array([], t) for f, t in zip(HITS, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)})
        v = unpack(left["vector"], np.float64, left.num_rows)
        prefix = unpack(left["prefix"], np.uint16, left.num_rows)
        files = positions(prefix, number)
        ids = left["ids"].to_pylist()
        q, order = (unpack(right[k], t, right.num_rows) for k, t in (("vector", np.float64), ("order", np.uint16)))
        visited = np.unpackbits(unpack(right["cells"], np.uint8, right.num_rows), axis=1)[:, :number].astype(bool)
        who, found, scores = [], [], []
        for at in range(0, len(q), BLOCK):
            near = footrule(files, order[at : at + BLOCK]) <= reach.footrule
            near &= visited[at : at + BLOCK][:, prefix[:, 0]]
            score = np.where(near, q[at : at + BLOCK] @ v.T, -np.inf)
            for i in range(len(near)):
                mine = np.flatnonzero(near[i])
                if len(mine) > top + 4:
                    mine = mine[np.argpartition(-score[i, mine], top + 4)[: top + 5]]
                exact = np.einsum("ij,j->i", v[mine], q[at + i])  # each product in the same order of components
                pairs = sorted((-s, x) for s, m in zip(exact.tolist(), mine.tolist(), strict=True) for x in ids[m])[: top + 1]
                who += [at + i] * len(pairs)
                scores += [-s for s, _ in pairs]
                found += [x for _, x in pairs]
        same = pa.array(who, pa.int64())
        return pa.table({"k1": right["k1"].take(same), "k2": right["k2"].take(same), "vec_id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.float64())})

    left = rows.select("shelf", "part", "ids", "vector", "prefix").groupBy("shelf", "part")
    right = queries.select("shelf", "part", "k1", "k2", "vector", "order", "cells").groupBy("shelf", "part")
    return left.cogroup(right).applyInArrow(meet, HITS)


def nearest(rows: DataFrame, id_: str, vector: str, queries: Column, top: int = TOP, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found for each row for which ``queries`` holds."""
    keyed = settle(_keyed(rows, id_, vector, queries), "keyed")
    classes = settle(classes_of(keyed, top), "classes")
    asked = settle(keyed.where("query").select("k1", "k2", "dim", "vector").dropDuplicates(["k1", "k2"]), "asked")
    hits = []
    for dim in sorted(r["dim"] for r in asked.select("dim").distinct().collect()):  # lengths of vectors; one, as a rule
        pivots = draw_pivots(classes, dim)
        index = build(classes, dim, pivots)
        drawn = asked.where(F.col("dim") == dim).orderBy("k2", "k1").limit(PROBES).select("vector").toArrow()  # at most PROBES rows
        probes = np.array(drawn.column("vector").to_pylist(), np.float64).reshape(-1, dim)
        hits.append(_search(index, asked, dim, pivots, fit(index, probes, pivots, top, target), top))
    if not hits:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id")
    found = union_all(hits).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= top + 1)
    found = found.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), "vec_id", "score")
    own = keyed.where("query").select("id", "k1", "k2", F.monotonically_increasing_id().alias("row"))
    out = own.join(found, (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2")) & (F.col("id") != F.col("vec_id")))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("vec_id") % QUERY_EVERY == 0)
