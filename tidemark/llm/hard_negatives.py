"""Hard-negative mining by rotated one-bit codes with their alignment.

Components are scaled and floored to integers.  A vector v is rotated (signs drawn from a seed and Hadamard
transforms, norms unchanged); its code c holds the signs of the result, as a unit vector, and its alignment
a = <v, c> is stored with it.  v - a c is at right angles to c and has the length r = sqrt(|v|^2 - a^2).  For an
anchor q, t = <q, c> is estimated by popcounts of the code and the bit planes of q rounded to a few bits, which
is off by no more than the length e of what was rounded away.  By Cauchy and Schwarz

    | <q, v> - a t |  <=  r sqrt(|q|^2 - t^2)

so <q, v> lies in an interval of a known width around a t.  Rows whose interval cannot reach the scores asked
for are left out; the others get exact integer products.

Rows are dealt to cells and anchors to groups, both of bounded sizes; each cell meets each group once, first for
the positives, then, with the positives' scores, for the negatives.  Results are exact.

Defined results: rows with a null label or id, a null vector, or a null or non-finite component take no part;
only vectors of the same length are compared; rows with the anchor's own id are not its positives or negatives;
each row that is an anchor has its results, and repeated positives and negatives each count; ties go to the
smaller id; an anchor without positives, or a positive without negatives in its band, has no rows; an empty
table has none.  Products beyond the range of a long are cut to it.  Columns of any further names may be there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructType

from .common import col, fresh, settle, table
from .vector_search import matrix, products, usable

SCALE = 256
ANCHOR_EVERY = 50
POSITIVES = 5
NEGATIVES = 3
BAND = (50, 95)  # per cent of the positive's score
PLANES = 6  # bits of a rounded anchor
CELL_BYTES = 16 << 20
GROUP_BYTES = 8 << 20
BLOCK = 32


def rotate(v: np.ndarray, seed: int = 20240611) -> np.ndarray:
    """Rows turned by a fixed orthonormal map of the next power of two (64 at least) of dimensions."""
    size = max(64, 1 << max(0, v.shape[1] - 1).bit_length())
    out = np.zeros((len(v), size))
    out[:, : v.shape[1]] = v
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, size))
    for s in signs:
        out *= s
        half = 1
        while half < size:
            pair = out.reshape(len(v), -1, 2, half)
            out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(v), size)
            half *= 2
        out /= math.sqrt(size)
    return out


def _words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(np.uint64)


def codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code words, alignment and norm of each row."""
    u = rotate(v)
    return _words(u >= 0), np.abs(u).sum(axis=1) / math.sqrt(u.shape[1]), np.sqrt((v**2).sum(axis=1))


def intervals(q: np.ndarray, words: np.ndarray, alignment: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner products of anchors with coded rows."""
    u = rotate(q)
    size = u.shape[1]
    low = u.min(axis=1, keepdims=True)
    step = np.maximum(u.max(axis=1, keepdims=True) - low, 1e-300) / ((1 << PLANES) - 1)
    level = np.rint((u - low) / step)
    error = np.sqrt(((u - low - step * level) ** 2).sum(axis=1, keepdims=True))
    count = lambda plane: np.bitwise_count(words[None, :, :] & plane[:, None, :]).sum(axis=2, dtype=np.int32)
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int32)
    weighted = np.zeros((len(q), len(words)), np.int64)
    for k in range(PLANES):
        weighted += count(_words((level.astype(np.int64) >> k & 1).astype(bool))).astype(np.int64) << k
    t = (low * (2 * ones - size)[None, :] + step * (2 * weighted - level.sum(axis=1, keepdims=True))) / math.sqrt(size)
    length = np.sqrt((q**2).sum(axis=1, keepdims=True))
    rest = np.sqrt(np.maximum(norm**2 - alignment**2, 0))
    across = np.sqrt(np.maximum(length**2 - np.maximum(np.abs(t) - error, 0) ** 2, 0))
    slack = alignment * error + rest * across + 1e-9 * length * norm + 1e-6
    return alignment * t - slack, alignment * t + slack


def encode(rows: DataFrame, scale: int) -> DataFrame:
    """row, id, dim, label, anchor, vector, words, alignment, norm: integers and codes of usable rows."""
    schema = StructType().add("id", LongType()).add("label", StringType()).add("anchor", rows.schema["anchor"].dataType)
    for name, kind in (("dim", IntegerType()), ("vector", BinaryType()), ("words", BinaryType()), ("alignment", DoubleType()), ("norm", DoubleType())):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for n, (which, v) in matrix(pa.concat_arrays([part.column(3)]), scale).items():
                    same = pa.array(which)
                    words, alignment, norm = codes(v)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(k).take(same) for k in range(3)), pa.array(np.full(len(which), n, np.int32)), _rows(v), _rows(words),
                         pa.array(alignment), pa.array(norm)], schema.names)

    made = rows.select("id", "label", "anchor", "vector").mapInArrow(run, schema)
    return settle(settle(made, "codes").withColumn("row", F.monotonically_increasing_id()), "codes")


def _rows(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _array(column: pa.ChunkedArray, kind: type, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)


class Cell:
    """Rows of a cell, and the anchors of a group that meet them."""

    def __init__(self, rows: pa.Table, anchors: pa.Table) -> None:
        n, m = rows.num_rows, anchors.num_rows
        dim = rows["dim"][0].as_py()
        self.v, self.words = _array(rows["vector"], np.float64, n).reshape(n, dim), _array(rows["words"], np.uint64, n)
        self.alignment, self.norm, self.id = (rows[k].to_numpy() for k in ("alignment", "norm", "id"))
        self.q, self.own = _array(anchors["vector"], np.float64, m).reshape(m, dim), anchors["id"].to_numpy()
        kinds = pa.concat_arrays([*rows["label"].chunks, *anchors["label"].chunks]).dictionary_encode().indices.to_numpy()
        self.label, self.asked = kinds[:n], kinds[n:]

    def blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each anchor with the intervals of all rows."""
        for at in range(0, len(self.q), BLOCK):
            low, high = intervals(self.q[at : at + BLOCK], self.words, self.alignment, self.norm)
            for k in range(len(low)):
                yield at + k, low[k], high[k]

    def scores(self, anchor: int, rows: np.ndarray) -> np.ndarray:
        return products(self.q[anchor : anchor + 1], self.v[rows])[0]


def positives_of(cell: Cell, most: int) -> Iterator[tuple[int, int, int]]:
    """Anchor, id and score of its best rows of the same label."""
    for k, low, high in cell.blocks():
        mine = np.flatnonzero((cell.label == cell.asked[k]) & (cell.id != cell.own[k]))
        if len(mine) > most:  # as many rows reach this floor for certain
            mine = mine[~(high[mine] < np.partition(low[mine], -most)[-most])]
        score = cell.scores(k, mine)
        for i in _first(score, cell.id[mine], most):
            yield k, int(cell.id[mine[i]]), int(score[i])


def negatives_of(cell: Cell, positives: list[list[int]], most: int, band: tuple[int, int]) -> Iterator[tuple[int, int, int, int]]:
    """Anchor, place of the positive, id and score of the best rows of other labels in the positive's band."""
    for k, low, high in cell.blocks():
        scores = positives[k]
        other = np.flatnonzero((cell.label != cell.asked[k]) & (cell.id != cell.own[k]))
        l, h = low[other], high[other]
        open_ = np.zeros(len(other), bool)
        for p in scores:
            bottom, top = band[0] * p / 100, band[1] * p / 100
            slack = 1e-9 * abs(p) + 1e-6
            may = ~(h < bottom - slack) & ~(l > top + slack)
            sure = l[(h <= top - slack) & (l >= bottom + slack)]
            if len(sure) > most:
                may &= ~(h < np.partition(sure, -most)[-most])
            open_ |= may
        mine = other[open_]
        score = cell.scores(k, mine)
        for nth, p in enumerate(scores):
            inside = np.flatnonzero(in_band(score, p, band))
            for i in _first(score[inside], cell.id[mine[inside]], most):
                yield k, nth, int(cell.id[mine[inside[i]]]), int(score[inside[i]])


def in_band(score: np.ndarray, positive: int, band: tuple[int, int]) -> np.ndarray:
    if abs(positive) < 1 << 55 and np.abs(score.astype(np.float64)).max(initial=0) < 1 << 55:
        return (band[0] * positive <= 100 * score) & (100 * score <= band[1] * positive)
    return np.array([band[0] * positive <= 100 * s <= band[1] * positive for s in score.tolist()], bool)


def _first(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    if len(score) > 8 * most:
        some = np.flatnonzero(score >= np.partition(score, -most)[-most])
        return some[np.lexsort((ids[some], -score[some].astype(object)) if score.min() == -(1 << 63) else (ids[some], -score[some]))][:most]
    return np.lexsort((ids, -score.astype(object) if score.min(initial=0) == -(1 << 63) else -score))[:most]


def _meeting(rows: DataFrame, anchors: DataFrame, cells: int, groups: int) -> tuple[DataFrame, DataFrame]:
    """Both sides so that each cell of rows meets each group of anchors under the same keys."""
    left = rows.withColumn("cell", F.pmod("row", F.lit(cells)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = anchors.withColumn("group", F.pmod("nth", F.lit(groups)).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    return left, right


def mine(
    rows: DataFrame, id_: str, vector: str, label: Column, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    band: tuple[int, int] = BAND, scale: int = SCALE, cell_bytes: int = CELL_BYTES, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    kind, flag = fresh(rows, "_label", "_anchor")
    good = rows.withColumns({kind: label.cast("string"), flag: F.coalesce(anchors, F.lit(False))})
    good = good.where(usable(col(vector)) & col(id_).isNotNull() & col(kind).isNotNull())
    good = good.select(
        col(id_).cast("long").alias("id"), col(kind).alias("label"), col(flag).alias("anchor"), col(vector).cast("array<double>").alias("vector")
    )
    coded = encode(good, scale)
    n, asked, dim = coded.agg(F.count(F.lit(1)), F.count_if("anchor"), F.coalesce(F.max("dim"), F.lit(0))).first()
    row_bytes = 10 * dim + 64
    cores = spark.sparkContext.defaultParallelism
    most = max(1, min(cell_bytes // row_bytes, max(1024, -(-n // (2 * cores)))))
    cells, groups = max(1, -(-n // most)), max(1, -(-asked * row_bytes // group_bytes))
    keys = ["dim", "cell", "group"]
    fields = ["id", "dim", "label", "vector", "words", "alignment", "norm"]
    first = settle(coded.where("anchor").select(F.col("row").alias("nth"), "id", "dim", "label", "vector"), "anchors")
    found = StructType().add("nth", LongType()).add("other", LongType()).add("score", LongType())

    def meet_same(left: pa.Table, right: pa.Table) -> pa.Table:
        hits = list(positives_of(Cell(left, right), positives)) if left.num_rows and right.num_rows else []
        return _table(hits, right, found.names)

    left, right = _meeting(coded, first, cells, groups)
    left = left.select(*fields, "cell", "group").groupBy(*keys)
    hits = left.cogroup(right.groupBy(*keys)).applyInArrow(meet_same, found)
    best = Window.partitionBy("nth").orderBy(F.desc("score"), "other")
    hits = hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    chosen = hits.groupBy("nth").agg(F.sort_array(F.collect_list(F.struct("place", "other", "score"))).alias("positives"))  # `positives` at most
    chosen = settle(chosen, "positives")
    second = first.join(chosen.withColumnRenamed("nth", "of"), F.col("nth") == F.col("of")).select(*first.columns, F.col("positives.score").alias("scores"))
    second = settle(second, "anchors")
    pair = StructType().add("nth", LongType()).add("place", LongType()).add("other", LongType()).add("score", LongType())

    def meet_other(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([], right, pair.names)
        return _table(list(negatives_of(Cell(left, right), right["scores"].to_pylist(), negatives, band)), right, pair.names)

    left, right = _meeting(coded, second, cells, groups)
    left = left.select(*fields, "cell", "group").groupBy(*keys)
    hits = left.cogroup(right.groupBy(*keys)).applyInArrow(meet_other, pair)
    best = Window.partitionBy("nth", "place").orderBy(F.desc("score"), "other")
    hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    names = first.select("nth", F.col("id").alias("anchor_id")).join(chosen.withColumnRenamed("nth", "of"), F.col("nth") == F.col("of"))
    names = names.select(F.col("of"), "anchor_id", "positives")
    out = hits.join(names, F.col("nth") == F.col("of"))
    positive = F.element_at("positives", (F.col("place") + 1).cast("int"))
    return out.select(
        "anchor_id", positive["other"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"),
        positive["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )


def _table(hits: list[tuple[int, ...]], anchors: pa.Table, names: list[str]) -> pa.Table:
    """Hits with their anchor's number in the table replaced by its own."""
    columns = [np.array(x, np.int64) for x in zip(*hits, strict=True)] if hits else [np.zeros(0, np.int64)] * len(names)
    if hits:
        columns[0] = anchors["nth"].to_numpy()[columns[0]]
    return pa.table(dict(zip(names, map(pa.array, columns), strict=True)))


def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, "vec_id", "embedding", label, F.col("vec_id") % ANCHOR_EVERY == 0)


SQL = f"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
         cast(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
  from v a join v c on a.vec_id <> c.vec_id and len(a.v) = len(c.v) where a.vec_id % {ANCHOR_EVERY} = 0),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score
  from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as nth from s where same) where nth <= {POSITIVES}),
n as (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
         row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same
   and {BAND[0]} * positive_score <= 100 * s.score and 100 * s.score <= {BAND[1]} * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= {NEGATIVES}
"""
