"""Gradient boosting of trees for any number of classes, by histograms that tasks aggregate.

Features are binned once at approximate quantiles; bin 0 holds missing cells, which go left.  Each round adds
one tree whose leaves have a value for every class.  Its cuts are found level by level: a pass over the rows
adds up gradients of the softmax by node, feature and bin, and the best cut of a node comes from running sums
over bins.  With more than ``SKETCH`` classes the gradients of a row are projected to that many numbers for the
search of cuts, so its cost does not depend on the number of classes; leaves always get exact sums (a Newton
step).  Rows keep no scores: a pass works them out from the trees so far, which are small and known everywhere.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from ..functions.columns import as_double
from ..functions.storage import settle

BINS = 32
SKETCH = 8
LEAST_LEAF = 5
SHRINK = 1.0  # added to counts and curvatures
CELLS = 2_000_000  # rows times classes worked on at once


@dataclass
class Tree:
    """Levels of cuts (feature, last bin that goes left; feature -1: all go left), and the leaves' values by class."""

    cuts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    values: np.ndarray | None = None

    def node(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        for feature, last in self.cuts:
            cut = feature[at]
            right = (cut >= 0) & (bins[np.arange(len(bins)), np.maximum(cut, 0)] > last[at])
            at = 2 * at + right
        return at


@dataclass
class Boosted:
    """Edges of the bins, scores before the first tree, the trees, and the gain of each feature."""

    features: list[str]
    edges: list[np.ndarray]
    start: np.ndarray
    trees: list[Tree] = field(default_factory=list)
    gain: np.ndarray | None = None

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.uint8)
        for j, edges in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(edges, x[:, j], "left"))
        return out

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.tile(self.start, (len(bins), 1))
        for tree in self.trees:
            out += tree.values[tree.node(bins)]
        return out

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        """The rows with the number of their likeliest class."""
        sent = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(self))
        schema = StructType([*df.schema, StructType().add(name, IntegerType())[0]])
        wide = df.select("*", *[as_double(df, c).alias(f"__x{j}") for j, c in enumerate(self.features)])
        kept = len(df.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = pickle.loads(sent.value)
            for batch in batches:
                bins = model.bins(_matrix(batch.columns[kept:], batch.num_rows))
                best = [model.scores(bins[a : a + step]).argmax(axis=1) for step in [_step(model)] for a in range(0, len(bins), step)]
                best = np.concatenate(best) if best else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(best.astype(np.int32))], schema.names)

        return wide.mapInArrow(run, schema)


def _step(model: Boosted) -> int:
    return max(1, CELLS // len(model.start))


def _matrix(columns: Sequence[pa.Array], rows: int) -> np.ndarray:
    made = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns]
    return np.stack(made, axis=1) if made else np.zeros((rows, 0))


def _softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


def _edges(rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    shares = [k / BINS for k in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(as_double(rows, c), shares, 2000).alias(f"q{j}") for j, c in enumerate(features)]).first()
    return [np.unique(np.array(found[f"q{j}"] or [], np.float64)) for j in range(len(features))]


def _passes(table: DataFrame, model: Boosted, tree: Tree, schema: StructType, add) -> DataFrame:
    """A pass over the binned rows; ``add`` gets bins, labels, nodes and probabilities and adds to a dictionary of arrays."""
    sent = table.sparkSession.sparkContext.broadcast(cloudpickle.dumps((model, tree)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, growing = pickle.loads(sent.value)
        total = None
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            label = batch.column(1).to_numpy()
            step = _step(known)
            for a in range(0, len(bins), step):
                part = bins[a : a + step]
                found = add(part, label[a : a + step], growing.node(part), _softmax(known.scores(part)))
                total = found if total is None else total + found
        if total is not None:
            at = np.nonzero(np.abs(total).sum(axis=-1))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x.astype(np.int32)) for x in at), *(pa.array(total[at][:, k]) for k in range(total.shape[-1]))], schema.names
            )

    return table.mapInArrow(run, schema)


def _grow_level(table: DataFrame, model: Boosted, tree: Tree, sketch: np.ndarray | None) -> None:
    """Find the best cut of each node of the last level."""
    nodes, width = 1 << len(tree.cuts), len(model.features)
    classes = len(model.start)
    size = classes if sketch is None else sketch.shape[1]
    sums = [f"g{k}" for k in range(size)]
    schema = StructType().add("node", IntegerType()).add("feature", IntegerType()).add("bin", IntegerType()).add("n", DoubleType())
    for name in sums:
        schema = schema.add(name, DoubleType())

    def add(bins: np.ndarray, label: np.ndarray, node: np.ndarray, chance: np.ndarray) -> np.ndarray:
        slope = -chance
        slope[np.arange(len(label)), label] += 1
        slope = slope if sketch is None else slope @ sketch
        out = np.zeros((nodes, width, BINS + 1, 1 + size))
        for j in range(width):
            at = node * (BINS + 1) + bins[:, j]
            out[:, j, :, 0] = np.bincount(at, minlength=nodes * (BINS + 1)).reshape(nodes, -1)
            for k in range(size):
                out[:, j, :, 1 + k] = np.bincount(at, slope[:, k], nodes * (BINS + 1)).reshape(nodes, -1)
        return out

    cells = _passes(table, model, tree, schema, add).groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ["n", *sums]])
    one = Window.partitionBy("node", "feature")
    left = one.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cells.select("node", "feature", "bin", *[F.sum(c).over(left).alias(f"l_{c}") for c in ["n", *sums]], *[F.sum(c).over(one).alias(f"t_{c}") for c in ["n", *sums]])

    def part(n, g):
        return sum((x * x for x in g), F.lit(0.0)) / (n + F.lit(SHRINK))

    lefts, totals = [F.col(f"l_{c}") for c in sums], [F.col(f"t_{c}") for c in sums]
    rest = F.col("t_n") - F.col("l_n")
    gain = part(F.col("l_n"), lefts) + part(rest, [t - x for x, t in zip(lefts, totals)]) - part(F.col("t_n"), totals)
    cuts = run.withColumn("gain", gain).where((F.col("l_n") >= LEAST_LEAF) & (rest >= LEAST_LEAF) & (F.col("gain") > 1e-9))
    best = cuts.groupBy("node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))).alias("best"))
    feature, last = np.full(nodes, -1, np.int64), np.zeros(nodes, np.int64)
    for r in best.collect():  # a row for each node of a level
        feature[r["node"]], last[r["node"]] = -r["best"]["f"], -r["best"]["b"]
        model.gain[-r["best"]["f"]] += r["best"]["gain"]
    tree.cuts.append((feature, last))


def _fill_leaves(table: DataFrame, model: Boosted, tree: Tree, rate: float) -> None:
    leaves, classes = 1 << len(tree.cuts), len(model.start)
    schema = StructType().add("leaf", IntegerType()).add("class", IntegerType()).add("g", DoubleType()).add("h", DoubleType())

    def add(bins: np.ndarray, label: np.ndarray, node: np.ndarray, chance: np.ndarray) -> np.ndarray:
        out = np.zeros((leaves, classes, 2))
        order = np.argsort(node, kind="stable")
        kinds, first = np.unique(node[order], return_index=True)
        out[kinds, :, 0] = -np.add.reduceat(chance[order], first, axis=0)
        out[kinds, :, 1] = np.add.reduceat((chance * (1 - chance))[order], first, axis=0)
        np.add.at(out[:, :, 0], (node, label), 1)
        return out

    sums = _passes(table, model, tree, schema, add).groupBy("leaf", "class").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    got = sums.toArrow()  # a row for each leaf and class
    values = np.zeros((leaves, classes))
    g, h = got["g"].to_numpy(), got["h"].to_numpy()
    values[got["leaf"].to_numpy(), got["class"].to_numpy()] = rate * g / (h + SHRINK / classes)
    tree.values = np.clip(values, -4, 4)
    model.trees.append(tree)


def fit_boosted(
    rows: DataFrame, label: str, classes: int, features: Sequence[str], rounds: int = 10, depth: int = 3, rate: float = 0.5, seed: int = 42
) -> Boosted:
    """Fit on rows whose column ``label`` has numbers from 0 to ``classes`` - 1; feature cells may be missing."""
    features = list(features)
    model = Boosted(features, _edges(rows, features), np.zeros(classes), gain=np.zeros(len(features)))
    sent = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    wide = rows.select(F.col(label).cast("int").alias("__label"), *[as_double(rows, c).alias(f"__x{j}") for j, c in enumerate(features)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(sent.value)
        for batch in batches:
            bins = known.bins(_matrix(batch.columns[1:], batch.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bins], pa.binary()), batch.column(0)], ["bins", "label"])

    table = settle(wide.mapInArrow(pack, "bins binary, label int"), "bins")
    count = np.zeros(classes)
    for r in table.groupBy("label").count().collect():  # a row for each class
        count[r["label"]] = r["count"]
    model.start = np.log((count + 0.5) / (count.sum() + 0.5 * classes))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        sketch = None if classes <= SKETCH else rng.normal(size=(classes, SKETCH)) / np.sqrt(SKETCH)
        tree = Tree()
        for _ in range(depth):
            _grow_level(table, model, tree, sketch)
            if (tree.cuts[-1][0] < 0).all():
                break
        _fill_leaves(table, model, tree, rate)
    return model
