"""Exact nearest neighbours of many points, by a tree of boxes that queries descend level by level.

The reference points are cut into blocks of similar size and small extent.  A node of the tree has at most
``fan`` children, found by cuts through a bounded sample of the node's points; points go down with the
cuts, so any number of blocks needs only more levels.  Of each node its box is known: the range of every
coordinate, which coordinates all or some of its points have, its numbers of points, and the ranges of
distances to a few pivots, which tell more than boxes where there are many coordinates.

A query first follows the closest child to one block.  The neighbours found there bound its search, and it
descends again, to all children whose box can still hold a neighbour.  The root's children are known
everywhere; below, queries meet the children of their node in a shuffle by node.  No pair of a query and a
point outside these blocks is looked at, no point is left out, and at most k candidates per query and
block leave a task.  Blocks, and the queries sent to a node, are split into pieces of bounded size.

Missing coordinates are NULL.  The distance uses the coordinates present on both sides, scaled up by the
share of those used.  Equal points are one row with a multiplicity.  One search serves several *sets*: for
a column, the queries that lack it look for their nearest points that have it.  With few coordinates each
set has a tree of its own, over the points that have the column.  It is cut by which coordinates are
present and by the others, and by the column itself only where the others are equal: a tree cut by a
column that the queries lack would send them to all its parts.  Its blocks are larger and cut into cells of a
few points, of which a query meets those that its bound reaches; points equal but for the column are cut to
the first that can be taken.  Near queries are held against the boxes as one box before each is.

Where every point looks for its nearest others (``nearest_others``), a query's first block is its own.  Inside a
block, cells of a few points are cut, and a query meets the cells that its bound reaches.  Blocks are held against
all queries of a block at once before they are held against each, and only what lies in other blocks is shuffled.
"""

from __future__ import annotations

import heapq
import itertools
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import release, settle

LEAF_POINTS = 2048
FAN = 1024
SAMPLE_PER_CHILD = 16
QUERY_PIECE = 20_000
PIVOTS = 6
FEW_COORDINATES = 4  # boxes alone tell enough
BLOCK_POINTS = 8192  # of blocks that are cut into cells
BLOCK_FAN = 8192
CELL_POINTS = 16
ASK_CHUNK = 64  # queries that are held against boxes as one box first
ASK_ROWS = 100_000  # queries that are cut into such chunks at once
BALANCED = 0.1  # a coordinate that this share of points lack, or have, divides them well


@dataclass
class _Tree:
    """Cuts in arrays; children below zero are blocks (-1 - block).  A missing coordinate goes right."""

    axis: np.ndarray
    cut: np.ndarray  # infinite: the points that have the coordinate go left
    left: np.ndarray
    right: np.ndarray

    def place(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        if len(self.axis) == 0:
            return node
        active = np.arange(len(points))
        while len(active):
            at = node[active]
            goes_left = points[active, self.axis[at]] <= self.cut[at]
            node[active] = np.where(goes_left, self.left[at], self.right[at])
            active = active[node[active] >= 0]
        return -1 - node


def _best_cut(part: np.ndarray, late: int = -1) -> tuple[int, float] | None:
    """A coordinate and where to cut it: by presence where that is balanced, else at the median of the widest.

    Few coordinates are cut by presence first, so that boxes tell the range of each.  The coordinate ``late``
    is cut where the others have no range.
    """
    there = ~np.isnan(part)
    share = there.mean(axis=0)
    even = np.minimum(share, 1 - share)
    if even.max(initial=0) >= BALANCED or part.shape[1] <= FEW_COORDINATES and even.max(initial=0) > 0:
        return int(even.argmax()), np.inf
    filled = np.where(there, part, -np.inf).max(axis=0), np.where(there, part, np.inf).min(axis=0)
    spread = np.where(share > 0, filled[0] - filled[1], 0.0)
    if late >= 0 and np.delete(spread, late).max(initial=0) > 0:
        spread[late] = 0.0
    if spread.max(initial=0) > 0:
        a = int(spread.argmax())
        x = part[there[:, a], a]
        middle = float(np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2])
        if middle == x.max():
            middle = float(x[x < middle].max())
        return a, middle
    return (int(even.argmax()), np.inf) if even.max(initial=0) > 0 else None


def _grow(points: np.ndarray, per_child: int, fan: int, late: int = -1) -> _Tree:
    """At most ``fan`` parts, the largest cut first, until all have at most ``per_child`` sample points."""
    axis, cut, left, right = [], [], [], []
    order = itertools.count()
    open_ = [(-len(points), next(order), points, -1, 0)]
    done = []
    while open_:
        size, _, part, parent, side = heapq.heappop(open_)
        found = _best_cut(part, late) if -size > per_child and len(open_) + len(done) + 1 < fan else None
        if found is None:
            done.append((parent, side))
            continue
        at = len(axis)
        axis.append(found[0])
        cut.append(found[1])
        left.append(0)
        right.append(0)
        if parent >= 0:
            (right if side else left)[parent] = at
        goes_left = part[:, found[0]] <= found[1]
        for some, way in ((part[goes_left], 0), (part[~goes_left], 1)):
            heapq.heappush(open_, (-len(some), next(order), some, at, way))
    for number, (parent, side) in enumerate(done):
        if parent >= 0:
            (right if side else left)[parent] = -1 - number
    return _Tree(*(np.array(v) for v in (axis, cut, left, right)))


def _pick_pivots(sample: np.ndarray, dims: int) -> np.ndarray:
    """Complete points far from one another."""
    whole = sample[~np.isnan(sample).any(axis=1)]
    if dims <= FEW_COORDINATES or not len(whole):
        return np.zeros((0, dims))
    picked = [whole[np.abs(whole - whole.mean(axis=0)).sum(axis=1).argmax()]]
    while len(picked) < PIVOTS:
        far = np.min([((whole - p) ** 2).sum(axis=1) for p in picked], axis=0)
        picked.append(whole[far.argmax()])
    return np.array(picked)


@dataclass
class _Boxes:
    """What is known of the children of a node."""

    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    every: np.ndarray  # all points have the coordinate
    some: np.ndarray
    weight: np.ndarray  # by set
    pivots: np.ndarray
    pivot_low: np.ndarray  # least and greatest squares of distances to pivots; NaN if a point misses a coordinate
    pivot_high: np.ndarray
    total: int

    def of(self, some: np.ndarray) -> _Boxes:
        """Some of the children."""
        rows = {f: getattr(self, f)[some] for f in ("ids", "low", "high", "every", "some", "weight", "pivot_low", "pivot_high")}
        return replace(self, **rows)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance of each query to each box, by the arithmetic of ``_distances``, which is monotone."""
        shape = (len(q), len(self.ids))
        near, far, most, n_every, n_some = (np.zeros(shape) for _ in range(5))
        for j in range(q.shape[1]):
            x, lo, hi = q[:, j : j + 1], self.low[:, j], self.high[:, j]
            has = ~np.isnan(x)
            every, some = has & self.every[:, j], has & self.some[:, j]
            gap = np.maximum(np.maximum(lo - x, x - hi), 0.0)
            reach = np.maximum(np.abs(x - lo), np.abs(x - hi))
            near += np.where(every, gap * gap, 0.0)
            square = reach * reach
            far += np.where(every, square, 0.0)
            most = np.maximum(most, np.where(some, square, 0.0))
            n_every += every
            n_some += some
        with np.errstate(divide="ignore", invalid="ignore"):
            near = np.where(n_some > 0, near * (self.total / n_some), np.inf)
            far = np.where(n_every == n_some, far * (self.total / n_every), most * self.total)
            far = np.where(n_every > 0, far, np.inf)
        if len(self.pivots):
            near = np.maximum(near, self._by_pivots(q))
        return np.sqrt(near), np.sqrt(far) * (1 + 1e-12)

    def near(self, q: np.ndarray, wanted: int, worst: float | None = None) -> _Boxes:
        """Those that can matter to any of some queries, which have the same coordinates: no farther than ``worst``, or
        else than a distance within which each query has as many points as it wants."""
        low, high = q.min(axis=0), q.max(axis=0)
        near, far, most, n_every, n_some = (np.zeros(len(self.ids)) for _ in range(5))
        with np.errstate(divide="ignore", invalid="ignore"):
            for j in np.flatnonzero(~np.isnan(low)):
                lo, hi, every, some = self.low[:, j], self.high[:, j], self.every[:, j], self.some[:, j]
                gap = np.fmax(np.fmax(lo - high[j], low[j] - hi), 0.0)
                reach = np.maximum(np.abs(high[j] - lo), np.abs(hi - low[j]))
                near += np.where(every, gap * gap, 0.0)
                square = reach * reach
                far += np.where(every, square, 0.0)
                most = np.maximum(most, np.where(some, square, 0.0))
                n_every += every
                n_some += some
            near = np.sqrt(np.where(n_some > 0, near * (self.total / n_some), np.inf))
            far = np.where(n_every == n_some, far * (self.total / n_every), most * self.total)
            far = np.sqrt(np.where((n_every > 0) & ~np.isnan(far), far, np.inf)) * (1 + 1e-12)
        limit = self.reach(far[None], wanted).max() if worst is None else worst
        return self.of(np.flatnonzero((near <= limit) & (near < np.inf)))

    def _by_pivots(self, q: np.ndarray) -> np.ndarray:
        """Least squares by the triangle inequality, over the coordinates that the query has."""
        there = ~np.isnan(q)
        out = np.zeros((len(q), len(self.ids)))
        for p, lo, hi in zip(self.pivots, self.pivot_low.T, self.pivot_high.T):
            own = np.sqrt(np.where(there, (q - p) ** 2, 0.0).sum(axis=1))[:, None]
            gap = np.maximum(np.maximum(self.low - p, p - self.high), 0.0) ** 2
            reach = np.maximum(np.abs(p - self.low), np.abs(p - self.high)) ** 2
            with np.errstate(invalid="ignore"):
                least = np.sqrt(np.maximum(lo - (~there) @ np.nan_to_num(reach).T, 0.0))
                greatest = np.sqrt(np.maximum(hi - (~there) @ np.nan_to_num(gap).T, 0.0))
                step = np.maximum(np.maximum(own - greatest, least - own), 0.0) * (1 - 1e-6) - 1e-9 * (own + greatest)
            out = np.fmax(out, np.maximum(step, 0.0) ** 2)
        return out * (self.total / np.maximum(there.sum(axis=1), 1))[:, None]

    def reach(self, far: np.ndarray, wanted: int) -> np.ndarray:
        """For each set a distance within which each query has as many points as it wants."""
        order = np.argsort(far, axis=1)
        ranked = np.take_along_axis(far, order, axis=1)
        out = np.full((len(far), self.weight.shape[1]), np.inf)
        for s in range(self.weight.shape[1]):
            enough = np.cumsum(self.weight[order, s], axis=1) >= wanted
            first = enough.argmax(axis=1)
            out[:, s] = np.where(enough.any(axis=1), ranked[np.arange(len(far)), first], np.inf)
        return out


def _distances(q: np.ndarray, x: np.ndarray, total: int) -> np.ndarray:
    lost = np.isnan(q)
    used = ~lost.all(axis=0) & ~np.isnan(x).all(axis=0)
    if not used.any():
        return np.full((len(q), len(x)), np.inf)
    q, x, lost = q[:, used], x[:, used], lost[:, used]
    if lost.any() and q.shape[1] <= FEW_COORDINATES:  # the queries of a pattern share their coordinates
        out = np.empty((len(q), len(x)))
        pattern = lost @ (1 << np.arange(q.shape[1]))
        for p in np.unique(pattern):
            same = pattern == p
            out[same] = _distances(q[same], x, total)
        return out
    squares = np.zeros((len(q), len(x)))
    shared = np.zeros((len(q), len(x))) if lost.any() or np.isnan(x).any() else None
    for j in range(q.shape[1]):
        step = q[:, j : j + 1] - x[:, j]
        if shared is None:
            squares += step * step
        else:
            both = ~np.isnan(step)
            squares += np.where(both, step * step, 0.0)
            shared += both
    if shared is None:
        return np.sqrt(squares * (total / q.shape[1]))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, np.sqrt(squares * (total / shared)), np.inf)


def _nearest_in_block(q: np.ndarray, x: np.ndarray, total: int, k: int):
    """Row, column and distance of the k nearest of ``x`` per query; ties by the order of ``x``."""
    rows, cols, dists = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    k = min(k, len(x))
    step = max(1, 2_000_000 // max(1, len(x)))
    for start in range(0, len(q), step):
        d = _distances(q[start : start + step], x, total)
        limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        r, c = np.nonzero((d <= limit) & np.isfinite(d))
        order = np.lexsort((c, d[r, c], r))
        r, c = r[order], c[order]
        first = np.searchsorted(r, r, side="left")
        best = np.arange(len(r)) - first < k
        rows.append(r[best] + start)
        cols.append(c[best])
        dists.append(d[r[best], c[best]])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dists)


def _split(x: np.ndarray, least: int) -> list[np.ndarray]:
    """Rows of near points in parts of at least ``least``, unless there are fewer in all, and less than twice as many."""
    parts, open_ = [], [np.arange(len(x))]
    while open_:
        part = open_.pop()
        if len(part) < 2 * least:
            parts.append(part)
            continue
        own = x[part]
        with np.errstate(invalid="ignore"):
            axis = int(np.nan_to_num(own.max(axis=0) - own.min(axis=0), posinf=np.inf).argmax())
        order = np.argpartition(own[:, axis], len(part) // 2)
        open_ += [part[order[len(part) // 2 :]], part[order[: len(part) // 2]]]
    return parts


class _Cells:
    """Points without missing coordinates in cells of a few, so that a query need not look at all of them."""

    def __init__(self, x: np.ndarray, least: int, scale: float = 1.0):
        """Cells as ``_split`` cuts them; squares of distances are scaled."""
        parts = _split(x, least)
        self.scale = scale
        self.rows = np.full((len(parts), max(map(len, parts))), -1)
        for at, part in enumerate(parts):
            self.rows[at, : len(part)] = part
        self.x = np.where(self.rows[..., None] >= 0, x[self.rows], np.nan)
        self.low = np.array([x[p].min(axis=0) for p in parts])
        self.high = np.array([x[p].max(axis=0) for p in parts])

    def _distance(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """By the arithmetic of ``_distances``; NaN where there is no point."""
        squares = np.zeros(np.broadcast_shapes(q.shape, x.shape)[:-1])
        with np.errstate(invalid="ignore"):
            for j in range(q.shape[-1]):
                step = q[..., j] - x[..., j]
                squares += step * step
            return np.sqrt(squares * self.scale)

    def reach(self, k: int) -> np.ndarray:
        """For each point a distance within which its cell has ``k`` others."""
        out = np.full(self.rows.max() + 1, np.inf)
        if self.rows.shape[1] > k:
            step = max(1, 1_000_000 // self.rows.shape[1] ** 2)
            for start in range(0, len(self.rows), step):
                x, rows = self.x[start : start + step], self.rows[start : start + step]
                d = self._distance(x[:, :, None], x[:, None])
                d[np.isnan(d)] = np.inf
                far = np.partition(d, k, axis=2)[:, :, k]
                out[rows[rows >= 0]] = far[rows >= 0]
        return out

    def nearest(self, q: np.ndarray, within: np.ndarray, n: np.ndarray, k: int, own: np.ndarray | None = None, first: bool = False):
        """Query, point, distance and number taken of the ``k`` nearest no farther than ``within``; ties by the order of points.

        ``own`` names the point that each query is itself: it counts once less.  With ``first`` a query looks into
        its closest cell first, which bounds its search.
        """
        found = []
        step = max(1, 100_000 // len(self.rows))
        for start in range(0, len(q), step):
            some, bound = q[start : start + step], within[start : start + step]
            squares = np.zeros((len(some), len(self.rows)))
            with np.errstate(invalid="ignore"):
                for j in range(q.shape[1]):
                    x = some[:, j : j + 1]
                    gap = np.maximum(np.maximum(self.low[:, j] - x, x - self.high[:, j]), 0.0)
                    squares += gap * gap
                least = np.sqrt(squares * self.scale)
                if first and self.rows.shape[1] >= k:
                    d = self._distance(some[:, None], self.x[np.nan_to_num(least, nan=np.inf).argmin(axis=1)])
                    d[np.isnan(d)] = np.inf
                    bound = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1])
                r, cell = np.nonzero(least <= bound[:, None])
                d = self._distance(some[r][:, None], self.x[cell])
                pair, place = np.nonzero((d <= bound[r][:, None]) & (d < np.inf))
            d, r, c = d[pair, place], r[pair], self.rows[cell[pair], place]
            counts = n[c] if own is None else n[c] - (c == own[start + r])
            d, r, c, counts = (v[counts > 0] for v in (d, r, c, counts))
            order = np.lexsort((c, d, r))
            d, r, c, counts = (v[order] for v in (d, r, c, counts))
            before = np.cumsum(counts) - counts
            before -= before[np.searchsorted(r, r, side="left")]
            taken = before < k
            found.append((start + r[taken], c[taken], d[taken], np.minimum(counts, k - before)[taken]))
        return tuple(map(np.concatenate, zip(*found)))


def _nearest_by_cells(q: np.ndarray, x: np.ndarray, n: np.ndarray, total: int, k: int, within: np.ndarray):
    """As ``_nearest_in_block``, of few coordinates and no farther than ``within``.

    Where queries and points share the same coordinates, equal points are as far: only the first that make
    ``k`` can be taken.  The others lie in cells.
    """
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    bits = 1 << np.arange(q.shape[1])
    lost_q, lost_x = np.isnan(q) @ bits, np.isnan(x) @ bits
    for a, b in itertools.product(np.unique(lost_q), np.unique(lost_x)):
        shared = np.flatnonzero((a | b) & bits == 0)
        if not len(shared):
            continue
        rows, cols = np.flatnonzero(lost_q == a), np.flatnonzero(lost_x == b)
        own = x[np.ix_(cols, shared)]
        order = np.lexsort(own.T)
        own, counts = own[order], n[cols[order]]
        before = np.cumsum(counts) - counts
        other = np.append(True, (own[1:] != own[:-1]).any(axis=1))
        before -= np.maximum.accumulate(np.where(other, before, 0))
        some = cols[np.sort(order[before < k])]
        cells = _Cells(x[np.ix_(some, shared)], max(CELL_POINTS, k), total / len(shared))
        r, c, d, _ = cells.nearest(q[np.ix_(rows, shared)], within[rows], n[some], k, first=True)
        found.append((rows[r], some[c], d))
    return map(np.concatenate, zip(*found))


CANDIDATES = "id bigint, set int, point bigint, distance double, v double, n bigint"


def _candidates(asks: pd.DataFrame, points: pd.DataFrame, xs: list[str], sets: Sequence[int], total: int, k: int) -> pd.DataFrame:
    """For each query and set that it belongs to, the k nearest of some points; with few coordinates those ``within`` reach."""
    few = len(xs) <= FEW_COORDINATES
    q, x = asks[xs].to_numpy(dtype=float), points[xs].to_numpy(dtype=float)
    asked, ids, n = asks["id"].to_numpy(), points["id"].to_numpy(), points["n"].to_numpy()
    parts = []
    for number, t in enumerate(sets):
        rows = np.flatnonzero(np.isnan(q[:, t])) if t >= 0 else np.arange(len(q))
        cols = np.flatnonzero(~np.isnan(x[:, t])) if t >= 0 else np.arange(len(x))
        value = x[cols, t] if t >= 0 else np.zeros(len(cols))
        order = np.lexsort((ids[cols], value))
        cols, value = cols[order], value[order]
        if len(rows) and len(cols):
            if few:
                r, c, d = _nearest_by_cells(q[rows], x[cols], n[cols], total, k, asks["within"].to_numpy(dtype=float)[rows])
            else:
                r, c, d = _nearest_in_block(q[rows], x[cols], total, k)
            parts.append((asked[rows[r]], np.full(len(r), number, np.int32), ids[cols[c]], d, value[c], n[cols[c]]))
    if not parts:
        return pd.DataFrame({"id": [], "set": [], "point": [], "distance": [], "v": [], "n": []})
    return pd.DataFrame(dict(zip(("id", "set", "point", "distance", "v", "n"), map(np.concatenate, zip(*parts)))))


def _share(df: DataFrame, value: object) -> Broadcast:
    """Broadcast a value with the code of its classes, so that workers need not have this package."""
    return df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value))


@dataclass
class _Search:
    """A search's parameters, and the tree: points in their blocks, and the boxes of each level."""

    xs: list[str]
    sets: list[int]  # coordinates that queries lack and points have; -1: all queries and points
    total: int
    wanted: int
    leaf_points: int
    fan: int
    pivots: np.ndarray
    written: list[DataFrame] = field(default_factory=list)  # by the driver, on the way

    def __getstate__(self) -> dict:
        return self.__dict__ | {"written": []}

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        self.written.append(settle(df, label))
        return self.written[-1]

    @property
    def late(self) -> int:
        """The coordinate that all queries lack."""
        return self.sets[0] if len(self.sets) == 1 else -1

    def _state(self, *more: str) -> str:
        return ", ".join(["id bigint", *(f"{x} double" for x in self.xs), *more])

    # ------------------------------------------------------------ building

    def build(self, points: DataFrame, size: int) -> tuple[DataFrame, list[DataFrame]]:
        """The points with their block, and the boxes of each level."""
        xs, fan = self.xs, self.fan
        levels = 1
        while fan**levels * self.leaf_points < size:
            levels += 1
        placed = points.select("id", *xs, "n").withColumn("node", F.lit(0).cast("bigint"))
        marks = [f"p{k}" for k in range(len(self.pivots))]
        for level in range(1, levels + 1):
            per_node = min(fan, -(-size // self.leaf_points)) * SAMPLE_PER_CHILD
            share = min(1.0, per_node * fan ** (level - 1) / size)
            picked = F.pmod(F.xxhash64(*xs, "id", F.lit(level)), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))
            sample = placed.where(picked) if share < 1 else placed
            blocks = -(-size // (self.leaf_points * fan ** (level - 1)))
            small = max(1, int(share * self.leaf_points)) if level == levels else max(SAMPLE_PER_CHILD, per_node // fan)
            if level == 1:
                drawn = sample.select(*xs).toPandas().to_numpy(dtype=float)  # at most about fan * SAMPLE_PER_CHILD rows
                self.pivots = _pick_pivots(drawn, len(xs))
                marks = [f"p{k}" for k in range(len(self.pivots))]
                tree = _share(points, (_grow(drawn, small, max(1, min(fan, blocks)), self.late), self.pivots))
                placed = placed.mapInPandas(self._placer(tree), self._state("n bigint", "node bigint", *(f"{m} double" for m in marks)))
            else:
                placed = self._place_below(placed, sample, small, marks)
            placed = self.keep(placed, "placed")
        boxes = [placed.groupBy("node").agg(
            F.count("*").alias("size"),
            *[F.sum(F.col("n") * F.col(xs[t]).isNotNull().cast("int") if t >= 0 else F.col("n")).alias(f"w{s}") for s, t in enumerate(self.sets)],
            *[F.min(x).alias(f"lo_{x}") for x in xs], *[F.max(x).alias(f"hi_{x}") for x in xs], *[F.count(x).alias(f"c_{x}") for x in xs],
            *[F.when(F.count(m) == F.count("*"), F.min(m)).alias(f"pl_{m}") for m in marks],
            *[F.when(F.count(m) == F.count("*"), F.max(m)).alias(f"ph_{m}") for m in marks],
        )]
        boxes[0] = self.keep(boxes[0].withColumn("parent", F.floor(F.col("node") / fan)), "boxes")
        for _ in range(levels - 1):
            below = boxes[0]
            sums = ["size", *(f"w{s}" for s in range(len(self.sets))), *(f"c_{x}" for x in xs)]
            above = below.groupBy(F.col("parent").alias("node")).agg(
                *[F.sum(c).alias(c) for c in sums],
                *[F.min(f"lo_{x}").alias(f"lo_{x}") for x in xs], *[F.max(f"hi_{x}").alias(f"hi_{x}") for x in xs],
                *[F.when(F.count(f"pl_{m}") == F.count("*"), F.min(f"pl_{m}")).alias(f"pl_{m}") for m in marks],
                *[F.when(F.count(f"ph_{m}") == F.count("*"), F.max(f"ph_{m}")).alias(f"ph_{m}") for m in marks],
            )
            boxes.insert(0, self.keep(above.withColumn("parent", F.floor(F.col("node") / fan)), "boxes"))
        return placed, boxes

    def _placer(self, tree: Broadcast):
        xs = self.xs

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cuts, pivots = pickle.loads(tree.value)
            for batch in batches:
                x = batch[xs].to_numpy(dtype=float)
                near = {f"p{k}": ((x - p) ** 2).sum(axis=1) for k, p in enumerate(pivots)}
                yield batch.assign(node=cuts.place(x), **near)

        return place

    def _place_below(self, placed: DataFrame, sample: DataFrame, small: int, marks: list[str]) -> DataFrame:
        """One level further down: each node's points by cuts through its own sample."""
        xs, fan, late = self.xs, self.fan, self.late

        def grow(part: pd.DataFrame) -> pd.DataFrame:
            tree = cloudpickle.dumps(_grow(part[xs].to_numpy(dtype=float), small, fan, late))
            return pd.DataFrame({"node": part["node"].iloc[:1], "tree": [tree]})

        trees = sample.select("node", *xs).groupBy("node").applyInPandas(grow, "node bigint, tree binary")
        pieces = placed.groupBy(F.col("node").alias("of")).agg(F.ceil(F.count("*") / (64 * self.leaf_points)).cast("int").alias("pieces"))
        trees = pieces.join(trees, F.col("of") == F.col("node"), "left").drop("node")
        trees = trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("of", "part", "tree")
        points = placed.join(pieces, F.col("node") == F.col("of")).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
        names = ["id", *xs, "n", "node", *marks]

        def place(points: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            known = tree["tree"].iloc[0] if len(tree) else None
            child = pickle.loads(known).place(points[xs].to_numpy(dtype=float)) if known is not None else 0
            return points[names].assign(node=points["node"] * fan + child)

        schema = self._state("n bigint", "node bigint", *(f"{m} double" for m in marks))
        return points.select(*names, "piece").groupBy("node", "piece").cogroup(trees.groupBy("of", "part")).applyInPandas(place, schema)

    def _boxes(self, rows: pd.DataFrame) -> _Boxes:
        table = lambda start: rows[[f"{start}_{x}" for x in self.xs]].to_numpy(dtype=float)
        marks = [f"p{k}" for k in range(len(self.pivots))]
        pivot = lambda start: rows[[f"{start}_{m}" for m in marks]].to_numpy(dtype=float).reshape(len(rows), len(marks))
        count, size = table("c"), rows["size"].to_numpy()[:, None]
        weight = rows[[f"w{s}" for s in range(len(self.sets))]].to_numpy(dtype=float)
        return _Boxes(
            rows["node"].to_numpy(dtype=np.int64), table("lo"), table("hi"), count == size, count > 0, weight,
            self.pivots, pivot("pl"), pivot("ph"), self.total,
        )

    # ------------------------------------------------------------ descending

    def _belongs(self, q: np.ndarray) -> np.ndarray:
        """Which sets each query belongs to."""
        return np.stack([np.isnan(q[:, t]) if t >= 0 else np.ones(len(q), bool) for t in self.sets], axis=1)

    def _parts(self, batch: pd.DataFrame, boxes: _Boxes) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        step = max(1, 1_000_000 // max(1, len(boxes.ids)))
        for start in range(0, len(batch), step):
            part = batch.iloc[start : start + step]
            yield part, part[self.xs].to_numpy(dtype=float)

    def _near(self, batch: pd.DataFrame, boxes: _Boxes, worst: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, _Boxes]]:
        """Rows of the batch, their coordinates and the boxes that matter to them.

        With few coordinates these are chunks of near queries that lack the same, and boxes are first held against the chunk.
        """
        if len(self.xs) > FEW_COORDINATES:
            step = max(1, 1_000_000 // max(1, len(boxes.ids)))
            for start in range(0, len(batch), step):
                yield np.arange(start, min(start + step, len(batch))), batch[self.xs].iloc[start : start + step].to_numpy(dtype=float), boxes
            return
        q = batch[self.xs].to_numpy(dtype=float)
        lost = np.isnan(q)
        pattern = lost @ (1 << np.arange(q.shape[1]))
        for p in np.unique(pattern):
            rows = np.flatnonzero(pattern == p)
            for part in _split(q[np.ix_(rows, ~lost[rows[0]])], ASK_CHUNK) if not lost[rows[0]].all() else [np.arange(len(rows))]:
                at = rows[part]
                few = boxes.near(q[at], self.wanted, None if worst is None else worst[at].max())
                yield at, q[at], few if len(few.ids) or worst is not None else boxes.of(np.arange(1))

    def closest(self, batch: pd.DataFrame, boxes: _Boxes) -> Iterator[pd.DataFrame]:
        """Each query at its closest child, with a bound of its search by set."""
        reach, found = np.array(batch["reach"].tolist()).reshape(len(batch), -1), []
        for at, q, some in self._near(batch, boxes):
            near, far = some.bounds(q)
            bound = np.minimum(some.reach(far, self.wanted), reach[at])
            least = near.min(axis=1, keepdims=True)
            tie = far
            for t in reversed(self.sets):
                if t >= 0:  # ties go to the smaller value that would be taken
                    tie = np.where(np.isnan(q[:, t : t + 1]), np.nan_to_num(some.low[:, t], nan=np.inf), tie)
            empty = np.stack([some.weight[:, s] == 0 for s in range(len(self.sets))], axis=1)
            useless = (self._belongs(q)[:, None, :] <= empty[None, :, :]).all(axis=2)
            order = np.where((near == least) & ~useless, tie, np.inf)
            best = np.where(np.isinf(order).all(axis=1), np.where(useless, np.inf, near).argmin(axis=1), order.argmin(axis=1))
            found.append((at, bound, some.ids[best]))
        if found:
            at, bound, node = map(np.concatenate, zip(*found))
            yield batch.iloc[at].assign(reach=list(bound), node=node)

    def open(self, batch: pd.DataFrame, boxes: _Boxes) -> Iterator[pd.DataFrame]:
        """Each query at all children that can hold a point nearer than its worst, or as near with a smaller value."""
        worst, tie = (np.array(batch[c].tolist(), float).reshape(len(batch), -1) for c in ("worst", "tie"))
        rows, nodes = [np.zeros(0, int)], [np.zeros(0, int)]
        for at, q, some in self._near(batch, boxes, worst.max(axis=1)):
            near, _ = some.bounds(q)
            belongs = self._belongs(q)
            may = np.zeros(near.shape, bool)
            for s, t in enumerate(self.sets):
                low = np.nan_to_num(some.low[:, t], nan=np.inf) if t >= 0 else np.full(len(some.ids), -np.inf)
                own, own_tie = worst[at, s : s + 1], tie[at, s : s + 1]
                inside = (near < own) | ((near == own) & (low <= own_tie))
                may |= inside & belongs[:, s : s + 1] & (some.weight[:, s] > 0)
            may &= np.isfinite(near)
            r, c = np.nonzero(may)
            rows.append(at[r])
            nodes.append(some.ids[c])
            if sum(map(len, rows)) > ASK_ROWS:
                yield batch.iloc[np.concatenate(rows)].assign(node=np.concatenate(nodes))
                rows, nodes = rows[:1], nodes[:1]
        yield batch.iloc[np.concatenate(rows)].assign(node=np.concatenate(nodes))

    def others(self, batch: pd.DataFrame, boxes: _Boxes) -> Iterator[pd.DataFrame]:
        """Each point at all children that can hold one as near as its worst.  The points of a block, which all have
        all coordinates, are first held against the boxes as one box."""
        for _, block in batch.groupby("home"):
            q, worst = block[self.xs].to_numpy(dtype=float), block["worst"].to_numpy()
            squares = np.zeros(len(boxes.ids))
            with np.errstate(invalid="ignore"):
                for j in range(q.shape[1]):
                    gap = np.maximum(np.maximum(boxes.low[:, j] - q[:, j].max(), q[:, j].min() - boxes.high[:, j]), 0.0)
                    squares += gap * gap
                some = np.flatnonzero(~(np.sqrt(squares) > worst.max()))
            few = boxes.of(some)
            for part, q in self._parts(block, few):
                with np.errstate(invalid="ignore"):
                    near, _ = few.bounds(q)
                r, c = np.nonzero((near <= part["worst"].to_numpy()[:, None]) & np.isfinite(near))
                yield part.iloc[r].assign(node=few.ids[c])

    def descend(self, queries: DataFrame, levels: list[DataFrame], way: str, schema: str) -> DataFrame:
        """Queries at blocks; ``way`` names the step that is taken at each level."""
        first = _share(queries, self._boxes(levels[0].toPandas()))  # at most `fan` rows
        step = getattr(self, way)

        def from_root(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, held = pickle.loads(first.value), []
            for batch in batches:  # more queries lie nearer to one another
                held.append(batch)
                if sum(map(len, held)) >= ASK_ROWS:
                    yield from step(pd.concat(held, ignore_index=True), known)
                    held = []
            if held:
                yield from step(pd.concat(held, ignore_index=True), known)

        at = queries.mapInPandas(from_root, schema)
        for boxes in levels[1:]:
            at = self.keep(at, "descent")
            busy = at.groupBy(F.col("node").alias("of")).agg(F.ceil(F.count("*") / QUERY_PIECE).cast("int").alias("shares"))
            asks = at.join(busy, F.col("node") == F.col("of")).withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"))
            known = boxes.withColumnRenamed("node", "child").join(busy, F.col("parent") == F.col("of"))
            known = known.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
            asks, known = asks.select(*at.columns, "share"), known.drop("of", "shares")
            at = asks.groupBy("node", "share").cogroup(known.groupBy("parent", "copy")).applyInPandas(self._below(way, at.columns), schema)
        return self.keep(at, "sent")

    def _below(self, way: str, names: list[str]):
        def below(asks: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
            if not len(asks) or not len(boxes):
                return asks.iloc[:0][names]
            return pd.concat(list(getattr(self, way)(asks[names], self._boxes(boxes.rename(columns={"child": "node"})))))

        return below

    def probe(self, sent: DataFrame, blocks: DataFrame, bounded: bool) -> DataFrame:
        """Candidates from the blocks the queries were sent to; with few coordinates no farther than ``within``."""
        busy = sent.groupBy("node").agg(F.ceil(F.count("*") / QUERY_PIECE).cast("int").alias("shares"))
        busy = F.broadcast(busy) if bounded else busy
        asked = sent.join(busy, "node").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"))
        sizes = blocks.groupBy("node").agg(F.ceil(F.count("*") / (4 * self.leaf_points)).cast("int").alias("pieces"))
        sizes = F.broadcast(sizes) if bounded else sizes
        asked = asked.join(sizes, "node").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        offered = blocks.join(sizes, "node").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
        offered = offered.join(busy, "node").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        xs, sets, total, wanted = self.xs, self.sets, self.total, self.wanted

        def look(asks: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
            return _candidates(asks, points, xs, sets, total, wanted)

        keys = ["node", "piece", "share"]
        return (
            asked.select(*keys, "id", *xs, "within").groupBy(*keys)
            .cogroup(offered.select(*keys, "id", *xs, "n").groupBy(*keys))
            .applyInPandas(look, CANDIDATES)
        )


def nearest(
    queries: DataFrame,
    points: DataFrame,
    dims: int,
    k: int,
    total: int | None = None,
    skip_self: bool = False,
    leaf_points: int | None = None,
    targets: Sequence[int] | None = None,
    fan: int | None = None,
) -> DataFrame:
    """The ``k`` nearest points of every query.

    ``queries``: ``id`` and coordinates ``x0``...; ``points``: ``id``, coordinates and ``n`` (number of
    equal rows).  Both have to be written tables, as they are read several times and ids must not change.
    Gives ``id``, ``set``, ``point``, ``distance``, ``v``, ``n`` where ``n`` counts the neighbours taken from
    that point; the sum per query is ``k`` unless there are fewer points.  With ``targets`` each query
    has its neighbours for every of these coordinates that it lacks, among the points that have it: ``set``
    is the place in ``targets`` and ``v`` the point's value there, which breaks ties.  With ``skip_self`` a
    row is no neighbour of itself, but its copies are.
    """
    spark = points.sparkSession
    xs = [f"x{j}" for j in range(dims)]
    few = dims <= FEW_COORDINATES
    leaf_points = leaf_points or (BLOCK_POINTS if few else LEAF_POINTS)
    fan = fan or (BLOCK_FAN if few else FAN)
    size = points.count()
    if size == 0:
        return spark.createDataFrame([], CANDIDATES)
    sets = [-1] if targets is None else list(targets)
    if targets is not None and len(sets) > 1 and few:
        found = []
        for number, t in enumerate(sets):
            lack, have = queries.where(F.col(xs[t]).isNull()), points.where(F.col(xs[t]).isNotNull())
            part = nearest(lack, have, dims, k, total, skip_self, leaf_points, [t], fan)
            found.append(part.withColumn("set", F.lit(number)))
        return reduce(DataFrame.unionByName, found)
    search = _Search(xs, sets, total or dims, k + 1 if skip_self else k, leaf_points, fan, np.zeros((0, dims)))
    placed, levels = search.build(points, size)
    blocks, bounded = placed.select("node", "id", *xs, "n"), len(levels) == 1
    none = F.array(*[F.lit(float("inf"))] * len(sets))
    start = queries.select("id", *xs, none.alias("reach"), F.lit(0).cast("bigint").alias("node"))
    home = search.descend(start, levels, "closest", search._state("reach array<double>", "node bigint"))
    first = search.keep(search.probe(home.withColumn("within", F.element_at("reach", 1)), blocks, bounded), "near")
    last = _take(first, search.wanted).groupBy("id", "set").agg(
        F.sum("n").alias("found"), F.max(F.struct("distance", "v")).alias("worst")
    )
    last = last.where(F.col("found") >= search.wanted).groupBy("id")
    last = last.agg(F.map_from_entries(F.collect_list(F.struct("set", "worst"))).alias("known"))
    numbers = F.array(*[F.lit(s) for s in range(len(sets))])
    value = lambda s: F.element_at("known", s)
    reach = lambda s: F.element_at("reach", s + 1)
    inf = F.lit(float("inf"))
    worst = F.transform(numbers, lambda s: F.least(F.coalesce(value(s)["distance"], inf), reach(s)))
    tie = F.transform(
        numbers, lambda s: F.when(F.coalesce(value(s)["distance"], inf) <= reach(s), F.coalesce(value(s)["v"], inf)).otherwise(inf)
    )
    again = home.withColumnRenamed("node", "home").join(last, "id", "left")
    again = again.select("id", *xs, worst.alias("worst"), tie.alias("tie"), "home", F.lit(0).cast("bigint").alias("node"))
    schema = search._state("worst array<double>", "tie array<double>", "home bigint", "node bigint")
    others = search.descend(again, levels, "open", schema).where(F.col("node") != F.col("home"))
    second = search.probe(others.select("id", *xs, "node", F.element_at("worst", 1).alias("within")), blocks, bounded)
    taken = settle(_take(first.unionByName(second), k, skip_self), "nearest")
    release(*search.written)
    return taken


NEIGHBOURS = "node bigint, id bigint, points array<bigint>, distances array<double>, counts array<bigint>, foreign array<bigint>"
OUT = [part.split()[0] for part in NEIGHBOURS.split(", ")]
FOUND = pa.schema([("home", pa.int64()), ("id", pa.int64()), ("point", pa.int64()), ("distance", pa.float64()), ("n", pa.int64())])


def _lists(row: np.ndarray, size: int, *values: np.ndarray) -> list[pa.Array]:
    """Lists of the values of each row; ``row`` is ascending."""
    ends = pa.array(np.searchsorted(row, np.arange(size + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(v)) for v in values]


def _arrays(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def nearest_others(
    points: DataFrame, dims: int, k: int, leaf_points: int = BLOCK_POINTS, fan: int = BLOCK_FAN
) -> DataFrame:
    """The ``k`` nearest others of every point, as a list: nearest first, equal distances by ``id``.

    ``points``: as for ``nearest``, without missing coordinates.  Gives a row per point: ``node``, the block that
    holds it, ``id``, ``points``, ``distances`` and ``counts``, the neighbours taken from each, and ``foreign``, those
    of the points that other blocks hold.  Copies of a point are its neighbours.
    """
    xs = [f"x{j}" for j in range(dims)]
    size = points.count()
    if size == 0:
        return points.sparkSession.createDataFrame([], NEIGHBOURS)
    search = _Search(xs, [-1], dims, k, leaf_points, fan, np.zeros((0, dims)))
    placed, levels = search.build(points, size)
    least = max(CELL_POINTS, k + 1)

    def sorted_points(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        table = table.sort_by("id")
        return table, np.stack(_arrays(table, *xs), axis=1), *_arrays(table, "id", "n")

    def inside(block: pa.Table) -> pa.Table:
        block, x, ids, n = sorted_points(block)
        cells = _Cells(x, least)
        r, c, d, taken = cells.nearest(x, cells.reach(k), n, k, own=np.arange(len(x)))
        enough = np.bincount(r, taken, minlength=len(x)) >= k
        worst = np.full(len(x), np.inf)
        np.maximum.at(farthest := np.zeros(len(x)), r, d)
        worst[enough] = farthest[enough]
        lists = _lists(r, len(x), ids[c], d, taken)
        return pa.table([block["node"], block["id"], *(block[c] for c in xs), pa.array(worst), *lists], names=names)

    names = ["home", "id", *xs, "worst", "points", "distances", "counts"]
    schema = f"home bigint, id bigint, {''.join(f'{x} double, ' for x in xs)}worst double, " + NEIGHBOURS.split(", ", 2)[2].rsplit(", ", 1)[0]
    first = search.keep(placed.select("node", "id", *xs, "n").groupBy("node").applyInArrow(inside, schema), "near")
    asks = first.select("id", *xs, "worst", "home", F.lit(0).cast("bigint").alias("node"))
    sent = search.descend(asks, levels, "others", search._state("worst double", "home bigint", "node bigint"))
    sent = sent.where(F.col("node") != F.col("home"))

    def outside(asked: pa.Table, block: pa.Table) -> pa.Table:
        block, x, ids, n = sorted_points(block)
        if not len(x) or not len(asked):
            return FOUND.empty_table()
        own, home, worst = _arrays(asked, "id", "home", "worst")
        r, c, d, taken = _Cells(x, least).nearest(np.stack(_arrays(asked, *xs), axis=1), worst, n, k)
        return pa.table([home[r], own[r], ids[c], d, taken], names=FOUND.names)

    busy = sent.groupBy("node").agg(F.ceil(F.count("*") / QUERY_PIECE).cast("int").alias("shares"))
    asked = sent.join(busy, "node").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"))
    offered = placed.join(busy, "node").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    found = (
        asked.select("node", "share", "id", *xs, "worst", "home").groupBy("node", "share")
        .cogroup(offered.select("node", "share", "id", *xs, "n").groupBy("node", "share"))
        .applyInArrow(outside, "home bigint, id bigint, point bigint, distance double, n bigint")
    )
    found = _take(found.withColumns({"set": F.lit(0), "v": F.lit(0.0)}), k).select(*FOUND.names)

    def merge(near: pa.Table, far: pa.Table) -> pa.Table:
        near = near.sort_by("id")
        node, ids = near["home"], near["id"].to_numpy()
        lists = [near[c].combine_chunks() for c in ("points", "distances", "counts")]
        row = np.repeat(np.arange(len(ids)), lists[0].value_lengths().to_numpy())
        asker, *more = _arrays(far, "id", "point", "distance", "n")
        row = np.concatenate([row, np.searchsorted(ids, asker)])
        point, d, n = (np.concatenate([a.flatten().to_numpy(), b]) for a, b in zip(lists, more))
        away = np.arange(len(row)) >= len(row) - len(asker)
        order = np.lexsort((point, d, row))
        row, point, d, n, away = (v[order] for v in (row, point, d, n, away))
        before = np.cumsum(n) - n
        before -= before[np.searchsorted(row, row, side="left")]
        taken = before < k
        n = np.minimum(n, k - before)
        out = _lists(row[taken], len(ids), point[taken], d[taken], n[taken])
        return pa.table([node, near["id"], *out, *_lists(row[taken & away], len(ids), point[taken & away])], names=OUT)

    own = first.select("home", "id", "points", "distances", "counts").groupBy("home")
    taken = settle(own.cogroup(found.groupBy("home")).applyInArrow(merge, NEIGHBOURS), "neighbours")
    release(*search.written)
    return taken


def _take(candidates: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """Nearest first, ties by ``v`` then point, until ``k`` neighbours are reached."""
    if skip_self:
        own = F.col("id") == F.col("point")
        candidates = candidates.withColumn("n", F.col("n") - F.when(own, 1).otherwise(0)).where("n > 0")
    order = Window.partitionBy("id", "set").orderBy("distance", "v", "point")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        candidates.withColumn("__upto", F.sum("n").over(upto))
        .where(F.col("__upto") - F.col("n") < k)
        .withColumn("n", F.least(F.col("n"), F.lit(k) - (F.col("__upto") - F.col("n"))))
        .drop("__upto")
    )
