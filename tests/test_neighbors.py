"""The tree of boxes against brute force: several levels, many columns, many patterns of missing cells, ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.storage import settle
from tidemark.operators import lof, neighbors
from tidemark.operators.imputers import knn_fill


def brute(q, x, n, k, targets):
    """id, set: value and distance of the k nearest, as sorted lists."""
    out = {}
    for i, a in enumerate(q):
        for s, t in enumerate(targets):
            if t >= 0 and not np.isnan(a[t]):
                continue
            found = []
            for j, b in enumerate(x):
                if t >= 0 and np.isnan(b[t]):
                    continue
                both = ~np.isnan(a) & ~np.isnan(b)
                if both.any():  # ties are those of this arithmetic
                    d = np.sqrt(sum((a[both] - b[both]) ** 2, start=0.0) * (len(a) / both.sum()))
                    found += [(d, b[t] if t >= 0 else 0.0)] * n[j]
            out[i, s] = [(round(d, 9), v) for d, v in sorted(found)[:k]]
    return out


def run(spark, q, x, n, k, targets, **more):
    dims = q.shape[1]
    schema = "id long, " + ", ".join(f"x{j} double" for j in range(dims))
    cells = lambda row: [None if np.isnan(v) else float(v) for v in row]
    queries = settle(spark.createDataFrame([(i, *cells(r)) for i, r in enumerate(q)], schema))
    points = settle(spark.createDataFrame([(j, *cells(r), int(m)) for j, (r, m) in enumerate(zip(x, n))], schema + ", n long"))
    out = {}
    wanted = None if targets == [-1] else targets
    for r in neighbors.nearest(queries, points, dims, k, targets=wanted, **more).collect():
        out.setdefault((r["id"], r["set"]), []).extend([(round(r["distance"], 9), r["v"])] * r["n"])
    return {key: sorted(v) for key, v in out.items()}


def table(seed, rows, dims, holes, digits):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(rows, dims)) @ np.diag(np.linspace(0.2, 3, dims)), digits)
    x[rng.random(x.shape) < holes] = np.nan
    return x, rng.integers(1, 4, rows)


@pytest.mark.parametrize(("dims", "holes", "digits", "leaf", "fan"), [(2, 0.3, 1, 4, 4), (3, 0.0, 0, 3, 3), (7, 0.4, 1, 8, 64), (40, 0.2, 2, 16, 5)])
def test_nearest_equals_brute_force(spark, dims, holes, digits, leaf, fan):
    x, n = table(dims, 150, dims, holes, digits)
    q, _ = table(dims + 1, 30, dims, max(holes, 0.2), digits)
    for targets in ([-1], [0, dims - 1]):
        got = run(spark, q, x, n, 4, targets, leaf_points=leaf, fan=fan)
        want = brute(q, x, n, 4, targets)
        assert {k: v for k, v in want.items() if v} == got


def test_pivots_prune_and_hold():
    """Bounds are bounds of the distances as computed, and pivots tell more than boxes where there are many coordinates."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2)) @ rng.normal(size=(2, 30)) + 0.01 * rng.normal(size=(400, 30))
    q = x[:20] + 0.01
    q[::2, 3] = np.nan
    for pivots in (np.zeros((0, 30)), neighbors._pick_pivots(x, 30)):
        tree = neighbors._grow(x, 10, 1024)
        leaf = tree.place(x)
        ids = np.unique(leaf)
        parts = [x[leaf == i] for i in ids]
        square = [((p[:, None, :] - pivots[None]) ** 2).sum(axis=2) for p in parts]
        stack = lambda f, xs: np.array([f(p, axis=0) for p in xs])
        true = np.ones((len(ids), 30), bool)
        boxes = neighbors._Boxes(ids, stack(np.min, parts), stack(np.max, parts), true, true, np.array([[len(p)] for p in parts]),
                                 pivots, stack(np.min, square), stack(np.max, square), 30)
        near, far = boxes.bounds(q)
        for b, p in enumerate(parts):
            d = neighbors._distances(q, p, 30)
            assert (near[:, b] <= d.min(axis=1)).all() and (d.max(axis=1) <= far[:, b]).all()
        fifth = np.sort(neighbors._distances(q, x, 30), axis=1)[:, 4:5]
        opened = (near <= fifth).sum()
        assert opened < len(q) * len(ids) / 2
        before = opened if not len(pivots) else before
    assert opened <= before


def test_a_coordinate_that_all_share(spark):
    """All points at one distance: only blocks with the smallest values are opened."""
    x = np.array([[1.0, float(i)] for i in range(300)])
    q = np.array([[1.0, np.nan], [5.0, np.nan]])
    got = run(spark, q, x, np.ones(300, int), 3, [1], leaf_points=8)
    assert got == {(0, 0): [(0.0, 0.0), (0.0, 1.0), (0.0, 2.0)], (1, 0): [(round(4 * 2**0.5, 9), float(v)) for v in range(3)]}


def test_knn_fill_of_forty_columns(spark):
    """More columns than a bit mask of patterns would hold, nearly every row with a pattern of its own."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(120, 3)) @ rng.normal(size=(3, 40))
    x = np.where(rng.random(base.shape) < 0.1, np.nan, np.round(base, 3))
    names = [f"c{j}" for j in range(40)]
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + ", ".join(f"{c} double" for c in names))
    got = knn_fill(df, names, k=3, leaf_points=16).orderBy("i").toPandas()[names].to_numpy()
    want = x.copy()
    targets = list(range(40))
    found = brute(x, x, np.ones(len(x), int), 3, targets)
    for (i, s), near in found.items():
        want[i, s] = np.mean([v for _, v in near])
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_driver_gets_only_the_root(spark):
    """With more blocks than the root has children, boxes stay in tables."""
    x, n = table(1, 400, 2, 0.0, 3)
    seen = []
    original = neighbors._Search._boxes
    try:
        neighbors._Search._boxes = lambda self, rows: seen.append(len(rows)) or original(self, rows)
        got = run(spark, x[:20], x, n, 3, [-1], leaf_points=4, fan=4)
    finally:
        neighbors._Search._boxes = original
    assert max(seen) <= 4
    assert got == brute(x[:20], x, n, 3, [-1])


def test_queries_lacking_the_widest_coordinate_meet_few_blocks(spark, monkeypatch):
    # a column of wide range that queries lack: a tree cut by it would send each query to most of its blocks
    rng = np.random.default_rng(7)
    met = {}
    probe = neighbors._Search.probe

    def counted(self, sent, blocks, bounded):
        met[size] = met.get(size, 0) + sent.count()
        return probe(self, sent, blocks, bounded)

    monkeypatch.setattr(neighbors._Search, "probe", counted)
    for size in (1000, 8000):
        x = np.round(np.stack([rng.random(size) * 50, rng.random(size) * 100 * size, rng.random(size) * 200], axis=1), 1)
        x[rng.random(size) < 0.05, 0] = np.nan
        q = np.stack([rng.random(60) * 50, np.full(60, np.nan), np.round(rng.random(60) * 200)], axis=1)
        got = run(spark, q, x, np.ones(size, int), 3, [0, 1], leaf_points=32)
        if size == 1000:
            assert got == {k: v for k, v in brute(q, x, np.ones(size, int), 3, [0, 1]).items() if v}
    assert met[8000] < 2 * met[1000], met


@pytest.mark.parametrize(("dims", "holes", "spread", "leaf"), [(2, 0.3, 3, 64), (3, 0.25, 4, 40), (4, 0.4, 3, 200), (1, 0.3, 9, 50)])
def test_cells_of_few_coordinates_equal_brute_force(spark, dims, holes, spread, leaf):
    """Large blocks of several patterns, with many points that differ in the target only, copies and ties."""
    rng = np.random.default_rng(dims)
    x = rng.integers(0, spread, (260, dims)).astype(float)
    x[:, 0] = np.round(rng.random(260) * 5, 1)
    x[rng.random(x.shape) < holes] = np.nan
    q = rng.integers(0, spread + 2, (50, dims)).astype(float)
    q[rng.random(q.shape) < 0.4] = np.nan
    n = rng.integers(1, 4, len(x))
    targets = sorted({0, dims - 1})
    got = run(spark, q, x, n, 5, targets, leaf_points=leaf)
    assert got == {key: sorted(v) for key, v in brute(q, x, n, 5, targets).items() if v}


def test_a_query_of_few_coordinates_meets_few_points_and_boxes(monkeypatch):
    """Not all points of a block, nor all boxes of a node: before, each query was held against each of them."""
    rng = np.random.default_rng(5)
    x = rng.random((4000, 3)) * [50, 1000, 200]
    x[::2, 1] = np.nan
    x[::2, 2] = np.floor(x[::2, 2] / 20) * 20  # equal but for the target
    q = rng.random((500, 3)) * [50, 1000, 200]
    q[:, 0] = np.nan
    xs, met = ["x0", "x1", "x2"], {"points": 0, "boxes": 0}
    count = lambda kind, size: met.__setitem__(kind, met[kind] + size)
    distances, cells, bounds = neighbors._distances, neighbors._Cells._distance, neighbors._Boxes.bounds
    monkeypatch.setattr(neighbors, "_distances", lambda q, x, total: count("points", len(q) * len(x)) or distances(q, x, total))
    monkeypatch.setattr(neighbors._Cells, "_distance", lambda self, q, x: [d := cells(self, q, x), count("points", d.size)][0])
    monkeypatch.setattr(neighbors._Boxes, "bounds", lambda self, q: count("boxes", len(q) * len(self.ids)) or bounds(self, q))
    asks = pd.DataFrame(q, columns=xs).assign(id=np.arange(len(q)), within=np.inf)
    points = pd.DataFrame(x, columns=xs).assign(id=np.arange(len(x)), n=1)
    found = neighbors._candidates(asks, points, xs, [0], 3, 5)
    want = brute(q, x, np.ones(len(x), int), 5, [0])
    near = found.sort_values(["id", "distance", "v", "point"]).groupby("id").head(5)
    assert {(i, 0): [(round(d, 9), v) for d, v in zip(g["distance"], g["v"])] for i, g in near.groupby("id")} == want
    assert met["points"] < len(q) * len(x) / 4, met

    q = rng.random((5000, 3)) * [50, 1000, 200]
    q[:, 0] = np.nan
    asks = pd.DataFrame(q, columns=xs).assign(id=np.arange(len(q)))
    leaf = neighbors._grow(x, 16, 1024, 0).place(x)
    ids = np.unique(leaf)
    parts = [x[leaf == i] for i in ids]
    stack = lambda f: np.array([f(pd.DataFrame(p)).to_numpy() for p in parts])
    boxes = neighbors._Boxes(ids, stack(lambda p: p.min()), stack(lambda p: p.max()), stack(lambda p: p.notna().all()), stack(lambda p: p.notna().any()),
                             np.array([[len(p)] for p in parts]), np.zeros((0, 3)), np.zeros((len(ids), 0)), np.zeros((len(ids), 0)), 3)
    search = neighbors._Search(xs, [0], 3, 5, 16, 1024, np.zeros((0, 3)))
    home = pd.concat(search.closest(asks.assign(reach=[[np.inf]] * len(q), node=0), boxes)).sort_values("id")
    near, far = bounds(boxes, q)
    assert met["boxes"] < len(q) * len(ids) / 3, met
    assert (near[np.arange(len(q)), np.searchsorted(ids, home["node"])] == near.min(axis=1)).all()
    assert np.array_equal(np.stack(home["reach"]), boxes.reach(far, 5))


@pytest.mark.parametrize(("dims", "digits", "leaf", "fan", "rows"), [(2, 1, 16, 4, 300), (3, 0, 8, 64, 120), (7, 1, 64, 1024, 150), (1, 0, 4, 3, 40)])
def test_others_equal_brute_force(spark, dims, digits, leaf, fan, rows):
    """Neighbours over several levels and blocks, with copies and ties, which go to the smaller id."""
    x, n = table(dims, rows, dims, 0.0, digits)
    x, first = np.unique(x, axis=0, return_index=True)
    n, k = n[first], 5
    cells = ", ".join(f"x{j} double" for j in range(dims))
    points = settle(spark.createDataFrame([(i, *map(float, r), int(m)) for i, (r, m) in enumerate(zip(x, n))], f"id long, {cells}, n long"))
    found = neighbors.nearest_others(points, dims, k, leaf_points=leaf, fan=fan).collect()
    assert len(found) == len(x)
    block = {r["id"]: r["node"] for r in found}
    for r in found:
        d = np.sqrt(sum((x - x[r["id"]]).T ** 2, start=0.0))
        near = [(d[j], j) for j in range(len(x)) for _ in range(n[j] - (j == r["id"]))]
        got = [(e, p) for e, p, c in zip(r["distances"], r["points"], r["counts"]) for _ in range(c)]
        assert got == sorted(near)[:k]
        assert sorted(r["foreign"]) == sorted(p for p in r["points"] if block[p] != r["node"])


def test_outlier_factor_moves_candidates_of_other_blocks_only(spark, monkeypatch):
    """Most points have all neighbours in their block: a row for each of them is not shuffled."""
    rows, k, seen = 3000, 5, []
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(np.round(rng.random((rows, 2)) * 100, 3).tolist(), "a double, b double")
    take = neighbors._take
    monkeypatch.setattr(neighbors, "_take", lambda found, *more: seen.append(found.count()) or take(found, *more))
    assert lof.lof_scores(df, ["a", "b"], k, leaf_points=1024).where("lof is null").count() == 0
    assert 0 < sum(seen) < rows * k / 4, seen
