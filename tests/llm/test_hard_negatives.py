import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives


def brute(rows, every, positives=5, negatives=3):
    good = [(i, k, [int(np.floor(256 * float(x))) for x in v]) for i, k, v in rows
            if i is not None and k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, k, q in good:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j, m) for j, m, v in good if j != i and len(v) == len(q))
        for s, j, m in [x for x in scored if x[2] == k][:positives]:
            band = [(-t, b) for t, b, o in scored if o != k and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(i, j, nth + 1, b, -s, t) for nth, (t, b) in enumerate(band)]
    return sorted(out)


def run(df, every, **more):
    out = hard_negatives.mine(df, "vec_id", "embedding", F.col("label"), F.col("vec_id") % every == 0, **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("sizes", [{}, {"cell_bytes": 3000, "group_bytes": 1500}])
@pytest.mark.parametrize("kind", ["int", "string"])
def test_equals_brute_force(spark, clash, sizes, kind):
    rng = random.Random(3)
    name = (lambda k: k) if kind == "int" else "kind {}".format
    rows = [(i, name(rng.randrange(3)), [rng.gauss(0.3, 1) for _ in range(9)]) for i in range(90)]
    rows += [(100, *rows[0][1:]), (101, *rows[0][1:]), (101, *rows[0][1:]), (102, name(1), rows[0][2]), (0, *rows[0][1:])]  # ties, repeats
    rows += [(202, name(1), None), (203, name(1), [1.0, None] * 4 + [1.0]), (204, name(1), [float("nan")] * 9), (206, None, rows[1][2]),
             (None, name(1), rows[1][2]), (208, name(1), []), (210, name(1), [2.0] * 3), (211, name(1), [2.0] * 3), (212, name(2), [1.5] * 3),
             (214, name(1), [0.0] * 9), (216, name(0), [-1e-9] * 9)]
    df = clash(spark.createDataFrame(rows, f"vec_id long, label {kind}, embedding array<double>"))
    assert run(df, 2, **sizes) == brute(rows, 2)


def test_empty_table(spark):
    assert run(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"), 1) == []


def test_dense_and_long_vectors(spark):
    """Many rows in one place; vectors of more than one code word."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(240, 100))
    v[:80] = v[0] + 0.02 * v[:80]
    rows = [(i, int(k), x.tolist()) for i, (k, x) in enumerate(zip(rng.integers(0, 4, 240), v, strict=True))]
    got = run(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), 10)
    assert got == brute(rows, 10) and len(got) > 100


@pytest.mark.parametrize("dim", [1, 5, 64, 200])
def test_intervals_hold_and_tell_rows_apart(dim):
    rng = np.random.default_rng(dim)
    q, v = np.floor(256 * rng.normal(size=(20, dim))), np.floor(256 * rng.normal(size=(300, dim)))
    v[:5], v[5:8] = q[:5], 0
    assert np.allclose((hard_negatives.rotate(v) ** 2).sum(axis=1), (v**2).sum(axis=1))
    low, high = hard_negatives.intervals(q, *hard_negatives.codes(v))
    exact = q @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    widest = 2 * np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)) + 1
    assert (high - low)[:, 8:].mean() < 0.8 * widest[:, 8:].mean()


def test_products_beyond_a_long_are_cut(spark):
    rows = [(0, 1, [1e10]), (1, 1, [1e10]), (2, 2, [8e9]), (3, 2, [1.0])]
    got = run(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), 2)
    assert all(r[4] <= (1 << 63) - 1 for r in got)


def test_query_equals_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    rows = [(i, (k + 1) % 10 if i % 7 == 0 else k, v) for i, k, v in rows]
    assert sorted(tuple(r) for r in hard_negatives.op13(spark, folder).collect()) == brute(rows, 50)
