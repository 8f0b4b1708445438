import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import permutation_index as index


def brute(rows, every, top):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            s = sorted((-float(np.einsum("ij,j->i", np.array([v], float), np.array(q, float))[0]), j) for j, v in good if j != i and len(v) == len(q))
            out.setdefault(i, []).append([(j, -x) for x, j in s[:top]])
    return out


def run(df, every, top=20, **more):
    got = {}
    for r in index.nearest(df, "vec_id", "embedding", F.col("vec_id") % every == 0, top, **more).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


def test_defined_results(spark, clash):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(7)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(9)]  # copies: ties go to the smaller id
    rows += [(202, None), (203, [1.0, None] * 3 + [1.0]), (204, [float("nan")] * 7), (205, [float("inf")] * 7), (None, rows[0][1]), (206, []),
             (208, [0.0] * 7), (210, [2.0] * 3), (212, [-1e-9] * 3), (214, [5.0] * 4)]
    got = run(clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), 2, 3, target=1.0)
    want = brute(rows, 2, 3)
    assert set(got) == {i for i, r in want.items() if r[0]}  # 214 is alone
    for i, ranked in got.items():
        assert [r for r, _, _ in ranked] == list(range(1, len(ranked) + 1))
        assert [(j, s) for _, j, s in ranked] == want[i][0]
    assert [j for _, j, _ in got[0]][:3] == [100, 101, 102] and [j for _, j, _ in got[100]][:3] == [0, 101, 102]


def test_equal_ids_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert not run(spark.createDataFrame([], schema), 1)
    got = run(spark.createDataFrame([(4, [1.0, 2.0]), (4, [1.0, 2.0]), (5, [2.0, 1.0])], schema), 2)
    assert got == {4: [(1, 5, 4.0), (1, 5, 4.0)]}


@pytest.mark.parametrize("kind", ["even", "norms", "dense"])
def test_recall(spark, kind, monkeypatch):
    """At least 0.95 of the true neighbours, also with norms of all sizes and with a third of the rows in one place."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 24))
    if kind == "norms":
        v *= rng.lognormal(0, 1, (1500, 1))
    if kind == "dense":
        v[:500] = v[0] + 0.01 * v[:500]
    monkeypatch.setattr(index, "SHELF_ROWS", 200)  # large cells are spread
    monkeypatch.setattr(index, "VISITS", 30)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = run(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20)
    score = v @ v.T
    np.fill_diagonal(score, -np.inf)
    found = [len({j for _, j, _ in got[q]} & set(np.argsort(-score[q])[:20].tolist())) / 20 for q in range(0, 1500, 20)]
    assert np.mean(found) >= 0.95


def test_query_finds_the_nearest(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toArrow()
    ids, v = rows["vec_id"].to_numpy(), np.array(rows["embedding"].to_pylist(), np.float64)
    got = index.op12(spark, folder).toArrow()
    score = v @ v.T
    np.fill_diagonal(score, -np.inf)
    place = {i: k for k, i in enumerate(ids.tolist())}
    hits = total = 0
    for q in ids[ids % 20 == 0].tolist():
        mine = got.filter((got["query_id"].to_numpy() == q)).sort_by("rank")
        near = np.argsort(-score[place[q]], kind="stable")[:20]
        hits, total = hits + len(set(mine["vec_id"].to_pylist()) & set(ids[near].tolist())), total + 20
        assert mine["rank"].to_pylist() == list(range(1, 21))
        for j, s in zip(mine["vec_id"].to_pylist(), mine["score"].to_pylist(), strict=True):
            assert abs(s - score[place[q], place[j]]) < 1e-12
    assert hits >= 0.95 * total


def test_footrule_of_inverted_files():
    rng = np.random.default_rng(1)
    order = np.argsort(rng.random((30, 40)), axis=1)[:, :12]
    far = index.footrule(index.positions(order, 40), order[:5])
    place = [{p: k for k, p in enumerate(o)} for o in order.tolist()]
    for i in range(5):
        for j in range(30):
            assert far[i, j] == sum(abs(k - place[j].get(p, 12)) for k, p in enumerate(order[i].tolist()))
