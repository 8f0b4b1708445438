import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import packing, vector_search

DOCS = "doc_id long, text string"


def brute_top(rows, every=2, top=3, scale=256):
    good = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))
            out += [(i, k + 1, j, -x) for k, (x, j) in enumerate(s[:top])]
    return sorted(out)


@pytest.mark.parametrize("block", [vector_search.BLOCK_BYTES, 700])
def test_top_products_equal_brute_force(spark, clash, block):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(7)]) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, [1.0, None] * 3 + [1.0]), (104, [float("nan")] * 7),
             (105, [float("inf")] * 7), (None, rows[0][1]), (106, []), (108, []), (110, [2.0] * 3), (112, [-1e-9] * 3)]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = vector_search.top_products(df, "vec_id", "embedding", F.col("vec_id") % 2 == 0, 3, block_bytes=block)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    q, v = np.floor(256 * rng.normal(size=(5, 33))), np.floor(256 * rng.normal(size=(50, 33)))
    for s in vector_search.LEVELS:
        bound = vector_search.statistics(q, s) @ vector_search.statistics(v, s).T
        assert (bound + 1e-3 >= q @ v.T).all()
    search = vector_search.Search(np.arange(2), v[:2], 1)
    search.offer(np.arange(10, 60), v)
    search.offer(np.arange(100, 101), -v[:1])  # cannot be better
    assert search.row[:, 0].tolist() == [10, 11]


def test_large_components_do_not_overflow():
    q = np.array([[2.0**62, 1.0]])
    assert vector_search.products(q, q)[0, 0] == (1 << 63) - 1
    assert vector_search.products(np.array([[2.0**40]]), np.array([[3.0]]))[0, 0] == 3 << 40


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_search.top_products(df, "vec_id", "embedding", F.lit(True)).count() == 0


def reference_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    return t.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def check_packed(rows, docs, capacity, ids=reference_ids):
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    expected = []
    for key, text in docs:
        x = np.array(ids(text), "<u4")
        for p, a in enumerate(range(0, len(x), capacity)):
            cut = x[a : a + capacity]
            expected.append((key, p, a, len(cut), zlib.crc32(cut.tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    return len(by_seq)


ODD = ["It's 12,5% of Ünïcode—ÀÉ, \"don't\"!! x̴. İstanbul ŒUVRE", " \t\n\r\x0b\x1c a b ", "a" * 3000, "日本語 текст 😀😀", "'s 's's",
       "<|endoftext|>", "", None, "é. É!", "word***word ...", "ΑΣ Σ.", "x" * 70 + "."]


def test_pieces_are_those_of_the_tokenizer(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(0, ODD[0]), (None, "no id")]
    got = packing.pack(spark.createDataFrame(docs, DOCS), "doc_id", F.col("text"), capacity=64).collect()
    check_packed(got, docs, 64)


def test_packing_is_tight(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    got = packing.pack(docs, "doc_id", F.col("text")).collect()
    n = check_packed(got, [tuple(r) for r in docs.collect()], packing.CAPACITY)
    assert n <= 1.02 * -(-sum(r["length"] for r in got) // packing.CAPACITY) + 1


def test_two_pieces_replace_the_smallest():
    counts = np.zeros(11, np.int64)
    counts[[7, 2, 4, 3]] = [1, 1, 1, 1]  # greedy: 7 + 3; the rest: 4 + 2
    assert sum(c for c, _ in packing.plan(counts, 10)) == 2
    counts = np.zeros(21, np.int64)
    counts[[11, 8, 5, 4]] = [1, 1, 1, 1]  # 11 + 8 leaves a gap of 1, 11 + 5 + 4 leaves none
    assert packing.plan(counts, 20)[0] == (1, {11: 1, 5: 1, 4: 1})


def test_no_documents(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), "doc_id", F.col("text")).count() == 0


@pytest.mark.parametrize("key", ["length", "piece", "task", "Number", "_key", "_text"])
def test_keys_with_names_of_the_result(spark, key):
    df = spark.createDataFrame([(3, "one two"), (None, None)], "k long, text string").withColumnRenamed("k", key)
    out = packing.pack(df, key, F.col("text"))
    name = f"_{key}" if key in ("length", "piece") else key
    assert out.columns == [name, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted((r[0] is None, r["length"]) for r in out.collect()) == [(False, 3), (True, 1)]


def test_plan_is_near_the_best_for_small_cases():
    """Against the least number of sequences that any packing of a few pieces needs."""
    def least(pieces, capacity):
        best = len(pieces)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(pieces):
                best = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + pieces[i] <= capacity and bins[b] not in bins[:b]:
                    place(i + 1, [*bins[:b], bins[b] + pieces[i], *bins[b + 1 :]])
            place(i + 1, [*bins, pieces[i]])

        place(0, [])
        return best

    rng = random.Random(5)
    worse = 0
    for _ in range(120):
        capacity = rng.randint(8, 20)
        pieces = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = np.bincount(pieces, minlength=capacity + 1)
        made = packing.plan(counts, capacity)
        used = sum(copies for copies, _ in made)
        assert sum((copies * np.array([f.get(n, 0) for n in range(capacity + 1)]) for copies, f in made), np.zeros(capacity + 1, int)).tolist() == counts.tolist()
        assert all(sum(n * k for n, k in f.items()) <= capacity for _, f in made)
        worse += used - least(pieces, capacity)
        assert used <= least(pieces, capacity) + 1
    assert worse <= 12
