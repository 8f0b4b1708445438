import hashlib
import random
import re

import pytest

from tidemark.llm import decontamination as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, window=10):
    out = []
    for key, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            x = words(t)
            n = min(window, len(x))
            for a in range(len(x) - n + 1 if x else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == x[a : a + n]:
                        hit.update(range(i, i + n))
                        if item is not None:
                            ids.add(str(item))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got, names = dc.find_passages(d, "text", b, "item_id", "text", keep=["doc_id"], **more)
    return sorted((tuple(r) for r in got.select("doc_id", *(x.alias(n) for n, x in dc.report(got, names).items())).collect()), key=repr)


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 4000])
def test_equal_to_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    rng = random.Random(5)
    vocabulary = ["The", "of", "and", "été", "x1", "ÄÖ", "zwei", "日本", "a"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--", "_"]) for _ in range(n))
    items = [(i, text(rng.choice([10, 12, 25]))) for i in range(12)] + [(20, "zwei x1 zwei"), (21, "a"), (22, "..."), (23, None), (None, text(11)), (2, "ÄÖ ÄÖ ÄÖ ÄÖ")]
    docs = [(i, text(rng.choice([0, 3, 30, 200]))) for i in range(25)]
    docs += [(30 + i, f"{text(7)} {t} {text(5)}") for i, (_, t) in enumerate(items[:8])]
    docs += [(50, None), (51, ""), (52, "..."), (None, items[0][1]), (30, docs[0][1]), (53, text(4000) + (items[1][1] or ""))]
    assert found(spark, docs, items) == brute(docs, items)


def test_occurrences_stay_in_one_text(spark):
    item = [(1, "a b c d e f g h i j")]
    docs = [(1, "a b c d e"), (2, "f g h i j"), (3, "a b c d e f g h i j"), (4, "z a b c d e f g h i jj")]
    assert [r[5] for r in found(spark, docs, item)] == [False, False, True, False]


def test_empty_tables(spark):
    assert found(spark, [], [(1, "x")]) == []
    assert found(spark, [(1, "x y")], []) == brute([(1, "x y")], [])


def test_very_long_words_and_texts(spark):
    long = "é" * 100_000
    docs = [(1, f"{long} {long}"), (2, "b " * 300_000 + "c"), (3, "x" * 3_000_000)]
    assert found(spark, docs, [(1, long), (2, "b b c")]) == [
        (1, 2, 2, 1, hashlib.sha256(b"1").hexdigest(), True), (2, 300_001, 3, 1, hashlib.sha256(b"2").hexdigest(), True),
        (3, 1, 0, 0, hashlib.sha256(b"").hexdigest(), False)]


def test_clean_documents_stay_with_their_columns(spark, clash, kept):
    docs = clash(spark.createDataFrame([(1, "one two"), (2, "three"), (3, None)], "doc_id long, text string"))
    items = spark.createDataFrame([(1, "Two")], "item_id long, text string")
    got = dc.decontaminate(docs, "text", items, "item_id", "text")
    assert sorted(r["doc_id"] for r in got.collect()) == [2, 3] and got.columns == docs.columns
    kept(docs, got)
