import random
import re

import pytest

from tidemark.llm import ngram_join
from tidemark.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, k):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, k=4, percent=85):
    sets = [shingles(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and sets[j] and 100 * n >= percent * len(a | sets[j]):
                root[top(i)] = top(j)
    smallest = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            smallest[top(i)] = min(key, smallest.get(top(i), key))
    return sorted(((key, len(s), smallest.get(top(i)) if s else key) for i, ((key, _), s) in enumerate(zip(docs, sets, strict=True))), key=repr)


def joined(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((tuple(r) for r in ngram_join.join(df, "doc_id", "text", **more).collect()), key=repr)


def family(rng, size, words, edits):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_components_equal_brute_force(spark, monkeypatch, small):
    if small:  # the ways for frequent tokens and large groups
        for name, value in (("FREQUENT", 4), ("PAIRED", 3), ("BLOCK", 5)):
            monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(11 + small)
    line = " ".join(f"line{i}" for i in range(25))
    texts = family(rng, 45, 60, 4) + family(rng, 12, 25, 3) + [f"{t} {line}" for t in family(rng, 8, 40, 40)]
    texts += [f"{line} {a} {line}" for a in "xyz"] * 2 + [texts[0]] * 9 + [" ".join(f"u{rng.random()}" for _ in range(50)) for _ in range(20)]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    docs += [(200, None), (201, ""), (202, " \n\t"), (203, "one two"), (204, "One\tTWO"), (205, "one two three four"), (206, "two one")]
    docs += [(207, ""), (None, texts[0]), (None, "one two"), (5, texts[5]), (6, texts[7]), (208, "ÀÉ one"), (209, "àé one"), (210, "a b one")]
    assert joined(spark, docs) == brute(docs)


def test_pipeline_parameters(spark):
    rng = random.Random(2)
    docs = list(enumerate(family(rng, 20, 50, 3) + family(rng, 5, 9, 1)))
    assert joined(spark, docs, words=5, percent=80) == brute(docs, 5, 80)


def test_empty_table_and_long_text(spark):
    assert joined(spark, []) == []
    long = " ".join(str(i) for i in range(60_000))
    assert joined(spark, [(3, long), (2, long + " end"), (9, "x" * 2_000_000)]) == [(2, 59_998, 2), (3, 59_997, 2), (9, 1, 9)]


def test_keep_one_keeps_columns_and_repeated_ids(spark, clash, kept):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (1, "a b c d e f"), (3, None), (None, "a b c d e f"), (4, "other"), (4, "words here")]
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    got = ngram_join.keep_one(docs, "doc_id", "text")
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(
        [(1, "a b c d e f"), (3, None), (4, "other"), (4, "words here"), (None, "a b c d e f")], key=repr)
    kept(docs, got)


def test_keep_one_decides_by_row(spark):
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    clean = "a text that is like no other one in this small table of rows at all"
    other = " ".join(reversed(near.split()))
    third = " ".join(sorted(near.split()))
    rows = [(3, near), (7, near + " more"), (7, clean), (5, other), (5, other + " end"), (None, third), (None, third + " x"), (None, third), (None, None), (None, "")]
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    kept = [(r["doc_id"], r["text"]) for r in got]
    assert (3, near) in kept and (7, clean) in kept and (None, None) in kept and (None, "") in kept
    assert sum(i == 5 for i, _ in kept) == 1 and sum(bool(t) and t.startswith(third) for _, t in kept) == 1 and len(kept) == 6


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    names = [f"n{i:03d}" for i in range(60)]
    rng.shuffle(names)
    edges = list(zip(names[:30], names[1:31], strict=True)) + [(names[31], x) for x in names[32:50]] + [(names[55], names[55])]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    for group in (names[:31], names[31:50]):
        assert {got.get(x, x) for x in group} == {min(group)}
    assert len(got) == 30 + 18
