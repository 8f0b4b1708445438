import hashlib
import random
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from tidemark.llm import alignment, atoms

PATHS = atoms.public_paths()
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tokenizers():
    return atoms.Pair(*PATHS)


def groups_of(pair, text):
    """Groups of ids of a whole text, without atoms and fragments."""
    if not text:
        return []
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    data = (" " + text).encode()
    if b"".join(pair.bytes_a[i] for i in a) != data or b"".join(pair.bytes_b[i] for i in b) != data:
        return []
    ends = [[0], [0]]
    for e, ids, names in ((ends[0], a, pair.bytes_a), (ends[1], b, pair.bytes_b)):
        for i in ids:
            e.append(e[-1] + len(names[i]))
    common = sorted(set(ends[0]) & set(ends[1]))
    place = [{x: k for k, x in enumerate(e)} for e in ends]
    return [(a[place[0][x] : place[0][y]], b[place[1][x] : place[1][y]]) for x, y in pairwise(common)]


def brute(pair, docs):
    """doc_id and the columns of the query, sorted."""
    made = [(i, groups_of(pair, t)) for i, t in docs]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in made]
    n = Counter(p for c in links for p in c)
    best = {}
    for (a, _), k in n.items():
        best[a] = max(k, best.get(a, 0))
    out = []
    for (i, g), c in zip(made, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
                    sum(k for p, k in c.items() if n[p] == best[p[0]]), sum(k * n[p] for p, k in c.items()), digest))
    return sorted(out, key=repr)


ODD = [
    "a b", "a  b", "  a", "a ", " ", "", None, "\n\n x", "a\n b\tc  \n d", "x　y z  w\x85 v\x1c u", "<s> </s> <|endoftext|> <0x41> <unk>",
    "a▁b c", "naïve café ﬁn é", "字典 漢字かな 한국어", "🙂🙃👩‍👩‍👧 🏳️‍🌈", "x\x00y z", "=" * 300, " " * 40 + "a" + " " * 33, "a" * 700,
    "don't we'll I'VE 12345678 3.14 foo_bar() {\n    return;\r\n}", "Слово и дело, вот так", "﻿bom", "​ ​ x", "e" + "́" * 30,
]


def documents(seed, count):
    rng = random.Random(seed)
    words = "the of and Zürich co-operate 12 3.5 naïve 　 \n  \t字 слово don't __x__ (a) <s> antidisestablishment ....".split(" ")
    return [" ".join(rng.choice(words) for _ in range(rng.choice([3, 30, 300]))) for _ in range(count)]


def run(spark, docs, chunk=alignment.CHUNK_BYTES, frequent=alignment.FREQUENT, add=lambda df: df):
    df = add(spark.createDataFrame(docs, "doc_id long, text string"))
    aligned = alignment.align(df, "doc_id", "text", PATHS, chunk)
    out = alignment.score_links(aligned, alignment.vocabulary_sizes(PATHS), frequent)
    assert out.columns == ["key", *NAMES]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize(("chunk", "frequent"), [(alignment.CHUNK_BYTES, alignment.FREQUENT), (40, alignment.FREQUENT), (7, 300), (150, 0)])
def test_scores_equal_brute_force(spark, tokenizers, clash, chunk, frequent):
    docs = [(None if i % 9 == 0 else i // 2, t) for i, t in enumerate(ODD + documents(1, 25) + ODD[:4])]
    assert run(spark, docs, chunk, frequent, clash) == brute(tokenizers, docs)


def test_query_equals_brute_force(spark, tokenizers, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    out = alignment.op11(spark, folder)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(tokenizers, docs)


def test_very_long_texts(spark, tokenizers):
    docs = [(1, " ".join(documents(3, 400))), (2, "x" * 200_000), (3, "字" * 60_000 + " a b"), (4, "a b " * 50_000)]
    assert run(spark, docs, 20_000) == brute(tokenizers, docs)


def test_composition_is_associative():
    """Any bracketing of a text's fragments gives the groups of the whole."""
    rng = np.random.default_rng(2)
    known = alignment.Atoms(*PATHS)
    for text in [*documents(5, 4), "字典 漢字かな 한국어 " * 9, "unsegmentable" * 30]:
        data = b" " + text.encode()
        if len(data) < 30:
            continue
        bounds = sorted({0, len(data), *rng.integers(1, len(data), 12).tolist()})
        parts = [alignment.fragment(known, data, a, b) for a, b in pairwise(bounds)]
        whole = alignment.fragment(known, data, 0, len(data))
        assert alignment.compose(parts) == whole == alignment.compose([alignment.Fragment(), whole, alignment.Fragment()])
        for _ in range(5):
            tree = list(parts)
            while len(tree) > 1:
                i = int(rng.integers(0, len(tree) - 1))
                tree[i : i + 2] = [alignment.compose(tree[i : i + 2])]
            assert tree[0] == whole


def test_ranges_cover_a_text_with_whole_atoms():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["a", "é ", " ", "x", "　", " \n", "bcd "]) for _ in range(rng.randint(1, 120)))
        data = b" " + text.encode()
        cuts = list(alignment.ranges(data, 16))
        assert [c[0] for c in cuts] == [0, *(c[1] for c in cuts[:-1])] and cuts[-1][1] == len(data)
        whole = alignment._split_bytes(data)
        for low, high, a, b in cuts:
            assert a <= low < high <= b
            assert [x for x in alignment._split_bytes(data[a:b])] == whole[len(alignment._split_bytes(data[:a])) :][: len(alignment._split_bytes(data[a:b]))]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_numbers_come_back():
    rng = np.random.default_rng(7)
    for most in (100, 1000, 1 << 40):
        values = rng.integers(0, most, 50)
        offsets = np.sort(np.concatenate([[0, 50], rng.integers(0, 50, 6)]))
        column = alignment.packed(values, offsets, "short")
        for part, skip in ((column, 0), (column.slice(2), 2)):
            back, at = alignment.unpacked(part, "short")
            assert back.tolist() == values[offsets[skip] :].tolist() and at.tolist() == (offsets[skip:] - offsets[skip]).tolist()
