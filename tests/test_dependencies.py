"""The search of the lattice against a count of every set, minimal sets only."""

import random
from collections import Counter, defaultdict
from itertools import combinations

from helpers import rows

from tidemark.operators import dependencies


def brute(data, names, max_size, max_share):
    found = []
    for size in range(max_size + 1):
        for x in combinations(names, size):
            for a in [n for n in names if n not in x]:
                groups = defaultdict(Counter)
                for r in data:
                    groups[tuple(r[names.index(c)] for c in x)][r[names.index(a)]] += 1
                lost = sum(sum(c.values()) - max(c.values()) for c in groups.values())
                if lost <= max_share * len(data) and not any(set(d) <= set(x) and b == a for d, b, *_ in found):
                    found.append((list(x), a, len(groups), lost))
    return found


def got(df, *args):
    return [(r["determinant"], r["dependent"], r["groups"], r["violating_rows"]) for r in dependencies.minimal_dependencies(df, *args).collect()]


def test_equals_a_count_of_every_set(spark, monkeypatch):
    rng = random.Random(2)
    names = list("abcde")
    data = []
    for i in range(300):
        a, b = rng.randrange(4), rng.randrange(5)
        data.append((a, None if b == 0 else b, (a + 2 * b) % 7, "x" if i % 40 == 0 else f"y{a}", 1.5))
    df = spark.createDataFrame(data, "a int, b int, c int, d string, e double")
    for share in (0.0, 0.05, 0.5):
        want = sorted(brute(data, names, 3, share), key=repr)
        assert sorted(got(df, names, 3, share), key=repr) == want
    assert (["a", "b"], "c", 20, 0) in got(df, names, 2, 0.0) and ([], "e", 1, 0) in got(df, names, 2, 0.0)
    monkeypatch.setattr(dependencies, "SETS_AT_ONCE", 2)
    assert sorted(got(df, names, 3, 0.05), key=repr) == sorted(brute(data, names, 3, 0.05), key=repr)


def test_planted_key_of_two_columns(spark):
    df = spark.range(200).selectExpr("id % 20 as p", "id div 20 as q", "id as r", "cast(id % 3 as string) as s")
    found = got(df, None, 2, 0.0)
    assert (["p", "q"], "r", 200, 0) in found and (["r"], "p", 200, 0) in found
    assert not any(set(x) > {"r"} for x, *_ in found)


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b int")
    assert rows(dependencies.minimal_dependencies(df)) == [([], "a", 0, 0, 0.0), ([], "b", 0, 0, 0.0)]
