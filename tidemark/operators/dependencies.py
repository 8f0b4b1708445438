"""Dependencies between sets of columns, by a level-wise search of the lattice of sets.

A set X determines a column a up to a share e of violating rows if that share of the rows has to be left out so
that equal values of X go with one value of a.  Only minimal sets are reported: none that contains a smaller
determining set.  A level is one aggregation by all its sets at once, over distinct rows with counts.  It tells
for each set in how many groups a column has more than one value; each of these has a violating row, so what
exceeds the allowed share by that alone is settled.  Violating rows are counted for the others, in a second
aggregation.  A missing cell is a value.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import check_columns, cleaned
from ..functions.storage import settle

SETS_AT_ONCE = 64


def _value(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), cleaned(df, name).cast("string")), F.lit("-"))


def _broken(rows: DataFrame, sets: Sequence[tuple[str, ...]], keys: list[str]) -> dict[tuple[str, ...], dict[str, int]]:
    """For each set the groups in which each column has more than one value, and the number of groups."""
    out = {}
    for at in range(0, len(sets), SETS_AT_ONCE):
        some = sets[at : at + SETS_AT_ONCE]
        several = [(F.min(f"v{k}") != F.max(f"v{k}")).alias(f"b{k}") for k in keys]
        values = rows.withColumns({f"v{k}": F.col(k) for k in keys})
        groups = values.groupingSets([[F.col(k) for k in s] for s in some], *map(F.col, keys))
        groups = groups.agg(F.grouping_id().alias("set"), *several)
        counts = groups.groupBy("set").agg(F.count("*").alias("groups"), *[F.count_if(f"b{k}").alias(f"b{k}") for k in keys])
        found = {r["set"]: r for r in counts.collect()}  # a row for each set
        for s in some:
            r = found.get(sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s))
            out[s] = {"groups": r["groups"] if r else 0, **{k: r[f"b{k}"] if r else 0 for k in keys}}
    return out


def _violating(rows: DataFrame, pairs: Sequence[tuple[tuple[str, ...], str]], keys: list[str]) -> dict[tuple[tuple[str, ...], str], int]:
    """Rows to be left out so that the set determines the column: all but the most frequent value of each group."""
    out = {}
    for at in range(0, len(pairs), SETS_AT_ONCE):
        some = pairs[at : at + SETS_AT_ONCE]
        sets = F.array(*[
            F.struct(F.lit(i).alias("pair"), F.array(*[F.col(k) for k in s]).alias("x"), F.col(a).alias("a")) for i, (s, a) in enumerate(some)
        ])
        spread = rows.select("n", F.explode(sets).alias("s")).select("n", "s.*")
        counted = spread.groupBy("pair", "x", "a").agg(F.sum("n").alias("n"))
        lost = counted.groupBy("pair", "x").agg((F.sum("n") - F.max("n")).alias("lost")).groupBy("pair").agg(F.sum("lost").alias("lost"))
        found = {r["pair"]: r["lost"] for r in lost.collect()}  # a row for each pair
        out |= {pair: found.get(i, 0) for i, pair in enumerate(some)}
    return out


def minimal_dependencies(
    df: DataFrame, columns: Sequence[str] | None = None, max_size: int = 2, max_share: float = 0.0
) -> DataFrame:
    """``determinant`` (names in the order of the columns), ``dependent``, ``groups``, ``violating_rows``, ``share``."""
    columns = check_columns(df, columns or df.columns)
    keys = [f"k{i}" for i in range(len(columns))]
    rows = settle(df.select(*[_value(df, c).alias(k) for k, c in zip(keys, columns)]).groupBy(*keys).agg(F.count("*").alias("n")), "rows")
    total = rows.agg(F.sum("n")).first()[0] or 0
    determined: dict[str, list[frozenset[str]]] = {k: [] for k in keys}
    lines = []
    for size in range(0, max_size + 1):
        wanted: dict[tuple[str, ...], list[str]] = {}
        for s in combinations(keys, size):
            own = [a for a in keys if a not in s and not any(d <= set(s) for d in determined[a])]
            if own:
                wanted[s] = own
        if not wanted:
            break
        known = _broken(rows, list(wanted), keys)
        open_ = [(s, a) for s, own in wanted.items() for a in own if known[s][a] <= max_share * total]
        sure = [p for p in open_ if known[p[0]][p[1]] == 0]
        lost = dict.fromkeys(sure, 0) | _violating(rows, [p for p in open_ if known[p[0]][p[1]] > 0], keys)
        for s, a in open_:
            if lost[s, a] <= max_share * total:
                determined[a].append(frozenset(s))
                names = [columns[keys.index(k)] for k in s]
                lines.append((names, columns[keys.index(a)], known[s]["groups"], lost[s, a], lost[s, a] / total if total else 0.0))
    schema = "determinant array<string>, dependent string, groups bigint, violating_rows bigint, share double"
    return df.sparkSession.createDataFrame(lines, schema)
