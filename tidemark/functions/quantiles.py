"""Exact quantiles of many columns in a fixed, small number of passes.

``percentile`` is exact but keeps every distinct value of a column in one task.  Here quantile
sketches first bracket each wanted value between two values of the column; their rank error is bounded,
so only a sliver of rows lies strictly inside a bracket.  The next pass counts the rows below and on
the bracket ends (a value that a third of all rows share is just a count), and a filter brings the
sliver to the driver.  A sliver that is still too large is bracketed again, which shrinks it by three
orders of magnitude per round.  Counts check every bracket, so the result never depends on the sketch.

The sketches of all tasks are not merged in one place: tasks are put in a few hundred groups, each
group merges its sketches, and the driver weighs the few thousand quantiles of every group.

Counts and moments are jobs of their own: next to a sketch Spark would not generate code for them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .columns import as_double, ref

ACCURACY = 10_000
STEPS = 4_000
SKETCH_GROUPS = 256
SKETCH_INPUTS = 32
DIRECT_ROWS = 100_000
SLIVER_ROWS = 20_000


@dataclass
class _Target:
    """One wanted order statistic: the bracket that holds it and the ranks around it (from 0)."""

    column: str
    rank: int
    low: float
    high: float
    below: int = 0
    on_low: int = 0
    inside: int | None = None
    value: float | None = None
    done: bool = field(default=False)


def interpolate(low: float, high: float, position: float) -> float:
    """The value at a position between two ranks, by the arithmetic of Spark's ``percentile``: equal to the last bit."""
    before, after = math.floor(position), math.ceil(position)
    return low if before == after or low == high else (after - position) * low + (position - before) * high


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    extra: Sequence[Column] = (),
    exact: bool = True,
    accuracy: int = ACCURACY,
    steps: int = STEPS,
    direct_rows: int = DIRECT_ROWS,
    sliver_rows: int = SLIVER_ROWS,
) -> tuple[dict[str, list[float | None]], Row]:
    """Interpolated quantiles per column, and the row of the ``extra`` aggregates.

    The extra aggregates share the first pass over the data; they see the chosen columns as doubles
    without NaN.  ``exact=False`` stops after the sketch.
    """
    columns, probs = list(columns), list(probs)
    base = df.select(*[as_double(df, c) for c in columns])
    limits = [
        agg.alias(f"__{name}_{i}")
        for i, c in enumerate(columns)
        for name, agg in (("n", F.count(ref(c))), ("lo", F.min(ref(c))), ("hi", F.max(ref(c))))
    ]
    first = base.agg(F.count("*").alias("__rows"), *limits, *extra).first()
    counts = {c: first[f"__n_{i}"] for i, c in enumerate(columns)}
    ends = {c: (first[f"__lo_{i}"], first[f"__hi_{i}"]) for i, c in enumerate(columns)}
    result: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    small = [c for c in columns if 0 < counts[c] <= direct_rows and exact]
    large = [c for c in columns if counts[c] and c not in small]
    if small and probs:
        row = base.agg(*[F.percentile(ref(c), probs).alias(f"p{i}") for i, c in enumerate(small)]).first()
        for i, c in enumerate(small):
            result[c] = list(row[f"p{i}"])
    if not large or not probs:
        return result, first

    sketches = dict(zip(large, _sketch(base, [ref(c) for c in large], accuracy, steps)))
    if not exact:
        return result | {c: [sketches[c].value_at(p) for p in probs] for c in large}, first

    targets: dict[tuple[str, int], _Target] = {}
    for c in large:
        for p in probs:
            position = p * (counts[c] - 1)
            low, high = sketches[c].around(p)
            for rank in {math.floor(position), math.ceil(position)}:
                targets.setdefault((c, rank), _Target(c, rank, low, high))
    _resolve(base, list(targets.values()), counts, ends, accuracy, steps, sliver_rows)
    for c in large:
        for j, p in enumerate(probs):
            position = p * (counts[c] - 1)
            low = targets[(c, math.floor(position))].value
            high = targets[(c, math.ceil(position))].value
            result[c][j] = interpolate(low, high, position)
    return result, first


def _resolve(base, targets, counts, limits, accuracy, steps, sliver_rows) -> None:
    while pending := [t for t in targets if not t.done]:
        spans = sorted({(t.column, t.low, t.high) for t in pending})
        fetch = {
            (t.column, t.low, t.high): (
                t.inside if t.inside is not None else counts[t.column] * 3 * _margin(accuracy, steps)
            )
            <= sliver_rows
            for t in pending
        }
        seen = _look_into(base, spans, fetch)
        narrow = []
        for t in pending:
            below, on_low, on_high, inside, sliver = seen[(t.column, t.low, t.high)]
            t.below, t.on_low, t.inside = below, on_low, inside
            k = t.rank - below
            if k < 0 or k >= on_low + inside + on_high:
                t.low, t.high, t.inside = *limits[t.column], counts[t.column]
            elif k < on_low:
                t.value, t.done = t.low, True
            elif k >= on_low + inside:
                t.value, t.done = t.high, True
            elif sliver is not None:
                t.value, t.done = sliver[k - on_low], True
            elif inside > sliver_rows:
                narrow.append(t)
        if narrow:
            _narrow(base, narrow, accuracy, steps)


def _within(span: tuple[str, float, float]) -> Column:
    c, low, high = span
    return (ref(c) > F.lit(low)) & (ref(c) < F.lit(high))


def _look_into(base, spans, fetch):
    """Per span: rows below, on either end and inside, and the values inside if they are few."""
    aggregates = []
    for i, span in enumerate(spans):
        x, low, high = ref(span[0]), F.lit(span[1]), F.lit(span[2])
        aggregates += [
            F.count_if(x < low).alias(f"b{i}"),
            F.count_if(x == low).alias(f"l{i}"),
            F.count_if(x == high).alias(f"h{i}"),
            F.count_if(_within(span)).alias(f"w{i}"),
        ]
    row = base.agg(*aggregates).first()
    few = [i for i, span in enumerate(spans) if fetch[span] and row[f"w{i}"]]
    slivers: dict[int, list[float]] = {i: [] for i in few}
    if few:
        found = F.array_compact(
            F.array(*[F.when(_within(spans[i]), F.struct(F.lit(i).alias("i"), ref(spans[i][0]).alias("x"))) for i in few])
        )
        inside = base.where(reduce(or_, [_within(spans[i]) for i in few])).select(F.inline(found))
        for i, x in inside.collect():
            slivers[i].append(x)
    return {
        span: (
            row[f"b{i}"],
            row[f"l{i}"],
            row[f"h{i}"] if span[1] != span[2] else 0,
            row[f"w{i}"],
            sorted(slivers.get(i, [])) if fetch[span] else None,
        )
        for i, span in enumerate(spans)
    }


def _narrow(base, targets, accuracy, steps) -> None:
    """Bracket the targets anew with sketches of the rows inside their brackets."""
    inside = [F.when(_within((t.column, t.low, t.high)), ref(t.column)) for t in targets]
    for t, sketch in zip(targets, _sketch(base, inside, accuracy, steps)):
        t.low, t.high = sketch.around((t.rank - t.below - t.on_low + 0.5) / t.inside)
        t.inside = math.ceil(t.inside * 3 * _margin(accuracy, steps))


def _margin(accuracy: int, steps: int) -> float:
    """Bound of the error in rank, as a share of the rows."""
    return 2.0 / accuracy + 2.0 / steps


@dataclass(frozen=True)
class _Sketch:
    """Quantiles of the groups in one list, with the share of the rows up to each."""

    values: np.ndarray
    upto: np.ndarray
    margin: float

    def value_at(self, p: float) -> float:
        at = min(int(np.searchsorted(self.upto, p)), len(self.values) - 1)
        return float(self.values[max(0, at)])

    def around(self, p: float) -> tuple[float, float]:
        return (
            float(self.values[0]) if p <= self.margin else self.value_at(p - self.margin),
            float(self.values[-1]) if p >= 1 - self.margin else self.value_at(p + self.margin),
        )


def _sketch(base: DataFrame, inputs: Sequence[Column], accuracy: int, steps: int) -> list[_Sketch]:
    """A sketch per input; a job takes so many inputs that the driver gets at most some 250 MB."""
    found = []
    for start in range(0, len(inputs), SKETCH_INPUTS):
        found += _sketch_some(base, inputs[start : start + SKETCH_INPUTS], accuracy, steps)
    return found


def _sketch_some(base: DataFrame, inputs: Sequence[Column], accuracy: int, steps: int) -> list[_Sketch]:
    # one literal instead of thousands
    grid = F.split(F.lit(",".join(str(i / steps) for i in range(steps + 1))), ",").cast("array<double>")
    named = [col.alias(f"x{i}") for i, col in enumerate(inputs)]
    group = F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("group")
    aggregates = []
    for i in range(len(named)):
        aggregates += [F.count(f"x{i}").alias(f"n{i}"), F.percentile_approx(f"x{i}", grid, accuracy).alias(f"q{i}")]
    rows = base.select(group, *named).groupBy("group").agg(*aggregates).collect()
    found = []
    for i in range(len(named)):
        parts = [(r[f"n{i}"], r[f"q{i}"]) for r in rows if r[f"n{i}"]]
        values = np.concatenate([np.array(q) for _, q in parts])
        weights = np.concatenate([np.full(len(q), n / len(q)) for n, q in parts])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])
        found.append(_Sketch(values[order], upto / upto[-1], _margin(accuracy, steps)))
    return found
