"""Apply what was fitted on a table to a stream of the same columns.

Fills and scalings are projections once fitted, so they need no state on the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame

from ..operators.missing import FillPlan, apply_fill
from ..operators.scaling import Pairs, apply_min_max, apply_standard

Change = Callable[[DataFrame], DataFrame]


def filling(plan: FillPlan) -> Change:
    return partial(apply_fill, plan=plan)


def normalizing(fitted: Pairs, feature_range: tuple[float, float] = (0, 1)) -> Change:
    return partial(apply_min_max, fitted=fitted, feature_range=feature_range)


def standardizing(fitted: Pairs) -> Change:
    return partial(apply_standard, fitted=fitted)


def on_stream(stream: DataFrame, changes: Sequence[Change]) -> DataFrame:
    """Apply the changes in order; works the same on a table."""
    for change in changes:
        stream = change(stream)
    return stream
