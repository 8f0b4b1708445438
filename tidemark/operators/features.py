"""Which columns tell a target column: split, best classifier within a budget, importances."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import check_columns, is_missing, numeric_columns, ref
from ..functions.lookup import fits_broadcast, lookup_join
from ..functions.storage import settle
from .boosting import Boosted, fit_boosted

ML_LABELS = 1000  # the learners of pyspark.ml are tried up to so many different values of a target
FIRST_ROWS = 5_000  # of the first rung
GROWTH = 4  # rows of a rung over those of the one before
KEPT = 3  # one in so many candidates goes on to the next rung


def _part(df: DataFrame, key: Sequence[str]) -> Column:
    """0 to 9999 by a hash of the key."""
    text = F.concat_ws("|", *[ref(c).cast("string") for c in check_columns(df, key)])
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint") % 10_000


def split_by_key(df: DataFrame, key: Sequence[str], train_share: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key: the same split for any partitioning of the table."""
    limit = F.lit(round(train_share * 10_000))
    return df.where(_part(df, key) < limit), df.where(_part(df, key) >= limit)


@dataclass
class Trial:
    """A fit of a rung: rows, accuracy on the held-out rows, and seconds."""

    name: str
    rows: int
    accuracy: float
    seconds: float


class _Learned:
    """A model of pyspark.ml over numbered labels."""

    def __init__(self, model, features: list[str]) -> None:
        self.model, self.features = model, features

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        doubles = df.withColumns({f"__d{i}": ref(c).cast("double") for i, c in enumerate(self.features)})
        return self.model.transform(doubles).select(*[ref(c) for c in df.columns], F.col("__prediction").cast("int").alias(name))

    def gains(self) -> list[float] | None:
        found = getattr(self.model.stages[-1], "featureImportances", None)
        return None if found is None else [float(found[i]) for i in range(len(self.features))]


def _learn(classifier, rows: DataFrame, features: list[str]) -> _Learned:
    doubles = [f"__d{i}" for i in range(len(features))]
    table = rows.withColumns({d: ref(c).cast("double") for d, c in zip(doubles, features)})
    filled = [f"__f{i}" for i in range(len(features))]
    whole = Imputer(inputCols=doubles, outputCols=filled, strategy="median")
    return _Learned(Pipeline(stages=[whole, VectorAssembler(inputCols=filled, outputCol="__features"), classifier]).fit(table), features)


def _candidates(seed: int, classes: int) -> dict[str, Callable[[DataFrame, list[str]], _Learned | Boosted]]:
    """Each candidate's fit; those of pyspark.ml only for as many classes as they can hold."""
    common = {"featuresCol": "__features", "labelCol": "__number", "predictionCol": "__prediction"}
    out = {
        "boosted": lambda rows, features: fit_boosted(rows, "__number", classes, features, 6, 3, 0.6, seed),
        "boosted_deep": lambda rows, features: fit_boosted(rows, "__number", classes, features, 4, 5, 0.5, seed),
    }
    if classes <= ML_LABELS:
        learners = {
            "random_forest": RandomForestClassifier(numTrees=20, maxDepth=6, seed=seed, **common),
            "decision_tree": DecisionTreeClassifier(maxDepth=6, seed=seed, **common),
            "logistic": LogisticRegression(maxIter=30, **common),
        }
        out |= {name: (lambda rows, features, c=c: _learn(c, rows, features)) for name, c in learners.items()}
    return out


class TargetModel:
    """The best of several classifiers."""

    def __init__(self, name: str, model: _Learned | Boosted, features: list[str], labels: DataFrame, trials: list[Trial]):
        self.name, self.model, self.features, self.labels, self.trials = name, model, features, labels, trials

    @property
    def scores(self) -> dict[str, float]:
        """Accuracy of each candidate's last fit."""
        return {t.name: t.accuracy for t in self.trials}

    def predict(self, df: DataFrame) -> DataFrame:
        """The rows with ``prediction``, the value of the target as text."""
        numbered = self.model.predict(df, "__found")
        names = self.labels.select(F.col("number").alias("__found"), F.col("label").alias("prediction"))
        return lookup_join(numbered, names, ["__found"]).select(*[ref(c) for c in df.columns], "prediction")

    def importances(self, spark) -> DataFrame:
        """``feature``, ``importance``; empty if the classifier has none."""
        if isinstance(self.model, Boosted):
            total = self.model.gain.sum() or 1.0
            gains = [float(g / total) for g in self.model.gain]
        else:
            gains = self.model.gains()
        rows = [] if gains is None else list(zip(self.features, gains))
        table = spark.createDataFrame(rows, "feature string, importance double")
        return table.orderBy(F.col("importance").desc(), "feature")


def fit_target(
    df: DataFrame,
    target: str,
    key: Sequence[str],
    features: Sequence[str] | None = None,
    seed: int = 42,
    names: Sequence[str] | None = None,
    budget: float = 60.0,
) -> TargetModel:
    """Find a good classifier for the target by successive halving within a budget of seconds.

    All candidates are fitted on a small part of the training rows; the best third goes on to a part
    ``GROWTH`` times larger, and so on up to all rows.  Accuracy is that on a fifth of the rows, told by the
    key, which no fit sees.  A rung that would, at the pace so far, outlast the budget is not begun; the best
    model of the last rung is the result, so the first rung always runs.  Rows without the target are left
    out; missing feature cells are allowed.
    """
    started = time.monotonic()
    check_columns(df, [target, *key])
    features = [c for c in numeric_columns(df, features) if c != target and c not in key]
    rows = df.where(ref(target).isNotNull())
    values = settle(rows.groupBy(ref(target).cast("string").alias("label")).count(), "values")
    if not fits_broadcast(values):
        raise ValueError(f"{target} has about as many values as a key; bin or convert it first")
    labels = settle(values.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("number")), "labels")  # few, as measured
    classes = labels.count()
    named = lookup_join(rows.withColumn("__label", ref(target).cast("string")), labels.withColumnRenamed("label", "__label"), ["__label"])
    slim = named.select(*[ref(c) for c in features], F.col("number").alias("__number"), _part(df, key).alias("__part"))
    table = settle(slim, "train")
    filled = table.agg(*[F.count(F.when(~is_missing(table, c), 1)).alias(f"n{i}") for i, c in enumerate(features)], F.lit(0)).first()
    features = [c for i, c in enumerate(features) if filled[f"n{i}"]]
    fit_rows, hold_rows = table.where(F.col("__part") < 8000), table.where(F.col("__part") >= 8000)
    total = fit_rows.count()
    left = {n: f for n, f in _candidates(seed, classes).items() if names is None or n in names}
    trials: list[Trial] = []
    best: tuple[str, _Learned | Boosted] | None = None
    size = min(total, FIRST_ROWS)
    while left:
        rung = fit_rows if size >= total else fit_rows.where(F.pmod(F.xxhash64("__part", *map(ref, features)), F.lit(10_000)) < math.ceil(10_000 * size / total))
        done: dict[str, tuple[float, _Learned | Boosted]] = {}
        begun = time.monotonic()
        for name, fit in left.items():
            at = time.monotonic()
            model = fit(rung, features)
            right = F.avg((F.col("__guess") == F.col("__number")).cast("double"))
            accuracy = model.predict(hold_rows, "__guess").agg(right).first()[0] or 0.0
            done[name] = accuracy, model
            trials.append(Trial(name, size, accuracy, time.monotonic() - at))
        ranked = sorted(done, key=lambda n: (-done[n][0], list(left).index(n)))
        best = ranked[0], done[ranked[0]][1]
        if size >= total:
            break
        left = {n: left[n] for n in ranked[: max(1, len(ranked) // KEPT)]}
        spent = time.monotonic() - begun
        size = min(total, size * GROWTH) if len(left) > 1 else total
        if time.monotonic() - started + spent * len(left) / len(done) > budget:
            break
    return TargetModel(best[0], best[1], features, labels, trials)

