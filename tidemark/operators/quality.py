"""Types, spelling, bins, dependencies and expectations of columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_double, check_columns, cleaned, is_missing, numeric_columns, ref, unpivot_rows
from ..functions.lookup import lookup_join
from ..functions.quantiles import exact_quantiles
from ..functions.storage import settle
from .charts import equal_width_bin
from .duplicates import drop_duplicates
from .missing import drop_missing



def discretize(
    df: DataFrame,
    column: str,
    bins: int | None = None,
    round_to: int | None = None,
    equal: str = "width",
    exact: bool = True,
    name: str | None = None,
) -> DataFrame:
    """Replace a number by its bin of equal width or equal frequency, or round it."""
    numeric_columns(df, [column])
    name = name or column
    x = as_double(df, column)
    if round_to is not None:
        x = F.round(x, round_to)
        df = df.withColumn(column, x)
    if bins is None:
        return df.withColumn(name, x)
    if equal == "width":
        row = df.agg(F.min(as_double(df, column)).alias("a"), F.max(as_double(df, column)).alias("b")).first()
        if row["a"] is None:
            return df.withColumn(name, F.lit(None).cast("int"))
        return df.withColumn(name, equal_width_bin(df, column, row["a"], row["b"], bins))
    if equal == "frequency":
        edges = exact_quantiles(df, [column], [i / bins for i in range(1, bins)], exact=exact)[0][column]
        spot = sum((F.when(x > F.lit(e), 1).otherwise(0) for e in edges if e is not None), F.lit(0))
        return df.withColumn(name, F.when(x.isNotNull(), spot.cast("int")))
    raise ValueError(f"bins must have equal 'width' or 'frequency', not {equal}")


def convert_types(df: DataFrame, types: Mapping[str, str], on_error: str = "fail") -> DataFrame:
    """Cast columns; a bad cell fails the job or becomes NULL."""
    check_columns(df, list(types))
    if on_error not in ("fail", "null"):
        raise ValueError(f"on_error must be 'fail' or 'null', not {on_error}")
    changed = {}
    for c, t in types.items():
        tried = ref(c).try_cast(t)
        if on_error == "fail":
            message = F.concat(F.lit(f"column {c}: not of type {t}: "), ref(c).cast("string"))
            tried = F.when(ref(c).isNotNull() & tried.isNull(), F.raise_error(message)).otherwise(tried)
        changed[c] = tried.cast(t)
    return df.withColumns(changed)


def wrong_types(df: DataFrame, types: Mapping[str, str], examples: int = 3) -> DataFrame:
    """Cells that are present but not of the wanted type: number per column and the first examples."""
    check_columns(df, list(types))
    bad = F.array_compact(
        F.array(
            *[
                F.when(
                    ref(c).isNotNull() & ref(c).try_cast(t).isNull(),
                    F.struct(F.lit(c).alias("column"), F.lit(t).alias("wanted"), ref(c).cast("string").alias("value")),
                )
                for c, t in types.items()
            ]
        )
    )
    from pyspark.sql import Window

    counted = df.select(F.inline(bad)).groupBy("column", "wanted", "value").agg(F.count("*").alias("n"))
    totals = counted.groupBy("column", "wanted").agg(F.sum("n").alias("n_wrong"), F.count("*").alias("n_values"))
    place = F.row_number().over(Window.partitionBy("column", "wanted").orderBy("value"))
    first = (
        counted.withColumn("place", place).where(F.col("place") <= examples)
        .groupBy("column", "wanted")
        .agg(F.array_join(F.sort_array(F.collect_list("value")), ", ").alias("examples"))
    )
    return totals.join(F.broadcast(first), ["column", "wanted"])


def _pieces(text: Column, size: Column, distance: int, shifts: range) -> Column:
    """Keys (length, piece number, piece) of a text for right values of ``size`` letters.

    A right value is cut into ``distance + 1`` pieces.  So many edits leave one of them unchanged, and
    move it by at most ``distance`` places.
    """
    out = []
    for i in range(distance + 1):
        start = F.floor(size * i / (distance + 1))
        length = (F.floor(size * (i + 1) / (distance + 1)) - start).cast("int")
        for shift in shifts:
            at = (start + 1 + shift).cast("int")
            key = F.struct(size.cast("int").alias("size"), F.lit(i).alias("i"), F.substring(text, at, length).alias("piece"))
            out.append(F.when(at >= 1, key))
    return F.array_compact(F.array(*out))


def merge_misspelled(
    df: DataFrame, column: str, canonical: Sequence[str] | DataFrame, distance: int = 2, name: str | None = None
) -> DataFrame:
    """Replace a value by the nearest of the right values within an edit distance; ties by value.

    ``canonical`` is a list or a table of one column, of any size.  Each different value that is not right
    is compared only with right values that share a piece with it (see ``_pieces``).
    """
    right = canonical if isinstance(canonical, DataFrame) else df.sparkSession.createDataFrame([(v,) for v in canonical], "v string")
    right = settle(right.toDF("__v").where("__v is not null").distinct(), "right")
    x = ref(column).cast("string")
    wrong = df.select(x.alias("__x")).where("__x is not null").groupBy("__x").agg(F.count("*").alias("n")).select("__x")
    wrong = settle(wrong.join(right, F.col("__x") == F.col("__v"), "left_anti"), "wrong")
    sizes = [F.length("__x") + d for d in range(-distance, distance + 1)]
    asked = F.array_distinct(F.flatten(F.array(*[_pieces(F.col("__x"), s, distance, range(-distance, distance + 1)) for s in sizes])))
    asks = wrong.select("__x", F.explode(F.filter(asked, lambda k: k["size"] >= 0)).alias("__key"))
    offers = right.select("__v", F.explode(_pieces(F.col("__v"), F.length("__v"), distance, range(1))).alias("__key"))
    far = F.levenshtein("__x", "__v", distance)
    near = asks.join(offers, "__key").withColumn("d", far).where("d >= 0").groupBy("__x").agg(F.min(F.struct("d", "__v"))["__v"].alias("__fixed"))
    fixed = settle(near, "fixed").withColumnRenamed("__x", "__wrong")
    joined = lookup_join(df.withColumn("__wrong", x), fixed, ["__wrong"])
    out = joined.withColumn(name or column, F.coalesce("__fixed", x))
    return out.select(*[ref(c) for c in df.columns], *([] if name is None or name in df.columns else [ref(name)]))


def drop_incomplete_and_duplicates(df: DataFrame) -> DataFrame:
    return drop_duplicates(drop_missing(df))


def mean_error(df: DataFrame, columns: Sequence[str] | None = None, z: float = 1.96) -> DataFrame:
    """Mean, standard error and normal interval of numeric columns."""
    columns = numeric_columns(df, columns)
    totals = df.agg(
        *[F.count(as_double(df, c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.avg(as_double(df, c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(as_double(df, c)).alias(f"s{i}") for i, c in enumerate(columns)],
    )
    rows = []
    for i, c in enumerate(columns):
        error = F.try_divide(F.col(f"s{i}"), F.sqrt(F.col(f"n{i}").cast("double")))
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n{i}").alias("n"),
                F.col(f"m{i}").alias("mean"),
                error.alias("std_error"),
                (F.col(f"m{i}") - F.lit(z) * error).alias("low"),
                (F.col(f"m{i}") + F.lit(z) * error).alias("high"),
            )
        )
    return totals.select(unpivot_rows(rows))


def functional_dependency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Whether each value of ``a`` goes with a single value of ``b``, and how many do not."""
    pairs = df.select(ref(a).alias("a"), ref(b).alias("b")).distinct()
    per = pairs.groupBy("a").agg(F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("n_values"),
        F.count_if(F.col("n") > 1).alias("n_broken"),
        F.coalesce(F.max("n") <= 1, F.lit(True)).alias("holds"),
    )


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square statistic, degrees of freedom and Cramer's V of two categorical columns.

    Only value pairs that occur are formed: the statistic is n * (sum(o^2 / (row * column)) - 1).
    """
    pairs = df.select(cleaned(df, a).alias("a"), cleaned(df, b).alias("b")).na.drop()
    cells = settle(pairs.groupBy("a", "b").agg(F.count("*").alias("o")), "cells")
    rows = cells.groupBy("a").agg(F.sum("o").alias("r"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("c"))
    joined = lookup_join(lookup_join(cells, rows, ["a"]), cols, ["b"])
    share = joined.agg(
        F.sum(F.col("o").cast("double") * F.col("o") / (F.col("r").cast("double") * F.col("c"))).alias("share"),
        F.sum("o").alias("n"),
    )
    sizes = rows.agg(F.count("*").alias("n_a")).join(F.broadcast(cols.agg(F.count("*").alias("n_b"))), F.lit(True))
    chi = F.greatest(F.col("n") * (F.col("share") - 1), F.lit(0.0))
    least = F.least(F.col("n_a"), F.col("n_b")) - 1
    return share.join(F.broadcast(sizes), F.lit(True)).select(
        "n",
        chi.alias("chi_square"),
        ((F.col("n_a") - 1) * (F.col("n_b") - 1)).alias("dof"),
        F.sqrt(F.try_divide(chi, F.col("n") * least)).alias("cramers_v"),
    )


@dataclass(frozen=True)
class Expectation:
    """A rule for the cells of a column; missing cells break only ``max_null_share``."""

    column: str
    of_type: str | None = None
    low: float | None = None
    high: float | None = None
    allowed: tuple | None = None
    max_null_share: float | None = None

    def failing(self, df: DataFrame) -> dict[str, Column]:
        x = cleaned(df, self.column)
        rules = {}
        if self.of_type is not None:
            rules["type"] = x.isNotNull() & x.try_cast(self.of_type).isNull()
        if self.low is not None or self.high is not None:
            value = x.try_cast("double")
            below = value < F.lit(self.low) if self.low is not None else F.lit(False)
            above = value > F.lit(self.high) if self.high is not None else F.lit(False)
            rules["range"] = below | above
        if self.allowed is not None:
            rules["allowed"] = ~x.isin(list(self.allowed))
        if self.max_null_share is not None:
            rules["null_share"] = is_missing(df, self.column)
        return rules


def check_expectations(df: DataFrame, expectations: Sequence[Expectation]) -> DataFrame:
    """``column``, ``rule``, ``failing_rows``, ``passed`` for all rules in one pass."""
    counts, rows = [F.count("*").alias("rows")], []
    for e in expectations:
        check_columns(df, [e.column])
        for rule, failing in e.failing(df).items():
            name = f"f{len(rows)}"
            counts.append(F.count_if(failing).alias(name))
            passed = (
                F.col(name) <= F.col("rows") * F.lit(float(e.max_null_share))
                if rule == "null_share"
                else F.col(name) == 0
            )
            rows.append(
                F.struct(
                    F.lit(e.column).alias("column"), F.lit(rule).alias("rule"),
                    F.col(name).alias("failing_rows"), passed.alias("passed"),
                )
            )
    return df.agg(*counts).select(unpivot_rows(rows))
