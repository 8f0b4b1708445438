"""Language of texts: by stop words, and by trained character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import check_columns, ref
from ..functions.lookup import fits_broadcast, lookup_join
from ..functions.storage import settle
from ..functions.text import DEFAULT_LANGUAGE, LANGUAGES, WORD_CLASS, stop_word_hits

CYRILLIC = "[Ѐ-ӿ]"
MAX_TEXT = 2**31 - 1
SLICE_BYTES = 2_000_000
CHARACTER = 21  # bits


def hits_by_language(tokens_: Column) -> Column:
    """Struct with the stop word hits per language."""
    return F.struct(*[stop_word_hits(tokens_, name).alias(name) for name in sorted(LANGUAGES.values())])


def pick_language(text: Column, hits: Column) -> Column:
    """Russian if most letters are Cyrillic; else the language with most hits, ties by name."""
    letters = F.length(F.regexp_replace(text, f"[^{WORD_CLASS}]", ""))
    cyrillic = F.length(F.regexp_replace(text, f"[^{CYRILLIC[1:-1]}]", ""))
    names = sorted(LANGUAGES.values())
    most = F.greatest(*[hits[name] for name in names])
    choice = F.when(most == 0, F.lit(DEFAULT_LANGUAGE))
    for name in names:
        choice = choice.when(hits[name] == most, F.lit(name))
    return F.when(cyrillic * 2 > letters, F.lit("russian")).otherwise(choice)


def _grams(df: DataFrame, text: str, keep: Sequence[Column], size: int) -> DataFrame:
    """Every run of ``size`` characters of the lowercase text, one per row.

    Runs that start at every ``size``-th character are the matches of one pattern; there are ``size``
    places to start from.
    """
    runs = [
        F.regexp_extract_all(F.substring(F.lower(ref(text)), start + 1, MAX_TEXT), F.lit(f"(?s).{{{size}}}"), F.lit(0))
        for start in range(size)
    ]
    return df.select(*keep, F.explode(F.flatten(F.array(*runs))).alias("gram"))


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts of a bounded number of bytes at a time: the first one's place, all code points, and each one's place."""
    values, start = texts.to_pylist(), 0
    while start < len(values):
        end, size = start, 0
        while end < len(values) and size < SLICE_BYTES:
            size += len(values[end] or b"")
            end += 1
        some = [(v or b"").decode("utf-8", "replace") for v in values[start:end]]
        points = np.frombuffer("".join(some).encode("utf-32-le"), "<u4")
        yield start, points, np.repeat(np.arange(start, end), [len(t) for t in some])
        start = end


def _whole(row: np.ndarray, size: int) -> np.ndarray:
    """Where runs of ``size`` characters start that do not leave their text."""
    return np.flatnonzero(row[: max(0, len(row) - size + 1)] == row[size - 1 :])


def _codes(points: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A number for each run, equal for equal runs only."""
    code, bits = points[at].astype(np.int64), CHARACTER
    for j in range(1, size):
        if bits + CHARACTER > 63:
            code, bits = np.unique(code, return_inverse=True)[1], 63 - CHARACTER
        code, bits = code << CHARACTER | points[at + j], bits + CHARACTER
    return code


def _count_grams(df: DataFrame, text: str, lang: str, size: int) -> DataFrame:
    """``lang``, ``gram``, ``n``: the runs of a slice of texts are counted in place before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch["lang"].dictionary_encode()
            known = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for _, points, row in _slices(batch["text"]):
                start = _whole(row, size)
                langs = known[row[start]]
                for one in np.unique(langs):
                    at = start[langs == one]
                    _, first, n = np.unique(_codes(points, at, size), return_index=True, return_counts=True)
                    joined = points[at[first][:, None] + np.arange(size)].tobytes().decode("utf-32-le")
                    grams = pa.array([joined[i : i + size] for i in range(0, len(joined), size)], pa.string())
                    name = coded.dictionary.take(pa.array([int(one) if one >= 0 else None], pa.int32())).take(pa.array(np.zeros(len(n), np.int32)))
                    yield pa.RecordBatch.from_arrays([name, grams, pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    schema = T.StructType([T.StructField("lang", df.schema[lang].dataType), T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])
    texts = df.select(ref(lang).alias("lang"), F.lower(ref(text)).cast("binary").alias("text"))
    return texts.mapInArrow(count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _scored(text: Column, model: DataFrame, size: int) -> Column:
    """Of each text: the number of its runs that the model has, and by language the sum of their weights.

    The model is broadcast as it is, so it must be of measured small size; runs are looked up a character at a time.
    """
    rows = model.where("gram is not null").select("gram", "lang", "weight").toArrow()
    grams, names = rows["gram"].combine_chunks().dictionary_encode(), rows["lang"].combine_chunks().dictionary_encode()
    points = np.frombuffer("".join(grams.dictionary.to_pylist()).encode("utf-32-le"), "<u4").reshape(-1, size).astype(np.int64)
    levels, place = [], np.zeros(len(points), np.int64)
    for j in range(size):
        level, place = np.unique(place << CHARACTER | points[:, j], return_inverse=True)
        levels.append(level)
    owner = place[grams.indices.to_numpy()]
    order = np.lexsort((names.indices.to_numpy(), owner))
    ends = np.searchsorted(owner[order], np.arange(len(points) + 1))
    table = levels, ends, names.indices.to_numpy()[order].astype(np.int64), rows["weight"].to_numpy()[order], names.dictionary
    shared = model.sparkSession.sparkContext.broadcast(table)

    def score(texts: pa.Array) -> pa.Array:
        levels, ends, langs, weights, names = shared.value
        known, parts = np.zeros(len(texts), np.int64), []
        for _, points, row in _slices(texts):
            at = _whole(row, size)
            place = np.zeros(len(at), np.int64)
            for j, level in enumerate(levels):
                code = place << CHARACTER | points[at + j]
                place = np.minimum(np.searchsorted(level, code), len(level) - 1)
                there = level[place] == code
                at, place = at[there], place[there]
            np.add.at(known, row[at], 1)
            pair, n = np.unique(row[at] * len(levels[-1]) + place, return_counts=True)
            owner, place = np.divmod(pair, len(levels[-1]))
            each = ends[place + 1] - ends[place]
            entry = np.repeat(ends[place] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            which, at_ = np.unique(np.repeat(owner, each) * len(names) + langs[entry], return_inverse=True)
            parts.append((which, np.bincount(at_, np.repeat(n, each) * weights[entry], len(which))))
        which, gain = (np.concatenate(v) for v in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0))
        owner, lang = np.divmod(which, max(1, len(names)))
        offsets = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32))
        gains = pa.StructArray.from_arrays([names.take(pa.array(lang)), pa.array(gain)], names=["lang", "gain"])
        return pa.StructArray.from_arrays([pa.array(known), pa.ListArray.from_arrays(offsets, gains)], names=["known", "gains"])

    kind = model.schema["lang"].dataType.simpleString()
    return F.arrow_udf(score, f"known bigint, gains array<struct<lang: {kind}, gain: double>>")(F.lower(text).cast("binary"))


def train_language_model(df: DataFrame, text: str, lang: str, size: int = 3) -> DataFrame:
    """Naive Bayes with add-one smoothing, for any number of languages: ``lang``, ``gram``, ``weight``, ``unseen``.

    A row tells the log probability of a gram in a language that has it, as the ``weight`` over ``unseen``, that of
    a gram which the language lacks.  A row without a gram stands for the language itself.
    """
    counts = settle(_count_grams(df, text, lang, size), "grams")
    different = counts.select("gram").distinct().count()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).where("lang is not null")
    unseen = -F.log(F.col("total").cast("double") + different)
    languages = settle(totals.select("lang", unseen.alias("unseen")), "languages")
    rows = lookup_join(counts, languages, ["lang"], "inner").select("lang", "gram", F.log(F.col("n") + 1.0).alias("weight"), "unseen")
    whole = languages.select("lang", F.lit(None).cast("string").alias("gram"), F.lit(0.0).alias("weight"), "unseen")
    return settle(rows.unionByName(whole), "model")


def classify_language(
    df: DataFrame, text: str, key: Sequence[str], model: DataFrame, size: int = 3, out: str = "lang",
    default: str | None = None,
) -> DataFrame:
    """Key and most probable language of each text, ties by name; grams the model lacks are ignored.

    A model of measured small size is broadcast, and texts are scored in place.  With a larger one grams are counted
    per text before they meet it, whose weights of a gram are one row.  Languages that share no gram with a text
    differ by ``unseen`` alone, so of these only the first one need be compared.
    """
    keys = [ref(c) for c in check_columns(df, key)]
    likely = model.where("gram is null").agg(F.min(F.struct((-F.col("unseen")).alias("u"), "lang")).alias("first")).first()["first"]
    if likely is None:
        return df.select(*keys, F.lit(default).cast("string").alias(out))
    languages = model.where("gram is null").select("lang", "unseen")
    if fits_broadcast(model) and not model.where("gram is not null").isEmpty():
        met = settle(df.select(*keys, _scored(ref(text), model, size).alias("__scored")).where("__scored.known > 0"), "scored")
        common = met.groupBy(*keys).agg(F.sum("__scored.known").alias("__known"))
        gains = met.select(*keys, F.inline("__scored.gains")).groupBy(*keys, "lang").agg(F.sum("gain").alias("gain"))
        single = lookup_join(gains, languages, ["lang"], "inner").select(*keys, "lang", "unseen", "gain")
    else:
        counted = _grams(df, text, keys, size).groupBy(*[ref(c) for c in key], "gram").agg(F.count("*").alias("n"))
        one = F.struct("lang", "weight", "unseen")
        by_gram = settle(model.where("gram is not null").groupBy("gram").agg(F.collect_list(one).alias("langs")), "model")
        met = settle(lookup_join(counted, by_gram, ["gram"], "inner"), "met")
        common = met.groupBy(*keys).agg(F.sum("n").alias("__known"))
        single = met.select(*keys, "n", F.inline("langs")).groupBy(*keys, "lang", "unseen").agg(F.sum(F.col("n") * F.col("weight")).alias("gain"))
    none = common.select(*keys, F.lit(likely["lang"]).alias("lang"), F.lit(-likely["u"]).alias("unseen"), F.lit(0.0).alias("gain"))
    both = single.unionByName(none.select(*single.columns)).join(common, list(key))
    score = F.col("gain") + F.col("__known") * F.col("unseen")
    found = both.groupBy(*keys).agg(F.min(F.struct((-score).alias("s"), "lang"))["lang"].alias(out))
    joined = df.select(*keys).join(found, list(key), "left")
    return joined.withColumn(out, F.coalesce(out, F.lit(default))) if default else joined
