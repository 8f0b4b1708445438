"""Sentence tokens with abbreviations learned from a corpus (Kiss and Strunk's statistics).

A word is an abbreviation if it and a following full stop occur together far more often than by chance: the
log-likelihood ratio, weighted by length, inner full stops and uses without one.  A word is a sentence starter
if it follows the end of a sentence far more often than elsewhere.  Both are grouped aggregations over the
words of the corpus.  The split itself stays in the row: a mark at a blank ends a sentence unless the next
word begins in lower case, or an abbreviation or initial stands before it and no capitalised starter behind it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ref
from ..functions.lookup import fits_broadcast
from ..functions.storage import settle
from ..functions.text import OUTER_SPACE, SPACE_CLASS

# Fixed values of the published method.
LEAST_ABBREVIATION = 0.3
LEAST_STARTER = 30.0
SHARE_OF_STOPS = 0.99

CLOSERS = r"[\"')\]}»”’]"
SEGMENT = rf"[\s\S]+?(?:[.!?]{CLOSERS}*[{SPACE_CLASS}]+|$)"
_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$"
_STOP = rf"\.{CLOSERS}*$"


def type_of(word: Column) -> Column:
    """A word in lower case, without outer signs and its last full stop."""
    return F.regexp_replace(F.lower(F.regexp_replace(word, _EDGES, "")), r"\.$", "")


def segments(text: Column) -> Column:
    """Parts of a text, each with the mark and the blanks at its end."""
    return F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(0))


def last_word(segment: Column) -> Column:
    return F.regexp_extract(segment, rf"([^{SPACE_CLASS}]+)[{SPACE_CLASS}]*$", 1)


def first_word(segment: Column) -> Column:
    return F.regexp_extract(segment, rf"^[{SPACE_CLASS}]*([^{SPACE_CLASS}]+)", 1)


def _log(x: Column) -> Column:
    """Counts are compared with smoothed shares, so that no logarithm is of 0."""
    return F.log(F.greatest(x, F.lit(1e-12)))


def word_counts(df: DataFrame, column: str) -> DataFrame:
    """type, stops, total: words of the corpus, with a full stop and in all."""
    words = df.select(F.explode(F.split(ref(column), f"[{SPACE_CLASS}]+")).alias("w")).where("w <> ''")
    counted = words.select(type_of(F.col("w")).alias("type"), F.col("w").rlike(_STOP).cast("int").alias("stop"))
    return counted.groupBy("type").agg(F.sum("stop").alias("stops"), F.count("*").alias("total"))


def abbreviation_score(stops: Column, total: Column, name: Column, all_stops: Column, all_words: Column) -> Column:
    """The weighted log-likelihood ratio of a word and a full stop."""
    share, rest = all_stops / all_words, total - stops
    chance = stops * _log(share) + rest * _log(1 - share)
    bound = stops * _log(F.lit(SHARE_OF_STOPS)) + rest * _log(F.lit(1 - SHARE_OF_STOPS))
    inner = F.length(name) - F.length(F.replace(name, F.lit("."), F.lit("")))
    signs = F.length(name) - inner
    return 2 * (bound - chance) * F.exp(-signs) * (inner + 1) * F.pow(signs, -rest)


def starter_score(breaks: Column, total: Column, after: Column, all_words: Column) -> Column:
    """The log-likelihood ratio of a word and the end of a sentence before it."""
    p, p1 = total / all_words, after / breaks
    p2 = (total - after) / F.greatest(all_words - breaks, F.lit(1.0))
    other, rest = total - after, all_words - breaks - total + after
    one = lambda hits, misses, share: hits * _log(share) + misses * _log(1 - share)
    apart = one(after, breaks - after, p1) + one(other, rest, p2)
    return 2 * (apart - one(after, breaks - after, p) - one(other, rest, p))


@dataclass
class SentenceModel:
    """Learned abbreviations and sentence starters, both in lower case without a full stop."""

    abbreviations: list[str]
    starters: list[str]


def _listed(df: DataFrame) -> list[str]:
    found = settle(df, "types")
    if not fits_broadcast(found):
        raise ValueError("too many learned words for a list; learn from a cleaner corpus")
    return sorted(r["type"] for r in found.collect())


def learn_sentences(df: DataFrame, column: str) -> SentenceModel:
    """Learn abbreviations, and then sentence starters, from a column of texts."""
    counts = settle(word_counts(df, column), "counts")
    sums = counts.agg(F.sum("stops"), F.sum("total")).first()
    if not sums[0]:
        return SentenceModel([], [])
    all_stops, all_words = (F.lit(float(x)) for x in sums)
    score = abbreviation_score(F.col("stops"), F.col("total"), F.col("type"), all_stops, all_words)
    some = counts.where((F.col("stops") > 0) & F.col("type").rlike(r"\p{L}"))
    abbreviations = _listed(some.where(score >= LEAST_ABBREVIATION).select("type"))
    pairs = df.select(segments(ref(column)).alias("s")).select(
        F.explode(F.arrays_zip(F.col("s").alias("a"), F.slice("s", 2, F.size("s")).alias("b"))).alias("p")
    )
    ends = pairs.select(last_word(F.col("p.a")).alias("last"), first_word(F.col("p.b")).alias("next")).where("next is not null")
    sure = ~_stops_within(F.col("last"), abbreviations) & ~F.col("next").rlike(r"^\p{Ll}")
    after = ends.where(sure).groupBy(type_of(F.col("next")).alias("type")).agg(F.count("*").alias("after"))
    after = settle(after, "starters")
    ends_in_all = after.agg(F.sum("after")).first()[0]
    if not ends_in_all:
        return SentenceModel(abbreviations, [])
    breaks = F.lit(float(ends_in_all))
    met = counts.join(after, "type").where(F.col("type").rlike(r"^\p{L}+$"))
    likely = starter_score(breaks, F.col("total"), F.least("after", "total"), all_words) >= LEAST_STARTER
    often = F.col("after") / breaks > F.col("total") / all_words
    return SentenceModel(abbreviations, _listed(met.where(likely & often).select("type")))


def _stops_within(word: Column, abbreviations: list[str]) -> Column:
    """The word's full stop is that of an abbreviation or an initial."""
    kind = type_of(word)
    known = kind.isin(abbreviations) if abbreviations else F.lit(False)
    return word.rlike(_STOP) & (known | kind.rlike(r"^\p{L}$"))


def sentence_tokens(text: Column, model: SentenceModel) -> Column:
    """The sentences of a text, trimmed, without empty ones; null stays null."""

    def ends(s: Column, i: Column) -> Column:
        here, after = last_word(s[i]), first_word(s[i + 1])
        kind = type_of(after)
        starts = after.rlike(r"^[^\p{L}\p{N}]*\p{Lu}") & (kind.isin(model.starters) if model.starters else F.lit(False))
        return F.when(_stops_within(here, model.abbreviations), starts).otherwise(~after.rlike(r"^\p{Ll}"))

    def cut(s: Column) -> Column:
        last = F.size(s) - 1
        places = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | ends(s, i))
        return F.transform(F.array(F.struct(s.alias("s"), places.alias("e"))), lambda x: F.transform(
            x["e"],
            lambda e, k: F.regexp_replace(
                F.array_join(F.slice(x["s"], F.when(k == 0, 1).otherwise(F.get(x["e"], k - 1) + 2), e - F.when(k == 0, -1).otherwise(F.get(x["e"], k - 1))), ""),
                OUTER_SPACE, "",
            ),
        ))[0]

    found = F.transform(F.array(segments(text)), lambda s: F.when(F.size(s) > 0, cut(s)).otherwise(F.array().cast("array<string>")))[0]
    return F.when(text.isNotNull(), F.filter(found, lambda x: x != ""))
