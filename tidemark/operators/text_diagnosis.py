"""Diagnose texts and advise on preparation steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.columns import check_columns, ref
from ..functions.text import (
    HTML_TAG,
    SPECIAL_BUT_PUNCTUATION,
    language_name,
    sentences,
    stop_word_hits,
    tokens,
)
from .language import hits_by_language, pick_language
from .vocabulary import with_stem_lemma_counts

ACTION = "struct<action:string,description:string,action_label:string>"


def _action(action: str, description: str | Column) -> Column:
    text = F.lit(description) if isinstance(description, str) else description
    return F.struct(
        F.lit(action).alias("action"),
        text.alias("description"),
        F.lit(labels.ACTION_LABELS.get(action, action)).alias("action_label"),
    )


def cleaning_flags(text: Column) -> dict[str, Column]:
    return {
        "remove_html": text.rlike(HTML_TAG),
        "remove_special_chars": text.rlike(SPECIAL_BUT_PUNCTUATION),
        "handle_numbers": text.rlike(r"\p{Nd}"),
    }


def cleaning_advice(text: Column) -> list[Column]:
    return [
        F.when(flag, _action(action, labels.CLEANING[action])) for action, flag in cleaning_flags(text).items()
    ]


def tokenize_advice(words: Column, sentences_: Column, task: str = "unknown") -> Column:
    """By the task; without a known task by length, sentence length and questions."""
    if task in labels.TASK_RULES:
        return _action(*labels.TASK_RULES[task])
    n_words, n_sentences = F.size(words), F.size(sentences_)
    asks = F.contains(F.array_join(sentences_, " "), F.lit("?"))
    return (
        F.when((n_sentences == 0) | (n_words < 5), _action("word_tokenize", labels.SHORT_TEXT))
        .when(n_words > n_sentences * 15, _action("sentence_tokenize", labels.LONG_SENTENCES))
        .when(asks, _action("sentence_tokenize", labels.QUESTIONS))
        .otherwise(_action("word_tokenize", labels.STANDARD))
    )


def percent(share: Column) -> Column:
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def stop_word_advice(ratio: Column) -> Column:
    def told(text: str) -> Column:
        return F.concat(F.lit(f"{text} ("), percent(ratio), F.lit(")"))

    return F.when(ratio > 0.4, _action("remove_stopwords", told(labels.MANY_STOPWORDS))).when(
        ratio > 0.2, _action("consider_remove_stopwords", told(labels.SOME_STOPWORDS))
    )


def stem_lemma_advice(stem_diff: Column, total_words: Column) -> Column:
    share = F.coalesce(F.try_divide(stem_diff, total_words), F.lit(0.0))
    return (
        F.when(share > 0.3, _action("lemmatize", labels.LEMMA_MUCH_BETTER))
        .when(share > 0.1, _action("lemmatize_or_stem", labels.LEMMA_BETTER))
        .otherwise(_action("stem", labels.STEM_ENOUGH))
    )


def stop_word_ratio(hits: Column, words: Column) -> Column:
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(hits / F.size(words))


def analyze_texts(
    df: DataFrame,
    column: str,
    key: Sequence[str],
    lang: str | None = None,
    task: str = "unknown",
    check_clean: bool = True,
    check_tokenize: bool = True,
    check_stopwords: bool = True,
    check_stem_lemma: bool = False,
    lemmas: DataFrame | None = None,
    language_chars: int | None = None,
) -> DataFrame:
    """One row of metrics and recommendations per text.

    Without ``lang`` the language is told from the whole text, or from its first ``language_chars``
    characters.  All but the stem-lemma check is one projection without a shuffle.
    """
    keys = [ref(c) for c in check_columns(df, key)]
    text = ref(column)
    base = df.select(*keys, text.alias("__text"))
    base = base.withColumns({"__words": tokens(F.col("__text")), "__sentences": sentences(F.col("__text"))})
    told = F.col("__text") if language_chars is None else F.substring("__text", 1, language_chars)
    if lang is not None:
        name = language_name(lang)
        base = base.withColumn("detected_lang", F.lit(name)).withColumn(
            "__own", stop_word_hits(F.col("__words"), name)
        )
    else:
        looked = F.col("__words") if language_chars is None else tokens(told)
        base = base.withColumn("__hits", hits_by_language(looked))
        base = base.withColumn("detected_lang", pick_language(told, F.col("__hits")))
        own = F.lit(0)
        for name in [f.name for f in base.schema["__hits"].dataType]:
            hits = F.col("__hits")[name] if language_chars is None else stop_word_hits(F.col("__words"), name)
            own = F.when(F.col("detected_lang") == name, hits).otherwise(own)
        base = base.withColumn("__own", own)
    ratio = stop_word_ratio(F.col("__own"), F.col("__words"))
    base = base.withColumn("stopword_ratio", ratio if check_stopwords else F.lit(None).cast("double"))
    advice: list[Column] = []
    if check_clean:
        advice += cleaning_advice(F.col("__text"))
    if check_tokenize:
        advice.append(tokenize_advice(F.col("__words"), F.col("__sentences"), task))
    if check_stopwords:
        advice.append(stop_word_advice(F.col("stopword_ratio")))
    stems = F.lit(None).cast("struct<stem_diff:bigint,total_words:bigint>")
    if check_stem_lemma:
        base = with_stem_lemma_counts(base, "__text", lemmas, lang or "english")
        stems = F.struct("stem_diff", "total_words")
        advice.append(stem_lemma_advice(F.col("stem_diff"), F.col("total_words")))
    found = F.array_compact(F.array(*[a.cast(ACTION) for a in advice])) if advice else F.array().cast(f"array<{ACTION}>")
    return base.select(
        *keys,
        F.length("__text").alias("length"),
        "detected_lang",
        "stopword_ratio",
        F.size("__words").alias("n_words"),
        F.size("__sentences").alias("n_sentences"),
        stems.alias("stem_vs_lemma"),
        found.alias("recommendations"),
    )


def analyze_collection(df: DataFrame, column: str, key: Sequence[str], **options) -> DataFrame:
    """Mean length, main language and all different recommendations of a collection.

    Every text counts.  Recommendations are made distinct before they meet; there are few kinds.
    """
    each = analyze_texts(df, column, key, **options)
    kinds = each.select("length", "detected_lang", "recommendations").groupBy("detected_lang").agg(
        F.count("*").alias("n"),
        F.sum("length").alias("length"),
        F.array_distinct(F.flatten(F.collect_set("recommendations"))).alias("found"),
    )
    return kinds.agg(
        (F.sum("length") / F.sum("n")).alias("avg_length"),
        F.min(F.struct((-F.col("n")).alias("rank"), "detected_lang"))["detected_lang"].alias("main_lang"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("recommendations"),
    )
