"""Ordered text preparation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.columns import ref
from ..functions.text import (
    as_text,
    handle_numbers,
    strip_html,
    strip_special,
    tokens,
    without_stop_words,
)
from .sentences import SentenceModel, learn_sentences, sentence_tokens
from .vocabulary import lemmatize_text, stem_text, token_column

Step = str | tuple[str, Mapping[str, object]]


def _text(df: DataFrame, column: str):
    """The text of a column; tokens are joined with blanks."""
    return as_text(ref(column)) if isinstance(df.schema[column].dataType, T.ArrayType) else ref(column)


def remove_html(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, strip_html(_text(df, column)))


def remove_special_chars(df: DataFrame, column: str, keep_punctuation: bool = False) -> DataFrame:
    return df.withColumn(column, strip_special(_text(df, column), keep_punctuation))


def number_handling(df: DataFrame, column: str, strategy: str = "keep") -> DataFrame:
    return df.withColumn(column, handle_numbers(_text(df, column), strategy))


def tokenize(
    df: DataFrame, column: str, token_type: str = "word", lang: str = "english", model: SentenceModel | None = None
) -> DataFrame:
    """Texts to arrays of words or of sentences.

    The rules of words are the same for every language.  Sentences follow abbreviations and starters that
    ``model`` has, or that are learned from the column itself.
    """
    if token_type == "word":
        return df.withColumn(column, tokens(_text(df, column)))
    if token_type == "sentence":
        text = _text(df, column)
        model = model or learn_sentences(df.select(text.alias("text")), "text")
        return df.withColumn(column, sentence_tokens(text, model))
    raise ValueError(f"unknown kind of token: {token_type}")


def remove_stopwords(df: DataFrame, column: str, lang: str = "russian") -> DataFrame:
    """Lowercase, tokenise, drop the stop words of the language and join with blanks."""
    return df.withColumn(column, as_text(without_stop_words(token_column(df, column), lang)))


def normalize_words(
    df: DataFrame,
    column: str,
    key: Sequence[str],
    method: str = "stem",
    lang: str = "russian",
    lemmas: DataFrame | None = None,
) -> DataFrame:
    if method == "stem":
        return stem_text(df, column, key, lang)
    if method == "lemmatize":
        if lemmas is None:
            raise ValueError("lemmatize needs a table of lemmas (lang, form, lemma)")
        return lemmatize_text(df, column, key, lemmas, lang)
    raise ValueError(f"unknown method: {method}")


STEPS = {
    "remove_html": remove_html,
    "remove_special_chars": remove_special_chars,
    "handle_numbers": number_handling,
    "tokenize": tokenize,
    "remove_stopwords": remove_stopwords,
    "normalize": normalize_words,
}


def prepare_text(df: DataFrame, column: str, steps: Sequence[Step], key: Sequence[str] = ()) -> DataFrame:
    """Apply steps in order; a step is a name or (name, parameters).

    All steps up to ``normalize`` are one projection.  ``normalize`` needs ``key``, the columns that
    identify a row.
    """
    for step in steps:
        name, params = (step, {}) if isinstance(step, str) else step
        if name not in STEPS:
            raise ValueError(f"unknown step: {name}; known are {sorted(STEPS)}")
        if name == "normalize":
            params = {"key": list(key), **params}
        df = STEPS[name](df, column, **params)
    return df


def describe_steps(steps: Sequence[Step]) -> str:
    named = [(s, {}) if isinstance(s, str) else s for s in steps]
    return " -> ".join(n + ("" if not p else f"({', '.join(f'{k}={v}' for k, v in p.items())})") for n, p in named)

