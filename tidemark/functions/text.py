"""Column expressions on texts: patterns, tokens, sentences, stop words.

The patterns spell out Unicode classes, because ``\\w`` and ``\\d`` are ASCII in Java.
"""

from __future__ import annotations

from functools import cache
from importlib import resources

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_CLASS = r"\p{L}\p{N}_"
SPACE_CLASS = r"\s\p{Z}"
HTML_TAG = "<[^>]+>"
SPECIAL = f"[^{WORD_CLASS}{SPACE_CLASS}]"
SPECIAL_BUT_PUNCTUATION = f"[^{WORD_CLASS}{SPACE_CLASS}.,!?]"
DIGITS = r"\p{Nd}+"
WORD = f"[{WORD_CLASS}]+(?:'[{WORD_CLASS}]+)?"
TOKEN = f"{WORD}|{SPECIAL}"
SENTENCE_GAP = f"(?<=[.!?])[{SPACE_CLASS}]+"
OUTER_SPACE = f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$"

# Language codes and the names of their stop word lists.
LANGUAGES = {"de": "german", "en": "english", "es": "spanish", "fr": "french", "ru": "russian"}
DEFAULT_LANGUAGE = "english"


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, HTML_TAG, "")


def strip_special(text: Column, keep_punctuation: bool = False) -> Column:
    return F.regexp_replace(text, SPECIAL_BUT_PUNCTUATION if keep_punctuation else SPECIAL, "")


def handle_numbers(text: Column, strategy: str = "keep") -> Column:
    if strategy == "keep":
        return text
    if strategy == "remove":
        return F.regexp_replace(text, DIGITS, "")
    if strategy == "replace":
        return F.regexp_replace(text, DIGITS, "[NUM]")
    raise ValueError(f"unknown strategy: {strategy}")


def tokens(text: Column) -> Column:
    """Words, with an inner apostrophe, and single punctuation marks."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def sentences(text: Column) -> Column:
    """Pieces after a full stop, exclamation or question mark and blanks; without empty ones."""
    parts = F.split(text, SENTENCE_GAP)
    trimmed = F.transform(parts, lambda s: F.regexp_replace(s, OUTER_SPACE, ""))
    return F.filter(trimmed, lambda s: s != "")


def language_name(lang: str) -> str:
    name = LANGUAGES.get(lang, lang)
    if name not in LANGUAGES.values():
        raise ValueError(f"unknown language: {lang}; known are {sorted(LANGUAGES.values())}")
    return name


@cache
def stop_words(lang: str) -> tuple[str, ...]:
    """The stop words of Spark's StopWordsRemover, kept as files of this package: no session is needed."""
    lists = resources.files(__package__).joinpath("stopwords")
    return tuple(lists.joinpath(f"{language_name(lang)}.txt").read_text(encoding="utf-8").splitlines())


def is_stop_word(word: Column, lang: str) -> Column:
    """A hash set lookup per word."""
    return word.isin(list(stop_words(lang)))


def without_stop_words(tokens_: Column, lang: str) -> Column:
    return F.filter(tokens_, lambda t: ~is_stop_word(t, lang))


def stop_word_hits(tokens_: Column, lang: str) -> Column:
    return F.size(F.filter(tokens_, lambda t: is_stop_word(F.lower(t), lang)))


def as_text(tokens_: Column) -> Column:
    return F.array_join(tokens_, " ")
