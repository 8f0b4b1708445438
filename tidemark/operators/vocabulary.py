"""Stemming in place, lemmatising by a table, and counts of words.

Texts do not move.  The stems of frequent words are worked out once and looked up in place, those of other
words are worked out in place.  Lemmas are looked up in place if the table's measured size allows; with a
larger table words are shuffled to meet it, and put together again by the hashes of their text, so that no
key of the table is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import check_columns, ref
from ..functions.lookup import fits_broadcast, looked_up, lookup_join
from ..functions.stemming import STEMMERS
from ..functions.storage import settle
from ..functions.text import as_text, language_name, tokens
from .lemma_rules import apply_lemma_rules, learn_lemma_rules

FREQUENT_WORDS = 200_000  # at most so many words, and all of a count or none, have their stems looked up
FREQUENT_LENGTH = 64
MISSING = "__found"


def token_column(df: DataFrame, column: str, lower: bool = True) -> Column:
    """Tokens of a text column, or the given tokens of an array column."""
    col = ref(column)
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return F.transform(col, F.lower) if lower else col
    return tokens(F.lower(col) if lower else col)


def text_hashes(df: DataFrame, column: str) -> list[Column]:
    """Two hashes of a text (or of given tokens): rows with equal texts have equal results, whatever their key."""
    return [F.xxhash64(ref(column)).alias("__h1"), F.xxhash64(F.lit("second"), ref(column)).alias("__h2")]


def _spread(df: DataFrame, column: str, lower: bool = True) -> DataFrame:
    """The words of each text with their place; a text that occurs often gives equal rows."""
    return df.select(*text_hashes(df, column), F.posexplode(token_column(df, column, lower)).alias("pos", "word"))


def stemmer(lang: str):
    found = STEMMERS.get(lang) or STEMMERS.get(language_name(lang))
    if found is None:
        raise ValueError(f"no stemmer for {lang}; there are {sorted(STEMMERS)}")
    return found


def with_lemmas(rows: DataFrame, word: str, lemmas: DataFrame, out: str = "lemma") -> DataFrame:
    """Add the lemma of a word column from a table (form, lemma); unknown words stay."""
    forms = lemmas.groupBy(F.col("form").alias(word)).agg(F.min("lemma").alias("__lemma"))
    joined = lookup_join(rows, settle(forms, "lemmas"), [word])
    return joined.withColumn(out, F.coalesce("__lemma", ref(word))).drop("__lemma")


def _rejoin(rows: DataFrame, column: str) -> DataFrame:
    """Put the words of each text together in order; the group is one text, its copies fall together."""
    placed = F.sort_array(F.collect_set(F.struct("pos", ref(column).alias("w"))))
    return rows.groupBy("__h1", "__h2").agg(as_text(F.transform(placed, lambda p: p["w"])).alias("__made"))


def _with_made(df: DataFrame, column: str, made: DataFrame) -> DataFrame:
    h1, h2 = text_hashes(df, column)
    keyed = df.withColumns({"__a": h1, "__b": h2})
    return keyed.join(made, (F.col("__a") == F.col("__h1")) & (F.col("__b") == F.col("__h2")), "left").drop("__a", "__b", "__h1", "__h2")


def _replace_text(df: DataFrame, column: str, made: DataFrame, out: str) -> DataFrame:
    """A missing text stays missing; a text without words becomes empty."""
    columns = df.columns if out in df.columns else [*df.columns, out]
    joined = _with_made(df, column, made)
    text = F.when(ref(column).isNotNull(), F.coalesce("__made", F.lit("")))
    return joined.withColumn(out, text).select(*[ref(c) for c in columns])


def frequent_stems(df: DataFrame, words: str, lang: str) -> DataFrame:
    """word, stem: of the words that occur most, but more than once, in a column of tokens."""
    counts = df.select(F.explode(words).alias("word")).where(F.length("word") <= FREQUENT_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    counts = settle(counts.where("n > 1"), "words")
    # words per power of 2^(1/4) of their count: a few hundred rows at most
    grade = F.floor(F.log2("n") * 4)
    least, total = None, 0
    for r in counts.groupBy(grade.alias("grade")).agg(F.count("*").alias("words")).orderBy(F.desc("grade")).collect():
        total += r["words"]
        if total > FREQUENT_WORDS:
            break
        least = r["grade"]
    often = counts.where(grade >= least) if least is not None else counts.where(F.lit(False))
    return settle(often.select("word", stemmer(lang)(F.col("word")).alias("stem")), "stems")


def _with_stems(df: DataFrame, words: str, lang: str, out: str) -> DataFrame:
    """Add the stems of a column of tokens."""
    stem, found = stemmer(lang), F.col(MISSING)
    looked = df.withColumn(MISSING, looked_up(F.col(words), frequent_stems(df, words, lang)))
    return looked.withColumn(out, F.transform(words, lambda w, i: F.coalesce(F.get(found, i), stem(w)))).drop(MISSING)


def _with_lookup(df: DataFrame, words: str, table: DataFrame, out: str) -> DataFrame:
    """Add the values that a small table has for a column of tokens; other words stay."""
    looked = df.withColumn(MISSING, looked_up(F.col(words), table))
    return looked.withColumn(out, F.transform(words, lambda w, i: F.coalesce(F.get(MISSING, i), w))).drop(MISSING)


def stem_text(df: DataFrame, column: str, key: Sequence[str] = (), lang: str = "russian", out: str | None = None) -> DataFrame:
    """Lowercase, tokenise, stem and join with blanks, in place: no row moves and no key is needed.

    ``lang`` names a language or a stemmer ("porter").  A missing text stays missing; a text without words
    becomes empty.
    """
    check_columns(df, key)
    out = out or column
    columns = df.columns if out in df.columns else [*df.columns, out]
    made = _with_stems(df.withColumn("__words", token_column(df, column)), "__words", lang, "__stems")
    return made.withColumn(out, as_text(F.col("__stems"))).select(*[ref(c) for c in columns])


def lemmatize_text(
    df: DataFrame, column: str, key: Sequence[str], lemmas: DataFrame, lang: str = "russian", out: str | None = None, guess: bool = False
) -> DataFrame:
    """Lowercase, tokenise, replace by the lemma of the table (lang, form, lemma), join with blanks.

    With ``guess`` words that the table has neither as form nor as lemma get the lemma that rules learned
    from the table give them; otherwise they stay.
    """
    check_columns(df, key)
    out = out or column
    own = lemmas.where(F.col("lang") == language_name(lang)) if "lang" in lemmas.columns else lemmas
    own = settle(own.select("form", "lemma"), "lemmas")
    forms = own
    if guess:
        # a lemma is its own form, unless the table says otherwise
        bare = own.select(F.col("lemma").alias("form"), "lemma").join(own.select("form"), "form", "left_anti").distinct()
        own = own.unionByName(bare)
        forms = settle(own.groupBy("form").agg(F.min("lemma").alias("lemma")), "lemmas")
        rules = apply_lemma_rules(F.col("word"), learn_lemma_rules(own))
        # each different word once
        kinds = df.select(F.explode(token_column(df, column)).alias("word")).distinct()
        met = lookup_join(settle(kinds, "words"), forms.withColumnRenamed("form", "word"), ["word"])
        forms = settle(met.select(F.col("word").alias("form"), F.coalesce("lemma", rules).alias("lemma")), "lemmas")
    changes = _changes(forms)
    if not fits_broadcast(changes):
        rows = with_lemmas(_spread(df, column), "word", forms)
        return _replace_text(df, column, _rejoin(rows, "lemma"), out)
    columns = df.columns if out in df.columns else [*df.columns, out]
    made = _with_lookup(df.withColumn("__words", token_column(df, column)), "__words", changes, "__lemmas")
    return made.withColumn(out, as_text(F.col("__lemmas"))).select(*[ref(c) for c in columns])


def _changes(forms: DataFrame) -> DataFrame:
    """form, lemma: the forms whose lemma is another word."""
    one = forms.where("form is not null").groupBy("form").agg(F.min("lemma").alias("lemma"))
    return settle(one.where("lemma <> form"), "lemmas")


def stem_lemma_counts(df: DataFrame, column: str, lemmas: DataFrame | None = None, lang: str = "english") -> DataFrame:
    """Per different text (two hashes): words whose Porter stem differs from the lemma, and words in all.

    Words are counted per text before they are shuffled.  Copies of a text fall together; each has one first
    word, so the counts are divided by the number of first words.
    """
    spread = _spread(df, column)
    counted = spread.groupBy("__h1", "__h2", "word").agg(F.count("*").alias("n"), F.count_if(F.col("pos") == 0).alias("copies"))
    if lemmas is not None:
        own = lemmas.where(F.col("lang") == language_name(lang)) if "lang" in lemmas.columns else lemmas
        counted = with_lemmas(counted, "word", own)
    else:
        counted = counted.withColumn("lemma", F.col("word"))
    differs = stemmer("porter")(F.col("word")) != F.col("lemma")
    sums = counted.groupBy("__h1", "__h2").agg(
        F.sum(F.when(differs, F.col("n")).otherwise(0)).alias("d"), F.sum("n").alias("t"), F.sum("copies").alias("c")
    )
    return sums.select("__h1", "__h2", F.expr("d div c").alias("stem_diff"), F.expr("t div c").alias("total_words"))


def with_stem_lemma_counts(df: DataFrame, column: str, lemmas: DataFrame | None, lang: str) -> DataFrame:
    """All columns and stem_diff, total_words of each row's text; in place if the lemmas' size allows."""
    zero = F.lit(0).cast("bigint")
    if lemmas is None:
        changes = None
    else:
        own = lemmas.where(F.col("lang") == language_name(lang)) if "lang" in lemmas.columns else lemmas
        lemmas = settle(own.select("form", "lemma"), "lemmas")
        changes = _changes(lemmas)
    if changes is None or fits_broadcast(changes):
        tokens_ = df.withColumn("__tokens", token_column(df, column))
        made = _with_stems(tokens_, "__tokens", "porter", "__stems")
        made = made.withColumn("__lemmas", F.col("__tokens")) if changes is None else _with_lookup(made, "__tokens", changes, "__lemmas")
        differ = F.filter(F.zip_with("__stems", "__lemmas", lambda s, l: s != l), lambda d: d)
        counts = {"stem_diff": F.size(differ), "total_words": F.size("__tokens")}
        known = F.col("__tokens").isNotNull()
        return made.withColumns({c: F.when(known, n.cast("bigint")).otherwise(zero) for c, n in counts.items()}).drop("__tokens", "__stems", "__lemmas")
    joined = _with_made(df, column, stem_lemma_counts(df, column, lemmas, lang))
    return joined.withColumns({"stem_diff": F.coalesce("stem_diff", zero), "total_words": F.coalesce("total_words", zero)})


def stem_lemma_difference(
    df: DataFrame, column: str, key: Sequence[str], lemmas: DataFrame | None = None, lang: str = "english"
) -> DataFrame:
    """Per row: words whose Porter stem differs from the lemma, and words in all."""
    keys = [ref(c) for c in check_columns(df, key)]
    return with_stem_lemma_counts(df, column, lemmas, lang).select(*keys, "stem_diff", "total_words")


def word_statistics(df: DataFrame, column: str, key: Sequence[str], top: int = 5) -> DataFrame:
    """Per row: different words, mean word length and the most frequent words, ties by word.

    A text without words has 0 different words, no mean length and no frequent words.
    """
    from ..functions.text import words

    keys = [ref(c) for c in check_columns(df, key)]
    rows = df.select(*keys, F.coalesce(F.sort_array(words(F.lower(ref(column)))), F.array().cast("array<string>")).alias("__words"))
    # equal words lie side by side: the places where a word begins, and where the next one does
    new = lambda w, i: (i == 0) | (w != F.get("__words", i - 1))
    place = F.transform("__words", lambda w, i: F.when(new(w, i), i))
    rows = rows.withColumn("__starts", F.array_compact(place))
    rows = rows.withColumn("unique_words", F.size("__starts").cast("bigint"))
    end = lambda i: F.coalesce(F.get("__starts", i + 1), F.size("__words"))
    runs = F.transform("__starts", lambda s, i: F.struct((s - end(i)).alias("less"), s.alias("start")))
    most = F.slice(F.sort_array(runs), 1, top)
    length = F.aggregate("__words", F.lit(0).cast("bigint"), lambda n, w: n + F.length(w))
    return rows.select(
        *keys, "unique_words",
        F.when(F.col("unique_words") > 0, length / F.size("__words")).alias("avg_word_length"),
        F.array_join(F.transform(most, lambda r: F.get("__words", r["start"])), ", ").alias("frequent_words"),
    )
