"""The published Snowball stemmers for English and Russian and the Porter stemmer as column expressions.

A word passes through the steps as a struct: ``w`` is the word so far, ``p1`` and ``p2`` the starts of
the regions R1 and R2.  Each step is a function given to ``transform``, so the expression grows with
the number of steps and not with how often a step uses the result of the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published English (Porter2) algorithm.
ENGLISH_VOWELS = "aeiouy"
ENGLISH_REGION_PREFIXES = "gener|commun|arsen"
ENGLISH_IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
ENGLISH_UNCHANGED = ["sky", "news", "howe", "atlas", "cosmos", "bias", "andes"]
ENGLISH_DONE_EARLY = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
ENGLISH_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
    "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": "",
}
ENGLISH_STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "", "ative": "",
}
ENGLISH_STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate",
    "iti", "ous", "ive", "ize", "ion",
]
ENGLISH_SHORT = "(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"

# Fixed values of the published Porter algorithm, with the exceptions that its common extension adds.
PORTER_IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning",
    "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
PORTER_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful",
    "logi": "log",
}
PORTER_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
PORTER_STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
]
PORTER_MORE_THAN_0 = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
PORTER_MORE_THAN_1 = "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]"
PORTER_SHORT = "(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
PORTER_DOUBLE = "(?:bb|cc|dd|ff|gg|hh|jj|kk|ll|mm|nn|pp|qq|rr|ss|tt|vv|ww|xx|zz)$"

# Fixed values of the published Russian algorithm.
RUSSIAN_VOWELS = "аеиоуыэюя"
RUSSIAN_GERUND = "(?:(?<=[ая])(?:вшись|вши|в)|ившись|ивши|ив|ывшись|ывши|ыв)$"
RUSSIAN_REFLEXIVE = "(?:ся|сь)$"
RUSSIAN_ADJECTIVE = (
    "(?:ее|ие|ые|ое|ими|ыми|ей|ий|ый|ой|ем|им|ым|ом|его|ого|ему|ому|их|ых|ую|юю|ая|яя|ою|ею)$"
)
RUSSIAN_PARTICIPLE = "(?:(?<=[ая])(?:ем|нн|вш|ющ|щ)|ивш|ывш|ующ)$"
RUSSIAN_VERB = (
    "(?:(?<=[ая])(?:ла|на|ете|йте|ли|й|л|ем|н|ло|но|ет|ют|ны|ть|ешь|нно)|ила|ыла|ена|ейте|уйте|ите|"
    "или|ыли|ей|уй|ил|ыл|им|ым|ен|ило|ыло|ено|ят|ует|уют|ит|ыт|ены|ить|ыть|ишь|ую|ю)$"
)
RUSSIAN_NOUN = (
    "(?:а|ев|ов|ие|ье|е|иями|ями|ами|еи|ии|и|ией|ей|ой|ий|й|иям|ям|ием|ем|ам|ом|о|у|ах|иях|ях|ы|ь|"
    "ию|ью|ю|ия|ья|я)$"
)
RUSSIAN_DERIVATION = "(?:ост|ость)$"
RUSSIAN_SUPERLATIVE = "(?:ейше|ейш)$"


Step = Callable[[Column], Column]


def _run(start: Column, steps: list[Step]) -> Column:
    """Pass a value through the steps."""
    state = F.array(start)
    for step in steps:
        state = F.transform(state, step)
    return F.get(state, F.lit(0))


def _with(state: Column, **changed: Column) -> Column:
    """The state with some fields changed or added."""
    for name, value in changed.items():
        state = state.withField(name, value)
    return state


def _head(word: Column, cut: Column | int) -> Column:
    """The word without its last characters."""
    return word.substr(F.lit(1), F.length(word) - cut)


def _before(word: Column, ending: Column) -> Column:
    """The letter before an ending."""
    return word.substr(F.length(word) - F.length(ending), F.lit(1))


def _region(text: Column, vowels: str) -> Column:
    """Length up to and with the first consonant after a vowel; the whole length without one."""
    found = F.length(F.regexp_extract(text, f"^.*?[{vowels}][^{vowels}]", 0))
    return F.when(found > 0, found).otherwise(F.length(text))


def _second_region(vowels: str) -> Step:
    return lambda s: _with(
        s, p2=s["p1"] + _region(s["w"].substr(s["p1"] + 1, F.length(s["w"])), vowels)
    )


def _find(endings) -> Step:
    """Note the longest of the endings the word has, or an empty text."""
    pattern = "(" + "|".join(endings) + ")$"
    return lambda s: _with(s, end=F.regexp_extract(s["w"], pattern, 1))


def _texts(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for pair in pairs.items() for v in pair])


def _swap(endings: Mapping[str, str], test: Callable[[Column, Column], Column]) -> list[Step]:
    """Replace the longest ending by its text if the test on state and start of the ending holds."""

    def replace(s: Column) -> Column:
        start = F.length(s["w"]) - F.length(s["end"])
        new = F.concat(_head(s["w"], F.length(s["end"])), _texts(endings)[s["end"]])
        return _with(s, w=F.when((s["end"] != "") & test(s, start), new).otherwise(s["w"]))

    return [_find(endings), replace]


def stem_english(word: Column) -> Column:
    """Stem of a lowercase word."""
    vowel = f"[{ENGLISH_VOWELS}]"

    def prepare(s: Column) -> Column:
        marked = F.regexp_replace(F.regexp_replace(s["word"], "^'", ""), "^y", "Y")
        return _with(s, w=F.regexp_replace(marked, f"({vowel})y", "$1Y"))

    def first_region(s: Column) -> Column:
        special = F.length(F.regexp_extract(s["w"], f"^(?:{ENGLISH_REGION_PREFIXES})", 0))
        return _with(s, p1=F.when(special > 0, special).otherwise(_region(s["w"], ENGLISH_VOWELS)))

    def possessive(s: Column) -> Column:
        return _with(s, w=F.regexp_replace(s["w"], "(?:'s'|'s|')$", ""))

    def plural(s: Column) -> Column:
        w = s["w"]
        return _with(
            s,
            w=F.when(~w.endswith("s") & ~w.endswith("ied"), w)
            .when(w.endswith("sses"), _head(w, 2))
            .when(w.rlike("(?:ied|ies)$"), _head(w, F.when(F.length(w) > 4, 2).otherwise(1)))
            .when(w.rlike("(?:us|ss)$"), w)
            .when(w.rlike(f"{vowel}.+s$"), _head(w, 1))
            .otherwise(w),
        )

    def keep(s: Column) -> Column:
        return _with(s, kept=F.when(s["w"].isin(ENGLISH_DONE_EARLY), s["w"]))

    def past(s: Column) -> Column:
        w, end = s["w"], s["end"]
        stem = _head(w, F.length(end))
        cut = end.isin("edly", "ed", "ingly", "ing") & stem.rlike(vowel)
        in_region = F.length(w) - F.length(end) >= s["p1"]
        return _with(
            s,
            cut=cut,
            w=F.when(end.isin("eedly", "eed"), F.when(in_region, F.concat(stem, F.lit("ee"))).otherwise(w))
            .when(cut, stem)
            .otherwise(w),
        )

    def mend(s: Column) -> Column:
        w = s["w"]
        short_word = (s["p1"] >= F.length(w)) & w.rlike(ENGLISH_SHORT)
        return _with(
            s,
            w=F.when(~s["cut"], w)
            .when(w.rlike("(?:at|bl|iz)$"), F.concat(w, F.lit("e")))
            .when(w.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _head(w, 1))
            .when(short_word, F.concat(w, F.lit("e")))
            .otherwise(w),
        )

    def last_y(s: Column) -> Column:
        w = s["w"]
        return _with(s, w=F.when(w.rlike("^.+[^aeiouy][yY]$"), F.concat(_head(w, 1), F.lit("i"))).otherwise(w))

    def in_step_2(s: Column, start: Column) -> Column:
        end, before = s["end"], _before(s["w"], s["end"])
        valid = F.when(end == "ogi", before == "l").when(end == "li", before.isin(list("cdeghkmnrt")))
        return (start >= s["p1"]) & F.coalesce(valid, F.lit(True))

    def in_step_3(s: Column, start: Column) -> Column:
        return start >= F.when(s["end"] == "ative", s["p2"]).otherwise(s["p1"])

    def in_step_4(s: Column, start: Column) -> Column:
        return (start >= s["p2"]) & ((s["end"] != "ion") | _before(s["w"], s["end"]).isin("s", "t"))

    def last(s: Column) -> Column:
        w, start = s["w"], F.length(s["w"]) - 1
        drop_e = w.endswith("e") & (
            (start >= s["p2"]) | ((start >= s["p1"]) & ~_head(w, 1).rlike(ENGLISH_SHORT))
        )
        drop_l = w.endswith("ll") & (start >= s["p2"])
        return _with(s, w=F.when(drop_e | drop_l, _head(w, 1)).otherwise(w))

    def choose(s: Column) -> Column:
        return F.coalesce(
            F.when((F.length(s["word"]) <= 2) | s["word"].isin(ENGLISH_UNCHANGED), s["word"]),
            F.when(s["word"].isin(list(ENGLISH_IRREGULAR)), _texts(ENGLISH_IRREGULAR)[s["word"]]),
            s["kept"],
            F.lower(s["w"]),
        )

    return _run(
        F.struct(word.alias("word")),
        [
            prepare, first_region, _second_region(ENGLISH_VOWELS), possessive, plural, keep,
            _find(["eedly", "eed", "edly", "ed", "ingly", "ing"]), past, mend, last_y,
            *_swap(ENGLISH_STEP_2, in_step_2),
            *_swap(ENGLISH_STEP_3, in_step_3),
            *_swap(dict.fromkeys(ENGLISH_STEP_4, ""), in_step_4),
            last, choose,
        ],
    )


def stem_porter(word: Column) -> Column:
    """Stem of a lowercase word by the Porter algorithm; a y that is a consonant is marked as Y on the way."""

    def above(text: Column, least: int) -> Column:
        """The text has more than so many runs of consonants behind vowels."""
        return text.rlike((PORTER_MORE_THAN_0, PORTER_MORE_THAN_1)[least])

    def prepare(s: Column) -> Column:
        return _with(s, w=F.regexp_replace(F.regexp_replace(s["word"], "^y", "Y"), "([aeiouy])y", "$1Y"))

    def plural(s: Column) -> Column:
        w = s["w"]
        return _with(
            s,
            w=F.when(~w.endswith("s"), w)
            .when(w.endswith("ies"), _head(w, F.when(F.length(w) == 4, 1).otherwise(2)))
            .when(w.endswith("sses"), _head(w, 2))
            .when(w.endswith("ss"), w)
            .otherwise(_head(w, 1)),
        )

    def past(s: Column) -> Column:
        w, end = s["w"], s["end"]
        stem = _head(w, F.length(end))
        cut = end.isin("ed", "ing") & stem.rlike("[aeiouy]")
        return _with(
            s,
            cut=cut,
            w=F.when(end == "ied", _head(w, F.when(F.length(w) == 4, 1).otherwise(2)))
            .when(end == "eed", F.when(above(stem, 0), _head(w, 1)).otherwise(w))
            .when(cut, stem)
            .otherwise(w),
        )

    def mend(s: Column) -> Column:
        w = s["w"]
        return _with(
            s,
            w=F.when(~s["cut"], w)
            .when(w.rlike("(?:at|bl|iz)$"), F.concat(w, F.lit("e")))
            .when(w.rlike(PORTER_DOUBLE), F.when(w.rlike("[lsz]$"), w).otherwise(_head(w, 1)))
            .when(above(w, 0) & ~above(w, 1) & w.rlike(PORTER_SHORT), F.concat(w, F.lit("e")))
            .otherwise(w),
        )

    def last_y(s: Column) -> Column:
        w = s["w"]
        return _with(s, w=F.when((F.length(w) > 2) & w.endswith("y"), F.concat(_head(w, 1), F.lit("i"))).otherwise(w))

    def twice(s: Column) -> Column:
        w = s["w"]
        return _with(s, w=F.when(w.endswith("alli") & above(_head(w, 4), 0), _head(w, 2)).otherwise(w))

    def in_step_2(s: Column, start: Column) -> Column:
        return above(_head(s["w"], F.when(s["end"] == "logi", 3).otherwise(F.length(s["end"]))), 0)

    def in_step_3(s: Column, start: Column) -> Column:
        return above(_head(s["w"], F.length(s["end"])), 0)

    def in_step_4(s: Column, start: Column) -> Column:
        stem = _head(s["w"], F.length(s["end"]))
        return above(stem, 1) & ((s["end"] != "ion") | stem.rlike("[st]$"))

    def last_e(s: Column) -> Column:
        w = s["w"]
        stem = _head(w, 1)
        drop = w.endswith("e") & (above(stem, 1) | (above(stem, 0) & ~stem.rlike(PORTER_SHORT)))
        return _with(s, w=F.when(drop, stem).otherwise(w))

    def last_l(s: Column) -> Column:
        w = s["w"]
        return _with(s, w=F.when(w.endswith("ll") & above(_head(w, 1), 1), _head(w, 1)).otherwise(w))

    stem = _run(
        F.struct(word.alias("word")),
        [
            prepare, plural, _find(["ied", "eed", "ed", "ing"]), past, mend, last_y, twice,
            *_swap(PORTER_STEP_2, in_step_2),
            *_swap(PORTER_STEP_3, in_step_3),
            *_swap(dict.fromkeys(PORTER_STEP_4, ""), in_step_4),
            last_e, last_l, lambda s: F.lower(s["w"]),
        ],
    )
    known = F.when(word.isin(list(PORTER_IRREGULAR)), _texts(PORTER_IRREGULAR)[word])
    return F.coalesce(known, F.when(F.length(word) <= 2, word), stem)


def stem_russian(word: Column) -> Column:
    """Stem of a lowercase word; ``rv`` is the part after the first vowel."""

    def split(s: Column) -> Column:
        head = F.regexp_extract(s["w"], f"^[^{RUSSIAN_VOWELS}]*[{RUSSIAN_VOWELS}]", 0)
        return _with(
            s,
            p1=_region(s["w"], RUSSIAN_VOWELS),
            head=F.when(head != "", head).otherwise(s["w"]),
        )

    def rest(s: Column) -> Column:
        return _with(s, rv=s["w"].substr(F.length(s["head"]) + 1, F.length(s["w"])))

    def reflexive(s: Column) -> Column:
        return _with(s, base=F.regexp_replace(s["rv"], RUSSIAN_REFLEXIVE, ""))

    def inflection(s: Column) -> Column:
        rv, base = s["rv"], s["base"]
        adjective = F.regexp_replace(F.regexp_replace(base, RUSSIAN_ADJECTIVE, ""), RUSSIAN_PARTICIPLE, "")
        return _with(
            s,
            rv=F.when(rv.rlike(RUSSIAN_GERUND), F.regexp_replace(rv, RUSSIAN_GERUND, ""))
            .when(base.rlike(RUSSIAN_ADJECTIVE), adjective)
            .when(base.rlike(RUSSIAN_VERB), F.regexp_replace(base, RUSSIAN_VERB, ""))
            .otherwise(F.regexp_replace(base, RUSSIAN_NOUN, "")),
        )

    def vowel(s: Column) -> Column:
        return _with(s, rv=F.regexp_replace(s["rv"], "и$", ""))

    def derivation(s: Column) -> Column:
        end = F.length(F.regexp_extract(s["rv"], RUSSIAN_DERIVATION, 0))
        start = F.length(s["head"]) + F.length(s["rv"]) - end
        return _with(s, rv=F.when((end > 0) & (start >= s["p2"]), _head(s["rv"], end)).otherwise(s["rv"]))

    def tidy(s: Column) -> Column:
        rv = s["rv"]
        plain = F.regexp_replace(F.regexp_replace(rv, RUSSIAN_SUPERLATIVE, ""), "нн$", "н")
        return F.concat(
            s["head"],
            F.when(rv.endswith("нн"), _head(rv, 1))
            .when(rv.rlike(RUSSIAN_SUPERLATIVE), plain)
            .otherwise(F.regexp_replace(rv, "ь$", "")),
        )

    return _run(
        F.struct(F.translate(word, "ё", "е").alias("w")),
        [split, _second_region(RUSSIAN_VOWELS), rest, reflexive, inflection, vowel, derivation, tidy],
    )


STEMMERS = {"english": stem_english, "russian": stem_russian, "porter": stem_porter}


def stem_tokens(words: Column, stem: Callable[[Column], Column]) -> Column:
    """Stems of an array of lowercase words, each different word worked out once."""

    def with_stems(s: Column) -> Column:
        return s.withField("stem", F.map_from_arrays(s["kinds"], F.transform(s["kinds"], stem)))

    start = F.struct(words.alias("words"), F.array_distinct(words).alias("kinds"))
    return _run(start, [with_stems, lambda s: F.transform(s["words"], lambda w: s["stem"][w])])
