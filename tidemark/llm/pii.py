"""Surrogates for personal data, by DataFrame functions alone.

Detected entities (e-mail addresses, phone numbers, IP addresses, card, account and social security
numbers, titled names) are replaced by keyed surrogates of the same type and format: digits stay digits
in the same layout, card numbers keep a valid check digit, letters keep their case and script, names
keep the gender of their title.  A surrogate is a function of the key and the entity in a normal form,
so all mentions of an entity get the same one, in whatever layout.

A name follows one title or several, and has any number of parts: words, in capitals too, initials, and
particles such as "von der" before them; a title is no part.  Names of one text are joined by family name (the
last word) where their genders agree, whatever their case: a mention without a given name is the first full name
of that family, and one without a gender takes that of another mention.  A family name alone gets the family
name of its person's surrogate.  Full and family names that stand without a title are replaced too in a text
that has them with one; given names alone are not.

Collision checks keep entities distinct as readers see them: over all texts, entities whose surrogate is that of
another one, or is itself an entity of the corpus, get the next attempt, until all differ; of names the family
names must differ, whatever title and given name stand before them.  Each attempt draws longer names.
Entities keep attempt 0 unless they lost; the table of losers is joined to the texts that mention them.

Defined results: a null or empty text stays as it is and has no entities; texts of any length are read whole;
repeated rows get equal texts; of entities that draw the same surrogate the smallest keeps it; an empty table
has no rows; a table may have columns of any further names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh, lookup, settle, table, union_all
from .spans import text_key

KEY = "tidemark"
MOST_ROUNDS = 40
COUNTRY = r"^\+(\d{1,3})(?=[ .(-])"  # the country code of a phone number
# Titles, and the patterns of the kinds in the order in which they are tried.
MALE = "Mr Herr Sr Señor Monsieur Don Господин".split()
FEMALE = "Mrs Ms Miss Frau Sra Srta Señora Señorita Mme Mlle Madame Doña Госпожа".split()
NEUTRAL = "Dr Prof".split()
PARTICLES = "von van der den dem de del della di da dos du la le zu zum zur af av bin ibn el".split()
_TITLES = "|".join(t for title in MALE + FEMALE + NEUTRAL for t in dict.fromkeys((title, title.upper())))
_PART = rf"(?!(?:{_TITLES})(?!\p{{L}}))\p{{Lu}}[\p{{L}}'’-]{{1,40}}"
_PARTICLES = rf"(?:(?:{'|'.join(PARTICLES)}) )*"
_NAME = rf"{_PARTICLES}(?:(?:{_PART}|\p{{Lu}}\.) {_PARTICLES})*{_PART}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "person": rf"(?<!\p{{L}})(?:(?:{_TITLES})\.? )+{_NAME}",
}
KINDS = tuple(PATTERNS)
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
PROBE = rf"\d[ .-]?\d|@|(?:{_TITLES})\.? \p{{L}}"
# Given names, and syllables that family names are made of, for Latin and Cyrillic script.
GIVEN = {
    ("m", "latin"): "Adam Albert Bruno Carlos Daniel David Emil Felix Hugo Ivan Jakob Leo Martin Oscar Paul Robert Simon Thomas Victor Walter".split(),
    ("f", "latin"): "Ada Alice Anna Clara Diana Elena Emma Eva Helen Ida Julia Laura Lucia Maria Nina Olga Rosa Sara Sofia Vera".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Максим Олег Павел Роман".split(),
    ("f", "cyrillic"): "Алла Анна Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга Юлия".split(),
}
SYLLABLES = {
    "latin": "bal ber bor dal der dor fal fen gar gel hal har kel kor lan len mar mer nal nor pel por ral ren sal sel tal ter val ver wal zan".split(),
    "cyrillic": "бал бер бор вал вер вол гар гол дал дор зал зер кал кор лан лер мал мор нал нор пал пер рал рон сал сел тал тер фал хан шал яр".split(),
}


def entities(text: Column) -> Column:
    """All matches, in order."""
    return F.when(text.rlike(PROBE), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


_TITLE = rf"^(?:(?:{_TITLES})\.? )+"
_TAIL = r"(?:['’]\p{Ll}?|['’-])$"  # a possessive ending, or a mark, is no part of a name


def bare_name(entity: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(entity, _TITLE, ""), f"^{_PARTICLES}", ""), _TAIL, "")


def family(name: Column) -> Column:
    return F.regexp_extract(name, r"(\S+)$", 1)


def people(found: Column) -> Column:
    """gender, name, family of the titled names among entities: each different one once, in order."""
    item = lambda e: F.struct(_gender(e).alias("gender"), bare_name(e).alias("name"), family(bare_name(e)).alias("family"))
    return F.array_distinct(F.transform(F.filter(found, lambda e: e.rlike(_TITLE)), item))


def untitled(persons: Column) -> Column:
    """A pattern of the names of people, with nothing that a pattern reads otherwise; null without people."""
    names = F.concat(F.transform(persons, lambda p: p["name"]), F.transform(persons, lambda p: p["family"]))
    names = F.array_distinct(F.concat(names, F.transform(names, F.upper)))
    names = F.transform(names, lambda n: F.replace(n, F.lit("."), F.lit("\\.")))
    names = F.reverse(F.array_sort(F.filter(names, lambda n: F.length(n) > 1)))  # a longer name before its beginning
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}@_])(?:"), F.array_join(names, "|"), F.lit(r")(?![\p{L}\p{N}@_])"))
    return F.when(F.size(names) > 0, pattern)


def _agree(a: Column, b: Column) -> Column:
    return (a == b) | (a == "n") | (b == "n")


def resolved(entity: Column, persons: Column) -> Column:
    """The normal form of a name in its text: gender and full name."""
    name, gender = F.lower(bare_name(entity)), F.when(entity.rlike(_TITLE), _gender(entity)).otherwise("n")
    low = F.transform(persons, lambda p: F.struct(p["gender"].alias("gender"), F.lower(p["name"]).alias("name"), F.lower(p["family"]).alias("family")))
    fits = lambda p: _agree(p["gender"], gender) & p["name"].contains(" ") & (p["family"] == name)
    whole = F.when(name.contains(" "), name).otherwise(F.coalesce(F.get(F.filter(low, fits), F.lit(0))["name"], name))
    titled = lambda names: F.get(F.filter(low, lambda p: (p["gender"] != "n") & p["name"].isin(*names)), F.lit(0))["gender"]
    known = F.when(gender != "n", gender).otherwise(F.coalesce(titled([whole]), titled([family(whole)]), F.lit("n")))
    return F.concat(known, F.lit(":"), whole)


def kind_of(entity: Column) -> Column:
    out = F.lit(KINDS[-1])
    for kind in reversed(KINDS[:-1]):
        out = F.when(entity.rlike(rf"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def _gender(entity: Column) -> Column:
    titles = F.regexp_extract(entity, _TITLE, 0)  # the first one that tells
    told = lambda words: rf"^(?:(?:{'|'.join(t for x in NEUTRAL for t in (x, x.upper()))})\.? )*(?:{'|'.join(t for x in words for t in (x, x.upper()))})\.? "
    return F.when(titles.rlike(told(MALE)), "m").when(titles.rlike(told(FEMALE)), "f").otherwise("n")


def normal(entity: Column, kind: Column, persons: Column) -> Column:
    """The form in which mentions of an entity agree; a name's has the gender that titles give it in its text."""
    return (
        F.when(kind == "email", F.lower(entity))
        .when(kind == "person", resolved(entity, persons))
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind == "ip", entity)
        .when((kind == "phone") & entity.rlike(COUNTRY), F.concat(F.regexp_extract(entity, COUNTRY, 1), F.lit(":"), _digits(F.regexp_replace(entity, COUNTRY, ""))))
        .otherwise(_digits(entity))
    )


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _hash(key: str, *parts: Column) -> Column:
    inner = F.sha2(F.concat_ws("\x1f", F.lit(key), *parts).cast("binary"), 256)
    return F.sha2(F.concat(F.lit(key), inner).cast("binary"), 256)


def _byte(hex_: Column, i: Column) -> Column:
    """One of the 32 bytes of a hash, as a number."""
    return F.conv(F.substring(hex_, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(words: list[str], number: Column) -> Column:
    return F.get(F.array(*(F.lit(w) for w in words)), F.pmod(number, F.lit(len(words))))


def _recoded(text: Column, hex_: Column) -> Column:
    """Each letter or digit replaced by a keyed one of its kind; others stay."""

    def one(c: Column, i: Column) -> Column:
        n = _byte(hex_, i)
        letter = lambda first, size: F.char(F.lit(first) + F.pmod(n, F.lit(size)))
        greek = F.get(F.split(F.lit("αβγδεζηθικλμνξοπρτυφχψω"), ""), F.pmod(n, F.lit(23)))
        cyrillic = F.get(F.split(F.lit("абвгдежзиклмнопрстуфхцчшэюя"), ""), F.pmod(n, F.lit(27)))
        return (
            F.when(c.rlike("[0-9]"), letter(48, 10)).when(c.rlike("[a-z]"), letter(97, 26)).when(c.rlike("[A-Z]"), letter(65, 26))
            .when(c.rlike(r"\p{IsCyrillic}"), cyrillic).when(c.rlike(r"\p{IsGreek}"), greek).when(c.rlike(r"\p{L}"), letter(97, 26))
            .otherwise(c)
        )

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, one), "")


def _check_digit(digits: Column) -> Column:
    """The digit that makes the number valid by the rule of card numbers."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    summed = F.aggregate(
        F.transform(each, lambda c, i: F.when(i % 2 == 0, doubled(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x
    )
    return F.pmod(-summed, F.lit(10)).cast("string")


def surrogate(norm: Column, kind: Column, attempt: Column, key: str = KEY) -> Column:
    """The surrogate of an entity, in its normal form."""
    h = _hash(key, kind, norm, attempt.cast("string"))
    wider = F.when(attempt > 2, F.substring(F.translate(h, "0123456789", "ghijklmnop"), 1, 10)).otherwise("")
    digits = _recoded(norm, h)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    valid = _check_digit(F.substring(norm, F.lit(1), F.length(norm) - 1)) == F.substring(norm, -1, 1)
    card = F.when(valid, F.concat(body, _check_digit(body))).otherwise(digits)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(_byte(h, i), F.lit(254)) + 1).cast("string")), ".")
    domain = _hash(key, F.lit("domain"), F.regexp_extract(norm, "@(.*)$", 1))
    label = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.char(F.lit(97) + F.pmod(_byte(domain, i), F.lit(26)))), "")
    end = F.regexp_extract(norm, r"\.([^.]+)$", 1)
    ending = F.when(end.isin("com", "org", "net"), F.concat(F.lit(".example."), end)).otherwise(".example")
    email = F.concat(_recoded(F.regexp_extract(norm, "^([^@]*)@", 1), h), wider, F.lit("@"), label, ending)
    iban = F.concat(F.substring(norm, 1, 2), _recoded(F.substring(norm, F.lit(3), F.length(norm)), h))
    gender = F.when(F.substring(norm, 1, 1) == "n", F.when(_byte(h, F.lit(0)) < 128, "m").otherwise("f")).otherwise(F.substring(norm, 1, 1))
    two = F.instr(norm, " ") > 0

    def name(script: str) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.lit(3) + attempt), lambda i: _pick(SYLLABLES[script], _byte(h, i)))
        family = F.initcap(F.array_join(parts, ""))
        given = F.when(gender == "m", _pick(GIVEN["m", script], _byte(h, F.lit(9)))).otherwise(_pick(GIVEN["f", script], _byte(h, F.lit(9))))
        return F.concat(F.substring(norm, 1, 2), F.when(two, F.concat(given, F.lit(" "), family)).otherwise(family))

    person = F.when(norm.rlike(r"\p{IsCyrillic}"), name("cyrillic")).otherwise(name("latin"))
    code = F.when(F.instr(norm, ":") > 0, F.regexp_extract(norm, "^([0-9]+:)", 1)).otherwise("")  # a country code stays
    phone = F.concat(code, _recoded(F.substring(norm, F.length(code) + 1, F.length(norm)), h))
    return (
        F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "person", person).when(kind == "iban", iban)
        .when(kind == "ip", octets).when(kind == "card", card).otherwise(digits)
    )


def rendered(entity: Column, kind: Column, replacement: Column) -> Column:
    """A surrogate in the layout of one mention."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    slot = F.when(kind == "iban", "[A-Z0-9]").otherwise("[0-9]")

    def put(a: Column, c: Column) -> Column:
        hit = F.regexp_like(c, slot)
        filled = F.when(hit, F.substring(F.regexp_replace(replacement, ":", ""), a["at"], F.lit(1))).otherwise(c)
        return F.struct(F.concat(a["out"], filled).alias("out"), (a["at"] + hit.cast("int")).alias("at"))

    chars = F.filter(F.split(entity, ""), lambda c: c != "")
    laid = F.aggregate(chars, start, put)["out"]
    full = F.substring(replacement, F.lit(3), F.length(replacement))
    bare = bare_name(entity)
    name = F.when(bare.contains(" "), full).otherwise(family(full))
    name = F.when((bare == F.upper(bare)) & (F.length(bare) > 2), F.upper(name)).otherwise(name)
    person = F.concat(F.regexp_extract(entity, _TITLE, 0), name, F.regexp_extract(entity, _TAIL, 0))
    return (
        F.when(kind.isin("email", "ip"), replacement)
        .when(kind == "person", person)
        .otherwise(laid)
    )


def _shown(kind: Column, norm: Column) -> Column:
    """What a reader tells entities by: of names the family name, whatever title and given name it has."""
    name = F.substring(norm, F.lit(3), F.length(norm))
    return F.when(kind == "person", F.lower(family(name))).otherwise(norm)


def losers(found: DataFrame, key: str = KEY) -> DataFrame:
    """kind, norm, replacement of the entities that cannot keep attempt 0."""
    known = settle(found.groupBy("kind", "norm").agg(F.count(F.lit(1)).alias("n")).drop("n"), "entities")
    taken = known.select(F.col("kind").alias("_k"), _shown(F.col("kind"), F.col("norm")).alias("_s")).distinct()
    waiting = known
    out = []
    for attempt in range(MOST_ROUNDS):
        made = surrogate(F.col("norm"), F.col("kind"), F.lit(attempt), key)
        tried = waiting.select("kind", "norm", made.alias("replacement")).withColumn("shown", _shown(F.col("kind"), F.col("replacement")))
        first = tried.groupBy("kind", "shown").agg(F.min(F.struct("norm", "replacement")).alias("one"))
        won = first.join(taken, (F.col("kind") == F.col("_k")) & (F.col("shown") == F.col("_s")), "left_anti")
        won = settle(won.select("kind", "one.norm", "one.replacement", "shown"), "surrogates")
        if attempt:
            out.append(won.drop("shown"))
        waiting = settle(waiting.join(won.select("kind", "norm"), ["kind", "norm"], "left_anti"), "waiting")
        if waiting.isEmpty():
            break
        taken = taken.unionByName(won.select(F.col("kind").alias("_k"), F.col("shown").alias("_s")))
    else:
        raise RuntimeError(f"entities without a free surrogate after {MOST_ROUNDS} attempts")
    return union_all(out) if out else known.select("kind", "norm", F.lit("").alias("replacement")).limit(0)


def replace(docs: DataFrame, text: str, key: str = KEY) -> tuple[DataFrame, str]:
    """All columns of the documents, with surrogates in the text, and a new column of counts per kind.

    Returns the table and the name of the column (an array of counts in the order of ``KINDS``).
    """
    t = col(text)
    item = lambda e: F.struct(e.alias("entity"), kind_of(e).alias("kind"))
    found, k1, k2, other, count, persons, pattern = fresh(docs, "_found", "_k1", "_k2", "_other", "entity_counts", "_persons", "_pattern")
    full = lambda s: F.struct(s["entity"].alias("entity"), s["kind"].alias("kind"), normal(s["entity"], s["kind"], F.col(persons)).alias("norm"))
    whole = F.coalesce(t, F.lit(""))
    # names that a text has with a title are searched in it without one
    more = F.concat(F.lit(f"{PATTERN}|"), untitled(F.col(persons)))
    prepared = docs.withColumn(found, entities(whole)).withColumn(persons, people(F.col(found))).withColumn(pattern, more)
    again = F.when(F.col(pattern).isNotNull(), F.regexp_extract_all(whole, F.col(pattern), F.lit(0))).otherwise(F.col(found))
    prepared = prepared.withColumn(found, again).withColumn(found, F.transform(F.transform(F.col(found), item), full)).drop(persons)
    names = F.transform(F.col(found), lambda s: F.struct(s["kind"].alias("kind"), s["norm"].alias("norm")))
    seen = prepared.select(*text_key(F.coalesce(t, F.lit(""))), F.explode(F.array_distinct(names)).alias("e"))
    seen = settle(seen.select("k1", "k2", "e.kind", "e.norm"), "mentions")
    special = settle(losers(seen.select("kind", "norm"), key), "losers")
    out = prepared
    if special.isEmpty():
        out = out.withColumn(other, F.lit(None).cast("map<string,string>"))
    else:
        entry = F.struct(F.concat_ws(":", "kind", "norm").alias("k"), F.col("replacement").alias("v"))
        per_text = seen.join(special, ["kind", "norm"]).groupBy("k1", "k2").agg(F.map_from_entries(F.collect_set(entry)).alias(other))
        per_text = settle(per_text.withColumnsRenamed({"k1": k1, "k2": k2}), "special")
        mine = text_key(F.coalesce(t, F.lit("")))
        out = lookup(out, per_text, (mine[0] == F.col(k1)) & (mine[1] == F.col(k2))).drop(k1, k2)

    def one(s: Column) -> Column:
        base = surrogate(s["norm"], s["kind"], F.lit(0), key)
        return rendered(s["entity"], s["kind"], F.coalesce(F.element_at(F.col(other), F.concat_ws(":", s["kind"], s["norm"])), base))

    gaps = F.when(F.col(pattern).isNotNull(), F.split(t, F.col(pattern), -1)).otherwise(F.split(t, PATTERN, -1))
    put = F.zip_with(gaps, F.transform(F.col(found), one), lambda g, s: F.concat(g, F.coalesce(s, F.lit(""))))
    counts = F.array(*(F.size(F.filter(F.col(found), _is(k))).cast("long") for k in KINDS))
    text_out = F.when(F.size(found) > 0, F.array_join(put, "")).otherwise(t)
    columns = [text_out.alias(c) if c == text else col(c) for c in docs.columns]
    return out.select(*columns, counts.alias(count)), count


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out, counts = replace(docs, "text")
    each = [F.get(counts, i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", reduce(lambda a, b: a + b, (F.get(counts, i) for i in range(len(KINDS)))).alias("n_entities"), *each, "text")
