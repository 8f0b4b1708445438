import math
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark.functions import labels, text as t
from tidemark.functions.stemming import stem_english, stem_porter, stem_russian
from tidemark.operators import language, lemma_rules, sentences, text_diagnosis, text_steps, vocabulary

# words and stems as published with the algorithms
ENGLISH = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign",
    "consist": "consist", "consisted": "consist", "consistency": "consist", "consistently": "consist",
    "consisting": "consist", "consolation": "consol", "consolatory": "consolatori", "consoled": "consol",
    "consolingly": "consol", "conspicuously": "conspicu", "conspiracy": "conspiraci", "conspire": "conspir",
    "constable": "constabl", "knack": "knack", "knaves": "knave", "kneaded": "knead", "kneeling": "kneel",
    "knightly": "knight", "knitting": "knit", "knives": "knive", "knocking": "knock", "knots": "knot",
    "skies": "sky", "dying": "die", "news": "news", "inning": "inning", "succeed": "succeed",
    "hopping": "hop", "hoping": "hope", "happily": "happili", "gas": "gas", "kiwis": "kiwi", "ties": "tie",
    "cries": "cri", "generously": "generous", "communication": "communic", "boy's": "boy", "by": "by", "say": "say",
}
RUSSIAN = {
    "в": "в", "вавиловка": "вавиловк", "вагнера": "вагнер", "вагон": "вагон", "вагона": "вагон", "вагоне": "вагон",
    "вагоном": "вагон", "важная": "важн", "важнее": "важн", "важнейшие": "важн", "важничал": "важнича",
    "важно": "важн", "важного": "важн", "важность": "важност", "важную": "важн", "вал": "вал", "валериановна": "валериановн",
    "валится": "вал", "валом": "вал", "вальса": "вальс", "п": "п", "па": "па", "павел": "павел", "павильон": "павильон",
    "падает": "пада", "падай": "пада", "падал": "пада", "падаль": "падал", "падать": "пада", "падаю": "пада",
    "падение": "паден", "падучая": "падуч", "ещё": "ещ",
}


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")


# the published examples of the rules, and the exceptions of the common extension
PORTER = dict(
    pair.split("/")
    for pair in """caresses/caress ponies/poni ties/tie cats/cat feed/feed agreed/agre plastered/plaster bled/bled motoring/motor
    sing/sing conflated/conflat troubled/troubl sized/size hopping/hop tanned/tan falling/fall hissing/hiss fizzed/fizz failing/fail
    filing/file happy/happi sky/sky relational/relat conditional/condit rational/ration valenci/valenc digitizer/digit
    conformabli/conform radicalli/radic differentli/differ vileli/vile analogousli/analog vietnamization/vietnam predication/predic
    operator/oper feudalism/feudal decisiveness/decis hopefulness/hope callousness/callous formaliti/formal sensitiviti/sensit
    sensibiliti/sensibl triplicate/triplic formative/form formalize/formal electriciti/electr electrical/electr hopeful/hope
    goodness/good revival/reviv allowance/allow inference/infer airliner/airlin gyroscopic/gyroscop adjustable/adjust
    defensible/defens irritant/irrit replacement/replac adjustment/adjust dependent/depend adoption/adopt communism/commun
    activate/activ angulariti/angular homologous/homolog effective/effect bowdlerize/bowdler probate/probat rate/rate cease/ceas
    controll/control roll/roll dying/die skies/sky news/news proceed/proceed enjoy/enjoy by/by say/say spied/spi died/die
    generalizations/gener oscillators/oscil syzygy/syzygi""".split()
)


@pytest.mark.parametrize("stem, pairs", [(stem_english, ENGLISH), (stem_russian, RUSSIAN), (stem_porter, PORTER)])
def test_published_stems(spark, stem, pairs):
    df = spark.createDataFrame(list(pairs.items()), "word string, want string")
    got = df.withColumn("stem", stem(F.col("word"))).where("stem <> want").collect()
    assert [(r["word"], r["want"], r["stem"]) for r in got] == []


def test_stop_words_are_those_of_spark(spark):
    from pyspark.ml.feature import StopWordsRemover

    for name in t.LANGUAGES.values():
        assert set(t.stop_words(name)) == set(StopWordsRemover.loadDefaultStopWords(name))
    with pytest.raises(ValueError, match="unknown language"):
        t.stop_words("klingon")


def test_cleaning(spark):
    df = column(spark, ["<b>Привет</b>, ёж! 42_a «x»"])
    assert text_steps.remove_html(df, "text").first()["text"] == "Привет, ёж! 42_a «x»"
    assert text_steps.remove_special_chars(df, "text").first()["text"] == "bПриветb ёж 42_a x"
    assert text_steps.remove_special_chars(df, "text", True).first()["text"] == "bПриветb, ёж! 42_a x"
    assert text_steps.number_handling(df, "text", "replace").first()["text"] == "<b>Привет</b>, ёж! [NUM]_a «x»"
    assert text_steps.number_handling(df, "text", "remove").first()["text"] == "<b>Привет</b>, ёж! _a «x»"
    with pytest.raises(ValueError, match="unknown strategy"):
        text_steps.number_handling(df, "text", "shout")


def test_tokens_and_sentences(spark):
    df = column(spark, ["Don't stop. Really?  Да, ёлка!\nEnd", "", "  \n "])
    words = rows(text_steps.tokenize(df, "text"), "id")
    assert words[0][1] == ["Don't", "stop", ".", "Really", "?", "Да", ",", "ёлка", "!", "End"]
    parts = rows(text_steps.tokenize(df, "text", "sentence"), "id")
    assert [p[1] for p in parts] == [["Don't stop.", "Really?", "Да, ёлка!", "End"], [], []]
    with pytest.raises(ValueError, match="unknown kind"):
        text_steps.tokenize(df, "text", "letter")


def test_stop_words_from_text_and_tokens(spark):
    df = column(spark, ["The cat is on the Mat"])
    assert text_steps.remove_stopwords(df, "text", "english").first()["text"] == "cat mat"
    assert text_steps.remove_stopwords(text_steps.tokenize(df, "text"), "text", "english").first()["text"] == "cat mat"
    ru = column(spark, ["Это не кот, а собака"])
    assert text_steps.remove_stopwords(ru, "text").first()["text"] == "это кот , собака"


LEMMAS = [("english", "mice", "mouse"), ("english", "cats", "cat"), ("russian", "коты", "кот")]


def test_stem_and_lemma_keep_order_and_empty_texts(spark):
    df = column(spark, ["Cats chased running mice", "", None])
    lemmas = spark.createDataFrame(LEMMAS, "lang string, form string, lemma string")
    got = rows(vocabulary.stem_text(df, "text", ["id"], "english"), "id")
    assert got == [(0, "cat chase run mice"), (1, ""), (2, None)]
    got = rows(vocabulary.lemmatize_text(df, "text", ["id"], lemmas, "english", out="lemma"), "id")
    assert [r[2] for r in got] == ["cat chased running mouse", "", None]
    diff = rows(vocabulary.stem_lemma_difference(df, "text", ["id"], lemmas), "id")
    assert diff == [(0, 3, 4), (1, 0, 0), (2, 0, 0)]


def test_texts_need_no_key(spark):
    data = [(None, "running cats"), (7, "alpha beta"), (7, "gamma delta"), (7, "alpha beta"), (8, None)]
    df = spark.createDataFrame(data, "id long, text string")
    lemmas = spark.createDataFrame(LEMMAS, "lang string, form string, lemma string")
    want = sorted([(None, "run cat"), (7, "alpha beta"), (7, "gamma delta"), (7, "alpha beta"), (8, None)], key=repr)
    assert rows(vocabulary.stem_text(df, "text", ["id"], "english")) == want
    assert [r[1] for r in rows(vocabulary.lemmatize_text(df, "text", ["id"], lemmas, "english"))].count("alpha beta") == 2
    assert rows(vocabulary.stem_lemma_difference(df, "text", ["id"], lemmas).where("id is null")) == [(None, 1, 2)]
    assert len(rows(text_diagnosis.analyze_texts(df, "text", ["id"], lang="english", check_stem_lemma=True, lemmas=lemmas))) == 5


def test_rare_words_are_worked_out_in_place(spark):
    df = column(spark, ["running running cats", "cats hopping running", "flies generously running"])
    whole = rows(vocabulary.stem_text(df, "text", ["id"], "english"), "id")
    plan = vocabulary.stem_text(df, "text", ["id"], "english")._jdf.queryExecution().executedPlan().toString()
    assert whole and not any(word in plan for word in ("Exchange", "Generate", "Join"))


def test_steps_in_order(spark):
    df = column(spark, ["<p>The 3 running cats!</p>"])
    steps = ["remove_html", "remove_special_chars", ("handle_numbers", {"strategy": "remove"}),
             ("remove_stopwords", {"lang": "english"}), ("normalize", {"lang": "english"})]
    assert text_steps.prepare_text(df, "text", steps, key=["id"]).first()["text"] == "run cat"
    with pytest.raises(ValueError, match="unknown step"):
        text_steps.prepare_text(df, "text", ["fold"])
    assert text_steps.describe_steps(["remove_html", ("tokenize", {"token_type": "word"})]) == "remove_html -> tokenize(token_type=word)"


def test_language_rule(spark):
    df = column(spark, ["the cat is on the mat", "это не кот", "der Hund ist nicht da", "zzz", "", "это the cat"])
    df = df.withColumn("h", language.hits_by_language(t.tokens(F.col("text"))))
    got = rows(df.select("id", language.pick_language(F.col("text"), F.col("h"))), "id")
    assert [g[1] for g in got] == ["english", "russian", "german", "english", "english", "english"]


def test_language_model(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de")], "text string, lang string")
    model = language.train_language_model(train, "text", "lang")
    df = column(spark, ["the dog and cat", "die katze und", "§"])
    got = rows(language.classify_language(df, "text", ["id"], model, default="en"), "id")
    assert got == [(0, "en"), (1, "de"), (2, "en")]
    rare = language.classify_language(df, "text", ["id"], model)
    assert rows(rare, "id")[2] == (2, None)


def actions(df):
    return [[a["action"] for a in r["recommendations"]] for r in df.orderBy("id").collect()]


def test_tokenize_advice_branches(spark):
    long = " ".join(["word"] * 20) + "."
    df = column(spark, ["", "too short", "Is this really a question? Yes", long, "Five plain words stand here."])
    got = text_diagnosis.analyze_texts(df, "text", ["id"], lang="english", check_stopwords=False, check_clean=False)
    found = [[(a["action"], a["description"]) for a in r["recommendations"]] for r in got.orderBy("id").collect()]
    assert [f[0][1] for f in found] == [labels.SHORT_TEXT, labels.SHORT_TEXT, labels.QUESTIONS, labels.LONG_SENTENCES, labels.STANDARD]
    got = text_diagnosis.analyze_texts(df, "text", ["id"], lang="english", task="ner", check_stopwords=False, check_clean=False)
    assert actions(got) == [["word_tokenize"]] * 5


def test_advice_groups_can_be_switched(spark):
    df = column(spark, ["the <b>cat</b> is on the mat 7 times"])
    got = text_diagnosis.analyze_texts(df, "text", ["id"])
    assert actions(got) == [["remove_html", "remove_special_chars", "handle_numbers", "word_tokenize", "consider_remove_stopwords"]]
    row = got.first()
    assert row["recommendations"][0]["action_label"] == labels.ACTION_LABELS["remove_html"]
    off = text_diagnosis.analyze_texts(df, "text", ["id"], check_clean=False, check_tokenize=False, check_stopwords=False)
    assert actions(off) == [[]] and off.first()["stopword_ratio"] is None
    stems = text_diagnosis.analyze_texts(df, "text", ["id"], check_clean=False, check_tokenize=False, check_stopwords=False, check_stem_lemma=True)
    assert stems.first()["stem_vs_lemma"]["total_words"] > 0 and len(actions(stems)[0]) == 1


def test_language_from_the_first_characters(spark):
    df = column(spark, ["the cat is here " + "der und die nicht " * 5])
    assert text_diagnosis.analyze_texts(df, "text", ["id"]).first()["detected_lang"] == "german"
    assert text_diagnosis.analyze_texts(df, "text", ["id"], language_chars=15).first()["detected_lang"] == "english"


def test_collection(spark):
    df = column(spark, ["the cat is on the mat", "the dog is here 5", "не кот это"])
    row = text_diagnosis.analyze_collection(df, "text", ["id"]).first()
    assert row["main_lang"] == "english" and row["avg_length"] == pytest.approx((21 + 17 + 10) / 3)
    assert "handle_numbers" in {a["action"] for a in row["recommendations"]}


def test_word_statistics(spark):
    df = column(spark, ["b a b c a b d e f"])
    row = vocabulary.word_statistics(df, "text", ["id"]).first()
    assert (row["unique_words"], row["avg_word_length"], row["frequent_words"]) == (6, 1.0, "b, a, c, d, e")
    df = spark.createDataFrame([(1, ""), (2, None), (3, "x"), (3, "x")], "id long, text string")
    assert rows(vocabulary.word_statistics(df, "text", ["id"])) == [(1, 0, None, ""), (2, 0, None, ""), (3, 1, 1.0, "x"), (3, 1, 1.0, "x")]


def test_sentences_with_learned_abbreviations(spark):
    """Planted abbreviations end no sentence, also before a capital; a starter behind one does."""
    rng = random.Random(3)
    names, nouns = ["Smith", "Jones", "Meyer", "Weber", "Olsen"], "garden river house table window market engine".split()
    plain = []
    for _ in range(400):
        a, b = rng.choice(nouns), rng.choice(nouns)
        plain.append(rng.choice([
            f"We met Dr. {rng.choice(names)} at the {a}. However the {b} was closed.",
            f"However it was approx. five miles to the {a}! Is the {b} open?",
            f"They saw the {a}. However Prof. {rng.choice(names)} kept the {b}.",
        ]))
    model = sentences.learn_sentences(column(spark, plain), "text")
    assert {"dr", "approx", "prof"} <= set(model.abbreviations) and not set(nouns) & set(model.abbreviations)
    assert "however" in model.starters
    asked = ["Dr. Smith left. He waved.", "It cost approx. Five men came.", "See J. Smith. now it rains. Then sun",
             "He met the Prof. However it rained.", "One.  Two?\n\nThree! \"Four.\" Five", "", None, "   ", "no end"]
    got = [r[1] for r in rows(column(spark, asked).select("id", sentences.sentence_tokens(F.col("text"), model)), "id")]
    assert got == [["Dr. Smith left.", "He waved."], ["It cost approx. Five men came."], ["See J. Smith. now it rains.", "Then sun"],
                   ["He met the Prof.", "However it rained."], ["One.", "Two?", "Three!", '"Four."', "Five"], [], None, [], ["no end"]]


def test_sentences_of_an_empty_corpus(spark):
    df = column(spark, ["", None])
    model = sentences.learn_sentences(df, "text")
    assert model.abbreviations == model.starters == []
    assert [r[1] for r in rows(df.select("id", sentences.sentence_tokens(F.col("text"), model)), "id")] == [[], None]


def test_lemmas_of_held_out_forms(spark):
    """Rules learned from half of a planted table give the lemmas of the other half."""
    rng = random.Random(5)
    syllables = "ka lo mi ru te sa no vi de pu".split()
    table = []
    for _ in range(900):
        stem = "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) + rng.choice("bdgklmnprt")
        table += rng.choice([[(stem + "s", stem)], [(stem + "ies", stem + "y")], [(stem + "ing", stem), (stem + "ed", stem)], [(stem, stem)]])
    table = sorted(set(table))
    held = [p for i, p in enumerate(table) if i % 2]
    df = spark.createDataFrame([p for i, p in enumerate(table) if i % 2 == 0], "form string, lemma string")
    rules = lemma_rules.learn_lemma_rules(df)
    assert {r["ending"]: (r["off"], r["put"]) for r in rules.collect() if r["ending"] in ("ies", "ing")} == {"ies": (3, "y"), "ing": (3, "")}
    asked = spark.createDataFrame(held, "form string, lemma string")
    right = asked.where(lemma_rules.apply_lemma_rules(F.col("form"), rules) == F.col("lemma")).count()
    assert right > 0.97 * len(held)
    texts = column(spark, [" ".join(f for f, _ in held[:20]), None, ""])
    got = rows(vocabulary.lemmatize_text(texts, "text", ["id"], df, "english", guess=True), "id")
    want = asked.limit(20).select(lemma_rules.apply_lemma_rules(F.col("form"), rules)).collect()
    assert [g[1] for g in got] == [" ".join(r[0] for r in want), None, ""]


def test_no_rules(spark):
    df = spark.createDataFrame([], "form string, lemma string")
    got = column(spark, ["cats"]).select(lemma_rules.apply_lemma_rules(F.col("text"), lemma_rules.learn_lemma_rules(df)))
    assert rows(got) == [("cats",)]


def test_language_model_of_many_languages(spark):
    """More languages than a table could have columns for: each text is told by its own syllables."""
    signs = [chr(0x4E00 + i) for i in range(600)]
    train = spark.createDataFrame([(f"{a}{b}{a} {b}{a}{b}", f"lang{i}") for i, (a, b) in enumerate(zip(signs, signs[1:]))], "text string, lang string")
    model = language.train_language_model(train, "text", "lang")
    df = spark.createDataFrame([(i, f"{signs[i]}{signs[i + 1]}{signs[i]}") for i in range(0, 599, 50)], "id int, text string")
    got = rows(language.classify_language(df, "text", ["id"], model), "id")
    assert got == [(i, f"lang{i}") for i in range(0, 599, 50)]
    empty = language.train_language_model(train.limit(0), "text", "lang")
    assert rows(language.classify_language(df.limit(1), "text", ["id"], empty, default="en")) == [(0, "en")]


def test_words_are_looked_up_where_texts_lie(spark, monkeypatch):
    # neither statistics nor lemmas shuffle the words of the texts; frequent words and others have the same stems
    df = column(spark, ["dogs running running", "running dogs, dogs hopping", "", None])
    lemmas = spark.createDataFrame([("dogs", "dog"), ("ran", "run")], "form string, lemma string")
    made = [
        vocabulary.word_statistics(df, "text", ["id"], top=2),
        vocabulary.lemmatize_text(df, "text", ["id"], lemmas, "english"),
        vocabulary.stem_lemma_difference(df, "text", ["id"], lemmas),
    ]
    for each in made:
        plan = each._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Exchange", "Generate", "Join", "Window"))
    assert rows(made[0].select("id", "unique_words", "frequent_words"), "id") == [(0, 2, "running, dogs"), (1, 3, "dogs, hopping"), (2, 0, ""), (3, 0, "")]
    assert rows(made[1], "id") == [(0, "dog running running"), (1, "running dog , dog hopping"), (2, ""), (3, None)]
    assert rows(made[2], "id") == [(0, 2, 3), (1, 2, 5), (2, 0, 0), (3, 0, 0)]
    stems = rows(vocabulary.stem_text(df, "text", ["id"], "english"), "id")
    assert stems == [(0, "dog run run"), (1, "run dog , dog hop"), (2, ""), (3, None)]
    monkeypatch.setattr(vocabulary, "FREQUENT_WORDS", 1)  # no lookup: all are worked out in place
    assert rows(vocabulary.stem_text(df, "text", ["id"], "english"), "id") == stems


@pytest.mark.parametrize("size", [1, 3, 5])
def test_language_model_in_place_equals_joined_grams(spark, monkeypatch, size):
    """Texts are not cut into a row per character, for any size of grams; repeated keys are one text, null ones none."""
    rng = random.Random(size)
    letters = {"aa": "abcd \n", "bb": "ABxyz\U0001f600", "cc": "я😀dbé", None: "qa"}
    write = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    train = [(write(chars, rng.randrange(40)), lang) for lang, chars in letters.items() for _ in range(10)] + [(None, "aa"), ("", "zz")]
    df = [(i // 2 if i % 9 else None, write("abcdxyzя😀é \n", rng.randrange(30))) for i in range(60)] + [(99, None), (98, ""), (97, "q" * 9)]
    train, df = spark.createDataFrame(train, "text string, lang string"), spark.createDataFrame(df, "id int, text string")
    grams = lambda t: [t.lower()[i : i + size] for i in range(len(t) - size + 1)]
    counts = {}
    for text, lang in train.collect():
        for g in grams(text or ""):
            counts.setdefault(lang, {}).setdefault(g, 0)
            counts[lang][g] += 1
    different = len({g for c in counts.values() for g in c})
    counts.pop(None, None)
    known = {g for c in counts.values() for g in c}

    def best(text):
        found = [g for g in grams(text) if g in known]
        scores = {lang: sum(math.log((c.get(g, 0) + 1) / (sum(c.values()) + different)) for g in found) for lang, c in counts.items()}
        return min(scores, key=lambda lang: (-scores[lang], lang)) if found else None

    with monkeypatch.context() as m:
        m.setattr(language, "_grams", lambda *a: pytest.fail("a row per character"))
        model = language.train_language_model(train, "text", "lang", size)
        assert {(r["lang"], r["gram"]) for r in model.collect()} == {(lang, g) for lang, c in counts.items() for g in [*c, None]}
        got = language.classify_language(df, "text", ["id"], model, size).orderBy("id").collect()
    with monkeypatch.context() as m:
        m.setattr(language, "fits_broadcast", lambda *a: False)
        assert got == language.classify_language(df, "text", ["id"], model, size).orderBy("id").collect()
    texts = {}
    for i, text in df.where("id is not null").collect():
        texts.setdefault(i, []).append(text or "")
    if size > 1:  # sums of one letter's weights come near each other
        for r in got:
            if r["id"] is None or len(texts[r["id"]]) == 1:
                assert r["lang"] == (best(texts[r["id"]][0]) if r["id"] is not None else None)
