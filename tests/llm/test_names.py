import random
import re

import pytest

from tidemark.llm import pii

DOCS = "doc_id long, text string"


def replaced(spark, texts):
    out, _ = pii.replace(spark.createDataFrame(list(enumerate(texts)), DOCS), "text")
    return [r["text"] for r in out.orderBy("doc_id").collect()]


CASES = [
    ("We met Mr. John R. Smith today.", ["John", "R.", "Smith"], r"We met Mr\. [A-Z]\w+ [A-Z]\w+ today\."),
    ("MR JOHN SMITH signed.", ["JOHN", "SMITH"], r"MR [A-Z]+ [A-Z]+ signed\."),
    ("Frau Anna von der Heide kam.", ["Anna", "Heide", "von der"], r"Frau [A-Z]\w+ [A-Z]\w+ kam\."),
    ("Frau Anna-Maria Müller-Lüdenscheidt kam.", ["Anna", "Maria", "Müller", "Lüdenscheidt"], r"Frau [A-Z]\w+ [A-Z]\w+ kam\."),
    ("Ask Mr. O’Neill’s team.", ["Neill"], r"Ask Mr\. [A-Z]\w+’s team\."),
    ("Herr Dr. Weber und Dr. J. Smith.", ["Weber", "Smith", "J."], r"Herr Dr\. [A-Z]\w+ und Dr\. [A-Z]\w+ [A-Z]\w+\."),
    ("Herr von Goethe schrieb.", ["Goethe"], r"Herr [A-Z]\w+ schrieb\."),
    ("Mr Smith. The garden is old.", ["Smith"], r"Mr [A-Z]\w+\. The garden is old\."),
    ("Señor Luis García y Señora Ana López", ["Luis", "García", "Ana", "López"], r"Señor [A-Z]\w+ [A-Z]\w+ y Señora [A-Z]\w+ [A-Z]\w+"),
    ("Dr. means a title. Prof. is one.", [], r"Dr\. means a title\. Prof\. is one\."),
]


def test_names_of_many_forms_leave_nothing_behind(spark):
    for (_, parts, pattern), got in zip(CASES, replaced(spark, [c[0] for c in CASES]), strict=True):
        assert re.fullmatch(pattern, got), got
        assert not any(p in got for p in parts), got


def test_one_person_in_several_cases(spark):
    got = replaced(spark, ["Mr John Smith came. MR SMITH sat. Smith left. JOHN SMITH won."])[0]
    m = re.fullmatch(r"Mr (\w+) (\w+) came\. MR (\w+) sat\. (\w+) left\. (\w+) (\w+) won\.", got)
    assert m and m[3] == m[2].upper() and m[4] == m[2] and (m[5], m[6]) == (m[1].upper(), m[2].upper())


def test_no_two_people_share_a_name_that_readers_see(spark):
    """5,000 family names under both genders and none, some with a given name: all family names differ and none is an old one."""
    rng = random.Random(7)
    syllables = "ba ke lo mu ri sa te vo zi ha".split()
    families = sorted({"".join(rng.choice(syllables) for _ in range(4)).capitalize() for _ in range(9000)})[:5000]
    titles = ["Mr", "Mrs", "Dr"]
    texts = [f"{titles[i % 3]} {'Pat ' if i % 2 else ''}{f} wrote." for i, f in enumerate(families)]
    out = replaced(spark, texts)
    shown = [re.fullmatch(r"(?:Mr|Mrs|Dr) (?:\w+ )?(\w+) wrote\.", t)[1] for t in out]
    assert len(set(shown)) == len(families) and not set(shown) & set(families)


@pytest.mark.parametrize("texts", [[], [None, "", "   "]])
def test_nothing_to_replace(spark, texts):
    assert replaced(spark, texts) == texts


def test_very_long_text(spark):
    text = "Mr. Adam Stone met Mrs. Eve Stone. " * 4000
    got = replaced(spark, [text])[0]
    assert "Stone" not in got and len(set(re.findall(r"Mr\. \w+ \w+", got))) == 1 and got.count("met") == 4000
