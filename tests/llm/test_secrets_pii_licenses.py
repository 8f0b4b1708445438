import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import licenses, pii, secrets

DOCS = "doc_id long, text string"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def scanned(spark, docs):
    got = secrets.scan(spark.createDataFrame(docs, DOCS), F.col("text"), ["doc_id", "text"])
    return got.select("doc_id", "text", secrets.written(F.col("base")).alias("b"), secrets.written(F.col("spans")).alias("s")).collect()


def test_base_spans_equal_regular_expressions(spark):
    rng = random.Random(8)
    bits = ["token", "Password", "api_key", "apikey", "SECRET", "=", ": ", '"', "'", "abcdef", "ab", "AKIA", "A1B2C3D4E5F6G7H8", "f" * 23, "0", "é", "😀", " ", "\n", "passwd=", "x" * 9]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(60)))) for i in range(300)]
    docs += [(400, None), (401, ""), (None, "token=abcdef"), (1, "token=abcdef"), (1, "token=abcdef"), (402, "password=token:abcdef token=ab secret: api_key:abcdefgh")]
    docs += [(403, ("a" * 30 + " token=abcdefg ") * 3000), (404, "f" * 500_000), (405, "a" * 500_000)]
    rows = scanned(spark, docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert r["b"] == base_spans(r["text"]), r["doc_id"]
        assert set(filter(None, r["b"].split(","))) <= set(r["s"].split(","))


def test_weak_parts_need_their_complement(spark):
    key, access = "abcdABCD0123" * 3 + "+/AB", "AKIA" + "Q" * 16
    near, far = " " * 300, " " * 900
    cases = {
        f"{access}{near}{key}": ["access", "pair"], f"{access}{far}{key}": ["access"], f"{key}{near}{access}": ["access", "pair"], key: [],
        "see https://a.b/c": [], f"{access} https://a.b/c": ["access", "endpoint"], "user=bob": [], "user=bob password=hunter22": ["assign", "login"],
        f"user=bob{far}password=hunter22": ["assign"], f"{key} password=hunter22": ["assign"],
    }
    rows = scanned(spark, list(enumerate(cases)))
    for r in rows:
        assert sorted(x.split(":")[0] for x in r["s"].split(",") if x) == cases[r["text"]], r["text"][:40]


def test_a_part_inside_a_long_endpoint_is_in_scope(spark):
    long = "https://a.b/" + "x" * 1500 + "?token=abcdefgh&" + "y" * 1500
    (row,) = scanned(spark, [(1, long)])
    assert [x.split(":")[0] for x in row["s"].split(",")] == ["endpoint", "assign"]


def test_scan_keeps_clashing_columns(spark, clash, kept):
    docs = clash(spark.createDataFrame([(1, "token=abcdef"), (2, None)], DOCS))
    got = secrets.scan(docs, F.col("text"), docs.columns)
    kept(docs, got)
    assert secrets.scan(docs.limit(0), F.col("text"), ["doc_id"]).count() == 0


def replaced(spark, docs):
    out, counts = pii.replace(spark.createDataFrame(docs, DOCS), "text")
    return {r["doc_id"]: r["text"] for r in out.collect()}


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return sum(d[0::2]) % 10 + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def test_surrogates_keep_type_format_gender_and_coreference(spark):
    got = replaced(spark, [
        (1, "Mr. John Smith, Mrs Anna Lee and Mr John Smith: J.Smith9@Foo.org, j.smith9@foo.org."),
        (2, "+1 (743) 555-3824 or +1 743-555-3824; 4111 1111 1111 1111 = 4111-1111-1111-1111; 10.0.0.1; 123-45-6789"),
        (3, None), (4, ""), (5, "version 1.2.3, 2 items, a@b"), (6, "Госпожа Анна Петрова, +1 (743) 555-3824"), (7, "DE89 3704 0044 0532 0130 00"),
    ])
    m = re.fullmatch(r"Mr\. (\w+ \w+), Mrs (\w+) (\w+) and Mr (\w+ \w+): (\S+@\S+\.example\.org), (\S+)\.", got[1])
    assert m and m[1] == m[4] and m[5] == m[6] and m[1].split()[0] in pii.GIVEN["m", "latin"] and m[2] in pii.GIVEN["f", "latin"]
    assert re.fullmatch(r"[a-z]\.[a-z]{5}\d@.*", m[5])
    p = re.fullmatch(r"(\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1 \d{3}-\d{3}-\d{4}); (\d{4}(?: \d{4}){3}) = (\d{4}(?:-\d{4}){3}); (\d+\.\d+\.\d+\.\d+); (\d{3}-\d\d-\d{4})", got[2])
    digits = [re.sub(r"\D", "", x) for x in p.groups()]
    assert digits[0] == digits[1] != "17435553824" and digits[2] == digits[3] != "4" + "1" * 15
    assert luhn(digits[2]) % 10 == 0 and p[5] != "10.0.0.1" and p[6] != "123-45-6789"
    assert got[3] is None and got[4] == "" and got[5] == "version 1.2.3, 2 items, a@b"
    assert got[6].startswith("Госпожа ") and got[6].split()[1] in pii.GIVEN["f", "cyrillic"] and got[6].endswith(p[1])
    assert re.fullmatch(r"DE\d\d(?: \d{4}){4} \d\d", got[7]) and got[7] != "DE89 3704 0044 0532 0130 00"


def test_mentions_of_a_person_in_one_text_agree(spark):
    got = replaced(spark, [
        (1, "Mr John Smith came. Mr Smith's car; John Smith and Smith, Mrs Smith, Dr. John Smith. Smithson."),
        (2, "Dr Anna Meyer, later Frau Anna Meyer and Frau Meyer; Prof Meyer"), (3, "John Smith and Smith without titles"), (4, "Mr John Smith, Mr Paul Smith"),
    ])
    m = re.fullmatch(r"Mr (\w+) (\w+) came\. Mr (\w+)'s car; (\w+ \w+) and (\w+), Mrs (\w+), Dr\. (\w+ \w+)\. Smithson\.", got[1])
    assert m and m[2] == m[3] == m[5] != m[6] and m[4] == m[7] == f"{m[1]} {m[2]}" and m[1] in pii.GIVEN["m", "latin"]
    assert "Smith" not in got[1].replace("Smithson", "") and "John" not in got[1]
    m = re.fullmatch(r"Dr (\w+) (\w+), later Frau (\w+ \w+) and Frau (\w+); Prof (\w+)", got[2])
    assert m and m[3] == f"{m[1]} {m[2]}" and m[2] == m[4] == m[5] and m[1] in pii.GIVEN["f", "latin"]
    assert got[3] == "John Smith and Smith without titles"
    one, two = re.fullmatch(r"Mr (\w+ \w+), Mr (\w+ \w+)", got[4]).groups()
    assert one != two


def test_collisions_are_resolved(spark):
    names = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(676)]  # as many as there are surrogates
    docs = [(i, f"{n}@x.com, {n}@x.com") for i, n in enumerate(names)] + [(1000, "again AA@x.com")]
    got = replaced(spark, docs)
    mails = [got[i].split(", ") for i in range(len(names))]
    assert all(a == b for a, b in mails) and len({a for a, _ in mails}) == len(names)
    assert not {a for a, _ in mails} & {f"{n}@x.com" for n in names} and got[1000] == f"again {mails[0][0]}"


def test_replace_keeps_clashing_columns(spark, clash, kept):
    docs = clash(spark.createDataFrame([(1, "call 555-123-4567 now"), (1, "call 555-123-4567 now"), (2, "x" * 300_000)], DOCS))
    out, counts = pii.replace(docs, "text")
    kept(docs, out)
    assert counts not in docs.columns and len({r["text"] for r in out.where("doc_id = 1").collect()}) == 1
    assert pii.replace(docs.limit(0), "text")[0].count() == 0


FILES = [
    ("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", "nothing here"), ("a/b/LICENSE", "intro\nLicensed under the Apache License, Version 2.0.\nrest"),
    ("a/b/c/y.txt", "prose only"), ("a/b/c/z.txt", "This work is licensed under the GNU General Public License, version 3."), ("top.txt", ""), (None, None),
    ("d/COPYING.md", "my driver license was lost in the park yesterday"), ("d/e.txt", None), ("a/b/x.txt", "nothing here"),
]


def test_licenses_and_inheritance(spark, clash, kept):
    rows = [(i, p, t) for i, (p, t) in enumerate(FILES)]
    files = clash(spark.createDataFrame(rows, "doc_id long, where_ string, text string"))
    got = licenses.scan(files, F.col("where_"), F.col("text"), files.columns)
    kept(files, got)
    names = [c for c in got.columns if c not in files.columns]
    out = {r["doc_id"]: (r[names[1]], r[names[3]], r[names[4]]) for r in got.collect()}
    assert out == {
        0: ("MIT", "MIT", None), 1: (None, "Apache-2.0", "a/b"), 2: ("Apache-2.0", "Apache-2.0", None), 3: (None, "Apache-2.0", "a/b"),
        4: ("GPL-3.0", "GPL-3.0", None), 5: (None, None, None), 6: (None, None, None), 7: (None, None, None), 8: (None, None, None),
        9: (None, "Apache-2.0", "a/b"),
    }
    assert licenses.scan(files.limit(0), F.col("where_"), F.col("text"), ["doc_id"]).count() == 0


def wrapped(text, mark=""):
    import textwrap

    return "\n".join(mark + line for line in textwrap.wrap(text, 72))


def test_wrapped_headers_and_licence_files(spark):
    rest = 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
    as_is = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.'
    mit = licenses.TEMPLATES["MIT"][-1]
    rows = [
        ("m/LICENSE", "Copyright (c) 2020 Some One\n\n" + "\n\n".join(map(wrapped, (mit, rest, as_is)))), ("m/src/a.txt", "nothing here"),
        ("n/LICENSE", "\n".join(map(wrapped, ("Copyright (c) 2020 Some One", mit, rest, as_is)))), ("n/a.txt", None),
        ("g/x.c", wrapped(licenses.TEMPLATES["GPL-3.0"][-1], " * ") + "\n\nint main;"), ("a/x.py", wrapped(licenses.TEMPLATES["Apache-2.0"][-1], "# ")),
    ] + [(f"p/{i}", f"plain words of the text and more of the same to the end {i}") for i in range(40)]
    files = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, where_ string, text string")
    got = licenses.scan(files, F.col("where_"), F.col("text"), ["doc_id"]).orderBy("doc_id").collect()
    assert [r["license"] for r in got] == ["MIT", "MIT", "MIT", "MIT", "GPL-3.0", "Apache-2.0"] + [None] * 40


@pytest.mark.parametrize("name", ["MIT", "GPL-2.0", "CC-BY-SA-4.0"])
def test_cosine_equals_brute_force(spark, name):
    import math

    texts = [licenses.TEMPLATES[name][0], "a license for words of many kinds", None, "the and of", f"Note: {licenses.TEMPLATES[name][0]}"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r["doc_id"]: (r["own_license"], r["cosine"]) for r in licenses.scan(docs, F.lit("x"), F.col("text"), ["doc_id"]).collect()}
    term = lambda t: re.findall(licenses.TERM, t.lower())
    known = {x for ts in licenses.TEMPLATES.values() for t in ts for x in term(t)}
    idf = lambda x: math.log(6 / (sum(x in term(t or "") for t in texts if x in known) + 1)) + 1
    for i, t in enumerate(texts):
        best = []
        for lic, ts in licenses.TEMPLATES.items():
            for s in (re.split(licenses.BREAK, t) if t else []):
                if re.search(licenses.SIGNAL, s):
                    for u in ts:
                        a, b = ({x: term(z).count(x) * idf(x) for x in term(z)} for z in (s, u))
                        dot = sum(v * b.get(x, 0) for x, v in a.items())
                        best.append((-round(dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())), 6), lic))
        want = min(best, default=(0, None))
        if -want[0] >= licenses.LEAST:
            assert got[i] == (want[1], pytest.approx(-want[0], abs=2e-6))
        else:
            assert got[i] == (None, None)
