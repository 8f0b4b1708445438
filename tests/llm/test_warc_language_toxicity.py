import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import charlm, language_id, toxicity, warc

PAGES = "page_id long, url string, html string"


def pages(n=60):
    rng = random.Random(1)
    rows = [(i, f"http://h{i % 3}.example.com/{i}\r\nx", "".join(rng.choice("abé<p>\r\n\r\n😀") for _ in range(rng.choice([0, 5, 99, 100, 4000])))) for i in range(n)]
    copy = "WARC/1.1\r\n\r\n" * 20
    return rows + [(200, None, copy), (90, "u", copy), (90, "u", copy), (300, "", copy), (None, "n", copy), (400, "s", "short"), (401, "s", "short"),
                   (402, "x", None), (403, "x", ""), (None, "y", "z" * 200), (500, "long", "é" * 3_000_000)]


def expected(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(b) if len(b) >= 100 else None
        revisit = f is not None and f != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_archives_are_read_back(spark, monkeypatch, clash, small):
    if small:
        for name, value in (("FRAME_BYTES", 3000), ("BUNDLE_BYTES", 2000), ("TASK_FRAMES", 2)):
            monkeypatch.setattr(warc, name, value)
    rows = pages()
    index = warc.write_bundles(clash(spark.createDataFrame(rows, PAGES)), "page_id", "url", "html")
    got = warc.read_bundles(index).collect()
    short = [(r["page_id"], r["payload_bytes"], r["computed_digest"] or r["payload_digest"], r["record_type"], r["refers_to"]) for r in got]
    assert sorted(short, key=repr) == expected(rows)
    payload = {(i, (h or "")) for i, _, h in rows}
    assert all((r["page_id"], r["payload"]) in payload for r in got if r["record_type"] == "response")
    assert all(r["computed_digest"] in (None, r["payload_digest"]) for r in got)
    if small:
        assert index.select("bundle", "frame").distinct().count() > 20


def test_records_are_fetched_by_their_offset(spark):
    index = warc.write_bundles(spark.createDataFrame(pages(), PAGES), "page_id", "url", "html")
    got = warc.fetch(index, F.col("page_id").isin(3, 90)).collect()
    assert len(got) == 3
    for r in got:
        assert r["record"].startswith("WARC/1.1\r\n") and f"<urn:uuid:{r['record_id']}>" in r["record"] and f"X-Page: {r['page_id']}\r\n" in r["record"]


def test_frames_are_independent_and_the_footer_is_skippable(spark, tmp_path):
    import zstandard

    writer = warc.BundleWriter(str(tmp_path), 0)
    places = [writer.add(bytes([65 + i % 26]) * 300_000) for i in range(10)]
    writer.close()
    assert len({f for f, _ in places}) > 1
    data = open(writer.path, "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole == b"".join(bytes([65 + i]) * 300_000 for i in range(10))  # any reader skips the table
    reader = warc.BundleReader(writer.path)
    assert all(reader.frame(f)[o : o + 1] == bytes([65 + i]) for i, (f, o) in enumerate(places))
    reader.close()


def test_no_pages(spark):
    index = warc.write_bundles(spark.createDataFrame([], PAGES), "page_id", "url", "html")
    assert index.count() == 0 and warc.read_bundles(index).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    return language_id.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "text", "lang")


def test_languages_of_unseen_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id >= 500")
    none = F.lit(None).cast("string")
    out, names = language_id.identify(docs, F.col("text"), model, none, none, none)
    right = out.select(F.col(names[0]) == F.col("lang"), F.length("text") > 100, names[2]).collect()
    assert np.mean([r[0] for r in right if r[1]]) > 0.95 and np.mean([r[2] for r in right]) > 0.98


def test_evidence_of_markup_and_host_decides_short_texts(spark, model):
    rows = [(i, "der die und nicht das ist", "de", "a.example.de") for i in range(30)] + [(50 + i, "the and that with for was", "en", "b.example.com") for i in range(30)]
    rows += [(100, "x q", None, "a.example.de"), (101, "x q", None, "b.example.com"), (102, "x q", "de", None), (103, None, "de", "a.example.de"),
             (104, "12 34 !?", "de", "a.example.de"), (105, "", "", ""), (100, "x q", None, "a.example.de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    suffix = F.regexp_extract("host", r"\.([^.]+)$", 1)
    out, names = language_id.identify(docs, F.col("text"), model, F.col("lang"), suffix, F.col("host"))
    got = {r["doc_id"]: (r[names[0]], r[names[2]]) for r in out.collect()}
    assert got[100] == ("de", True) and got[101] == ("en", True) and got[102][0] == "de"
    assert not any(got[i][1] for i in (103, 104, 105)) and out.count() == len(rows)


def made_up(number, rows, rng):
    """Own sample data: texts over words that only this language has."""
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(12)]
    return [(f"l{number:02d}", " ".join(rng.choice(words) for _ in range(30))) for _ in range(rows)]


def test_rare_and_many_languages_have_models(spark):
    rng = random.Random(7)
    rows = [r for i in range(40) for r in made_up(i, 3000 if i == 0 else 12, rng)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    model = language_id.fit(docs, "text", "lang", sample=50)
    assert len(model[0]) == 40
    none = F.lit(None).cast("string")
    small = docs.where("lang <> 'l00'")
    out, names = language_id.identify(small, F.col("text"), model, none, none, none)
    right = [r["lang"] == r[names[0]] and r[names[2]] for r in out.collect()]
    assert np.mean(right) > 0.95


def test_other_scripts_are_told_apart_and_gibberish_is_rejected(spark):
    rng = random.Random(5)
    words = {
        "ru": "это был большой дом и мы жили там все время пока они не ушли".split(),
        "uk": "це був великий будинок і ми жили там весь час поки вони не пішли".split(),
        "zh": "这 是 一个 很 大 的 房子 我们 在 那里 住 了 时间 他们 没有 走".split(),
        "ja": "これ は とても 大きな 家 です 私たち が そこ に 住んで いた 時間".split(),
        "pl": "to był duży dom i mieszkaliśmy tam cały czas aż oni nie odeszli".split(),
    }
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(lang, text(lang, 30)) for lang in words for _ in range(12)]
    model = language_id.fit(spark.createDataFrame(rows, "lang string, text string"), "text", "lang")
    other = [("none", "".join(rng.choice("bcdfghjklmnpqrstvwxz ") for _ in range(200))), ("none", "ეს არის დიდი სახლი და ჩვენ იქ ვცხოვრობდით " * 3)]
    docs = spark.createDataFrame([(lang, text(lang, 12)) for lang in words for _ in range(5)] + other, "lang string, text string")
    none = F.lit(None).cast("string")
    out, names = language_id.identify(docs, F.col("text"), model, none, none, none)
    for r in out.collect():
        assert r[names[2]] == (r["lang"] != "none") and r["lang"] in (r[names[0]], "none"), r


def test_identified_documents_keep_their_columns(spark, clash, kept):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = clash(docs.unionByName(docs.limit(1).withColumns({"text": F.lit(None).cast("string")})))
    got = language_id.keep_identified(more, "text", "lang", "source")
    assert got.columns == more.columns and got.count() == docs.count()
    kept(more, got)
    assert language_id.keep_identified(more.limit(0), "text", "lang", "source").count() == 0


def test_noisy_channel_restores_words(spark):
    texts = ["idiot moron clown loser stupid trash worthless people are not the same and this is that"] * 30
    counts = toxicity.count_grams(spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string"), "text")
    logs = charlm.log_probabilities(counts)
    assert counts.sum() == 30 * len(charlm.grams(texts[0]))
    for seen, word in {"1d10t": "idiot", "m0r0n": "moron", "cl0wn": "clown", "l.o.s.e.r": "loser", "stuuuupid": "stupid", "tr@$h": "trash", "people": "people"}.items():
        assert toxicity.decode(seen, logs) == word
    words = toxicity.restorer(logs)
    assert "idiot" in words("you i d i o t!") and "moron" in words("a M0R0N.") and "clown" in words("(c-l-o-w-n)")
    assert words("Plain words, here. And  more") == {"plain", "words", "here", "and", "more"} and words("") == set()


def test_disguises_at_the_end_doubled_letters_and_spaced_words_are_read(spark):
    texts = ["what a moron you are a stupid fool ass asshole jackass loser traitor i am an idiot it is a day"] * 30
    logs = charlm.log_probabilities(toxicity.count_grams(spark.createDataFrame([(t,) for t in texts], "text string"), "text"))
    words = toxicity.restorer(logs)
    cases = {
        "an a$$, he": "ass", "asshol3": "asshole", "jack@$$!": "jackass", "f00l": "fool", "lo5er": "loser", "stuupid": "stupid", "tra1+or": "traitor",
        "what a m o r o n": "moron", "you are a s t u p i d fool": "stupid", "so i a m a n i d i o t": "idiot", "!diot": "idiot", "a m 0 r 0 n": "moron",
    }
    for text, word in cases.items():
        assert word in words(text), (text, words(text))


def labelled(n=600):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "de", "fi", "go") for b in ("la", "me", "ni", "ru") for c in ("s", "t", "n", "")]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 40))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", f"zorg{rng.choice(vocabulary)}"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_toxic_documents(spark, clash, kept):
    docs, labels = labelled()
    docs += [(1000, "you 1d10t bala"), (1001, None), (1002, ""), (None, "moron bala"), (1003, "bala mes"), (1004, "word " * 200_000), (1003, "bala mes")]
    d = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    model = toxicity.train(d, "doc_id", "text", spark.createDataFrame(labels + [(None, 1), (5000, 1), (7, None)], "doc_id long, toxic int"), "doc_id", "toxic")
    assert {"idiot", "moron", "zorg*"} <= set(model["markers"])
    out = toxicity.score(d, F.col("text"), model, d.columns)
    kept(d, out)
    name = out.columns[-1]
    got = {(r["doc_id"], r["text"]): r[name] for r in out.collect()}
    right = [(got[i, t] >= 0.5) == bool(y) for (i, t), (_, y) in zip(docs, labels, strict=False)]
    assert np.mean(right) > 0.97
    assert got[1000, "you 1d10t bala"] > 0.5 and got[None, "moron bala"] > 0.5 and got[1003, "bala mes"] < 0.5
    assert got[1001, None] == got[1002, ""] < 0.5 and out.count() == len(docs)


def test_labels_of_held_out_rows_have_no_influence(spark):
    import zlib

    docs, labels = labelled(200)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    one, two = (toxicity.train(d, "doc_id", "text", spark.createDataFrame(x, "doc_id long, toxic int"), "doc_id", "toxic") for x in (labels, turned))
    assert one["markers"] == two["markers"] and one["constant"] == two["constant"]


def test_without_labels_the_base_rate_is_the_score(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = toxicity.train(d, "doc_id", "text", spark.createDataFrame([], "doc_id long, toxic int"), "doc_id", "toxic")
    assert toxicity.score(d, F.col("text"), model, ["doc_id"]).first()["score"] == pytest.approx(0.25)
    assert toxicity.score(d.limit(0), F.col("text"), model, ["doc_id"]).count() == 0
