"""Language evidence fused in plain Python, for every row of a table with all kinds of evidence missing now and then."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import langmodel, language_id


def softmax(x):
    e = np.exp(np.array(x) - max(x))
    return e / e.sum()


def brute(rows, model):
    """language, probability and acceptance of rows (text, declared, suffix, host)."""
    languages, blocks, pooled = model
    k = len(languages) + 1
    tables = [langmodel.Block(b) for b in blocks]
    clean = lambda x: (x or "").strip(" ").lower() or None
    seen = []
    for text, declared, suffix, host in rows:
        codes, letters = langmodel.codes(text or "")
        score = [language_id.TEMPER * s for t in tables for s in t.score(codes)]
        score.append(language_id.TEMPER * langmodel.score_none(codes, pooled) + math.log(language_id.NONE))
        host = clean(host)
        domain = ".".join(host.split(".")[-2:]) if host and "." in host else "" if host else None
        seen.append((score, softmax(score) if letters else None, clean(declared), clean(suffix), host, domain))

    def level(place):
        out = {}
        for row in seen:
            if row[1] is not None and row[place] is not None:
                out[row[place]] = out.get(row[place], 0) + row[1]
        return out

    everything = sum((r[1] for r in seen if r[1] is not None), np.zeros(k))
    base = (everything + 1) / (everything.sum() + k)
    by_declared, by_suffix, by_host, by_domain = (level(i) for i in (2, 3, 4, 5))
    likelihood = lambda counts, value: np.log((counts[value] + 0.5) / (everything + 50)) if value in counts else 0
    out = []
    for score, own, declared, suffix, host, domain in seen:
        prior = base
        for counts, value in ((by_domain, domain), (by_host, host)):
            left = np.maximum(counts[value] - (own if own is not None else 0), 0) if value in counts else np.zeros(k)
            prior = (left + language_id.STRENGTH * prior) / (left.sum() + language_id.STRENGTH)
        post = softmax(np.log(prior) + score + likelihood(by_declared, declared) + likelihood(by_suffix, suffix))
        best = post[:-1].max()
        out.append((languages[int(post[:-1].argmax())], best, own is not None and best >= language_id.CONFIDENCE))
    return out


def test_fusion_equals_plain_python(spark, folder):
    rng = random.Random(11)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("text", "lang").limit(160).collect()
    model = language_id.fit(spark.read.parquet(f"{folder}/documents.parquet"), "text", "lang")
    rows = []
    for text, lang in docs:
        host = rng.choice([f"www.site{rng.randrange(4)}.{lang}", f"a{rng.randrange(3)}.shared.com", "localhost", None, " "])
        rows.append((text[: rng.choice([15, 60, 400])], rng.choice([lang, lang.upper(), "xx", "", None]), rng.choice([lang, "com", None]), host))
    rows += [(None, "en", "com", "www.site0.en"), ("", None, None, None), ("1234 5678", "de", "de", None), ("Слово и дело о ком-то", "ru", "ru", "x.ru")] * 3
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, text string, d string, s string, h string").repartition(3)
    out, names = language_id.identify(df, "text", model, F.col("d"), F.col("s"), F.col("h"))
    got = out.select("k", *names).orderBy("k").collect()
    for (_, language, probability, accepted), (name, best, sure) in zip(got, brute(rows, model), strict=True):
        assert language == name and abs(probability - best) < 2e-6 and (accepted == sure or abs(best - language_id.CONFIDENCE) < 1e-9)
