"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the text under a character trigram model of each language, the
language that the markup declares, the suffix of the address, and a prior of the host.  Likelihoods of
declarations and suffixes and the host priors are counted over all rows by grouped aggregation: each
row counts with its probabilities by text alone.  Priors are smoothed down a hierarchy (all rows,
domain, host), and a row's own count is taken out of its host's.

The trigram models are fitted on labelled rows, about ``SAMPLE`` of each language at most, drawn by hash, so
that a language's model does not depend on how frequent the others are.  Every language with ``LEAST_ROWS``
labelled rows has a model.  Everything else covers all rows.  Whole texts are scored, ``BLOCK`` languages at
a time.

One more hypothesis is that the text is in none of the languages (``langmodel``); it has counts and priors
like a language, but never names a row: the likeliest language does.  A row is rejected when no text is there
to judge (no letter at all) or no language reaches ``CONFIDENCE``, be it for another one or for none.  Defined results: a null text counts as empty; evidence that is missing (null or empty)
says nothing; where no row is labelled, all rows are rejected with a null language; of languages with equal
probabilities the first in alphabetical order is taken; repeated rows each count as evidence and get equal
results; texts of any length are scored whole; an empty table has no rows.
"""

from __future__ import annotations



import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType

from . import langmodel
from .common import annotate, col, fresh, lean, lookup, settle, table

SAMPLE = 20_000  # labelled rows of each language for its trigram model
BLOCK = 32  # languages whose tables are in a worker's memory at once
NONE = 0.05  # prior of the hypothesis that a text is in none of the languages
LEAST_ROWS = 5  # labelled rows a language needs
CONFIDENCE = 0.5
TEMPER = 0.15  # neighbouring trigrams are not independent
STRENGTH = 8.0  # rows that a parent's prior counts for
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
DECLARED = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"
TAGS = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]+>|&[a-z#0-9]+;"


# languages; for each block of them and each language the places that occur and their counts; letters of none
Model = tuple[list[str], list[list[tuple[np.ndarray, np.ndarray]]], np.ndarray]


def fit(rows: DataFrame, text: str, language: str, sample: int = SAMPLE) -> Model:
    """Counts of trigrams, bigrams and letters of each language."""
    good = rows.select(col(text).alias("text"), F.trim(col(language)).alias("lang")).where("text is not null and lang <> ''")
    sizes = settle(good.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_ROWS), "languages")
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())
    if not languages:
        return [], [], np.zeros(0)
    share = sizes.select(F.col("lang").alias("_lang"), (F.lit(float(sample)) / F.col("n") * (1 << 30)).alias("_share"))
    spot = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    drawn = lookup(good, share, F.col("lang") == F.col("_lang"), "inner").where(spot < F.col("_share")).select("text", "lang")
    schema = StructType().add("lang", StringType()).add("gram", IntegerType()).add("n", LongType())

    def count(batches):
        total = {}

        def report():
            for lang, mine in total.items():
                at = np.flatnonzero(mine)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(mine[at])], schema.names
                )
            total.clear()

        for batch in batches:
            for t, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lang not in total and len(total) >= BLOCK:
                    yield from report()
                if lang not in total:
                    total[lang] = np.zeros(langmodel.SIZE, np.int64)
                total[lang] += np.bincount(langmodel.counts(t), minlength=langmodel.SIZE)
        yield from report()

    # bounded: one row per language and trigram that occurs
    found = settle(drawn.mapInArrow(lean(count), schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "trigrams")
    blocks, letters = [], []
    for a in range(0, len(languages), BLOCK):
        names = languages[a : a + BLOCK]
        part = found.where(F.col("lang").isin(names)).toArrow()
        owner = np.array([names.index(x) for x in part.column("lang").to_pylist()], np.int64)
        place, n = part.column("gram").to_numpy(), part.column("n").to_numpy()
        blocks.append([(place[owner == i], n[owner == i].astype(np.float32)) for i in range(len(names))])
        letters += [langmodel.letters(*x) for x in blocks[-1]]
    return languages, blocks, langmodel.pool(letters)


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _softmax(scores: Column) -> Column:
    """Of an array of logarithms.  What is the same for all entries is worked out once, not in the lambda."""
    shifted = F.zip_with(scores, F.array_repeat(F.array_max(scores), F.size(scores)), lambda x, top: F.exp(x - top))
    return F.zip_with(shifted, F.array_repeat(_total(shifted), F.size(scores)), lambda x, n: x / n)


def _sums(prefix: str, n: int) -> list[Column]:
    return [F.sum(F.get(F.col(prefix), F.lit(i))).alias(f"s{i}") for i in range(n)]


def _array(n: int) -> Column:
    return F.array(*(F.col(f"s{i}") for i in range(n)))


def identify(
    rows: DataFrame, text: Column | str, model: Model, declared: Column, suffix: Column, host: Column,
    keep: list[str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Keep columns and add: language, its probability, and accepted.  Returns also the added names."""
    spark = rows.sparkSession
    keep = rows.columns if keep is None else keep
    names = fresh(rows, "language", "probability", "accepted")
    languages, blocks, pooled = model
    k = len(languages) + 1  # the last one is none of them
    if not languages:
        none = [F.lit(None).cast("string"), F.lit(0.0), F.lit(False)]
        return rows.select(*(col(c) for c in keep), *(x.alias(n) for n, x in zip(names, none, strict=True))), names
    # the places that occur, some 100,000 a language; a worker lays out one block at a time
    sent = [spark.sparkContext.broadcast(b) for b in blocks]
    score, letters, d, s, h, domain = fresh(rows.select(*(col(c) for c in keep)), "_score", "_letters", "_declared", "_suffix", "_host", "_domain")
    added = StructType().add(score, ArrayType(DoubleType())).add(letters, LongType())

    def make():
        only = langmodel.Block(sent[0].value) if len(sent) == 1 else None

        def work(columns):
            texts = [langmodel.codes(t or "") for t in columns[0].to_pylist()]
            scores = np.zeros((len(texts), k))
            for i, part in enumerate(sent):
                block = only or langmodel.Block(part.value)
                for row, (c, _) in zip(scores[:, i * BLOCK : i * BLOCK + block.size], texts, strict=True):
                    row += TEMPER * block.score(c)
            for row, (c, _) in zip(scores, texts, strict=True):
                row[-1] = TEMPER * langmodel.score_none(c, pooled) + np.log(NONE)
            return [pa.array(scores.tolist(), pa.list_(pa.float64())), pa.array([n for _, n in texts], pa.int64())]

        return work

    clean = lambda x: F.nullif(F.lower(F.trim(x)), F.lit(""))
    labels = {d: clean(declared), s: clean(suffix), h: clean(host)}
    # the text passes through Python with the kept columns once here and once, alone, for the counts

    def scored(columns: list[str]) -> DataFrame:
        wide = rows.withColumns(labels).withColumn(domain, F.regexp_extract(F.col(h), r"([^.]+\.[^.]+)$", 1))
        sent_once = not isinstance(text, str) or text in columns
        return annotate(wide, {"text": text if sent_once else col(text)}, added, make, [*columns, d, s, h, domain])

    small = settle(
        scored([]).select(F.when(F.col(letters) > 0, _softmax(F.col(score))).alias("p"), d, s, h, domain), "language"
    )
    voting = small.where("p is not null")
    # counts per level; the finest level is by all four keys, so a hot host is summed before the shuffle
    fine = settle(voting.groupBy(d, s, h, domain).agg(*_sums("p", k)), "evidence")

    def level(*by: str) -> DataFrame:
        return fine.where(" and ".join(f"`{b}` is not null" for b in by) or "true").groupBy(*by).agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(k)))

    total = level().first()
    everything = [float(total[i] or 0.0) for i in range(k)]
    size = sum(everything)
    base = F.array(*(F.lit((x + 1.0) / (size + k)) for x in everything))

    def likelihood(by: str, title: str) -> DataFrame:
        """log P(value | language) for each value."""
        share = [F.log((F.col(f"s{i}") + 0.5) / F.lit(everything[i] + 50.0)) for i in range(k)]
        return level(by).select(F.col(by).alias(f"{title}_key"), F.array(*share).alias(title))

    def counted(by: str, title: str) -> DataFrame:
        return level(by).select(F.col(by).alias(f"{title}_key"), _array(k).alias(title))

    out = scored(keep)
    extra = fresh(out, "_ld", "_ls", "_cd", "_ch")
    for by, title, side in ((d, extra[0], likelihood), (s, extra[1], likelihood), (domain, extra[2], counted), (h, extra[3], counted)):
        right = settle(side(by, title), "evidence")
        out = lookup(out, right, F.col(by) == F.col(f"{title}_key")).drop(f"{title}_key")
    zero = F.array_repeat(F.lit(0.0), k)
    own = F.when(F.col(letters) > 0, _softmax(F.col(score))).otherwise(zero)
    at = lambda x, i: F.get(x, i)

    def smoothed(counts: Column, parent: Column) -> Column:
        c = F.coalesce(F.zip_with(counts, own, lambda x, y: F.greatest(x - y, F.lit(0.0))), zero)
        mixed = F.zip_with(c, parent, lambda x, p: x + STRENGTH * p)
        return F.zip_with(mixed, F.array_repeat(_total(c), k), lambda x, n: x / (n + STRENGTH))

    prior = fresh(out, "_prior", "_post")
    out = out.withColumn(prior[0], smoothed(F.col(extra[2]), base)).withColumn(prior[0], smoothed(F.col(extra[3]), F.col(prior[0])))
    parts = [F.transform(F.col(prior[0]), lambda p: F.log(p)), F.col(score), F.coalesce(F.col(extra[0]), zero), F.coalesce(F.col(extra[1]), zero)]
    fused = parts[0]
    for p in parts[1:]:
        fused = F.zip_with(fused, p, lambda x, y: x + y)
    out = out.withColumn(prior[1], _softmax(fused))
    named = F.slice(F.col(prior[1]), F.lit(1), F.lit(len(languages)))
    best = F.array_max(named)
    language = at(F.array(*(F.lit(x) for x in languages)), F.array_position(named, best).cast("int") - 1)
    results = [language, F.round(best, 6), (F.col(letters) > 0) & (best >= CONFIDENCE)]
    return out.select(*(col(c) for c in keep), *(x.alias(n) for n, x in zip(names, results, strict=True))), names


def keep_identified(docs: DataFrame, text: str, language: str, source: str) -> DataFrame:
    """The documents whose language is identified, with all their columns."""
    model = fit(docs, text, language)
    none = F.lit(None).cast("string")
    out, names = identify(docs, text, model, col(language), none, col(source))
    return out.where(col(names[2])).drop(*names)


def op3(spark: SparkSession, folder: str) -> DataFrame:
    """All pages; the models are fitted on documents with a known language."""
    model = fit(table(spark, folder, "documents"), "text", "lang")
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    url, html = F.col("url"), F.col("html")
    host = F.regexp_extract(url, HOST, 1)
    out, names = identify(
        pages, F.regexp_replace(html, TAGS, " "), model, F.regexp_extract(html, DECLARED, 1),
        F.regexp_extract(host, r"\.([^.]+)$", 1), host, keep=["page_id"],
    )
    return out.select("page_id", *(col(n).alias(x) for n, x in zip(names, ("language", "probability", "accepted"), strict=True)))
