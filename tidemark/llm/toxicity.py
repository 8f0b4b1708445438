"""Toxicity scores after noisy-channel deobfuscation.

Disguised words (look-alike symbols, letters spaced or dotted apart, repeated letters) are read as the
output of a noisy channel: a lattice has for each symbol the letters that it may stand for, or nothing
for a separator or repeated letter; a blank among letters set apart may also end a word.  The Viterbi path under a character trigram model, counted over all
documents, restores the text.  Restored texts are scored by a logistic model on marker words and word
beginnings, which are chosen on labelled rows: greedily, each next marker explains toxic rows that the
markers before leave unexplained, so that copies and topics add no markers of their own.

Only the text is an input of the score.  Labels are learned from at most ``SAMPLE`` labelled rows, drawn
by hash among those whose crc32 of the id is not divisible by ``HELD_OUT``.

Defined results: null and empty texts get the score of a text without markers; without labelled rows
of both kinds every score is the smoothed base rate; rows without an id are not held out and never
learned from; repeated rows get equal scores; texts of any length are read whole; an empty table has no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType

from . import charlm
from .common import annotate, col, fresh, lookup, settle, table, worker_cache

HELD_OUT = 5
SAMPLE = 100_000  # labelled rows
MOST_CANDIDATES = 100_000  # word beginnings that are counted on clean rows
MOST_SHARP = 20_000  # beginnings that hardly occur in clean rows
MOST_MARKERS = 400
LEAST_TOXIC = 3  # toxic rows that a marker must occur in
LEAST_GAIN = 1.5  # of toxic rows, each weighed by what is left to explain
EXPLAINED = 0.7  # what each marker leaves of a row
PRECISION = 0.8
BEGINNINGS = (4, 5, 6)
CACHE = 100_000

# The letters that a symbol may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = ".-_*~'`^,:;/ "
COST_LOOKALIKE, COST_DROP, COST_DROP_SYMBOL, COST_REPEAT, COST_KEEP_REPEAT = 1.0, 0.7, 8.0, 0.3, 1.5
COSTS_BREAK = (0.7, 2.5, 99.0)  # a run of single characters is read at each: trigrams alone seldom tell where words end
LONE = 0.05  # share of a letter's words that are the letter alone, from which on it may be one

WORD = re.compile(r"[^\W\d_]+")
SPACED = re.compile(r"(?<!\S)(?:\S[ ]){2,}\S(?![^\W_])")
_SYMBOLS = re.escape("".join(LOOKALIKES))
_APART = re.escape(SEPARATORS.replace(" ", ""))
QUOTES = SEPARATORS + "\"?)[]{}<>#%&"  # around words; look-alikes among them may also be letters
# a letter and a look-alike anywhere, a letter twice, or single letters set apart
SUSPECT = re.compile(
    rf"[^\W\d_].*[{_SYMBOLS}]|[{_SYMBOLS}].*[^\W\d_]|([^\W\d_])\1|(?<![^\W\d_])[^\W\d_][{_APART}][^\W\d_][{_APART}][^\W\d_](?![^\W\d_])",
    re.DOTALL,
)
# what a text must have for a run of single characters, in a form that is found fast
_HINT_SPACED = re.compile(r" \S \S ")
DOUBLED = re.compile(r"([^\W\d_])\1")
THRICE = re.compile(r"([^\W\d_])\1\1")
LETTER = {c: i + 1 for i, c in enumerate(charlm.LETTERS)}
LONGEST_KEPT = 64  # characters of a token whose forms are kept


def count_grams(texts: DataFrame, text: str) -> np.ndarray:
    """Trigram counts of all texts; what comes to the driver is bounded by the alphabet."""
    schema = StructType().add("gram", IntegerType()).add("n", LongType())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(charlm.GRAMS, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    total += np.bincount(charlm.grams(t), minlength=charlm.GRAMS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], schema.names)

    out = np.zeros(charlm.GRAMS)
    found = texts.select(col(text)).mapInArrow(count, schema).groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return out


def decode(observed: str, logs: np.ndarray, price_break: float = COSTS_BREAK[0], doubles: bool = False) -> str:
    """The most likely word behind an observed one; words, where blanks are observed.

    With ``doubles`` a letter that stands twice is rather kept.
    """
    drop_repeat, keep_repeat = (COST_KEEP_REPEAT, 0.0) if doubles else (COST_REPEAT, COST_KEEP_REPEAT)
    best: dict[tuple[int, int], tuple[float, tuple]] = {(charlm.GAP, charlm.GAP): (0.0, ())}
    before = ""
    for c in observed.lower():
        options = [(x, COST_LOOKALIKE) for x in LOOKALIKES.get(c, "")]
        if c.isalpha():
            options.append((c, keep_repeat if c == before else 0.0))
        elif c == " ":
            options.append((c, price_break))
        drop = drop_repeat if c == before and c.isalpha() else COST_DROP if c in SEPARATORS else COST_DROP_SYMBOL if not c.isalpha() else None
        now: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, path) in best.items():
            for letter, price in options:
                k = charlm.GAP if letter == " " else LETTER.get(letter, charlm.OTHER)
                total = cost + price - float(logs[(a * charlm.SIZE + b) * charlm.SIZE + k])
                if total < now.get((b, k), (np.inf,))[0]:
                    now[b, k] = total, (path, letter)
            if drop is not None and cost + drop < now.get((a, b), (np.inf,))[0]:
                now[a, b] = cost + drop, path
        best, before = now, c
    end = min(best.items(), key=lambda s: (s[1][0] - float(logs[(s[0][0] * charlm.SIZE + s[0][1]) * charlm.SIZE]), s[0]))
    letters, path = [], end[1][1]
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


def restorer(logs: np.ndarray) -> Callable[[str], set[str]]:
    """A function from a text to its words, and the restored forms of disguised ones, in lower case."""
    cache, model = worker_cache(), zlib.crc32(logs.tobytes())
    if cache.get("restored_by") != model:
        cache["restored_by"], cache["restored"] = model, {}
    known: dict[str, tuple[str, ...]] = cache["restored"]

    def single(m: re.Match) -> str:
        """What decoding makes of a letter that stands twice among letters: the paths meet after the next letter."""
        word, at, c = m.string, m.start(), LETTER.get(m.group(1), charlm.OTHER)
        x = LETTER.get(word[at - 1], charlm.OTHER) if at else charlm.GAP
        y = LETTER.get(word[at + 2], charlm.OTHER) if at + 2 < len(word) else charlm.GAP
        first, second = (x * charlm.SIZE + c) * charlm.SIZE, (c * charlm.SIZE + c) * charlm.SIZE
        kept_ = COST_KEEP_REPEAT - float(logs[first + c]) - float(logs[second + y])
        return m.group() if kept_ < COST_REPEAT - float(logs[first + y]) else m.group(1)

    def twice(word: str) -> tuple[str, ...]:
        """What a word of letters alone, some of them doubled, may be a disguise of."""
        return (decode(word, logs) if THRICE.search(word) else DOUBLED.sub(single, word),)

    def forms(token: str) -> tuple[str, ...]:
        """The words of a token, and what it may be a disguise of."""
        out = WORD.findall(token)
        bare = token.strip(QUOTES + "!(")
        # a look-alike at the beginning may be a letter or a mark; at the end of a sentence '!' is a mark
        for t in {bare, token.lstrip(QUOTES).rstrip(QUOTES + "!(")}:
            if t.isalpha():
                out += twice(t) if DOUBLED.search(t) else ()
            elif SUSPECT.search(t):
                out.append(decode(t, logs))
                if DOUBLED.search(t):
                    out.append(decode(t, logs, doubles=True))
        return tuple(dict.fromkeys(out))

    def readings(run: str) -> tuple[str, ...]:
        """The words of a run of single characters."""
        out = [w for price in COSTS_BREAK for w in decode(run, logs, price).split()]
        first = LETTER.get(run[0])
        if first and logs[(charlm.GAP * charlm.SIZE + first) * charlm.SIZE + charlm.GAP] > np.log(LONE):
            out += [run[0], *(w for price in COSTS_BREAK for w in decode(run[2:], logs, price).split())]
        return tuple(dict.fromkeys(out))

    def kept(token: str, make: Callable[[str], tuple[str, ...]]) -> tuple[str, ...]:
        there = known.get(token)
        if there is None:
            there = make(token)
            if len(token) <= LONGEST_KEPT:
                if len(known) >= CACHE:
                    known.clear()
                known[token] = there
        return there

    def words(text: str) -> set[str]:
        low = text.lower()
        out: set[str] = set()
        for token in set(low.split()):
            if not token.isalpha():
                word = token.strip(".,")
                if not word.isalpha():
                    out.update(kept(token, forms))
                    continue
                token = word
            out.add(token)
            if DOUBLED.search(token):
                out.update(kept(token, twice))
        if _HINT_SPACED.search(f" {low} "):
            for m in SPACED.finditer(low):
                out.update(kept(m.group(), readings))
        return out

    return words


def beginnings(words: set[str]) -> set[str]:
    """Words, and their beginnings marked by a star."""
    out = set(words)
    for n in BEGINNINGS:
        out.update([b + "*" for b in {w[:n] for w in words if len(w) > n}])
    return out


def _counts(rows: DataFrame, logs, wanted=None) -> DataFrame:
    """In how many texts each beginning occurs (of the wanted ones, where given)."""
    schema = StructType().add("marker", StringType()).add("n", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = restorer(logs.value)
        only = None if wanted is None else set(wanted.value)
        total: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                there = beginnings(words(t or ""))
                total.update(there if only is None else there & only)
                if len(total) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], schema.names)
                    total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], schema.names)

    return rows.mapInArrow(run, schema).groupBy("marker").agg(F.sum("n").alias("n"))


def choose(patterns: list[tuple[tuple[int, ...], int, int]], names: list[str]) -> list[int]:
    """Markers in the order of what they explain; patterns are (markers there, toxic rows, clean rows).

    Where a marker is there, others that begin like it are no further evidence.
    """
    size = len(names)
    stem = np.unique([n[: BEGINNINGS[0]] for n in names], return_inverse=True)[1]
    left_toxic = np.array([t for _, t, _ in patterns], np.float64)
    clean = np.array([c for _, _, c in patterns], np.float64)
    rows = np.repeat(np.arange(len(patterns)), [len(p) for p, _, _ in patterns])
    marks = np.array([m for p, _, _ in patterns for m in p], np.int64)
    false = np.bincount(marks, clean[rows], size)
    out: list[int] = []
    while len(out) < MOST_MARKERS:
        gain = np.bincount(marks, left_toxic[rows], size)
        value = np.where(gain >= LEAST_GAIN, gain - 2 * false, -1)
        value[out] = -1
        best = int(np.argmax(value))
        if value[best] <= 0:
            break
        out.append(best)
        there = np.unique(rows[marks == best])
        left_toxic[there] *= EXPLAINED
        apart = ~(np.isin(rows, there) & (stem[marks] == stem[best]))
        rows, marks = rows[apart], marks[apart]
    return out


def fit_logistic(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of a ridge logistic model on grouped rows; the first one is the constant."""
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(a.shape[1])
    n = toxic + clean
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (toxic - n * p) - penalty * w
        hessian = (a * (n * p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str) -> dict:
    """The channel's language model, the markers and their weights."""
    spark = docs.sparkSession
    usable = F.pmod(F.crc32(col(label_key).cast("string").cast("binary")), F.lit(HELD_OUT)) != 0
    known = labels.where(col(label_key).isNotNull() & col(label).isNotNull() & usable)
    known = known.groupBy(col(label_key).alias("_key")).agg(F.max(col(label)).alias("_toxic"))
    rows = known.count()
    if rows > SAMPLE:
        known = known.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < int(SAMPLE / rows * (1 << 30)))
    known = settle(known, "labels")
    counts = count_grams(docs, text)
    logs = charlm.log_probabilities(counts)
    sent = spark.sparkContext.broadcast(logs)  # bounded by the alphabet
    learned = lookup(docs.select(col(key).alias("_id"), col(text).alias("_text")), known, F.col("_id") == F.col("_key"), "inner")
    sums = learned.groupBy("_toxic").count().collect()
    toxic, clean = (sum(r["count"] for r in sums if (r["_toxic"] >= 1) == t) for t in (True, False))
    base = (toxic + 0.5) / (toxic + clean + 2)
    model = {"logs": logs, "markers": {}, "constant": float(np.log(base / (1 - base)))}
    if not toxic or not clean:
        return model
    # texts that occur more than once count once: a large group of copies is not evidence of its words
    bad = _counts(learned.where("_toxic >= 1").select("_text"), sent).where(F.col("n") >= LEAST_TOXIC)
    bad = settle(bad.orderBy(F.desc("n"), "marker").limit(MOST_CANDIDATES), "markers")
    names = spark.sparkContext.broadcast([r["marker"] for r in bad.select("marker").collect()])  # MOST_CANDIDATES
    good = _counts(learned.where("_toxic < 1").select("_text"), sent, names)
    good = good.select(F.col("marker").alias("_m"), F.col("n").alias("_c"))
    both = bad.join(good, F.col("marker") == F.col("_m"), "left")
    sharp = both.where(F.col("n") >= PRECISION * (F.col("n") + F.coalesce("_c", F.lit(0))))
    drawn = sharp.orderBy(F.desc("n"), "marker").limit(MOST_SHARP).collect()
    final = sorted((r["marker"] for r in drawn), key=lambda m: (m.endswith("*"), m))  # at a tie the whole word is taken
    place = spark.sparkContext.broadcast({m: i for i, m in enumerate(final)})

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = restorer(sent.value)
        number = place.value
        for batch in batches:
            found = [sorted(number[b] for b in beginnings(words(t or "")) if b in number) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["toxic", "marks"])

    schema = StructType().add("toxic", IntegerType()).add("marks", ArrayType(IntegerType()))
    seen = learned.select((F.col("_toxic") >= 1).cast("int").alias("toxic"), "_text").mapInArrow(present, schema)
    grouped = seen.groupBy("marks").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).collect()  # SAMPLE at most
    # a pattern of markers weighs once per pattern among toxic rows: copies have equal patterns
    patterns = [(tuple(r["marks"]), 1 if r["t"] else 0, r["c"]) for r in grouped if r["marks"]]
    chosen = choose(patterns, final) if patterns else []
    at = {m: i for i, m in enumerate(chosen)}
    x = np.zeros((len(grouped), len(chosen)))
    for i, r in enumerate(grouped):
        for m in r["marks"]:
            if m in at:
                x[i, at[m]] = 1
    weights = fit_logistic(x, np.array([r["t"] for r in grouped], float), np.array([r["c"] for r in grouped], float))
    model["constant"] = float(weights[0])
    model["markers"] = {final[m]: float(w) for m, w in zip(chosen, weights[1:], strict=True)}
    return model


def score(docs: DataFrame, text: Column, model: dict, keep: list[str], name: str = "score") -> DataFrame:
    """Keep columns and add the score of the whole text (after an underscore, if a kept column has its name)."""
    name = fresh(docs.select(*(col(c) for c in keep)), name)[0]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: the alphabet and MOST_MARKERS

    def make():
        m = sent.value
        words = restorer(m["logs"])
        whole = {k for k in m["markers"] if not k.endswith("*")}
        parts = {k[:-1] for k in m["markers"] if k.endswith("*")}
        sizes = sorted({len(k) for k in parts})

        def work(columns):
            out = []
            for t in columns[0].to_pylist():
                there = words(t or "")
                found = whole & there
                for n in sizes:
                    found.update(b + "*" for b in parts & {w[:n] for w in there if len(w) > n})
                total = m["constant"] + sum(sorted(m["markers"][k] for k in found))
                out.append(1 / (1 + np.exp(-min(max(total, -30.0), 30.0))))
            return [pa.array(out, pa.float64())]

        return work

    return annotate(docs, {"text": text}, StructType().add(name, DoubleType()), make, keep)


def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, "doc_id", "text", table(spark, folder, "labels"), "doc_id", "toxic")
    out = score(docs, F.col("text"), model, ["doc_id"])
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(HELD_OUT)) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
