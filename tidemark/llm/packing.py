"""Best-two-fit packing of token sequences.

The plan is made on the histogram of piece lengths, which has at most ``capacity`` entries whatever
the number of documents.  A sequence is filled greedily, longest pieces first; then, while there is a
gap, its smallest piece is taken out and two unpacked pieces are put in that fill the wider gap more
tightly.  The same filling is repeated as often as the histogram allows, so the plan has a few rows
per length.  Pieces get numbers within their length (per task, plus counts of earlier tasks) and find
their place in the plan by their number; no piece list passes through one task or the driver.

Defined results: a null text is empty and has one piece with the closing id alone; equal documents are
packed each; rows without a doc_id keep it null; a key that is named like a column of the result gets an
underscore before its name; an empty table has no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .atoms import ragged
from .common import col, lean, lookup, settle, slices, small_batches, table, worker_cache

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
CACHED_WORDS = 600_000
CACHED_IDS = 4_000_000
LEARNED = 20_000  # words encoded in one call
SPECIAL = "<|"  # how special tokens begin; they are told by their case and all their signs
SIGNS = "!\"#$%&()*+,-./:;<=>?@[]^_{|}~"
KEY = "_key"
_SHIFT = 40


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _plain(text: str) -> str:
    """Lower case, where that cannot interact with the vocabulary's own normalisation."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if SPECIAL in text else text.lower()


def _parts(word: str) -> tuple[str, str]:
    """A word and the ASCII signs at its end; the vocabulary never joins a letter or digit with a sign."""
    core = word if SPECIAL in word else word.rstrip(SIGNS)
    return (core, word[len(core) :]) if core and core[-1] <= "\u00ff" and core[-1].isalnum() else (word, "")


class Words:
    """Ids of the different words that a worker met, all in one array; numbers hold until the next look-up."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.ids, self.first = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def look_up(self, names: list[str]) -> np.ndarray:
        """Numbers of different words; new ones are encoded in few calls, without the signs at their end."""
        if len(self.number) > CACHED_WORDS or len(self.ids) > CACHED_IDS:
            self.clear()
        number = self.number
        new = [w for w in names if w not in number]
        parts = [_parts(w) for w in new]
        missing = list({x for p in parts for x in p}.difference(number))
        for at in range(0, len(missing), LEARNED):
            some = missing[at : at + LEARNED]
            made = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            self._add(some, np.array(made.ids, np.uint32), np.bincount(np.array(made.word_ids, np.int64), minlength=len(some)))
        both = [(w, p) for w, p in zip(new, parts, strict=True) if p[1]]
        if both:
            code = np.array([number[x] for _, p in both for x in p], np.int64)
            self._add([w for w, _ in both], self.gather(code), self.count(code).reshape(-1, 2).sum(axis=1))
        return np.array([number[w] for w in names], np.int64)

    def _add(self, words: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(count)])

    def count(self, code: np.ndarray) -> np.ndarray:
        return self.first[code + 1] - self.first[code]

    def gather(self, code: np.ndarray) -> np.ndarray:
        return self.ids[ragged(self.first[code], self.count(code))]


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as little-endian unsigned 32-bit numbers.

    No piece of this kind of vocabulary spans a blank, so the texts of a slice are split at blanks, its
    different words are looked up once, and the ids are gathered for all places together.
    """
    cache = worker_cache()
    if cache.get("words_path") != path:
        cache["words_path"], cache["words"] = path, Words(path)
    words: Words = cache["words"]

    def encode(texts: list[str]) -> list[bytes]:
        lists = pc.split_pattern(pa.array([_plain(t).replace("\n", " ") for t in texts], pa.string()), " ")
        names = pc.list_flatten(lists).dictionary_encode()
        code = words.look_up(names.dictionary.to_pylist())[names.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
        size = np.concatenate([[0], np.cumsum(words.count(code))])
        places = 4 * size[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])]
        data = words.gather(code).astype("<u4").tobytes()
        return [data[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]

    return encode


def tokenize(docs: DataFrame, key: str, text: Column, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of documents: the key under the name ``KEY``, piece, start, length, ids_crc32, and a number within task and length."""
    schema = (
        StructType().add(KEY, docs.schema[key].dataType).add("piece", IntegerType()).add("start", LongType())
        .add("length", LongType()).add("ids_crc32", LongType()).add("task", IntegerType()).add("number", LongType())
    )
    closing = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch):
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += closing
                    for p, a in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[a : a + 4 * capacity]
                        row.append(i)
                        piece.append(p)
                        start.append(a // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                size = np.array(length, np.int64)
                order = np.argsort(size, kind="stable")
                lengths, first, count = np.unique(size[order], return_index=True, return_counts=True)
                number = np.empty(len(size), np.int64)
                number[order] = np.arange(len(size)) - np.repeat(first - seen[lengths], count)
                seen[lengths] += count
                keys = part.column(0).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()),
                     pa.array(np.full(len(size), task, np.int32)), pa.array(number)], schema.names)

    small_batches(docs.sparkSession)
    return docs.select(col(key).alias(KEY), text.alias("_text")).mapInArrow(lean(run), schema)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Fillings as (copies, {length: pieces}); counts[n] is the number of pieces of length n."""
    left = counts.astype(np.int64).copy()
    out = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return out
        used: dict[int, int] = {}
        free = left.copy()
        gap = capacity

        def put(n: int, k: int = 1) -> None:
            used[n] = used.get(n, 0) + k
            free[n] -= k
            if not used[n]:
                del used[n]

        while gap:
            at = int(np.searchsorted(there, gap, "right")) - 1
            while at >= 0 and not free[there[at]]:
                at -= 1
            if at < 0:
                break
            n = int(there[at])
            k = min(int(free[n]), gap // n)
            put(n, k)
            gap -= n * k
        while gap and used:
            small = min(used)
            room = gap + small
            put(small, -1)
            there_now = np.flatnonzero(free[:room])
            pair = _tightest(there_now, free, room)
            if pair is None or sum(pair) <= small:
                put(small)
                break
            put(pair[0])
            put(pair[1])
            gap = room - sum(pair)
        copies = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= copies * k
        out.append((copies, used))


def _tightest(lengths: np.ndarray, free: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two free pieces with the largest sum that fits."""
    if not len(lengths):
        return None
    mate = np.searchsorted(lengths, room - lengths, "right") - 1
    twin = (mate == np.arange(len(lengths))) & (free[lengths] < 2)
    mate = mate - twin
    fits = mate >= 0
    if not fits.any():
        return None
    total = np.where(fits, lengths + lengths[mate], -1)
    best = int(np.argmax(total))
    return int(lengths[best]), int(lengths[mate[best]])


def places(fillings: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each length and filling: first piece number, pieces a copy, first sequence, offset."""
    rows = []
    sequence = 0
    taken: dict[int, int] = {}
    for copies, used in fillings:
        offset = 0
        for n in sorted(used, reverse=True):
            rows.append((n, taken.get(n, 0), used[n], sequence, offset))
            taken[n] = taken.get(n, 0) + copies * used[n]
            offset += n * used[n]
        sequence += copies
    rows.sort()
    cut = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": (cut[:, 0] << _SHIFT) + cut[:, 1], "first": cut[:, 1], "each": cut[:, 2], "sequence": cut[:, 3], "offset": cut[:, 4]}


def pack(docs: DataFrame, key: str, text: Column, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence_id and its offset there."""
    spark = docs.sparkSession
    pieces = settle(tokenize(docs, key, text, path or vocabulary_path(), capacity), "pieces")
    by_task = settle(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    where = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    base = base.withColumnsRenamed({"task": "_task", "length": "_length", "base": "_base"})
    ranked = lookup(pieces, base, (F.col("task") == F.col("_task")) & (F.col("length") == F.col("_length")), "inner")
    ranked = ranked.select(KEY, "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("number")).alias("_rank"))
    schema = StructType(ranked.schema.fields[:-1]).add("sequence_id", LongType()).add("offset", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = where.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(p["key"], (length << _SHIFT) + rank, "right") - 1
            step = rank - p["first"][at]
            sequence = p["sequence"][at] + step // p["each"][at]
            offset = p["offset"][at] + step % p["each"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], schema.names)

    packed = ranked.mapInArrow(run, schema)
    return packed.withColumnRenamed(KEY, f"_{key}" if key.lower() in (c.lower() for c in packed.columns[1:]) else key)


def op7(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), "doc_id", F.col("text"))
