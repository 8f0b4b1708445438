"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items: ``window`` consecutive words, or a whole shorter
item.  Patterns of one length are searched together.  The shift table has, for each block of two
words (one, if a pattern has one), how far the search may jump before a pattern can end there; where
the jump is 0 the block's suffix bucket lists the patterns to test, and their words are compared.
Many stretches of a batch are searched in step, one numpy operation for all.

Windows are cut into blocks of a bounded size by their hash.  Each block is broadcast and searched in
a pass of its own over the documents, which adds its hits to those found before: the benchmark may be
of any size.

Defined results: a null or empty text has no words; an item without words has no windows; a window
of an item without an id marks words but adds no item; items with the same id count once; repeated
documents are separate rows with equal results; texts of any length are read whole; without documents or items
there are no rows, or no hits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from . import wordcodes
from .common import annotate, col, fresh, settle, table

WINDOW = 10
BLOCK_BYTES = 8 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LANE = 512


def windows(benchmark: DataFrame, item: Column, text: Column, window: int = WINDOW) -> DataFrame:
    """The different (item_id, window) pairs of a benchmark; a window's words are joined by blanks."""
    words = benchmark.select(
        item.cast("string").alias("item_id"),
        F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("words"),
    ).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    cut = F.transform(starts, lambda i: F.array_join(F.slice("words", i, window), " "))
    return words.select("item_id", F.explode(cut).alias("window")).distinct()


class Tables:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, words: int, codes: np.ndarray, texts: list[bytes], items: list[list[str]]) -> None:
        self.words, self.codes, self.texts, self.items = words, codes, texts, items
        self.block = min(2, words)
        self.bits = np.uint64(64 - max(12, math.ceil(math.log2(16 * words * len(codes)))))
        self.shift = np.full(1 << (64 - int(self.bits)), words - self.block + 1, np.int64)
        for end in range(self.block, words + 1):  # blocks that end later in a pattern allow shorter jumps
            at = self.place(*(codes[:, end - self.block + k] for k in range(self.block)))
            np.minimum.at(self.shift, at, words - end)
        last = self.place(*(codes[:, words - self.block + k] for k in range(self.block)))
        self.order = np.argsort(last, kind="stable")
        self.bucket = np.searchsorted(last[self.order], np.arange(len(self.shift) + 1))

    def place(self, *block: np.ndarray) -> np.ndarray:
        x = block[0] if len(block) == 1 else block[0] * np.uint64(0x9E3779B97F4A7C15) + block[1]
        return (wordcodes.mix(x) >> self.bits).astype(np.int64)

    def candidates(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions and patterns whose code sequences agree."""
        n = len(code) - self.words + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            return none, none
        at = np.arange(0, n, LANE)
        stop = np.minimum(at + LANE, n)
        found = []
        while len(at):
            block = [code[at + (self.words - self.block + k)] for k in range(self.block)]
            jump = self.shift[self.place(*block)]
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        at = np.concatenate(found)
        place = self.place(*(code[at + (self.words - self.block + k)] for k in range(self.block)))
        count = self.bucket[place + 1] - self.bucket[place]
        first = np.repeat(self.bucket[place], count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at, pattern = np.repeat(at, count), self.order[first + step]
        for k in range(self.words):
            same = code[at + k] == self.codes[pattern, k]
            at, pattern = at[same], pattern[same]
        return at, pattern


def build(pairs: list[tuple[str, str | None]]) -> list[Tables]:
    """Tables of one block of (window, item) pairs, one for each number of words."""
    items: dict[str, list[str]] = {}
    for window, item in pairs:
        items.setdefault(window, []).extend([] if item is None else [item])
    texts = list(items)
    words = wordcodes.split(pa.array(texts, pa.large_string()), "alnum")
    sizes = np.diff(words.first)
    out = []
    for size in np.unique(sizes[sizes > 0]):
        mine = np.flatnonzero(sizes == size)
        codes = words.code[words.first[mine][:, None] + np.arange(size)]
        out.append(Tables(int(size), codes, [texts[i].encode() for i in mine], [items[texts[i]] for i in mine]))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def scan(texts: pa.Array, tables: list[Tables]) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set]]:
    """Words of each text, and for texts with occurrences their word spans and items."""
    words = wordcodes.split(texts, "alnum")
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set] = {}
    for t in tables:
        at, pattern = t.candidates(words.code)
        doc = np.searchsorted(words.first, at, "right") - 1
        whole = at + t.words <= words.first[doc + 1]  # an occurrence lies in one text
        for i, p, d in zip(at[whole].tolist(), pattern[whole].tolist(), doc[whole].tolist(), strict=True):
            if words.raw(i, i + t.words) == t.texts[p]:
                begin = i - int(words.first[d])
                spans.setdefault(d, []).append((begin, begin + t.words))
                items.setdefault(d, set()).update(t.items[p])
    return np.diff(words.first), spans, items


def find_passages(
    docs: DataFrame, text: str, benchmark: DataFrame, item: str, item_text: str,
    window: int = WINDOW, keep: list[str] | None = None, names: tuple[str, str, str] = ("n_words", "hits", "items"),
) -> tuple[DataFrame, list[str]]:
    """Keep columns of the documents and add: words, hit spans (start, end, ... in words), item ids.

    Returns the table and the names of the three added columns, changed where a kept column has them.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    pairs = settle(windows(benchmark, col(item), col(item_text), window), "windows")
    size = pairs.agg(F.sum(F.octet_length("window") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    names = fresh(docs.select(*(col(c) for c in keep)), *names)
    previous = fresh(docs, "_hits", "_items")
    out = docs.select(*(col(c) for c in dict.fromkeys([*keep, text])))
    out = out.withColumns({previous[0]: F.array().cast("array<int>"), previous[1]: F.array().cast("array<string>")})
    added = (
        StructType().add(names[0], LongType()).add(names[1], ArrayType(IntegerType(), False))
        .add(names[2], ArrayType(StringType(), False))
    )
    for k in range(blocks):
        part = pairs.where(F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks)) == k)
        # bounded: a block holds about BLOCK_BYTES
        mine = spark.sparkContext.broadcast([tuple(r) for r in part.select("window", "item_id").collect()])

        def make(mine=mine):
            tables = build(mine.value)

            def work(columns: list[pa.Array]) -> list[pa.Array]:
                texts, before, known = columns
                n, spans, items = scan(texts, tables)
                hits: list = [[]] * len(n)
                found: list = [[]] * len(n)
                if blocks > 1:
                    hits, found = before.to_pylist(), known.to_pylist()
                for d, s in spans.items():
                    s += zip(hits[d][::2], hits[d][1::2], strict=True)
                    hits[d] = _merged(s)
                    found[d] = sorted(items[d].union(found[d]))
                return [pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]

            return work

        last = k == blocks - 1
        carried = keep if last else list(dict.fromkeys([*keep, text]))
        step = added
        if not last:
            step = StructType().add(fresh(out, "_n")[0], LongType()).add(previous[0], added[1].dataType).add(previous[1], added[2].dataType)
        inputs = {"text": text if text in carried else col(text), "hits": col(previous[0]), "items": col(previous[1])}
        out = annotate(out, inputs, step, make, carried)
    return out, names


def report(docs: DataFrame, names: list[str]) -> dict[str, Column]:
    """The digest columns of the found passages."""
    n_words, hits, items = names
    n_hit = F.aggregate(
        F.sequence(F.lit(0), F.size(hits) - 1, F.lit(2)), F.lit(0).cast("long"),
        lambda s, i: s + F.get(hits, i + 1) - F.get(hits, i),
    )
    n_hit = F.when(F.size(hits) > 0, n_hit).otherwise(F.lit(0).cast("long"))
    return {
        "n_words": col(n_words), "n_hit": n_hit, "n_items": F.size(items).cast("long"),
        "items_sha256": F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256),
        "contaminated": F.size(hits) > 0,
    }


def decontaminate(docs: DataFrame, text: str, benchmark: DataFrame, item: str, item_text: str, window: int = WINDOW) -> DataFrame:
    """The documents without a window of the benchmark, with all their columns."""
    found, names = find_passages(docs, text, benchmark, item, item_text, window)
    return found.where(F.size(names[1]) == 0).drop(*names)


def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found, names = find_passages(docs, "text", table(spark, folder, "benchmark"), "item_id", "text", keep=["doc_id"])
    return found.select("doc_id", *(x.alias(n) for n, x in report(found, names).items()))


SQL = rf"""
with iw as (
  select cast(item_id as varchar) as item_id,
    regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') as w from benchmark where text is not null),
win as (
  select distinct item_id, least(len(w), {WINDOW}) as n,
    array_to_string(list_slice(w, i, i + {WINDOW} - 1), ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) as i from iw where len(w) > 0)),
dw as (
  select row_number() over () as r, doc_id,
    case when text is null then [] else regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') end as w
  from documents),
pos as (select r, w, unnest(range(1, len(w) + 1)) as i from dw where len(w) > 0),
occ as (
  select p.r, p.i, x.n, x.item_id
  from (select r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as win
        from pos, (select distinct n from win) where i + n - 1 <= len(w)) p
  join win x on x.n = p.n and x.win = p.win),
hit as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + n)) as j from occ) group by r),
its as (
  select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct r, item_id from occ where item_id is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  n_hit is not null as contaminated
from dw left join hit using (r) left join its using (r)
"""
