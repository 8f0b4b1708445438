"""Alignment of two tokenizers over the same bytes, as a monoid of fragments.

The tokens that end inside a byte range of a document form a *fragment*: those up to the first place where
a token of each tokenizer ends (open prefix), the groups between such places (closed), and those behind the
last one (open suffix).  Two neighbouring fragments compose: the left one's suffix and the right one's prefix
become a group.  This is associative and an empty fragment is its unit, so fragments may be composed in any
tree.  A document of up to ``chunk`` bytes is one fragment.  Longer ones are cut into byte ranges that go to
different tasks, each with the whole atoms at its edges (see ``atoms``); rounds of ``FAN`` neighbours at a
time compose them.  A range's bound is dropped where the atom over it reaches ``chunk`` bytes to a side, so no
atom is encoded more than twice.

Links are all pairs of tokens of a group.  Distinct pairs of documents are counted in tasks before they are
shuffled.  Counts of the most frequent pairs, a bounded number, are sent to all tasks; the others are joined.

Defined results: a text that is null or empty, or whose tokens do not give back its bytes, has no tokens;
each row is a document, also with an equal or null id; ties for an id's highest count are all best; an
empty table has no rows.  Texts of any length are whole; a table may have columns of any further names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructType

from .atoms import FIELDS as VALUES
from .atoms import Atoms, group_sizes, group_texts, public_paths, ragged, split
from .common import col, lean, settle, slices, small_batches, table

CHUNK_BYTES = 64 << 10
FAN = 16
COUNTED = 1 << 20  # pairs that a task holds before it reports them
FREQUENT = 1 << 20  # pairs whose counts are sent to all tasks
EXPANDED = 4096  # pairs of a group that are written out one by one
SLICE_BYTES = 2 << 20

# The start of an atom in bytes: a blank behind a sign that is no blank of any kind.
_CUT = re.compile(
    rb"(?<=[!-~\x80-\xbf])(?<!\xc2\x85)(?<!\xc2\xa0)(?<!\xe1\x9a\x80)(?<!\xe2\x80[\x80-\x8a\xa8\xa9\xaf])(?<!\xe2\x81\x9f)(?<!\xe3\x80\x80) "
)

ALIGNED = ["ids_a", "ids_b", "sizes_a", "sizes_b"]
# How numbers are packed: ids of up to 65,536 in two bytes, of larger vocabularies in four; sizes in as few as each needs.
Kinds = tuple[str, str, str, str]


def pack_ids(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def packed(values: np.ndarray, offsets: np.ndarray, kind: str) -> pa.Array:
    """A binary array whose rows are runs of numbers of two or four bytes, or of as few bytes as each needs."""
    if kind == "short":
        data, ends = shorten(values, offsets)
    else:
        data, ends = values.astype(kind), offsets * np.dtype(kind).itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of such an array, and where each row begins and the last one ends."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    if kind == "short":
        return lengthen(data, offsets)
    return data.view(kind).astype(np.int64), offsets // np.dtype(kind).itemsize


def shorten(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as groups of seven bits, lowest first; all but a number's last group have the eighth bit set."""
    if values.max(initial=0) < 128:
        return values.astype(np.uint8), offsets
    values = values.astype(np.int64)
    size = 1 + sum((values >> 7 * k > 0).astype(np.int64) for k in range(1, 9))
    ends = from_zero(size)
    nth = ragged(np.zeros(len(size), np.int64), size)
    data = np.repeat(values, size) >> 7 * nth & 127
    data[nth < np.repeat(size, size) - 1] |= 128
    return data.astype(np.uint8), ends[offsets]


def lengthen(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    last = data < 128
    if last.all():
        return data.astype(np.int64), offsets
    ends = np.flatnonzero(last) + 1
    first = np.concatenate([[0], ends[:-1]])
    nth = np.arange(len(data)) - np.repeat(first, ends - first)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * nth, first), from_zero(last)[offsets]


def from_zero(count: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(count)]).astype(np.int64)


def packing(sizes: tuple[int, int]) -> Kinds:
    return *("<u2" if n <= 1 << 16 else "<u4" for n in sizes), "short", "short"


def vocabulary_sizes(paths: tuple[str, str]) -> tuple[int, int]:
    import sentencepiece
    from tokenizers import Tokenizer

    return Tokenizer.from_file(paths[0]).get_vocab_size(), sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size()


# ---------------------------------------------------------------- short documents: one fragment each


def _align_texts(atoms: Atoms, texts: pa.Array, kinds: Kinds) -> list[pa.Array]:
    """ids_a, ids_b, sizes_a, sizes_b, groups_sha256 of texts."""
    flat, count = split(texts)
    names = flat.dictionary_encode()
    code = atoms.look_up(names.dictionary.to_pylist())[names.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
    owner = np.repeat(np.arange(len(count)), count)
    bad = np.zeros(len(count), bool)
    bad[owner[atoms.broken[code]]] = True
    code, count = code[~bad[owner]], np.where(bad, 0, count)
    first = from_zero(count)
    out = [packed(atoms.gather(f, code), from_zero(atoms.count(f, code))[first], kind) for f, kind in zip(VALUES, kinds, strict=True)]
    bounds, codes = first.tolist(), code.tolist()
    groups = (";".join(map(atoms.text.__getitem__, codes[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    return [*out, pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string())]


# ---------------------------------------------------------------- long documents: fragments of byte ranges


@dataclass(frozen=True)
class Fragment:
    """Packed ids of open prefix, closed groups and open suffix; without a closed place all is prefix."""

    whole: bool = True
    cut: bool = False
    head_a: bytes = b""
    head_b: bytes = b""
    ids_a: bytes = b""
    ids_b: bytes = b""
    sizes_a: bytes = b""
    sizes_b: bytes = b""
    tail_a: bytes = b""
    tail_b: bytes = b""


FIELDS = list(Fragment.__dataclass_fields__)
FRAGMENT = StructType()
for _name in FIELDS:
    FRAGMENT = FRAGMENT.add(_name, BooleanType() if _name in ("whole", "cut") else BinaryType())


def compose(parts: list[Fragment]) -> Fragment:
    """The product of neighbouring fragments, from left to right."""
    head_a, head_b, tail_a, tail_b = [], [], [], []
    body: dict[str, list[bytes]] = {k: [] for k in ALIGNED}
    cut = False
    for x in parts:
        if not cut:
            head_a.append(x.head_a)
            head_b.append(x.head_b)
        elif not x.cut:
            tail_a.append(x.head_a)
            tail_b.append(x.head_b)
        else:  # the suffix so far and this prefix are a group
            group_a, group_b = b"".join([*tail_a, x.head_a]), b"".join([*tail_b, x.head_b])
            for k, v in zip(ALIGNED, (group_a, group_b, _number(len(group_a) // 4), _number(len(group_b) // 4)), strict=True):
                body[k].append(v)
        if x.cut:
            for k in ALIGNED:
                body[k].append(getattr(x, k))
            tail_a, tail_b, cut = [x.tail_a], [x.tail_b], True
    joined = {k: b"".join(v) for k, v in body.items()}
    return Fragment(all(x.whole for x in parts), cut, *map(b"".join, (head_a, head_b)), **joined, tail_a=b"".join(tail_a), tail_b=b"".join(tail_b))


def _number(n: int) -> bytes:
    return n.to_bytes(4, "little")


def closed(x: Fragment) -> tuple[bytes, bytes, bytes, bytes]:
    """ids_a, ids_b, sizes_a, sizes_b of a whole document: its start is a closed place, so its prefix is a group."""
    if not x.whole or not x.cut:
        return b"", b"", b"", b""
    head = _number(len(x.head_a) // 4), _number(len(x.head_b) // 4)
    return x.head_a + x.ids_a, x.head_b + x.ids_b, head[0] + x.sizes_a, head[1] + x.sizes_b


def fragment(atoms: Atoms, data: bytes, low: int, high: int) -> Fragment:
    """The fragment of the tokens that end in data[low:high]; ``data`` is a run of whole atoms, each with its blank."""
    names = [x.decode() for x in _split_bytes(data)]
    kinds, at = np.unique(np.array(names, object), return_inverse=True) if names else ([], np.zeros(0, np.int64))
    code = atoms.look_up(list(kinds))[at]
    if atoms.broken[code].any():
        return Fragment(whole=False)
    ids, ends = [], []
    for field, length in (("a", atoms.pair.length_a), ("b", atoms.pair.length_b)):
        own = atoms.gather(field, code)
        end = np.cumsum(length[own])
        mine = (end > low) & (end <= high)
        ids.append(own[mine])
        ends.append(end[mine])
    (a, b), (common, sizes_a, sizes_b) = ids, group_sizes(*ends)
    if not len(common):
        return Fragment(head_a=pack_ids(a), head_b=pack_ids(b))
    m, n, p, q = sizes_a[0], sizes_b[0], sizes_a.sum(), sizes_b.sum()
    return Fragment(
        True, True, pack_ids(a[:m]), pack_ids(b[:n]), pack_ids(a[m:p]), pack_ids(b[n:q]),
        pack_ids(sizes_a[1:]), pack_ids(sizes_b[1:]), pack_ids(a[p:]), pack_ids(b[q:]),
    )


def _split_bytes(data: bytes) -> list[bytes]:
    """Names of the atoms of a run of atoms."""
    return _CUT.split(data[1:]) if data else []


def ranges(data: bytes, chunk: int) -> Iterator[tuple[int, int, int, int]]:
    """low, high, and the atoms' run from a to b around them, for ranges that cover the bytes."""
    size = len(data)
    bounds = [(0, 0, 0)]  # bound, start of the atom over it, start of the next atom
    for at in range(chunk, size, chunk):
        left = max(0, at - chunk)
        before = 0 if left == 0 else None
        for m in _CUT.finditer(data, left, at):
            before = m.start()
        behind = _CUT.search(data, at, min(size, at + chunk))
        after = behind.start() if behind else size if at + chunk >= size else None
        if before is not None and after is not None:
            bounds.append((at, before, after))
    bounds.append((size, size, size))
    for (low, before, _), (high, _, after) in zip(bounds[:-1], bounds[1:], strict=True):
        yield low, high, before, after


KEYS = ["row", "key", "part", "parts"]


def _cut_long(docs: DataFrame, chunk: int) -> DataFrame:
    """row, key, part, parts, low, high, data: a row for each byte range."""
    schema = (
        StructType([*docs.select("row", "key").schema]).add("part", IntegerType()).add("parts", IntegerType())
        .add("low", LongType()).add("high", LongType()).add("data", BinaryType())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = b" " + batch.column(2)[i].as_py().encode()
                cuts = list(ranges(data, chunk))
                for a in range(0, len(cuts), FAN):
                    some = cuts[a : a + FAN]
                    low, high, left, right = (np.array(x, np.int64) for x in zip(*some, strict=True))
                    same = pa.array(np.full(len(some), i))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(same), batch.column(1).take(same), pa.array(np.arange(a, a + len(some), dtype=np.int32)),
                         pa.array(np.full(len(some), len(cuts), np.int32)), pa.array(low - left), pa.array(high - left),
                         pa.array([data[p:q] for p, q in zip(left, right, strict=True)], pa.binary())], schema.names)

    return docs.select("row", "key", "text").mapInArrow(run, schema)


def _align_long(docs: DataFrame, schema: StructType, paths: tuple[str, str], kinds: Kinds, chunk: int) -> DataFrame:
    """The alignment of long documents, by a tree of compositions."""
    parts = _cut_long(docs, chunk).repartition("row", "part")
    state = StructType([*parts.select(*KEYS).schema])
    for f in FRAGMENT:
        state = state.add(f)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        atoms = Atoms(*paths)
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                rows = zip(*(part.column(k).to_pylist() for k in ("low", "high", "data")), strict=True)
                yield _fragment_rows([fragment(atoms, data, low, high) for low, high, data in rows], part)

    def merge(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        joined = compose([Fragment(**{k: r[k] for k in FIELDS}) for r in rows])
        numbers = [pa.array([n], pa.int32()) for n in (rows[0]["part"] // FAN, -(-rows[0]["parts"] // FAN))]
        same = group.slice(0, 1).combine_chunks().to_batches()[0]
        keys = pa.RecordBatch.from_arrays([same.column("row"), same.column("key"), *numbers], KEYS)
        return pa.Table.from_batches([_fragment_rows([joined], keys)])

    tree = settle(parts.mapInArrow(make, state), "fragments")
    most = tree.agg(F.max("parts")).first()[0] or 1
    while most > 1:
        tree = settle(tree.groupBy("row", F.floor(F.col("part") / FAN).alias("above")).applyInArrow(merge, state), "fragments")
        most = -(-most // FAN)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                whole = [closed(Fragment(**{k: r[k] for k in FIELDS})) for r in part.select(FIELDS).to_pylist()]
                digest = []
                for x in whole:
                    groups = ";".join(group_texts(*(np.frombuffer(v, "<u4") for v in x)))
                    digest.append(hashlib.sha256(groups.encode()).hexdigest() if groups else "")
                columns = []
                for k, kind in enumerate(kinds):
                    values = np.frombuffer(b"".join(x[k] for x in whole), "<u4")
                    columns.append(packed(values, from_zero(np.array([len(x[k]) // 4 for x in whole], np.int64)), kind))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("key"), *columns, pa.array(digest, pa.string())], schema.names)

    return tree.select("row", "key", *FIELDS).mapInArrow(finish, schema)


def _fragment_rows(made: list[Fragment], keys: pa.RecordBatch) -> pa.RecordBatch:
    columns = [pa.array([getattr(x, k) for x in made], pa.bool_() if k in ("whole", "cut") else pa.binary()) for k in FIELDS]
    return pa.RecordBatch.from_arrays([*(keys.column(k) for k in KEYS), *columns], [*KEYS, *FIELDS])


def align(docs: DataFrame, key: str, text: str, paths: tuple[str, str] | None = None, chunk: int = CHUNK_BYTES) -> DataFrame:
    """A row per document: row (a number), key, ids_a, ids_b, sizes_a, sizes_b (packed), groups_sha256."""
    small_batches(docs.sparkSession)
    paths = paths or public_paths()
    kinds = packing(vocabulary_sizes(paths))
    schema = StructType().add("row", LongType()).add("key", docs.schema[key].dataType)
    for name in ALIGNED:
        schema = schema.add(name, BinaryType())
    schema = schema.add("groups_sha256", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        atoms = Atoms(*paths)
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *_align_texts(atoms, part.column(2), kinds)], schema.names)

    base = docs.select(F.monotonically_increasing_id().alias("row"), col(key).alias("key"), col(text).alias("text"))
    short = F.coalesce(F.octet_length("text"), F.lit(0)) <= chunk
    pieces = _align_long(base.where(~short), schema, paths, kinds, chunk)
    return settle(base.where(short).mapInArrow(lean(run), schema).unionByName(pieces), "aligned")


# ---------------------------------------------------------------- links


def links(batch: pa.RecordBatch, names: list[str], sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, pair and number of links, for each different pair of a row; a pair is id_a * (ids of B) + id_b."""
    size_b = sizes[1]
    (a, _), (b, _), (m, groups), (n, _) = (unpacked(batch.column(names.index(k)), kind) for k, kind in zip(ALIGNED, packing(sizes), strict=True))
    owner = np.repeat(np.arange(batch.num_rows), np.diff(groups))
    start_a, start_b = np.cumsum(m) - m, np.cumsum(n) - n
    few = m * n <= EXPANDED
    # Each token of A in a group meets the group's tokens of B.
    each = np.repeat(n[few], m[few])
    first = ragged(start_a[few], m[few])
    pair = np.repeat(a[first], each) * size_b + b[ragged(np.repeat(start_b[few], m[few]), each)]
    row, times = np.repeat(np.repeat(owner[few], m[few]), each), np.ones(len(pair), np.int64)
    for g in np.flatnonzero(~few):  # a large group: its different ids meet, with the product of their numbers
        ids_a, count_a = np.unique(a[start_a[g] : start_a[g] + m[g]], return_counts=True)
        ids_b, count_b = np.unique(b[start_b[g] : start_b[g] + n[g]], return_counts=True)
        pair = np.concatenate([pair, (ids_a[:, None] * size_b + ids_b).ravel()])
        row = np.concatenate([row, np.full(len(ids_a) * len(ids_b), owner[g])])
        times = np.concatenate([times, np.outer(count_a, count_b).ravel()])
    order = np.lexsort((pair, row))
    row, pair, times = row[order], pair[order], times[order]
    new = np.ones(len(pair), bool)
    new[1:] = (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(new)
    return row[at], pair[at], np.add.reduceat(times, at) if len(at) else times


def count_pairs(aligned: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """pair, n: in how many rows the pair is linked."""
    schema = StructType().add("pair", LongType()).add("n", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pair, n = (np.concatenate(x) for x in zip(*held, strict=True))
            kinds, at = np.unique(pair, return_inverse=True)
            return kinds, np.bincount(at, n, len(kinds)).astype(np.int64)

        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                held.append(np.unique(links(part, ALIGNED, sizes)[1], return_counts=True))
                size += len(held[-1][0])
                if size > COUNTED:
                    held = [merged()]
                    size = len(held[0][0])
                if size > COUNTED // 2 and len(held) == 1:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], schema.names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], schema.names)

    return aligned.select(*ALIGNED).mapInArrow(lean(run), schema).groupBy("pair").agg(F.sum("n").alias("n"))


Known = tuple[np.ndarray, np.ndarray, np.ndarray]  # each A id's highest count; frequent pairs and their counts


def _known(counts: DataFrame, best: DataFrame, size_a: int, frequent: int) -> tuple[Known, int]:
    """What all tasks get, of a size bounded by the vocabulary and ``frequent``; pairs counted less often are not in it."""
    highest = np.zeros(size_a, np.int64)
    top = best.toArrow()  # at most a row for each id of A
    highest[top.column("a").to_numpy()] = top.column("most").to_numpy()
    doubling = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("pairs"))
    least, total = 1 << 62, 0
    for r in doubling.orderBy(F.desc("level")).collect():  # at most 63 rows
        total += r["pairs"]
        if total > frequent:
            break
        least = 1 << r["level"]
    rows = counts.where(F.col("n") >= least).sort("pair").toArrow()  # at most `frequent` rows
    return (highest, rows.column("pair").to_numpy(), rows.column("n").to_numpy()), least


def score_links(aligned: DataFrame, sizes: tuple[int, int], frequent: int = FREQUENT) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each aligned document."""
    spark = aligned.sparkSession
    size_a, size_b = sizes
    counts = settle(count_pairs(aligned, sizes), "pairs")
    id_a = F.expr(f"pair div {size_b}")
    best = counts.groupBy(id_a.cast("int").alias("a")).agg(F.max("n").alias("most"))
    known, least = _known(counts, best, size_a, frequent)
    sent: Broadcast[Known] = spark.sparkContext.broadcast(known)
    schema = StructType().add("row", LongType()).add("key", aligned.schema["key"].dataType)
    for name in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"):
        schema = schema.add(name, LongType())
    schema = schema.add("groups_sha256", StringType())
    inner = list(schema.names)
    schema = schema.add("rare", ArrayType(LongType())).add("rare_times", ArrayType(LongType()))
    names = ["row", "key", *ALIGNED, "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        highest, known_pair, known_n = sent.value
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                row, pair, times = links(part, names, sizes)
                there, n = np.zeros(len(pair), bool), np.zeros(len(pair), np.int64)
                if len(known_pair):
                    at = np.minimum(np.searchsorted(known_pair, pair), len(known_pair) - 1)
                    there = known_pair[at] == pair
                    n = np.where(there, known_n[at], 0)
                total = lambda x: _exact(row, x, part.num_rows)  # noqa: B023, E731
                is_best = there & (n == highest[pair // size_b])
                length = [np.diff(unpacked(part.column(names.index(k)), kind)[1]) for k, kind in zip(ALIGNED[:3], packing(sizes), strict=False)]
                numbers = [*length, total(times), total(times * is_best), total(times * n)]
                bounds = pa.array(from_zero(np.bincount(row[~there], minlength=part.num_rows)).astype(np.int32))
                rare = [pa.ListArray.from_arrays(bounds, pa.array(x[~there])) for x in (pair, times)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *map(pa.array, numbers), part.column(names.index("groups_sha256")), *rare], schema.names)

    scored = aligned.select(*names).mapInArrow(run, schema)
    if least <= 1:  # no pair is missing from what the tasks got
        return scored.select(*inner[1:])
    scored = settle(scored, "scored")
    few = counts.where(F.col("n") < least).join(F.broadcast(best), id_a == F.col("a"))  # best: a row for each id of A
    few = few.select(F.col("pair").alias("other"), "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    open_ = scored.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("row", "x.*")
    met = open_.join(few.hint("merge"), F.col("rare") == F.col("other"))
    more = met.groupBy(F.col("row").alias("of")).agg(
        F.sum(F.col("rare_times") * F.col("best")).alias("more_best"), F.sum(F.col("rare_times") * F.col("n")).alias("more_sum")
    )
    out = scored.join(more.hint("merge"), F.col("row") == F.col("of"), "left")
    plus = {"n_best": "more_best", "count_sum": "more_sum"}
    return out.select(*((F.col(c) + F.coalesce(plus[c], F.lit(0))).alias(c) if c in plus else F.col(c) for c in inner[1:]))


def _exact(row: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
    """Sums of whole numbers by row; rows are in order."""
    out = np.zeros(rows, np.int64)
    if len(row):
        at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[at]] = np.add.reduceat(x, at)
    return out


def op11(spark: SparkSession, folder: str) -> DataFrame:
    paths = public_paths()
    aligned = align(table(spark, folder, "documents"), "doc_id", "text", paths)
    return score_links(aligned, vocabulary_sizes(paths)).withColumnRenamed("key", "doc_id")
