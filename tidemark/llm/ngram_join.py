"""N-gram Jaccard join with prefix filters under several global token orders.

A document's tokens are the hashes of its distinct word n-grams.  Two sets whose Jaccard similarity is
at least t share a token among the first n - ceil(t * n) + 1 tokens of each, under any order of all
tokens.  Here are three such orders: each is a hash order in which tokens of many documents come last
(the counts that find them are taken over all documents; the order affects cost alone, never results).
Pairs that meet under the first order must also meet under the second and third before their sets are
compared.

* Documents with equal sets are one class; everything below works on classes.
* A token's classes, up to ``PAIRED``, are paired.  Beyond that pairs would grow with the square, so each
  class is paired with the token's leader alone, the class with the fewest rare tokens.
* Of the pairs that pass the filters, each class's most promising one is compared first, for ``ROUNDS``
  rounds; then all pairs that are still between components.  A class that is after that in another
  component than a leader of its is compared with all classes of that leader, in blocks of bounded size
  that return a spanning forest of their links.  Pairs within a component need no comparison, so no link
  between components is lost.
* Components come from alternating stars.

Defined results: a null or blank text has an empty set, which is linked with nothing; with fewer words
than n the whole sequence is one token; rows with the same id are separate documents; rows without an id
join components but never name one; texts of any length are whole sets; an empty table has no rows; a table may
have columns of any further names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from . import wordcodes
from .common import annotate, col, fresh, lean, lookup, release, settle, slices, small_batches, table, union_all
from .components import components
from .spans import text_key

WORDS = 4
PERCENT = 85
FREQUENT = 8  # a token that was counted in so many documents goes last
MOST_FREQUENT = 1 << 19  # of these tokens, the most frequent ones
COUNTED = 2 << 20  # tokens that a task holds to count them
PAIRED = 24
ROUNDS = 3
BLOCK = 256
PARTS = 2  # what is shuffled in so many turns, so that the files of one are gone before the next
_SEEDS = tuple(np.uint64(x) for x in (0x8E51A37F4C2B9D61, 0x3F84D5B5B5470917, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_HIGH = np.uint64(1 << 63)


def token_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    w = wordcodes.split(texts, "blank")
    code, out = w.code, []
    n = len(code)
    gram = np.zeros(n, np.uint64)
    for k in range(words):
        m = max(0, n - k)
        gram[:m] = gram[:m] * np.uint64(0x9E3779B97F4A7C15) + wordcodes.mix(code[k:] + _SEEDS[0])
    gram = wordcodes.mix(gram)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(gram[a : b - words + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for i in range(a, b):
                short = wordcodes.mix(short ^ code[i : i + 1]) * _SEEDS[1]
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(tokens: np.ndarray) -> bytes | None:
    """128 bits of a set; nothing for an empty one."""
    if not len(tokens):
        return None
    sums = [np.add.reduce(wordcodes.mix(tokens ^ s)) + np.uint64(len(tokens)) for s in _SEEDS[:2]]
    return np.array(sums, ">u8").tobytes()


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def frequent_tokens(docs: DataFrame, text: str, words: int, percent: int) -> np.ndarray:
    """Tokens of many documents, sorted.

    Each task counts the first tokens of its documents and reports those it has twice; a token that a
    task has more than once on average is always found.  A bounded number comes to the driver.
    """
    schema = StructType().add("token", LongType()).add("n", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0, np.uint64)]
        size = 0

        def report() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(seen), return_counts=True)
            often = n > 1
            return pa.RecordBatch.from_arrays([_signed(token[often]), pa.array(n[often])], schema.names)

        for batch in batches:
            for part in slices(batch):
                sets = [s[: 2 * prefix_size(len(s), percent)] for s in token_sets(part.column(0), words) if len(s)]
                seen += sets
                size += sum(map(len, sets))
                if size > COUNTED:
                    yield report()
                    seen, size = [np.zeros(0, np.uint64)], 0
        yield report()

    small_batches(docs.sparkSession)
    counts = docs.select(col(text)).mapInArrow(lean(run), schema).groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toArrow()
    return np.sort(top.column("token").to_numpy().view(np.uint64))


def describe(docs: DataFrame, key: str, text: str, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """id, n, class, rare, and prefixes: t1 (first order; its tail of `late` frequent tokens), t2, t3 (32 bits)."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    ints, longs = ArrayType(IntegerType()), ArrayType(LongType())
    added = (
        StructType().add("n", LongType()).add("class", BinaryType()).add("rare", IntegerType()).add("late", IntegerType())
        .add("t1", longs).add("t2", ints).add("t3", ints)
    )

    def make():
        often = sent.value

        def work(columns: list[pa.Array]) -> list[pa.Array]:
            rows = []
            for s in token_sets(columns[0], words):
                at = np.searchsorted(often, s)
                late = (often[np.minimum(at, len(often) - 1)] == s) if len(often) else np.zeros(len(s), bool)
                size = prefix_size(len(s), percent) if len(s) else 0
                orders = []
                for seed in (None, *_SEEDS[2:]):
                    order = (s if seed is None else wordcodes.mix(s ^ seed)) >> np.uint64(1)
                    order = np.where(late, order | _HIGH, order)
                    first = np.argpartition(order, size - 1)[:size] if size < len(s) else np.arange(len(s))
                    orders.append(first)
                one = orders[0][np.argsort(late[orders[0]], kind="stable")]
                rows.append((
                    len(s), fingerprint(s), int(len(s) - late.sum()), int(late[one].sum()), s[one].view(np.int64),
                    *((s[o] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) for o in orders[1:]),
                ))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return [pa.array(c, t) for c, t in zip(columns, types, strict=True)]

        return work

    source = docs.select(col(key).alias("id"), col(text).alias("text"))
    return settle(annotate(source, {"text": F.col("text")}, added, make, ["id"]), "sets")


def meet(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (lead, class) of classes with the same token, whose sizes allow a link; of tokens with more than PAIRED classes (token, class, rare)."""
    schema = StructType().add("token", LongType()).add("lead", BinaryType()).add("class", BinaryType()).add("rare", IntegerType())
    types = [pa.int64(), pa.binary(), pa.binary(), pa.int32()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.names)

    def pairs(classes: set[tuple[int, bytes, int]]) -> list[tuple]:
        order = sorted(classes)
        return [
            (None, a, b, None) for i, (_, a, n) in enumerate(order) for _, b, m in order[i + 1 :]
            if 100 * min(n, m) >= percent * max(n, m)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, here, many = None, set(), False  # the token that may go on in the next batch
        for batch in batches:
            token = batch.column(0).to_numpy()
            if not len(token):
                continue
            edge = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]])
            size = np.diff(edge)
            out: set[tuple] = set()
            # only runs of two and more, and the first and last run, have anything to do
            for r in np.unique(np.concatenate([np.flatnonzero(size > 1), [0, len(size) - 1]])):
                a, n = int(edge[r]), int(size[r])
                if token[a] != last:
                    if len(here) > 1 and not many:
                        out.update(pairs(here))
                    last, here, many = int(token[a]), set(), False
                here.update(zip(*(batch.column(c).slice(a, n).to_pylist() for c in (2, 1, 3)), strict=True))
                if many or len(here) > PAIRED:
                    many = True
                    out.update((last, None, c, x) for x, c, _ in here)
                    here = set()
                if len(out) > 50_000:
                    yield batch_of(list(out))
                    out = set()
            yield batch_of(list(out))
        if len(here) > 1 and not many:
            yield batch_of(pairs(here))

    return postings.repartition("token").sortWithinPartitions("token").mapInArrow(lean(run), schema)


def _similar(inter, a, b, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def compare_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """u, v: a spanning forest of the links of each block's seekers with its others."""
    schema = StructType().add("u", BinaryType()).add("v", BinaryType())

    def run(block: pa.Table) -> pa.Table:
        name, sets = block.column("class").to_pylist(), block.column("tokens").combine_chunks()
        sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
        seeks, part = np.array(block.column("seeks").to_pylist(), bool), block.column("part").to_pylist()
        tokens, at = sets.values.to_numpy(), sets.offsets.to_numpy()
        size = np.diff(at)
        owner = np.repeat(np.arange(len(size)), size)
        known, number, count = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = count[number] > 1
        place = np.cumsum(count > 1) - 1
        owner, number = owner[shared], place[number[shared]]
        s, m = np.flatnonzero(seeks), np.flatnonzero(~seeks)
        inter = np.zeros((len(s), len(m)), np.float32)
        width = 4096
        for a in range(0, int((count > 1).sum()), width):
            here = (number >= a) & (number < a + width)
            x = np.zeros((len(size), width), np.float32)
            x[owner[here], number[here] - a] = 1
            inter += x[s] @ x[m].T
        inter = inter.astype(np.int64)
        hit = _similar(inter, size[s][:, None], size[m][None, :], percent)
        root: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(hit), strict=True):
            x, y = top(part[s[i]]), top(part[m[j]])  # what is one component already needs no link
            if x != y:
                root[x] = y
                out.append((name[s[i]], name[m[j]]))
        return pa.table([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], names=["u", "v"])

    return rows.groupBy("lead", "i", "j").applyInArrow(run, schema)


def _in_turns(part: Callable[[int], DataFrame], label: str) -> DataFrame:
    """The union of parts that are written one after another; shuffle files of one are deleted before the next."""
    written = []
    for turn in range(PARTS):
        written.append(settle(part(turn), label))
        release(session=written[0].sparkSession)
    whole = settle(union_all(written), label)
    release(*written)
    return whole


def links(docs: DataFrame, key: str, text: str, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """u, v: links between classes that connect each component.  ``sets`` is released on the way."""
    # one row per class: of copies that with the smallest id
    copies = sets.where(F.col("class").isNotNull()).groupBy("class").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first")).where("c > 1")
    copies = settle(copies.withColumnRenamed("class", "_class"), "copies")
    one = lookup(sets.where(F.col("class").isNotNull()), copies, F.col("class") == F.col("_class"))
    one = one.where(F.col("c").isNull() | F.col("id").eqNullSafe(F.col("first"))).drop("_class", "c", "first")
    early = F.slice("t1", F.lit(1), F.size("t1") - F.col("late"))
    tail = F.slice("t1", F.size("t1") - F.col("late") + 1, F.col("late"))
    postings = one.select(F.explode(early).alias("token"), "class", "rare", F.col("n").cast("int").alias("n"))
    met = _in_turns(lambda turn: meet(postings.where(F.pmod("token", F.lit(PARTS)) == turn), percent), "met")
    hot = one.where("late > 0").select(F.explode(tail).alias("token"), "class", "rare")
    hot = hot.unionByName(met.where("lead is null").select("token", "class", "rare")).groupBy("token", "class").agg(F.min("rare").alias("rare"))
    hot = settle(hot, "hot")
    leaders = hot.groupBy(F.col("token").alias("_t")).agg(F.min(F.struct("rare", "class")).alias("lead"), F.count(F.lit(1)).alias("c"))
    leaders = settle(leaders.where("c > 1").select("_t", F.col("lead.class").alias("lead")), "leaders")
    stars = lookup(hot, leaders, F.col("token") == F.col("_t"), "inner").where(F.col("class") != F.col("lead"))
    stars = settle(stars.select("lead", "class").distinct(), "stars")
    candidates = settle(met.where("lead is not null").select("lead", "class").unionByName(stars).distinct(), "candidates")
    release(met, hot, leaders)
    wanted = settle(candidates.select(F.explode(F.array("lead", "class")).alias("_class")).distinct(), "classes")
    known = lookup(one.select("class", "id", "n", "t2", "t3"), wanted, F.col("class") == F.col("_class"), "inner")
    known = settle(known.groupBy("class").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("n", "t2", "t3"))), "known")
    release(sets, copies, wanted)

    def both(frame: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
        for side in ("lead", "class"):
            mine = right.select(F.col("class").alias("_class"), *(F.col(c).alias(f"{side}_{c}") for c in columns))
            frame = frame.join(mine.hint("merge"), F.col(side) == F.col("_class")).drop("_class")
        return frame

    # prefixes under the second and third order must meet; how much they do tells how promising a pair is
    near = both(candidates, known, "n", "t2", "t3")
    fits = 100 * F.least("lead_n", "class_n") >= percent * F.greatest("lead_n", "class_n")
    near = near.where(fits & F.arrays_overlap("lead_t2", "class_t2") & F.arrays_overlap("lead_t3", "class_t3"))
    common = (F.size(F.array_intersect("lead_t2", "class_t2")) + F.size(F.array_intersect("lead_t3", "class_t3"))) / F.greatest("lead_n", "class_n")
    near = settle(near.select("lead", "class", common.alias("common")), "near")
    release(candidates)
    # sets are made anew for the classes that are compared; those of a leader may be compared with all others of it
    compared = near.select("lead", "class").unionByName(stars).select(F.explode(F.array("lead", "class")).alias("_class")).distinct()
    compared = settle(compared, "compared")
    made = _sets_of(docs, key, text, lookup(known.select("class", "id"), compared, F.col("class") == F.col("_class"), "inner"), words)
    release(known, compared)

    def verified(pairs: DataFrame) -> DataFrame:
        """u, v: the pairs that are links; only sets that are compared move."""
        pairs = settle(pairs.select("lead", "class", F.pmod(F.xxhash64("lead"), F.lit(PARTS)).alias("turn")), "pairs")
        ids = pairs.select("turn", F.explode(F.array("lead", "class")).alias("_class")).distinct()
        ids = settle(ids, "ids")

        def part(turn: int) -> DataFrame:
            mine = lookup(made, ids.where(F.col("turn") == turn), F.col("class") == F.col("_class"), "inner").drop("_class", "turn")
            inter = F.size(F.array_intersect("lead_tokens", "class_tokens"))
            same = both(pairs.where(F.col("turn") == turn).drop("turn"), mine, "tokens")
            same = same.where(_similar(inter, F.size("lead_tokens"), F.size("class_tokens"), percent))
            return same.select(F.col("lead").alias("u"), F.col("class").alias("v"))

        same = _in_turns(part, "links")
        release(pairs, ids)
        return same

    def apart(found: DataFrame, pairs: DataFrame) -> DataFrame:
        """The pairs with the components of both classes."""
        root = settle(components(found), "roots")
        for side in ("lead", "class"):
            mine = root.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
            pairs = lookup(pairs, mine, F.col(side) == F.col("_node")).withColumn(f"{side}_part", F.coalesce("_root", side)).drop("_node", "_root")
        return settle(pairs, "parts")

    found = None
    left = near
    for _ in range(ROUNDS):
        best = settle(left.groupBy("class").agg(F.max(F.struct("common", "lead"))["lead"].alias("lead")), "best")
        more = verified(best)
        found = more if found is None else settle(found.unionByName(more), "links")
        tried = best.select(F.col("class").alias("_c"), F.col("lead").alias("_l"))
        rest = lookup(left, tried, (F.col("class") == F.col("_c")) & (F.col("lead") == F.col("_l")), "left_anti")
        left = apart(found, rest.select("lead", "class", "common")).where("lead_part <> class_part").select("lead", "class", "common")
    found = settle(found.unionByName(verified(left)), "links")
    group = apart(found, stars)
    open_ = F.col("lead_part") != F.col("class_part")
    count = group.groupBy(F.col("lead").alias("_lead")).agg(F.count(F.lit(1)).alias("all"), F.sum(open_.cast("int")).alias("left"))
    count = settle(count.where("`left` > 0 and `all` > 1"), "counts")
    group = lookup(group, count, F.col("lead") == F.col("_lead"), "inner").withColumnsRenamed({"class": "name", "class_part": "part"})
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    spot = lambda c: F.pmod(F.xxhash64("name"), parts(c)).cast("int")
    numbers = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
    columns = ["lead", "name", "part"]
    seekers = group.where("lead_part <> part").select(*columns, F.lit(True).alias("seeks"), spot("left").alias("i"), numbers("all").alias("j"))
    others = group.select(*columns, F.lit(False).alias("seeks"), spot("all").alias("j"), numbers("left").alias("i"))
    blocks = seekers.unionByName(others).join(made.hint("merge"), F.col("name") == F.col("class"))
    blocks = blocks.select("lead", "i", "j", "class", "part", "seeks", "tokens")
    rest = _in_turns(lambda turn: compare_blocks(blocks.where(F.pmod(F.xxhash64("lead"), F.lit(PARTS)) == turn), percent), "links")
    release(made)
    return found.unionByName(rest)


def _sets_of(docs: DataFrame, key: str, text: str, known: DataFrame, words: int) -> DataFrame:
    """class, tokens: the whole sets of some classes, made anew from their texts."""
    needed = settle(known.select(F.col("class").alias("_class"), F.col("id").alias("_id")), "needed")
    source = docs.select(col(key).alias("id"), col(text).alias("text"))
    texts = lookup(source, needed, F.col("id").eqNullSafe(F.col("_id")), "inner")
    added = StructType().add("class", BinaryType()).add("tokens", ArrayType(LongType()))

    def make():
        def work(columns: list[pa.Array]) -> list[pa.Array]:
            found = token_sets(columns[0], words)
            return [pa.array([fingerprint(s) for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))]

        return work

    made = annotate(texts, {"text": F.col("text")}, added, make, ["_class"]).where(F.col("class") == F.col("_class"))
    made = settle(made.select("class", "tokens"), "tokens")
    return made if not _repeated(made) else settle(made.groupBy("class").agg(F.first("tokens").alias("tokens")), "tokens")


def _repeated(made: DataFrame) -> bool:
    """Whether a class occurs twice, as it does where rows repeat their id."""
    return not made.select("class").groupBy("class").count().where("count > 1").isEmpty()


def join(docs: DataFrame, key: str, text: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id, n (size of the set), component (its smallest id), for each row."""
    docs = docs.select(col(key), col(text))
    frequent = frequent_tokens(docs, text, words, percent)
    described = describe(docs, key, text, frequent, words, percent)
    sets = settle(described.select("id", "n", "class"), "classes")
    found = components(links(docs, key, text, described, words, percent))
    classes = sets.where(F.col("class").isNotNull()).groupBy(F.col("class").alias("_class")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c"))
    roots = found.select("node", "root").unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    roots = settle(roots, "roots")
    classes = lookup(classes, roots, F.col("_class") == F.col("node"))
    named = settle(classes.where("c > 1 or root is not null").select("_class", F.coalesce("root", "_class").alias("root"), "first"), "named")
    smallest = settle(named.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("component")), "smallest")
    named = settle(lookup(named, smallest, F.col("root") == F.col("_root")).select("_class", "component"), "members")
    out = lookup(sets.select("id", "n", "class"), named, F.col("class") == F.col("_class"))
    return out.select("id", "n", F.when(F.col("_class").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def keep_one(docs: DataFrame, key: str, text: str, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component; all columns.

    Rows are told by id and text together, so that rows that share an id are judged one by one: of a component
    the row with the smallest id stays (of equal ids that with the smallest hash of its text), and of its rows
    without an id one stays too.  Rows with the same id and text are one document, and so are rows without an
    id that have the same text, if it has words.
    """
    row, gone = fresh(docs, "_row", "_gone")
    names = ("a", "b")
    code = [c.alias(n) for c, n in zip(text_key(F.coalesce(col(text), F.lit(""))), names, strict=True)]
    # ids before no ids; an order among rows, and the same for copies
    numbered = docs.withColumn(row, F.struct(col(key).isNull().alias("none"), col(key).alias("id"), *code))
    found = settle(join(numbered.select(col(row), col(text)), row, text, words, percent), "components")
    nameless = found.where("id.none and component is not null and n > 0").groupBy("component").agg(F.min("id").alias("_first"))
    nameless = settle(nameless.withColumnRenamed("component", "_component"), "nameless")
    other = found.where("not id.none and id <> component").select("id")
    rest = lookup(found.where("id.none and n > 0"), nameless, F.col("component") == F.col("_component"), "inner")
    other = settle(other.unionByName(rest.where(F.col("id") != F.col("_first")).select("id")).distinct().withColumnRenamed("id", gone), "gone")
    out = lookup(numbered, other, col(row) == col(gone), "left_anti")
    twice = found.where("not id.none or n > 0").groupBy("id").count().where("count > 1").select(F.col("id").alias(gone))
    twice = settle(twice, "twice")
    if twice.isEmpty():
        return out.drop(row)
    again = lookup(out, twice, col(row) == col(gone), "left_semi")
    single = lookup(out, twice, col(row) == col(gone), "left_anti")
    return single.unionByName(again.dropDuplicates([row])).drop(row)


def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = join(table(spark, folder, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
