"""Matches of a pattern with their places, and keys of texts, as column expressions.

Spark returns matched strings without places; the pieces between the matches give them: a match starts
after the lengths of all earlier pieces and matches.  The sums run over chunks of ``CHUNK`` matches, so
that long texts with many matches do not copy long arrays again and again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def _running(sizes: Column) -> Column:
    """Sums of an array up to and without each entry."""
    last = F.size(sizes) - 1
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    add = lambda a, x: a + x
    sums = F.transform(starts, lambda s: F.aggregate(F.slice(sizes, s + 1, F.lit(CHUNK)), F.lit(0).cast("long"), add))
    grow = lambda a, x: F.concat(a, F.array(F.element_at(a, F.lit(-1)) + x))
    before = F.aggregate(sums, F.array(F.lit(0).cast("long")), grow)
    inner = F.transform(
        starts,
        lambda s, i: F.slice(
            F.aggregate(F.slice(sizes, s + 1, F.lit(CHUNK)), F.array(F.get(before, i)), grow),
            F.lit(1), F.least(F.lit(CHUNK), F.size(sizes) - s),
        ),
    )
    return F.flatten(inner)


def matches(text: Column, pattern: str, probe: str, groups: tuple[int, ...] = ()) -> Column:
    """Array of (start, end, g1, ...) of all matches; texts without the probe pattern are not searched."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sizes = F.zip_with(gaps, whole, lambda g, m: (F.length(g) + F.coalesce(F.length(m), F.lit(0))).cast("long"))
    columns = [_running(sizes), gaps, whole, *(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups)]
    zipped = F.arrays_zip(*(c.alias(f"c{i}") for i, c in enumerate(columns)))

    def place(z: Column) -> Column:
        start = z["c0"] + F.length(z["c1"])
        fields = [start.alias("start"), (start + F.length(z["c2"])).alias("end")]
        return F.struct(*fields, *(z[f"c{3 + i}"].alias(f"g{i + 1}") for i in range(len(groups))))

    kinds = "".join(f",g{i + 1}:string" for i in range(len(groups)))
    found = F.transform(F.filter(zipped, lambda z: z["c2"].isNotNull()), place)
    empty = F.array().cast(f"array<struct<start:bigint,end:bigint{kinds}>>")
    return F.when(text.rlike(probe), found.cast(f"array<struct<start:bigint,end:bigint{kinds}>>")).otherwise(empty)


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text: rows with equal texts have equal results."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text, F.length(text)).alias("k2")]

