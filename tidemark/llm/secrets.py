"""Secret scans with multipart credential linking, by DataFrame functions alone.

Three kinds of secrets are reported wherever they stand: assignments, access identifiers and hex keys.
Weaker parts are reported only where their complement stands within ``SCOPE`` code points:

* ``pair``: a 40-character key, near an access identifier;
* ``endpoint``: a URL or service host, near an access identifier or an assignment;
* ``login``: an assigned user name, near an assignment.

The interval join has no pairs of parts: the strong parts of each text and stretch of ``SCOPE`` are
summed to their first start and last end in each stretch that they cover, and a weak part looks at all stretches that it
covers and one more on either side.  Texts that occur more than once are linked once.

Defined results: a null text is empty; spans of equal start are ordered as the kinds are listed here; texts of any
length are searched whole; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh, lookup, settle, table
from .spans import matches, text_key

SCOPE = 400
KINDS = ("assign", "access", "hex", "pair", "endpoint", "login")
BASE = 3
# Patterns of the kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KEY40 = "(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"(?<![A-Za-z0-9])(?:https?|ftp|jdbc:[a-z]{2,20}|s3|redis|mongodb|postgres(?:ql)?|mysql|amqps?)://[^\s\"'<>]{3,}|(?<![A-Za-z0-9.-])[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.amazonaws\.com"
LOGIN = r"""(?<![A-Za-z0-9])((?i:user(?:_?name)?|login|client_?id|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{2,})"""
# (pattern, what a text must have to be searched)
PATTERNS = {
    "assign": (ASSIGN, "(?i)passw|secret|token|api_?key"),
    "access": (ACCESS, "AKIA"),
    "hex": (HEX, HEX),
    "pair": (KEY40, KEY40),
    "endpoint": (ENDPOINT, r"://|amazonaws\.com"),
    "login": (LOGIN, "(?i)user|login|client_?id|account"),
}
# weak kind: kinds of which one must be near
COMPLEMENT = {"pair": ("access",), "endpoint": ("access", "assign"), "login": ("assign",)}


def _span(number: int) -> Callable[[Column], Column]:
    return lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end"))


def find(text: Column) -> dict[str, Column]:
    """For each kind its spans (start, kind number, end), in order."""
    out = {}
    for number, kind in enumerate(KINDS):
        pattern, probe = PATTERNS[kind]
        found = matches(text, pattern, probe, (2,) if kind == "assign" else ())
        if kind == "assign":
            found = F.filter(found, lambda m: F.length(m["g1"]) >= ASSIGN_LEAST)
        out[kind] = F.transform(found, _span(number))
    return out


def linked(found: DataFrame) -> DataFrame:
    """k1, k2, added: the weak spans of each text that have a complement in scope."""
    weak = [k for k in KINDS if k in COMPLEMENT]
    strong = [k for k in KINDS if k not in COMPLEMENT and any(k in c for c in COMPLEMENT.values())]
    has = lambda ks: sum((F.size(k) for k in ks), F.lit(0)) > 0
    once = found.where(has(weak) & has(strong)).groupBy("k1", "k2").agg(*(F.first(k).alias(k) for k in [*weak, *strong]))
    once = settle(once, "parts")
    bin_ = lambda x: F.floor(x / SCOPE)
    anchors = once.select("k1", "k2", F.explode(F.concat(*strong)).alias("s"))
    places = F.sequence(bin_(F.col("s.start")), bin_(F.col("s.end")))
    anchors = anchors.select("k1", "k2", "s", F.explode(places).alias("bin")).groupBy("k1", "k2", "bin", F.col("s.kind").alias("with"))
    anchors = anchors.agg(F.min("s.start").alias("first"), F.max("s.end").alias("last"))
    parts = once.select("k1", "k2", F.explode(F.concat(*weak)).alias("w"))
    near = F.sequence(bin_(F.col("w.start")) - 1, bin_(F.col("w.end")) + 1)
    parts = parts.select("k1", "k2", "w", F.explode(near).alias("bin"))
    distance = lambda first, last: F.greatest(first - F.col("w.end"), F.col("w.start") - last, F.lit(0))
    fits = F.lit(False)
    for kind, complements in COMPLEMENT.items():
        fits |= (F.col("w.kind") == KINDS.index(kind)) & F.col("with").isin([KINDS.index(c) for c in complements])
    joined = parts.join(anchors, ["k1", "k2", "bin"]).where(fits)
    # parts of the same stretch are in scope; in a neighbouring one its nearest part decides
    inside = (distance(F.col("first"), F.col("first")) <= SCOPE) | (distance(F.col("last"), F.col("last")) <= SCOPE)
    same = F.col("bin").between(bin_(F.col("w.start")), bin_(F.col("w.end")))
    return joined.where(same | inside).groupBy("k1", "k2").agg(F.collect_set("w").alias("added"))


def scan(docs: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """Kept columns and: base (array of spans), spans (base and added ones, in order).

    A kept column of such a name stays, and the new one gets an underscore before its name.
    """
    whole = F.coalesce(text, F.lit(""))
    found = docs.select(F.struct(*(col(c) for c in keep)).alias("row"), *text_key(whole), *(c.alias(k) for k, c in find(whole).items()))
    found = settle(found, "secrets")
    added = settle(linked(found), "linked").withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    out = lookup(found, added, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))
    base = F.array_sort(F.concat("assign", "access", "hex"))
    spans = F.array_sort(F.concat(base, F.coalesce(F.col("added"), F.array().cast(found.schema["pair"].dataType))))
    base_name, spans_name = fresh(docs.select(*(col(c) for c in keep)), "base", "spans")
    return out.select("row.*", base.alias(base_name), spans.alias(spans_name))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(table(spark, folder, "documents"), F.col("text"), ["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(i).alias(f"n_{KINDS[i]}") for i in range(BASE)),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )
