"""License scans by sparse TF-IDF cosine, with inheritance along paths; DataFrame functions alone.

Every line, sentence (over line ends) and paragraph of a text is compared with license templates, which are
short notices and the headers of licenses: terms weigh their count times the logarithm of how few documents
have them (counted over all documents; terms that no template has count as the rarest), and the
cosine is summed by joining the sentence's terms with the
templates' sparse vectors.  Units are left out before that only if they cannot reach ``LEAST``: the terms that a
unit shares with a template must have ``LEAST`` squared of the template's squared weight.  A file whose best cosine reaches ``LEAST`` has that license itself.  Any other
file takes that of the nearest licence file among its directory and the directories above: the
directories are joined with those that hold a licence file, and the deepest wins.

Defined results: null and empty texts have no license of their own; of equal cosines the template first
in alphabetical order is taken; of several licence files in a directory that with the highest cosine, then the
first path; a null path has no directory and inherits nothing; repeated rows get equal results; texts of any
length are read whole; an empty table has no rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh, lookup, settle, table
from .spans import text_key

LEAST = 0.6
SIGNAL = r"(?i)licen[sc]|copyright|copying|spdx|public domain|redistribut|without warranty|free software|\bgpl|creative commons|\bcc[ -](?:by|0)"  # of most notices; excludes nothing
MARGIN = 1e-4  # of sums, and of the rounding of cosines
PARAGRAPH = r"\n[\t\r ]*\n\s*"
SENTENCE = r"\n[\t\r ]*\n\s*|(?<=[.!?;])\s+(?=\S)"
BREAK = r"\n+|(?<=[.!?;])\s+(?=\S)"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
# Common forms of license notices, by SPDX name.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has dedicated all copyright to the public domain."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
LICENCE_FILE = r"(?i)(?:^|/)(?:un)?(?:licen[sc]e|copying|notice)(?:[.-][a-z0-9.-]*)?$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def template_terms(spark: SparkSession) -> DataFrame:
    """template, license, term, tf: a few hundred rows."""
    rows = [(f"{name}#{i}", name, text) for name, texts in TEMPLATES.items() for i, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "template string, license string, text string")
    exploded = frame.select("template", "license", F.explode(terms(F.col("text"))).alias("term"))
    return exploded.groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf"))


def weights(docs: DataFrame, text: Column, vocabulary: DataFrame) -> tuple[DataFrame, float]:
    """term, idf of the templates' terms over all documents, and the idf of a term that no document has."""
    wanted = [r["term"] for r in vocabulary.select("term").distinct().collect()]  # bounded by TEMPLATES
    words = F.split(F.lower(text), r"[^a-z0-9.-]+")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[.-]+|[.-]+$", ""))
    there = F.array_intersect(bare, F.array(*(F.lit(w) for w in sorted(wanted))))
    total = docs.count()
    counts = docs.select(F.explode(there).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(total + 1.0) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    out = vocabulary.select("term").distinct().join(counts, "term", "left").select("term", idf.alias("idf"))
    return settle(out, "idf"), math.log(total + 1.0) + 1



def reach(vectors: DataFrame) -> Callable[[Column], Column]:
    """Whether a unit (or text) may reach ``LEAST``: a quick test of rare terms, then all templates.

    A cosine is at most the root of what the shared terms have of the template's squared weights.
    """
    by: dict[str, list[tuple[float, str]]] = {}
    for r in vectors.collect():  # bounded by TEMPLATES
        by.setdefault(r["template"], []).append((r["tw"] ** 2, r["term"]))
    need = LEAST**2 - MARGIN
    rare, shares = set(), {}
    for number, (_, pairs) in enumerate(sorted(by.items())):
        left = 1.0
        for share, term in sorted(pairs, reverse=True):
            shares.setdefault(term, []).append({"t": number, "w": share})
            if left >= need:  # without these terms the others are not enough
                rare.add(term)
                left -= share
    table_ = F.from_json(F.lit(json.dumps(shares)), "map<string,array<struct<t:int,w:double>>>")
    known, few = (F.array(*(F.lit(t) for t in sorted(x))) for x in (shares, rare))

    def best(words: Column) -> Column:
        pairs = F.array_sort(F.flatten(F.transform(F.array_intersect(words, known), lambda t: F.element_at(table_, t))))
        start = F.struct(F.lit(-1).alias("t"), F.lit(0.0).alias("s"), F.lit(0.0).alias("b"))

        def add(a: Column, p: Column) -> Column:
            total = F.when(p["t"] == a["t"], a["s"] + p["w"]).otherwise(p["w"])
            return F.struct(p["t"].alias("t"), total.alias("s"), F.greatest(a["b"], total).alias("b"))

        return F.aggregate(pairs, start, add)["b"]

    quick = lambda text: F.arrays_overlap(terms(text), few)
    return lambda text: F.when(quick(text), best(terms(text)) >= need).otherwise(F.lit(False))


def units(body: Column) -> Column:
    return F.array_distinct(F.concat(F.split(body, BREAK, -1), F.split(body, SENTENCE, -1), F.split(body, PARAGRAPH, -1)))


def detect(docs: DataFrame, text: Column) -> DataFrame:
    """k1, k2, license, cosine of each different text with a license; the best unit decides."""
    spark = docs.sparkSession
    body = F.coalesce(text, F.lit(""))
    vocabulary = settle(template_terms(spark), "templates")
    idf, rarest = weights(docs, body, vocabulary)
    vectors = vocabulary.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = vectors.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    vectors = settle(vectors.join(norms, "template").select("template", "license", "term", (F.col("w") / F.col("norm")).alias("tw")), "vectors")
    may = reach(vectors)
    # a text has all terms of its units: one that cannot reach it as a whole has no such unit
    signal = docs.where(may(body)).select(*text_key(body), F.filter(units(body), may).alias("s"))
    signal = signal.where(F.size("s") > 0).groupBy("k1", "k2").agg(F.first("s").alias("s"))
    # a sentence is told by its text: each different one is compared once
    places = settle(signal.select("k1", "k2", F.explode("s").alias("sentence")), "sentences")
    lines = places.select(F.xxhash64("sentence").alias("line"), "sentence").groupBy("line").agg(F.first("sentence").alias("sentence"))
    words = lines.select("line", F.explode(terms(F.col("sentence"))).alias("term")).groupBy("line", "term").agg(F.count(F.lit(1)).alias("tf"))
    words = lookup(words, idf.withColumnRenamed("term", "_term"), F.col("term") == F.col("_term"))
    words = settle(words.select("line", "term", (F.col("tf") * F.coalesce("idf", F.lit(rarest))).alias("w")), "terms")
    length = words.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    hit = lookup(words, vectors.withColumnRenamed("term", "_term"), F.col("term") == F.col("_term"), "inner")
    dots = hit.groupBy("line", "template", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(length, "line").select("line", "license", F.round(F.col("dot") / F.col("length"), 6).alias("cosine"))
    scored = scored.where(F.col("cosine") >= LEAST)
    order = F.struct((-F.col("cosine")).alias("c"), F.col("license").alias("l"))
    best = settle(scored.groupBy("line").agg(F.min(order).alias("best")), "lines")
    best = best.withColumnRenamed("line", "_line")
    found = lookup(places, best, F.xxhash64("sentence") == F.col("_line"), "inner")
    return found.groupBy("k1", "k2").agg(F.min("best").alias("b")).select("k1", "k2", F.col("b.l").alias("license"), (-F.col("b.c")).alias("cosine"))


def scan(files: DataFrame, path: Column, text: Column, keep: list[str]) -> DataFrame:
    """Kept columns and: path, own license, cosine, license (own or inherited), inherited_from (a directory)."""
    body = F.coalesce(text, F.lit(""))
    own = settle(detect(files, text), "licenses").withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    names = fresh(files.select(*(col(c) for c in keep)), "path", "own_license", "cosine", "license", "inherited_from")
    key = text_key(body)
    base = files.select(F.struct(*(col(c) for c in keep)).alias("row"), path.alias("_path"), key[0].alias("_a"), key[1].alias("_b"))
    known = lookup(base, own, (F.col("_a") == F.col("_k1")) & (F.col("_b") == F.col("_k2")))
    known = known.select(
        "row", "_path", F.col("license").alias("_own"), F.col("cosine").alias("_cosine"),
        F.regexp_replace("_path", "(?:^|/)[^/]*$", "").alias("_dir"),
    )
    known = settle(known, "files")
    at = F.col("_path")
    held = known.where(F.col("_own").isNotNull() & at.rlike(LICENCE_FILE))
    rank = F.struct((-F.col("_cosine")).alias("c"), at.alias("p"), F.col("_own").alias("l"))
    licensed = held.groupBy(F.col("_dir").alias("_home")).agg(F.min(rank)["l"].alias("_given"))
    directories = known.where(F.col("_dir").isNotNull()).groupBy("_dir").agg(F.count(F.lit(1)).alias("_n"))
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    steps = directories.select("_dir", F.posexplode(F.array_distinct(above)).alias("_depth", "_above"))
    met = steps.join(licensed, F.col("_above") == F.col("_home")).groupBy("_dir")
    nearest = met.agg(F.max(F.struct("_depth", "_above", "_given")).alias("_n"))
    nearest = settle(nearest.select(F.col("_dir").alias("_of"), F.col("_n._above").alias("_from"), F.col("_n._given").alias("_given")), "nearest")
    out = lookup(known, nearest, F.col("_dir") == F.col("_of"))
    mine = F.col("_own").isNotNull()
    return out.select(
        "row.*", at.alias(names[0]), F.col("_own").alias(names[1]), F.col("_cosine").alias(names[2]),
        F.coalesce("_own", "_given").alias(names[3]), F.when(~mine, F.col("_from")).alias(names[4]),
    )


def document_path() -> Column:
    """Documents have no paths: the source is the top directory, hundreds of ids the next; each id that ends
    in 00 is its directory's licence file."""
    name = F.when(F.col("doc_id") % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 10_000), F.floor(F.col("doc_id") / 100), name)


def op8(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"), document_path(), F.col("text"), ["doc_id"])
