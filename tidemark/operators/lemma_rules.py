"""Lemmas of forms that no table has: endings and their edits, learned from the forms that one has.

An edit takes so many letters off the end of a form and puts others on.  For each ending of up to ``LONGEST``
letters the most frequent edit of the table's forms is kept if enough forms agree on it; endings that say the
same as the next shorter kept one are left out.  A form takes the edit of its longest ending: a decision
list, looked up in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lookup import fits_broadcast
from ..functions.storage import settle

LONGEST = 5
LEAST_FORMS = 3
LEAST_SHARE = 0.6
LEAST_STEM = 2  # letters of a form before its ending


def edits(lemmas: DataFrame) -> DataFrame:
    """form, off, put: how many letters come off the end of each form, and what is put on."""
    both = lemmas.where("form is not null and lemma is not null").select("form", "lemma")
    one = both.groupBy("form").agg(F.min("lemma").alias("lemma"))
    places = F.sequence(F.lit(1), F.greatest(F.least(F.length("form"), F.length("lemma")), F.lit(1)))
    same = one.withColumn("same", F.size(F.filter(places, lambda i: F.left("form", i) == F.left("lemma", i))))
    return same.select("form", (F.length("form") - F.col("same")).alias("off"), F.expr("substr(lemma, same + 1)").alias("put"))


def learn_lemma_rules(lemmas: DataFrame, least_forms: int = LEAST_FORMS, least_share: float = LEAST_SHARE) -> DataFrame:
    """ending, off, put, forms, share: the kept endings of a table (form, lemma); ties go to the smaller edit."""
    known = edits(lemmas)
    longest = F.least(F.length("form") - LEAST_STEM, F.lit(LONGEST))
    ends = known.where(longest >= 1).select("off", "put", "form", F.explode(F.sequence(F.lit(1), longest)).alias("size")).where("size >= off")
    counted = ends.groupBy(F.expr("right(form, size)").alias("ending"), "off", "put").agg(F.count("*").alias("forms"))
    total = Window.partitionBy("ending")
    order = total.orderBy(F.desc("forms"), "off", "put")
    best = counted.withColumns({"all": F.sum("forms").over(total), "nth": F.row_number().over(order)}).where("nth = 1")
    best = best.withColumn("share", F.col("forms") / F.col("all"))
    good = best.where((F.col("forms") >= least_forms) & (F.col("share") >= least_share)).select("ending", "off", "put", "forms", "share")
    good = settle(good, "rules")
    # the next shorter kept ending, which decides where this one is left out
    shorter = good.select(F.col("ending").alias("e"), F.col("off").alias("o"), F.col("put").alias("p"))
    tails = good.withColumn("tail", F.explode(F.expr("transform(sequence(0, length(ending) - 1), k -> right(ending, k))")))
    met = tails.join(shorter, F.col("tail") == F.col("e")).groupBy("ending").agg(F.max_by(F.struct("o", "p"), F.length("e")).alias("next"))
    kept = good.join(met.withColumnRenamed("ending", "__of"), F.col("ending") == F.col("__of"), "left")
    says_more = F.col("next").isNull() | (F.col("next.o") != F.col("off")) | (F.col("next.p") != F.col("put"))
    nothing = F.col("next").isNull() & (F.col("off") == 0) & (F.col("put") == "")
    return kept.where(says_more & ~nothing).select("ending", "off", "put", "forms", "share")


def apply_lemma_rules(word: Column, rules: DataFrame) -> Column:
    """The word with the edit of its longest known ending; other words stay.  The rules are few and become literals."""
    rules = settle(rules, "rules")
    if not fits_broadcast(rules):
        raise ValueError("too many rules for a decision list; ask for more forms behind each")
    by_size: dict[int, list] = {}
    for r in rules.collect():
        by_size.setdefault(len(r["ending"]), []).append(r)
    tried = []
    for size in sorted(by_size, reverse=True):
        cells = [x for r in by_size[size] for x in (F.lit(r["ending"]), F.struct(F.lit(r["off"]).alias("off"), F.lit(r["put"]).alias("put")))]
        tried.append(F.when(F.length(word) >= size + LEAST_STEM, F.create_map(*cells)[F.right(word, F.lit(size))]))
    if not tried:
        return word
    return F.transform(
        F.array(F.struct(word.alias("w"), F.coalesce(*tried).alias("r"))),
        lambda s: F.when(s["r"].isNull(), s["w"]).otherwise(F.concat(F.left(s["w"], F.length(s["w"]) - s["r"]["off"]), s["r"]["put"])),
    )[0]
