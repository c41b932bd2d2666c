"""An audit of five filters in every order, by the Walsh-Hadamard transform of their failure masks.

A document's mask has a bit for each filter that it fails. For each part and
label one aggregation takes 32 signed sums over documents, the sum of
(-1)^|mask & w| for each w. They are the transform of the counts of masks, and
the same signs turn them back: 32 times the count of mask m is the sum over w of
(-1)^|m & w| times the sum of w, exactly. Every figure of every order follows
from the 32 counts, so documents are read once whatever the number of orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, save, scratch

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
LABELS = ("all", "good", "toxic")
#: Filter E needs other documents; the others are told from a text alone.
ALONE = FILTERS[:-1]


def failures(text: Column) -> Column:
    """The mask of filters A to D on a whole text, as a Column; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    tests = {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }
    return sum((F.when(tests[f], 1 << i).otherwise(0) for i, f in enumerate(ALONE)), F.lit(0)).cast("int")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of every row of docs.

    A text is known by its SHA-256. The smallest id of each text is found by an
    aggregation, and rows look it up by text and id together: a text that a
    third of all rows share is spread over its ids. A document is good or toxic
    if any of its label rows says so.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), failures(F.col("text")).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("print"))
    rows = save(rows, "masks")
    first = rows.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    says = lambda c: F.max(F.coalesce(F.col(c).cast("int") == 1, F.lit(False))).alias(c)
    named = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality"), says("toxic")).where("doc_id is not null and (quality or toxic)")
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    said = lambda c: F.coalesce(F.col(c), F.lit(False))
    met = rows.join(first, ["print", "doc_id"], "left").join(named, "doc_id", "left")
    return met.select("part", (F.col("mask") + F.when(later, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"), said("quality").alias("good"), said("toxic").alias("toxic"))


def parity_sums(rows: DataFrame) -> DataFrame:
    """part, and for each label an array of MASKS signed sums."""
    weight = {"all": F.lit(1), "good": F.col("good").cast("int"), "toxic": F.col("toxic").cast("int")}
    sign = [1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(w)) % 2) for w in range(MASKS)]
    sums = [F.sum(sign[w] * weight[x]).cast("long").alias(f"{x}_{w}") for x in LABELS for w in range(MASKS)]
    return rows.groupBy("part").agg(*sums).select("part", *(F.array(*(F.col(f"{x}_{w}") for w in range(MASKS))).alias(x) for x in LABELS))


def inverted(sums: str) -> Column:
    """The count of each mask from an array of signed sums."""
    signed = lambda m: F.aggregate(F.transform(sums, lambda s, w: s * (1 - 2 * (F.bit_count(m.bitwiseAND(w)) % 2))), F.lit(0).cast("long"), lambda a, b: a + b)
    return F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: F.shiftright(signed(m), len(FILTERS)))


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, mask of the filters before, bit of the step's own) of every order."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for i, f in enumerate(order):
            own = 1 << FILTERS.index(f)
            out.append(("".join(order), i + 1, before, own))
            before |= own
    return out


def _over(cells: str, test, weight=None) -> Column:
    """The sum of an array of counts over the masks that pass a test."""
    chosen = F.transform(cells, lambda n, m: F.when(test(m), n * weight(m) if weight else n).otherwise(F.lit(0).cast("long")))
    return F.aggregate(chosen, F.lit(0).cast("long"), lambda a, b: a + b)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    600 rows for each language (null is the empty text), none for an empty
    table. Null texts are empty: they fail A, and E from the second on. Equal
    texts without an id are neither first nor later: E doesn't fail them, nor do
    rows that repeat an id and a text. A document with f failures takes 120 / f
    from each of them in the sum over all orders. Columns other than doc_id,
    text, lang and the labels' doc_id, quality, toxic are not read.
    """
    with scratch(docs.sparkSession):
        cells = save(parity_sums(masks(docs, labels)).select("part", *(inverted(x).alias(x) for x in LABELS)), "cells", keep=True)
    every = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("before"), F.lit(own).alias("own")) for o, s, b, own in steps()))
    before, own = F.col("at.before"), F.col("at.own")
    fails = lambda m: m.bitwiseAND(own) != 0
    here = lambda m: fails(m) & (m.bitwiseAND(before) == 0)
    orders = 120
    columns = {
        "kept": _over("all", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0),
        "removed": _over("all", here),
        "redundant": _over("all", lambda m: fails(m) & (m.bitwiseAND(before) != 0)),
        "unique_fails": _over("all", lambda m: m == own),
        "good_lost": _over("good", here),
        "toxic_lost": _over("toxic", here),
        "shapley": _over("all", fails, lambda m: (F.lit(orders) / F.greatest(F.bit_count(m), F.lit(1))).cast("long")),
    }
    rows = cells.withColumn("at", F.explode(every))
    return rows.select("part", "at.filter_order", "at.step", *(c.alias(n) for n, c in columns.items()))
