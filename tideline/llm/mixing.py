"""Mixing sources to target weights, with DataFrame functions only.

Every source gets a budget of words. A document's place within its source is a
hash-random key. The keys of a source are cut into equal ranges, so each range
holds about `range_rows` documents whatever the source's share; sums per range
and a running sum over a source's ranges give each document its prefix without
a global sort. A source is taken as often as its budget holds it whole, then
once more up to the exact word at which the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import native_size, save, scratch

#: A range of keys holds about this many documents.
RANGE_ROWS = 500
WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3


def budgets(per_source: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Targets of each source: (source, source_size) gets target (double) and budget (words, long).

    Sources by code point, null last, weigh `weights`, repeating, and share all
    words. No target goes above `most` times its source; the excess is reshared
    by weight. Sources of which that limit holds first come first: with limits
    L and weights w sorted by L / w, the first k are limited for the smallest k
    at which (total - their limits) / (the others' weights) is no more than the
    next L / w. No words at all: every target is 0. `per_source` has a row per
    source, so its one-task windows see no more rows than there are sources: a
    million of them are some 50 MB.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    limit = (F.col("source_size") * most).cast("double")
    df = per_source.select("source", "source_size", w.alias("w"), limit.alias("lim"))
    ratio = W.orderBy(F.col("lim") / F.col("w"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(W.unboundedPreceding, -1)
    after = ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("lim").over(before), F.lit(0.0))) / F.sum("w").over(after)
    df = df.withColumn("level", level).withColumn("place", F.row_number().over(ratio))
    free = F.col("level") <= F.col("lim") / F.col("w")
    shared = F.min_by("level", F.when(free, F.col("place"))).over(W.partitionBy())
    first = F.min(F.when(free, F.col("lim") / F.col("w"))).over(W.partitionBy())
    target = F.when(F.col("lim") / F.col("w") < F.coalesce(first, F.lit(float("inf"))), F.col("lim")).otherwise(F.least(F.col("lim"), shared * F.col("w")))
    df = df.withColumn("target", F.coalesce(target, F.lit(0.0)))
    return df.select("source", "source_size", "target", F.round("target").cast("long").alias("budget"))


def _places(docs: DataFrame, weights, most: int, seed: str, range_rows: int, whole_rows: bool) -> DataFrame:
    """_row (doc_id, source, or all columns), _size, _source_size, _target, _taken of every row."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))
    row = F.struct(*(docs.columns if whole_rows else ["doc_id"])).alias("_row")
    keyed = docs.select(row, F.col("source").alias("_source"), native_size().alias("_size"), key.alias("_key"))
    sized = save(keyed.select("_row.doc_id", "_source", "_size", "_key").select(F.struct("doc_id").alias("_row"), "_source", "_size", "_key"), "sizes", keep=not whole_rows)
    per_source = save(sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources")
    goal = budgets(per_source, weights, most).join(per_source.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s")))
    goal = save(goal.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("budget").alias("_budget"), F.col("n").alias("_n")), "budgets", keep=True)
    at = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    part = F.floor(at * F.ceil(F.col("_n") / F.lit(range_rows)) / F.lit(float(2**32)))
    # a source's row of `goal` is small; if there are too many sources to broadcast, the join of a hot source is split at run time
    ranged = lambda df: df.join(goal, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_range", part)
    sums = ranged(sized).groupBy("_source", "_range").agg(F.sum("_size").alias("_sum"))
    upto = W.partitionBy("_source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = save(sums.select(F.col("_source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_before")), "ranges", keep=True)
    df = ranged(keyed if whole_rows else sized).join(sums, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    within = W.partitionBy("_source", "_range").orderBy("_key", "_row.doc_id", "_size").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum("_size").over(within), F.lit(0))
    size = F.col("_source_size")
    epochs = F.when(size > 0, F.floor(F.col("_budget") / size)).otherwise(0)
    taken = epochs * F.col("_size") + F.least(F.col("_size"), F.greatest(F.lit(0), F.col("_budget") - epochs * size - before))
    return df.select("_row", "_size", "_source_size", "_target", taken.cast("long").alias("_taken"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = "mix", range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of the mix, repeats counted) for every row of docs.

    docs: doc_id, text, source; other columns are left out. A null text has
    size 0, a null source is a source of its own, the last. Rows that repeat a
    doc_id and text share a key, and with it a range. Empty tables give no rows.
    The keys come from md5 of both, so reruns agree.
    """
    names = {"_size": "size", "_source_size": "source_size", "_target": "target", "_taken": "taken"}
    with scratch(docs.sparkSession):
        placed = _places(docs, weights, most, seed, range_rows, False)
    return placed.select("_row.doc_id", *(F.col(k).alias(v) for k, v in names.items()))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = "mix", range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of docs that the mix takes, as often as it does, with all their columns.

    A row that a budget cuts appears once more with the text up to that word.
    Rows of which no word is taken, such as those without words, are left out.
    """
    with scratch(docs.sparkSession):
        placed = _places(docs, weights, most, seed, range_rows, True).where("_taken > 0")
    copies, rest = F.floor(F.col("_taken") / F.col("_size")).cast("int"), F.col("_taken") % F.col("_size")
    text = F.col("_row.text")
    texts = F.concat(F.array_repeat(text, copies), F.when(rest > 0, F.array(first_words(text, rest))).otherwise(F.expr("cast(array() as array<string>)")))
    return placed.withColumn("_text", F.explode(texts)).select(*(F.col("_text").alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    ends = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(ends, F.lit(1), n.cast("int")), "")
