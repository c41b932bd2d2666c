"""Connected components, and joins that suit them."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, text_print

#: Most and fewest bits of a bitmap; as rows of 64 bits the largest has 262,144 rows.
MOST_BITS, LEAST_BITS = 1 << 24, 1 << 16


def _bits(small: DataFrame) -> int:
    """Bits for the keys of a written table: 16 to a key, and 2 at least; 0 for more keys than the largest bitmap serves."""
    n = small.count()
    return 0 if 2 * n > MOST_BITS else max(LEAST_BITS, min(MOST_BITS, 1 << (16 * n).bit_length()))


def maybe(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """big with `_maybe`: true for all rows whose key occurs in small, and for few others.

    A bitmap of hashed keys is broadcast; MOST_BITS bounds its rows. Use it
    before an exact join, so that few rows of a wide table are shuffled. Where
    small has too many keys for a bitmap, every row may be one, and the join
    after it is a plain one.
    """
    size = _bits(small)
    if not size:
        return big.withColumn("_maybe", F.lit(True))
    bit = f"pmod(xxhash64({key}), {size}L)"
    bits = small.select(F.expr(f"shiftright({bit}, 6)").alias("_word"), F.expr(f"shiftleft(1L, cast({bit} & 63 as int))").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    hit = F.coalesce(F.expr(f"(shiftright(_bits, cast({bit} & 63 as int)) & 1) = 1"), F.lit(False))
    return big.join(F.broadcast(bits), F.expr(f"shiftright({bit}, 6)") == F.col("_word"), "left").withColumn("_maybe", hit).drop("_word", "_bits")


def maybe_in(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """The rows of big whose key occurs in small, and few others; exactly those where there is no bitmap."""
    if not _bits(small):
        return big.join(small.select(F.col(key).alias("_key")).distinct(), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    return maybe(big, small, key).where("_maybe").drop("_maybe")


def _told(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """docs with _maybe and _print, `rows` renamed, and the condition of a match: all columns of rows, nulls equal."""
    told = maybe(docs.withColumn("_print", text_print()), rows, "doc_id")
    named = rows.select(*(F.col(c).alias(f"_of_{c}") for c in rows.columns))
    tests = (F.col("_print" if c == "text_print" else c).eqNullSafe(F.col(f"_of_{c}")) for c in rows.columns)
    return told, named, reduce(and_, tests)


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows that `rows` (written, no row twice) names by doc_id, text_print and maybe other columns; only what may be among them is shuffled."""
    told, named, same = _told(docs, rows)
    return told.where("not _maybe").unionByName(told.where("_maybe").join(named, same, "left_anti")).select(*docs.columns)


def first_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs with one of the equal rows for each doc_id and text_print in `rows`."""
    told, named, same = _told(docs, rows)
    some = told.where("_maybe").join(named.withColumn("_named", F.lit(True)), same, "left")
    first = some.where("_named").dropDuplicates(["doc_id", "_print"])
    return told.where("not _maybe").select(*docs.columns).unionByName(some.where("_named is null").select(*docs.columns)).unionByName(first.select(*docs.columns))


def components(links: DataFrame) -> DataFrame:
    """node, comp (its component's smallest node) of every node of links (a, b).

    Every round takes the smallest label among neighbours and then the label of
    that label, so the number of rounds grows with the logarithm of a path's
    length. Each round is a written table.
    """
    edges = save(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = save(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        met = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        met = save(met, "met")
        jump = met.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        after = save(met.join(jump, "comp", "left").select("node", "was", F.least(F.col("comp"), F.coalesce("far", "comp")).alias("comp")), "labels")
        labels = after.select("node", "comp")
        if after.where("was <> comp").isEmpty():
            return labels
