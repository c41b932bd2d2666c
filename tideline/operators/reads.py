"""Bounded reads: pages, lookups and counts of managed collections, their sinks and dead letters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

DEFAULT_LIMIT, MOST_LIMIT = 100, 1000


class BadRequest(ValueError):
    code = "BAD_REQUEST"


class NotFound(LookupError):
    code = "NOT_FOUND"


def page_params(limit: str | None = None, skip: str | None = None) -> tuple[int, int]:
    """Limit (100 if not given, 1000 at most) and skip of a page; anything but whole numbers, a limit below 1 or a skip below 0 is refused."""
    try:
        n, s = DEFAULT_LIMIT if not limit else int(limit), 0 if not skip else int(skip)
    except ValueError as error:
        raise BadRequest("limit and skip take whole numbers") from error
    if n <= 0 or s < 0:
        raise BadRequest("limit starts at 1, skip at 0")
    return min(n, MOST_LIMIT), s


def page(df: DataFrame, order: list, limit: int = 0, skip: int = 0) -> DataFrame:
    """Rows in order, `limit` after `skip`; 0 is no limit. Planned as a bounded top-k, not a sort of everything."""
    out = df.orderBy(*order)
    out = out.offset(skip) if skip else out
    return out.limit(limit) if limit else out


def documents(docs: DataFrame, limit: int = 0, skip: int = 0, key: str = "_id") -> DataFrame:
    return page(docs, [F.col(key).asc()], limit, skip)


def has_more(n_rows: int, limit: int) -> bool:
    """Whether to offer a next page: this one is full."""
    return n_rows == limit


def document(docs: DataFrame, doc_id: str, key: str = "_id") -> DataFrame:
    """The document with this id, as text. An id that no key can have gives no row: digits for whole-number keys, else 24 hexadecimal ones."""
    whole = isinstance(docs.schema[key].dataType, IntegralType)
    if not re.fullmatch(r"-?[0-9]{1,18}" if whole else r"[0-9a-fA-F]{24}", doc_id):
        return docs.where(F.lit(False))
    return docs.where(F.col(key) == (F.lit(int(doc_id)) if whole else F.lit(doc_id.lower()))).limit(1)


def collection(collections: DataFrame, name: str) -> DataFrame:
    return collections.where(F.col("collectionName") == name)


def dead_letters(dlq: DataFrame, collections: DataFrame, collection: str, limit: int = 0, skip: int = 0) -> DataFrame:
    """Of a managed collection, latest first; equal times in order of dedupKey, so that pages are stable."""
    own = managed(dlq.where(F.col("collectionName") == collection), collections)
    return page(own, [F.col("failedAt").desc(), F.col("dedupKey").asc()], limit, skip)


def dead_letter(dlq: DataFrame, collection: str, entry_id: str) -> DataFrame:
    return dlq.where((F.col("_id") == entry_id) & (F.col("collectionName") == collection))


def count_dead_letters(dlq: DataFrame, collections: DataFrame) -> DataFrame:
    return managed(dlq, collections).groupBy("collectionName").agg(F.count(F.lit(1)).alias("entries"))


def managed(rows: DataFrame, collections: DataFrame, name: str = "collectionName") -> DataFrame:
    """Rows of collections that are configured."""
    return rows.join(collections.select(F.col("collectionName").alias("_name")), F.col(name) == F.col("_name"), "left_semi")


def stream_enabled(collections: DataFrame) -> DataFrame:
    return collections.where("streamEnabled")


def sinks_of(sinks: DataFrame, collections: DataFrame, name: str) -> DataFrame:
    own = collections.where(F.col("collectionName") == name).select(F.col("collectionName").alias("_name"))
    return sinks.join(own, F.col("collectionId") == F.col("_name"), "left_semi")


def sink(sinks: DataFrame, name: str, sink_id) -> DataFrame:
    """A sink of this collection; an id of another collection's sink gives no row."""
    return sinks.where((F.col("id") == sink_id) & (F.col("collectionId") == name))


def with_sinks(collections: DataFrame, sinks: DataFrame) -> DataFrame:
    """Each collection that has sinks with each of them. Collections are few; the planner broadcasts them by their size."""
    return collections.join(sinks, F.col("collectionName") == F.col("collectionId"))


def one(df: DataFrame, what: str):
    """The one row, or NotFound."""
    rows = df.limit(1).collect()
    if not rows:
        raise NotFound(f"{what} not found")
    return rows[0]
