"""Retries and dead letters as DataFrames; expiry of documents. Where a stream keeps them: streaming/stores.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

#: Seconds: the first retry, the longest wait, and how long a processed event is remembered.
BASE_DELAY, MOST_DELAY, REMEMBER = 1, 300, 24 * 3600
MOST_RETRIES = 5
#: Due events of a collection that one tick takes.
TICK = 10


def backoff(attempt: Column) -> Column:
    """Seconds before the attempt-th retry: 1, 2, 4, ... up to five minutes."""
    return F.least(F.lit(float(MOST_DELAY)), F.lit(float(BASE_DELAY)) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)).cast("double")))


def due(queue: DataFrame, now: Column, limit: int = TICK) -> DataFrame:
    """The earliest due events of each collection, `limit` at most."""
    first = W.partitionBy("collectionName").orderBy("nextRetryAt", "id")
    return queue.where(F.col("nextRetryAt") <= now).withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= limit).drop("_k")


def queue_depth(queue: DataFrame) -> DataFrame:
    return queue.groupBy("collectionName").agg(F.count(F.lit(1)).alias("depth"))


def retry_rows(failed: DataFrame, now: Column, version: Column, most: int = MOST_RETRIES) -> DataFrame:
    """First queue entries of failed events: eventId, tableName, record (JSON), error."""
    return failed.select(F.col("eventId").alias("id"), F.col("tableName").alias("collectionName"), F.col("record").alias("eventData"), F.lit(0).alias("retryCount"), F.lit(most).alias("maxRetries"), (now + F.expr(f"interval {BASE_DELAY} seconds")).alias("nextRetryAt"), F.col("error").alias("lastError"), version.alias("version"), F.lit(False).alias("removed"))


def retry_step(taken: DataFrame, parsed: Column, outcomes: DataFrame) -> DataFrame:
    """What becomes of each taken event: action is dlq (retries are used up), drop (broken JSON), done or requeue, with the new count and delay.

    outcomes: id, ok, error of the deliveries tried.
    """
    joined = taken.withColumn("_parsed", parsed).join(outcomes.select(F.col("id").alias("_id"), "ok", "error"), F.col("id") == F.col("_id"), "left")
    action = F.when(F.col("retryCount") >= F.col("maxRetries"), "dlq").when(~F.col("_parsed"), "drop").when(F.coalesce("ok", F.lit(True)), "done").otherwise("requeue")
    again = F.col("retryCount") + 1
    return joined.select("id", "collectionName", "eventData", "maxRetries", "lastError", "version", action.alias("action"), F.when(action == "requeue", again).otherwise(F.col("retryCount")).alias("retryCount"), F.when(action == "requeue", backoff(again + 0)).alias("delay"), F.when(action == "requeue", F.col("error")).alias("error"))


def absent(dlq: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries whose dedupKey the dead letters lack, one for each key: the first write holds."""
    first = entries.groupBy("dedupKey").agg(F.min_by(F.struct(*entries.columns), F.struct("failedAt", "_id")).alias("_r")).select("_r.*")
    return first.join(dlq.select("dedupKey"), "dedupKey", "left_anti")


def expired(documents: DataFrame, attribute: str, now: Column) -> DataFrame:
    """Documents past the time in their attribute; without a time, or where the attribute is none, they never expire."""
    if not isinstance(documents.schema[attribute].dataType, (DateType, TimestampType, TimestampNTZType)):
        return documents.where(F.lit(False))
    return documents.where(F.col(attribute) <= now)


def removals(documents: DataFrame, collection: str, attribute: str, now: Column, key: str = "_id") -> DataFrame:
    """REMOVE records of expired documents, as the feed would deliver them; an id and its time make the event id, so a second run repeats it."""
    gone = expired(documents, attribute, now)
    doc = F.col(key).cast("string")
    event = F.concat(F.lit(f"{collection}:expired:"), doc, F.lit(":"), F.date_format(F.col(attribute).cast("timestamp"), "yyyyMMddHHmmssSSSSSS"))
    image = F.to_variant_object(F.struct(*documents.columns))
    return gone.select(F.lit(collection).alias("tableName"), F.lit("REMOVE").alias("recordType"), F.lit(None).cast("variant").alias("newImage"), image.alias("oldImage"), now.cast("timestamp").alias("timestamp"), event.alias("eventId"), doc.alias("documentId"))


def in_order(records: DataFrame) -> DataFrame:
    """Records dealt by document and sorted by event within: a task takes a document's events one after the other. The shuffle is the price of order; a document is never split."""
    return records.repartition("documentId").sortWithinPartitions("documentId", "eventId")

