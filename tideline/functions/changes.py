"""Change events to stream records, and records to and from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import id_text

OPERATIONS = {"insert": "INSERT", "update": "MODIFY", "replace": "MODIFY", "delete": "REMOVE"}
TERMINAL = ("drop", "invalidate")


def event_id(collection: str) -> Column:
    """collection:token; without a token collection:T:I:documentKey of what is there; else empty."""
    token = F.nullif(F.col("_id._data"), F.lit(""))
    time = F.when(F.col("clusterTime").isNotNull(), F.concat(F.col("clusterTime.t").cast("string"), F.lit(":"), F.col("clusterTime.i").cast("string")))
    key = F.when(F.startswith(F.schema_of_variant("documentKey"), F.lit("OBJECT")), F.to_json("documentKey"))
    rest = F.nullif(F.concat_ws(":", time, key), F.lit(""))
    return F.coalesce(F.concat(F.lit(f"{collection}:"), F.coalesce(token, rest)), F.lit(""))


def document_id() -> Column:
    return id_text(F.try_variant_get("documentKey", "$['_id']", "variant"))


def _object(name: str) -> Column:
    return F.when(F.startswith(F.schema_of_variant(name), F.lit("OBJECT")), F.col(name))


def parse_changes(changes: DataFrame, collection: str, clock: Column | None = None, old_image: bool = True) -> DataFrame:
    """Records of all known operations; `clock` is the time of parsing. Other operations give no record, see `quarantined` and `terminal`."""
    op = F.col("operationType")
    kind = F.coalesce(*(F.when(op == k, F.lit(v)) for k, v in OPERATIONS.items()))
    new = F.when(op.isin("insert", "update", "replace"), _object("fullDocument"))
    old = F.when(op.isin("update", "replace", "delete") & F.lit(old_image), _object("fullDocumentBeforeChange"))
    known = changes.where(op.isin(*OPERATIONS))
    return known.select(F.lit(collection).alias("tableName"), kind.alias("recordType"), new.alias("newImage"), old.alias("oldImage"), (F.current_timestamp() if clock is None else clock).alias("timestamp"), event_id(collection).alias("eventId"), document_id().alias("documentId"))


def quarantined(changes: DataFrame, collection: str) -> DataFrame:
    """eventId, reason of events that give no record: unknown or missing operations, and events without identity."""
    op = F.col("operationType")
    reason = F.when(op.isNull(), F.lit("missing operationType")).when(~op.isin(*OPERATIONS, *TERMINAL), F.concat(F.lit("unknown operation type: "), op)).when(event_id(collection) == "", F.lit("no event identity"))
    return changes.select(event_id(collection).alias("eventId"), reason.alias("reason")).where("reason is not null")


def terminal(changes: DataFrame) -> DataFrame:
    """Events after which the collection has no stream."""
    return changes.where(F.col("operationType").isin(*TERMINAL))


def until_terminal(changes: DataFrame) -> tuple[DataFrame, str | None, str | None]:
    """The events up to the first terminal one, by token, its operation, and their highest token; what is behind it belongs to a feed that has ended. Events without a token stay. One pass."""
    token, ends = F.upper("_id._data"), F.col("operationType").isin(*TERMINAL)
    end, first, last = changes.agg(F.min_by("operationType", F.when(ends, F.coalesce(token, F.lit("")))), F.min(F.when(ends, token)), F.max(token)).first()
    if first is None:
        return changes, end, last
    return changes.where(F.coalesce(token <= first, F.lit(True))), end, first


def record_json() -> Column:
    """A record as JSON; absent images and empty ids are left out."""
    stamp = F.date_format(F.to_utc_timestamp("timestamp", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.to_json(F.struct("tableName", "recordType", "newImage", "oldImage", stamp.alias("timestamp"), F.nullif("eventId", F.lit("")).alias("eventId"), F.nullif("documentId", F.lit("")).alias("documentId")))


_RECORD_JSON = "tableName string, recordType string, newImage variant, oldImage variant, timestamp string, eventId string, documentId string, _broken string"


def parse_record(json: Column) -> Column:
    """A record struct of its JSON: null images are absent, a bad timestamp is null, broken JSON or no object gives null. Ids stay."""
    told = F.from_json(json, _RECORD_JSON, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return F.get(F.transform(F.array(told), _record), F.lit(0))  # a lambda's argument is evaluated once, a repeated expression in branches each time


def _record(r: Column) -> Column:
    image = lambda k: F.when(~F.is_variant_null(r[k]), r[k])
    text = lambda k: F.coalesce(r[k], F.lit(""))
    record = F.struct(r["tableName"].alias("tableName"), r["recordType"].alias("recordType"), image("newImage").alias("newImage"), image("oldImage").alias("oldImage"), F.try_to_timestamp(r["timestamp"]).alias("timestamp"), text("eventId").alias("eventId"), text("documentId").alias("documentId"))
    return F.when(r.isNotNull() & r["_broken"].isNull(), record)


# -- columns of a document table


def key_columns(partition_key: str | None, sort_key: str | None) -> list[str]:
    return [k for k in (partition_key, sort_key) if k] or ["_id"]


def display_columns(documents: DataFrame, image: str, partition_key: str | None = None, sort_key: str | None = None) -> list[str]:
    """Key columns, then all top-level keys of the page in order of first appearance. `documents` is one page, bounded by its size."""
    keys = documents.withColumn("_row", F.monotonically_increasing_id()).select("_row", F.posexplode(F.json_object_keys(F.to_json(image))).alias("pos", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct("_row", "pos")).alias("at")).orderBy("at").collect()
    lead = key_columns(partition_key, sort_key)
    return lead + [r["key"] for r in first if r["key"] not in lead]


def key_labels(partition_key: str | None = None, sort_key: str | None = None) -> dict[str, str]:
    return {k: label for k, label in ((partition_key, "PK"), (sort_key, "SK")) if k}
