"""Documents that expire, swept by the hour in which they fall due.

Records say when documents will expire: a new image's time makes an entry in
expiry/due=<hour>, and an old image's time takes the entry that it made away, by
a mark in cancelled/due=<hour>. A sweep reads the hours that have come and gives
a REMOVE for each entry that is due, once: what it found is written first, then
marked, and a sweep that ended between is completed by the next one. Hours to
come are not read, nor are documents.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stores import Folders

HOUR = 3600
_ENTRY = "documentId string, at timestamp, version string, image string"
_MARK = "documentId string, at timestamp, version string"
_REMOVED = "tableName string, recordType string, oldImage string, timestamp timestamp, eventId string, documentId string, at timestamp, version string"


def _time(image: str, attribute: str) -> Column:
    """A date in an image: a timestamp, or as extended JSON has it. Anything else never expires."""
    x = F.try_variant_get(image, f"$['{attribute}']", "variant")
    kind = F.schema_of_variant(x)
    millis = F.try_variant_get(x, "$['$date']", "long")
    text = F.try_to_timestamp(F.try_variant_get(x, "$['$date']", "string"))
    return F.coalesce(F.when(kind.startswith("TIMESTAMP") | (kind == "DATE"), F.try_variant_get(x, "$", "timestamp")), F.timestamp_millis(millis), text)


class Expiry:
    def __init__(self, folders: Folders, collection: str, attribute: str, bucket: int = HOUR):
        self.folders, self.collection, self.attribute, self.bucket = folders, collection, attribute, bucket
        #: Hours that the last sweep has read.
        self.seen: list[int] = []

    def _put(self, name: str, rows: DataFrame, part: str) -> None:
        for old in self.folders.glob(f"{name}/due=*/part={part}"):
            self.folders.delete(old)
        due = F.floor(F.unix_seconds("at") / self.bucket).cast("long")
        rows.withColumns({"due": due, "part": F.lit(part)}).repartition("due").write.mode("append").partitionBy("due", "part").parquet(self.folders.path(name))

    def apply(self, records: DataFrame, part: str) -> None:
        """Entries and marks of records, whose images hold both times. Event ids order a document's records. A part replaces what it has written before."""
        told = records.select("documentId", "recordType", F.col("eventId").alias("version"), _time("oldImage", self.attribute).alias("was"), _time("newImage", self.attribute).alias("at"), F.to_json("newImage").alias("image"))
        self._put("cancelled", told.where("was is not null").select("documentId", F.col("was").alias("at"), "version"), part)
        self._put("expiry", told.where("at is not null and recordType <> 'REMOVE'").select("documentId", "at", "version", "image"), part)

    def _read(self, name: str, shape: str, hours: list[int]) -> DataFrame:
        paths = [p for p in (self.folders.path(f"{name}/due={h}") for h in hours) if self.folders.exists(f"{name}/{p.rsplit('/', 1)[1]}")]
        return self.folders.spark.read.schema(shape).option("basePath", self.folders.path(name)).parquet(*paths) if paths else self.folders.spark.createDataFrame([], shape)

    def _live(self, hours: list[int]) -> DataFrame:
        """Entries of these hours that no later record has taken away: the last of each document and time."""
        rows = self._read("expiry", _ENTRY, hours).groupBy("documentId", "at").agg(F.max(F.struct("version", "image")).alias("r")).select("documentId", "at", "r.*")
        marks = self._read("cancelled", _MARK, hours).groupBy("documentId", "at").agg(F.max("version").alias("gone"))
        swept = self._read("swept", _MARK, hours).groupBy("documentId", "at").agg(F.max("version").alias("done"))
        left = rows.join(marks, ["documentId", "at"], "left").join(swept, ["documentId", "at"], "left")
        return left.where("(gone is null or version >= gone) and (done is null or version > done)").select("documentId", "at", "version", "image")

    def _complete(self, sweep: str) -> None:
        self._put("swept", self.folders.read(f"removed/part={sweep}", _REMOVED).select("documentId", "at", "version"), sweep)

    def sweep(self, now: dt.datetime) -> DataFrame:
        """REMOVE records of the documents that have expired since the sweeps before, with their last image as text. Past hours of which nothing is left go."""
        name = f"sweep-{int(now.timestamp() * 1_000_000):020d}"
        for path, _ in self.folders.children("removed", "part="):
            part = path.rsplit("part=", 1)[1]
            if not self.folders.exists(f"completed/part={part}"):
                self._finish(part)
        self.seen = sorted(h for h in (int(p.rsplit("due=", 1)[1]) for p, _ in self.folders.children("expiry", "due=")) if h * self.bucket <= now.timestamp())
        at = F.lit(now).cast("timestamp")
        due = self._live(self.seen).where(F.col("at") <= at)
        event = F.concat(F.lit(f"{self.collection}:expired:"), F.col("documentId"), F.lit(":"), F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "yyyyMMddHHmmssSSSSSS"))
        due.select(F.lit(self.collection).alias("tableName"), F.lit("REMOVE").alias("recordType"), F.col("image").alias("oldImage"), at.alias("timestamp"), event.alias("eventId"), "documentId", "at", "version").write.mode("overwrite").parquet(self.folders.path(f"removed/part={name}"))
        self._finish(name)
        for hour in self.seen:
            if (hour + 1) * self.bucket <= now.timestamp():
                self.folders.delete(self.folders.path(f"expiry/due={hour}"))
        return self.folders.read(f"removed/part={name}", _REMOVED).drop("at", "version")

    def _finish(self, sweep: str) -> None:
        self._complete(sweep)
        self.folders.spark.createDataFrame([(sweep,)], "sweep string").write.mode("overwrite").parquet(self.folders.path(f"completed/part={sweep}"))

    def removed(self) -> DataFrame:
        """The REMOVE records of all sweeps."""
        return self.folders.read("removed", _REMOVED).drop("at", "version", "part")
