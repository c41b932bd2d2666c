"""Folders in which a stream keeps its state: the retry queue by due time, processed keys by hour with filters.

All writes replace what a run of the same part has written before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.fileindex import INDEX, files_for, index_of
from ..operators.state import TICK

#: Seconds of a bucket of the retry queue, and of the time that its removals are remembered after the bucket has gone.
BUCKET, REMEMBERED = 60, 86_400
#: Parts of a filter table at which it is written anew as one.
MANY_PARTS = 64
_TAKEN = "id string, version long"
_KEYS = "eventId string, expiresAt timestamp"


@dataclass
class Folders:
    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def on_disk(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        p, files = self.on_disk(self.path(name))
        return files.exists(p)

    def delete(self, path: str) -> None:
        p, files = self.on_disk(path)
        files.delete(p, True)

    def glob(self, pattern: str) -> list[str]:
        p, files = self.on_disk(self.path(pattern))
        return [x.getPath().toString() for x in files.globStatus(p) or []]

    def children(self, name: str, prefix: str) -> list[tuple[str, float]]:
        """(path, seconds since 1970 of its last change) of the entries of a folder, by name."""
        p, files = self.on_disk(self.path(name))
        found = [(x.getPath().toString(), x.getModificationTime() / 1000) for x in files.listStatus(p) if x.getPath().getName().startswith(prefix)] if files.exists(p) else []
        return sorted(found)

    def read(self, name: str, shape: str) -> DataFrame:
        """A table; empty before its first row."""
        if not self.exists(name):
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(self.path(name))


class RetryQueue:
    """Entries lie in folders by the minute in which they fall due: retry/due=<minute>/part=<writer>. Those taken are named, with their version, in taken/due=<minute>.

    A tick reads the minutes that have come, earliest first, until it has
    enough; entries that are not due are not read, however many they are.
    """

    def __init__(self, folders: Folders, bucket: int = BUCKET):
        self.folders, self.bucket = folders, bucket
        #: Minutes that the last `due` has read.
        self.seen: list[int] = []

    def _bucket(self) -> Column:
        return F.floor(F.unix_seconds("nextRetryAt") / self.bucket).cast("long")

    def put(self, rows: DataFrame, part: str) -> None:
        for old in self.folders.glob(f"retry/due=*/part={part}"):
            self.folders.delete(old)
        rows.withColumns({"due": self._bucket(), "part": F.lit(part)}).write.mode("append").partitionBy("due", "part").parquet(self.folders.path("retry"))

    def _minutes(self) -> list[int]:
        return sorted(int(path.rsplit("due=", 1)[1]) for path, _ in self.folders.children("retry", "due="))

    def live(self, minute: int) -> DataFrame:
        """A minute's entries that were not taken."""
        rows = self.folders.read(f"retry/due={minute}", schema.RETRY).drop("part")
        if not self.folders.exists(f"taken/due={minute}"):
            return rows
        return rows.join(self.folders.read(f"taken/due={minute}", _TAKEN).select("id", "version").distinct(), ["id", "version"], "left_anti").select(*rows.columns)

    def all(self) -> DataFrame:
        """Every entry that was not taken, due or not."""
        rows = self.folders.read("retry", schema.RETRY + ", due long")
        return rows.drop("part").join(self.folders.read("taken", _TAKEN + ", due long").select("id", "version", "due").distinct(), ["id", "version", "due"], "left_anti").select(*(c for c in rows.columns if c not in ("due", "part")))

    def due(self, now: Column, second: float, limit: int = TICK) -> list[tuple]:
        """(minute, row) of the earliest due entries, `limit` at most. Past minutes of which all entries were taken go."""
        out: list[tuple] = []
        self.seen = []
        for minute in self._minutes():
            if minute * self.bucket > second or len(out) >= limit:
                break
            self.seen.append(minute)
            live = self.live(minute)
            rows = live.where(F.col("nextRetryAt") <= now).orderBy("nextRetryAt", "id", "version").limit(limit - len(out)).collect()
            out += [(minute, r) for r in rows]
            if not rows and (minute + 1) * self.bucket < second and live.isEmpty():
                self.folders.delete(self.folders.path(f"retry/due={minute}"))
        return out

    def taken(self, rows: DataFrame, part: str) -> None:
        """rows: due (minute), id, version."""
        for old in self.folders.glob(f"taken/due=*/part={part}"):
            self.folders.delete(old)
        rows.select("due", "id", "version", F.lit(part).alias("part")).write.mode("append").partitionBy("due", "part").parquet(self.folders.path("taken"))

    def forget(self, second: float) -> None:
        """Removals go a day after their minute; until then an entry that a batch writes again stays removed."""
        for path, _ in self.folders.children("taken", "due="):
            minute = int(path.rsplit("due=", 1)[1])
            if (minute + 1) * self.bucket + REMEMBERED < second and not self.folders.exists(f"retry/due={minute}"):
                self.folders.delete(path)


class ProcessedKeys:
    """Keys of delivered events, in processed/hour=<hour of expiry>/part=<batch>, sorted; `keys` has the range and the filter of each file."""

    def __init__(self, folders: Folders):
        self.folders = folders
        #: Files that the last `fresh` has read.
        self.seen: list[str] = []

    def table(self) -> DataFrame:
        return self.folders.read("processed", _KEYS).select("eventId", "expiresAt")

    def index(self) -> DataFrame:
        return self.folders.read("keys", INDEX + ", hour string")

    def put(self, rows: DataFrame, hour: str, part: str, expire_at: Column) -> None:
        """rows: eventId. All of a batch expire together."""
        path = self.folders.path(f"processed/hour={hour}/part={part}")
        if self.folders.exists(f"keys/part={part}"):  # all files that filters name stay as they are
            return
        rows.select("eventId", expire_at.alias("expiresAt")).repartitionByRange("eventId").sortWithinPartitions("eventId").write.mode("overwrite").parquet(path)
        index_of(self.folders.spark.read.schema(_KEYS).parquet(path), "eventId").withColumn("hour", F.lit(hour)).coalesce(1).write.mode("overwrite").parquet(self.folders.path(f"keys/part={part}"))

    def fresh(self, records: DataFrame, now: Column) -> DataFrame:
        """Records once each, without those whose key is live; only files that may hold one of their keys are read."""
        records = records.dropDuplicates(["eventId"])
        if not self.folders.exists("keys"):
            self.seen = []
            return records
        hour = F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyy-MM-dd-HH")
        self.seen = files_for(self.index().where(F.col("hour") >= hour), records, "eventId")
        if not self.seen:
            return records
        low, high = records.agg(F.min("eventId"), F.max("eventId")).first()
        keys = self.folders.spark.read.schema(_KEYS).parquet(*self.seen).where((F.col("expiresAt") > now) & F.col("eventId").between(low, high))
        return records.join(keys.select("eventId"), "eventId", "left_anti")

    def compact(self, hour: str, name: str) -> None:
        """What expired before this hour goes; many parts of the filters become one, written before the old ones go."""
        for path, _ in self.folders.children("processed", "hour="):
            if path.rsplit("hour=", 1)[1] < hour:
                self.folders.delete(path)
        old = self.folders.children("keys", "part=")
        if len(old) > MANY_PARTS:
            self.index().where(F.col("hour") >= hour).drop("part").distinct().coalesce(1).write.mode("overwrite").parquet(self.folders.path(f"keys/part={name}"))
            for path, _ in old:
                self.folders.delete(path)
