"""The control plane: rules for collections, streams, expiry, protection and sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import Filter
from ..functions.text import canonical_json
from ..operators.fileindex import INDEX, files_for, index_of
from ..operators.routing import Sink
from ..schema import RECORD_TYPES

#: Names of the engine's own tables.
RESERVED = ("config.collections", "config.sinks", "config.dlq")
RESERVED_PREFIX = "system."
#: Sink types and the fields each must have.
REQUIRED = {"http": ("endpoint",), "eventbridge": ("eventBusName",), "meilisearch": ("host",), "redis": ("url", "stream")}
#: Fields that hold addresses, with the schemes they may have (none: any).
ADDRESSES = {"http": ("endpoint", ()), "meilisearch": ("host", ()), "redis": ("url", ("redis", "rediss", "unix"))}


class Refused(Exception):
    """A rule of the control plane; `code` names it."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def is_reserved(name: Column) -> Column:
    return name.isin(*RESERVED) | F.startswith(name, F.lit(RESERVED_PREFIX))


def reserved(name: str) -> bool:
    return name in RESERVED or name.startswith(RESERVED_PREFIX)


def fingerprint(sink_type: str, spec: dict) -> str:
    """SHA-256 of type and spec with sorted keys: a sink's identity, whatever its filter."""
    return hashlib.sha256(canonical_json({"spec": spec, "type": sink_type}).encode()).hexdigest()


def fingerprint_column(sink_type: Column, spec_json: Column) -> Column:
    """The same of columns; spec_json is canonical JSON."""
    return F.sha2(F.concat(F.lit('{"spec":'), spec_json, F.lit(',"type":'), F.to_json(F.struct(sink_type.alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(sink_type.alias("t")))) - 6), F.lit("}")), 256)


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that a key rule refuses: reason is missing (a key is null) or duplicate, with the number of rows."""
    missing = F.greatest(*(F.col(k).isNull().cast("int") for k in keys)) if len(keys) > 1 else F.col(keys[0]).isNull().cast("int")
    nulls = df.where(missing == 1).agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing").alias("reason"), "n")
    twice = df.where(missing == 0).groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).select(F.lit("duplicate").alias("reason"), "n")
    return nulls.unionByName(twice)


def parse_config(text: str, allowed: set[str], strict: bool = True) -> dict:
    """A JSON object; strict refuses fields that are not known."""
    try:
        config = json.loads(text)
    except ValueError as error:
        raise Refused("INVALID_BODY", "not JSON") from error
    if not isinstance(config, dict):
        raise Refused("INVALID_BODY", "not an object")
    if strict and config.keys() - allowed:
        raise Refused("INVALID_BODY", f"unknown field {sorted(config.keys() - allowed)[0]}")
    return config


def validate_sink(sink_type: str, spec: dict, event_types=()) -> None:
    if sink_type not in REQUIRED:
        raise Refused("INVALID_SINK_TYPE", f"unknown sink type {sink_type}")
    if not spec:
        raise Refused("INVALID_SINK_SPEC", "a sink needs a spec")
    for name in REQUIRED[sink_type]:
        if not spec.get(name):
            raise Refused("INVALID_SINK_SPEC", f"{sink_type} needs {name}")
    if sink_type in ADDRESSES:
        name, schemes = ADDRESSES[sink_type]
        parts = urlsplit(str(spec[name]))
        if not parts.scheme or not (parts.netloc or parts.scheme == "unix") or schemes and parts.scheme not in schemes:
            raise Refused("INVALID_SINK_SPEC", f"{sink_type} {name} is no address")
    for t in event_types:
        if t not in RECORD_TYPES:
            raise Refused("INVALID_EVENT_TYPE", f"unknown event type {t}")


@dataclass(frozen=True)
class Collection:
    name: str
    partition_key: str | None = None
    sort_key: str | None = None
    stream_enabled: bool = False
    old_image: bool = False
    started_at: float | None = None
    ttl_attribute: str | None = None
    protected: bool = True


@dataclass
class Catalog:
    """Collections and sinks. `publish(name)` tells running streams of a change; `purge(name)` drops a deleted collection's state."""

    collections: dict[str, Collection] = field(default_factory=dict)
    sinks: dict[str, Sink] = field(default_factory=dict)
    publish: Callable[[str], None] = lambda name: None
    purge: Callable[[str], None] = lambda name: None
    can_keep_old_images: bool = True

    def get(self, name: str) -> Collection:
        if name not in self.collections:
            raise Refused("COLLECTION_NOT_FOUND", f"no collection {name}")
        return self.collections[name]

    def _put(self, c: Collection) -> Collection:
        self.collections[c.name] = c
        self.publish(c.name)
        return c

    def create(self, name: str, partition_key: str | None = None, sort_key: str | None = None) -> Collection:
        """Protection is on from the start."""
        if not name:
            raise Refused("INVALID_NAME", "a collection needs a name")
        if reserved(name):
            raise Refused("RESERVED_NAME", f"{name} is reserved")
        if name in self.collections:
            raise Refused("COLLECTION_EXISTS", f"{name} exists")
        if sort_key and not partition_key:
            raise Refused("INVALID_KEY", "a sort key needs a partition key")
        if sort_key and sort_key == partition_key:
            raise Refused("INVALID_KEY", "the keys must differ")
        return self._put(Collection(name, partition_key, sort_key))

    def delete(self, name: str, drop: Callable[[str], None] = lambda name: None) -> None:
        """Drops data, sinks, configuration and state, then tells; dead letters and processed keys stay."""
        if self.get(name).protected:
            raise Refused("DELETION_PROTECTED", f"{name} is protected")
        drop(name)
        self.sinks = {i: s for i, s in self.sinks.items() if s.collection != name}
        del self.collections[name]
        self.purge(name)
        self.publish(name)

    def enable_stream(self, name: str, old_image: bool = False, now: float = 0.0) -> Collection:
        c = self.get(name)
        if c.stream_enabled:
            raise Refused("STREAM_ENABLED", "a stream cannot change while it is on")
        if old_image and not self.can_keep_old_images:
            raise Refused("OLD_IMAGE_UNAVAILABLE", "old images cannot be kept here")
        return self._put(replace(c, stream_enabled=True, old_image=old_image, started_at=now))

    def disable_stream(self, name: str) -> Collection:
        if not self.get(name).stream_enabled:
            raise Refused("STREAM_DISABLED", "the stream is off")
        return self._put(replace(self.get(name), stream_enabled=False, old_image=False, started_at=None))

    def enable_ttl(self, name: str, attribute: str) -> Collection:
        if not attribute:
            raise Refused("INVALID_TTL", "expiry needs an attribute")
        if self.get(name).ttl_attribute:
            raise Refused("TTL_ENABLED", "the attribute cannot change")
        return self._put(replace(self.get(name), ttl_attribute=attribute))

    def disable_ttl(self, name: str) -> Collection:
        c = self.get(name)
        return self._put(replace(c, ttl_attribute=None)) if c.ttl_attribute else c

    def protect(self, name: str) -> Collection:
        if self.get(name).protected:
            raise Refused("PROTECTION_ENABLED", f"{name} is protected already")
        return self._put(replace(self.get(name), protected=True))

    def unprotect(self, name: str) -> Collection:
        c = self.get(name)
        return self._put(replace(c, protected=False)) if c.protected else c

    def sinks_of(self, name: str) -> list[Sink]:
        self.get(name)
        return [s for s in self.sinks.values() if s.collection == name]

    def create_sink(self, name: str, sink_id: str, sink_type: str, spec: dict, event_types=(), conditions: dict | None = None) -> Sink:
        c = self.get(name)
        validate_sink(sink_type, spec, event_types)
        if not c.stream_enabled:
            raise Refused("STREAM_DISABLED", "sinks need a stream")
        if any(fingerprint(s.type, s.spec) == fingerprint(sink_type, spec) for s in self.sinks_of(name)):
            raise Refused("SINK_EXISTS", "a sink with this type and spec exists")
        self.sinks[sink_id] = sink = Sink(sink_id, name, sink_type, spec, tuple(event_types), Filter.parse(conditions))
        self.publish(name)
        return sink

    def get_sink(self, name: str, sink_id: str) -> Sink:
        s = self.sinks.get(sink_id)
        if s is None or s.collection != name:
            raise Refused("SINK_NOT_FOUND", f"no sink {sink_id}")
        return s

    def update_sink(self, name: str, sink_id: str, changes: dict) -> Sink:
        """Filter and event types only; type and spec may be given unchanged."""
        s = self.get_sink(name, sink_id)
        if changes.get("type", s.type) != s.type or changes.get("spec", s.spec) != s.spec:
            raise Refused("SINK_IMMUTABLE", "type and spec cannot change")
        if not changes.keys() & {"filter", "eventTypes"}:
            raise Refused("NOTHING_TO_UPDATE", "no filter and no event types")
        types = tuple(changes.get("eventTypes", s.event_types))
        validate_sink(s.type, s.spec, types)
        self.sinks[sink_id] = s = replace(s, event_types=types, filter=Filter.parse(changes["filter"]) if "filter" in changes else s.filter)
        self.publish(name)
        return s

    def delete_sink(self, name: str, sink_id: str) -> None:
        self.get_sink(name, sink_id)
        del self.sinks[sink_id]
        self.publish(name)


def catalog_tables(spark, catalog: Catalog) -> tuple[DataFrame, DataFrame]:
    """Collections and sinks as tables; both are as small as the configuration."""
    from ..schema import COLLECTION, SINK

    c = [(x.name, x.partition_key, x.sort_key, x.stream_enabled, x.old_image, x.ttl_attribute, x.protected) for x in catalog.collections.values()]
    s = [(x.id, x.collection, x.type, canonical_json(x.spec), list(x.event_types), canonical_json(x.filter.config()), fingerprint(x.type, x.spec)) for x in catalog.sinks.values()]
    return spark.createDataFrame(c, COLLECTION), spark.createDataFrame(s, SINK)


# -- rows that arrive


class UniqueKeys:
    """The keys of a collection's rows by part, each file with its range and filter, so that what arrives is held against few of them."""

    def __init__(self, folders, keys: list[str]):
        self.folders, self.keys = folders, keys
        #: Files that the last check has read.
        self.seen: list[str] = []

    def _key(self) -> Column:
        """All key columns as one text; null where one is missing."""
        parts = [F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")) for k in self.keys]
        return F.concat(*parts)

    def violations(self, rows: DataFrame) -> DataFrame:
        """reason, n: rows without a whole key, rows that share one, and rows whose key is stored already."""
        told = rows.select(self._key().alias("key"))
        self.seen = files_for(self.folders.read("keys", INDEX), told, "key")
        n = F.sum("n").cast("long").alias("n")
        found = told.where("key is null").groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing").alias("reason"), "n")
        once = told.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        found = found.unionByName(once.where("n > 1").agg(F.coalesce(n, F.lit(0)).alias("n")).select(F.lit("duplicate").alias("reason"), "n"))
        stored = self.folders.spark.read.schema("key string").parquet(*self.seen) if self.seen else self.folders.spark.createDataFrame([], "key string")
        taken = once.join(stored.distinct(), "key", "left_semi").agg(F.coalesce(n, F.lit(0)).alias("n"))
        return found.unionByName(taken.select(F.lit("stored").alias("reason"), "n"))

    def insert(self, rows: DataFrame, part: str) -> None:
        """Keep the rows' keys as a part, or refuse them all."""
        wrong = [r for r in self.violations(rows).collect() if r["n"]]
        if wrong:
            raise Refused("KEY_VIOLATION", ", ".join(f"{r['n']} {r['reason']}" for r in wrong))
        path = self.folders.path(f"rows/part={part}")
        rows.select(self._key().alias("key")).repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)
        index_of(self.folders.spark.read.schema("key string").parquet(path), "key").coalesce(1).write.parquet(self.folders.path(f"keys/part={part}"))
