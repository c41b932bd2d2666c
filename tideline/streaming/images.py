"""Whole documents for feeds that deliver changes only: images before and after each event, from state.

A feed may give an update as its changed fields alone. Each document's last
image is kept in a state store, with the token of the event that made it; an
update applies to it and gives both images, a deletion gives the one before.
A document that the state doesn't know stays without, as one that is looked up
too late does. Needs the RocksDB state store (`use_rocksdb`).
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a feed of deltas has beside a change event's columns: JSON of updatedFields, removedFields, truncatedArrays.
DESCRIPTION = "updateDescription"
#: Documents are handled together by a hash of their keys, as each call costs milliseconds; a call holds its share of a batch's events. A query's checkpoint is bound to it.
BUCKETS = 1024
_STATE = "document string, token string"
_OUT = "token string, t long, i int, operationType string, documentKey string, fullDocument string, fullDocumentBeforeChange string"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _parent(node, path: list[str], make: bool):
    """The object or array that holds the last key of a path, or None."""
    for key, after in zip(path[:-1], path[1:], strict=True):
        if isinstance(node, list):
            node = node[int(key)] if key.isdigit() and int(key) < len(node) else None
        elif isinstance(node, dict):
            if key not in node and make:
                node[key] = {}
            node = node.get(key)
        if not isinstance(node, (dict, list)):
            return None
    return node


def _set(document: dict, path: list[str], value) -> None:
    node, key = _parent(document, path, True), path[-1]
    if isinstance(node, dict):
        node[key] = value
    elif isinstance(node, list) and key.isdigit():
        node += [None] * (int(key) + 1 - len(node))
        node[int(key)] = value


def updated(document: str, description: str | None) -> str:
    """A document's JSON after an update: shortened arrays first, then removed fields, then new values. Dots walk into objects, digits into arrays; a path that leads nowhere changes nothing."""
    doc, told = json.loads(document), json.loads(description) if description else {}
    for cut in told.get("truncatedArrays") or []:
        path = cut["field"].split(".")
        node = _parent(doc, path, False)
        array = node.get(path[-1]) if isinstance(node, dict) else node[int(path[-1])] if isinstance(node, list) and path[-1].isdigit() and int(path[-1]) < len(node) else None
        if isinstance(array, list):
            del array[cut["newSize"] :]
    for name in told.get("removedFields") or []:
        path = name.split(".")
        node = _parent(doc, path, False)
        if isinstance(node, dict):
            node.pop(path[-1], None)
    for name, value in (told.get("updatedFields") or {}).items():
        _set(doc, name.split("."), value)
    return json.dumps(doc, ensure_ascii=False, separators=(",", ":"))


class Images(StatefulProcessor):
    """The events of a bucket of documents, each document's in the order of tokens. Events up to the last token that was applied are not applied again; they keep the images that they bring."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("documents", "key string", _STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = [e for frame in rows for e in frame.astype(object).where(frame.notna(), None).itertuples(index=False)]
        events.sort(key=lambda e: (e.key, e.token is not None, e.token or ""))
        out: list[tuple] = []
        for document, own in itertools.groupby(events, key=lambda e: e.key):
            self._document((document,), own, out)
        yield pd.DataFrame(out, columns=["token", "t", "i", "operationType", "documentKey", "fullDocument", "fullDocumentBeforeChange"])

    def _document(self, key: tuple[str], events: Iterator, out: list[tuple]) -> None:
        document, at = self.last.getValue(key) if self.last.containsKey(key) else (None, "")
        known, began = document, at
        for e in events:
            before, after = e.fullDocumentBeforeChange, e.fullDocument
            if e.token is None or e.token > at:
                op = e.operationType
                before = before if before is not None else document if op in ("update", "replace", "delete") else None
                if op == "update" and after is None and before is not None:
                    after = updated(before, e.updateDescription)
                if op in ("insert", "update", "replace"):
                    document = after
                elif op == "delete":
                    document = None
                at = e.token or at
            out.append((e.token, e.t, e.i, e.operationType, e.documentKey, after, before))
        if (document, at) != (known, began):
            if document is None and not at:
                self.last.removeKey(key)
            else:  # also of a deleted document: its last token
                self.last.updateValue(key, (document, at))

    def close(self) -> None:
        pass


def with_images(deltas: DataFrame, ttl_hours: float | None = None) -> DataFrame:
    """Change events (documents as text, with updateDescription) with both images. Streams only.

    An update that brings its document keeps it, and so does the state. Images
    of documents without events for ttl_hours are forgotten. Events without a
    document key have no images and go through by themselves. A batch's events
    of one document meet in one task, and those of a bucket in its memory.
    """
    key = F.coalesce("documentKey", F.concat(F.lit("event:"), F.coalesce("_id._data", F.lit(""))))
    flat = deltas.select(key.alias("key"), F.upper("_id._data").alias("token"), F.col("clusterTime.t").alias("t"), F.col("clusterTime.i").alias("i"), "operationType", "documentKey", "fullDocument", "fullDocumentBeforeChange", DESCRIPTION)
    ttl = int(ttl_hours * 3_600_000) if ttl_hours else None
    dealt = flat.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    done = dealt.groupBy("bucket").transformWithStateInPandas(Images(ttl), _OUT, "append", "ProcessingTime" if ttl else "None")
    when = F.when(F.col("t").isNotNull(), F.struct("t", "i"))
    return done.select(F.struct(F.col("token").alias("_data")).alias("_id"), "operationType", when.alias("clusterTime"), "documentKey", "fullDocument", "fullDocumentBeforeChange")
