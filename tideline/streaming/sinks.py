"""Delivery: transports by sink type, run where the records are, returning outcomes.

A transport is built once for each partition and sink from its spec and sends
one record at a time: `send(record)` returns or raises. Clients for Redis,
EventBridge and Meilisearch are handed in, as none comes with Spark.
"""

from __future__ import annotations

import http.client
import json
import queue
import threading
import time
import urllib.parse
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.changes import record_json
from ..operators.routing import Sink
from ..schema import OUTCOME, RECORD_TYPES

#: Seconds of a send, bytes of an answer that are read, bytes of an EventBridge entry.
TIMEOUT, DRAIN, ENTRY_BYTES = 30.0, 4096, 262_144
TASK_WAIT, TASK_POLL = 5.0, 0.05
#: Records that a lane of a task holds, and its workers.
QUEUE, WORKERS = 1024, 4
DETAIL_TYPE, SOURCE = "stream-record", "change-feed"


class Transport(Protocol):
    def send(self, record: dict) -> None: ...


class DeliveryError(Exception):
    pass


def decode_spec(kind: type, spec: dict):
    """A typed spec from an open map: unknown fields are ignored, missing ones an error."""
    names = kind.__dataclass_fields__
    try:
        return kind(**{k: v for k, v in spec.items() if k in names})
    except TypeError as error:
        raise DeliveryError(f"spec: {error}") from error


_own = threading.local()


class _Watched:
    """What a lane knows of one of its workers: the job in hand, and until when its client may take for a call."""

    def __init__(self):
        self.lock, self.job, self.began, self.until, self.dropped = threading.Lock(), None, 0.0, None, False


def limited(call: Callable, *args, **kwargs):
    """The call's result within TIMEOUT seconds. A client that hangs is left to a thread of its own, which ends with the process: in a lane that is its worker, which the lane replaces."""
    watched = getattr(_own, "watched", None)
    if watched is not None:
        watched.until = time.monotonic() + TIMEOUT
        try:
            value = call(*args, **kwargs)
        finally:
            watched.until = None
        if watched.dropped:
            raise DeliveryError(_no_answer())
        return value
    done: queue.SimpleQueue = queue.SimpleQueue()

    def run() -> None:
        try:
            done.put((True, call(*args, **kwargs)))
        except BaseException as error:
            done.put((False, error))

    threading.Thread(target=run, daemon=True).start()
    try:
        ok, value = done.get(timeout=TIMEOUT)
    except queue.Empty:
        raise DeliveryError(_no_answer()) from None
    if not ok:
        raise value
    return value


def _no_answer() -> str:
    return f"no answer within {TIMEOUT:g} s"


@dataclass
class HttpTransport:
    """POST of the record's JSON; redirects are not followed and only 2xx is success. One connection is kept."""

    endpoint: str
    authToken: str | None = None  # noqa: N815
    connection: Any = None

    def send(self, record: dict) -> None:
        url = urllib.parse.urlsplit(self.endpoint)
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.authToken}"} if self.authToken else {})
        path = (url.path or "/") + (f"?{url.query}" if url.query else "")
        try:
            for kept in ([True] if self.connection else []) + [False]:
                if not kept:
                    self.connection = (http.client.HTTPSConnection if url.scheme == "https" else http.client.HTTPConnection)(url.netloc, timeout=TIMEOUT)
                try:
                    self.connection.request("POST", path, json.dumps(record).encode(), headers)
                    answer = self.connection.getresponse()
                    break
                except (http.client.RemoteDisconnected, BrokenPipeError, ConnectionResetError):
                    self.connection.close()
                    if not kept:  # a kept one may have been closed meanwhile; a new one tells
                        raise
            answer.read(DRAIN)
            if not answer.isclosed():  # more than is read: the connection can't serve again
                self.connection.close()
                self.connection = None
        except (OSError, http.client.HTTPException) as error:
            self.connection = None
            raise DeliveryError(str(error) or type(error).__name__) from error
        if not 200 <= answer.status < 300:
            raise DeliveryError(f"status {answer.status}")


@dataclass
class RedisTransport:
    """XADD of the JSON as field `event`; the stream is never trimmed."""

    stream: str
    client: Any = None

    def send(self, record: dict) -> None:
        limited(self.client.xadd, self.stream, {"event": json.dumps(record)})


@dataclass
class EventBridgeTransport:
    """One entry; too large a detail is an error, never cut, and so is a failed entry."""

    eventBusName: str  # noqa: N815
    source: str = SOURCE
    detailType: str = DETAIL_TYPE  # noqa: N815
    client: Any = None

    def send(self, record: dict) -> None:
        detail = json.dumps(record)
        if len(detail.encode()) > ENTRY_BYTES:
            raise DeliveryError("entry is too large")
        answer = limited(self.client.put_events, Entries=[{"EventBusName": self.eventBusName, "Source": self.source, "DetailType": self.detailType, "Detail": detail}])
        if answer.get("FailedEntryCount"):
            raise DeliveryError(f"entry failed: {answer['Entries'][0].get('ErrorMessage', '')}")


@dataclass
class MeilisearchTransport:
    """Upsert of a new image, delete where there is only an old one; waits for the task to succeed."""

    indexName: str  # noqa: N815
    client: Any = None

    def send(self, record: dict) -> None:
        action, document = search_action(record)
        task = limited(self.client.upsert if action == "upsert" else self.client.delete, self.indexName, document)
        until = time.monotonic() + TASK_WAIT
        while (state := limited(self.client.task, task)) not in ("succeeded", "failed", "canceled"):
            if time.monotonic() > until:
                raise DeliveryError("task did not end")
            time.sleep(TASK_POLL)
        if state != "succeeded":
            raise DeliveryError(f"task {state}")


def search_action(record: dict) -> tuple[str, Any]:
    """What becomes of an index: inserts and changes upsert their new image, and delete where there is an old one alone; removals delete. All else is an error, so that no document goes that may be live."""
    kind, new, old = record.get("recordType"), record.get("newImage"), record.get("oldImage")
    if kind not in RECORD_TYPES:
        raise DeliveryError(f"no such record type: {kind}")
    if kind != "REMOVE" and new is not None:
        if not isinstance(new, dict):
            raise DeliveryError("the new image is no object")
        return "upsert", new
    if kind != "REMOVE" and old is None:
        raise DeliveryError("no image to index or to delete by")
    key = record.get("documentId")
    if key in (None, ""):
        raise DeliveryError("no document id to delete by")
    return "delete", key


def entry_too_large() -> Column:
    return F.octet_length(record_json()) > ENTRY_BYTES


class _Unavailable:
    """What an unknown type or a refused spec becomes: a sink that always fails, so nothing is lost silently."""

    def __init__(self, reason: str):
        self.reason = reason

    def send(self, record: dict) -> None:
        raise DeliveryError(self.reason)


_REGISTRY: dict[str, Callable[[Sink], Transport]] = {}


def register_transport(kind: str, build: Callable[[Sink], Transport]) -> None:
    """A later registration of a type replaces the earlier one."""
    _REGISTRY[kind] = build


def registered_types() -> list[str]:
    return sorted(_REGISTRY)


def build_transport(sink: Sink, registry: dict[str, Callable[[Sink], Transport]]) -> Transport:
    if sink.type not in registry:
        return _Unavailable(f"no transport for type {sink.type}")
    try:
        return registry[sink.type](sink)
    except Exception as error:
        return _Unavailable(f"{sink.type}: {error}")


def registered_transport(sink: Sink) -> Transport:
    return build_transport(sink, _REGISTRY)


register_transport("http", lambda s: decode_spec(HttpTransport, s.spec))
register_transport("redis", lambda s: decode_spec(RedisTransport, s.spec))
register_transport("eventbridge", lambda s: decode_spec(EventBridgeTransport, s.spec))
register_transport("meilisearch", lambda s: decode_spec(MeilisearchTransport, {"indexName": s.collection} | s.spec))


class Lane:
    """A sink's queues within a task: WORKERS threads, each with its own transport; records of one document go to one of them, in order. A worker whose client hangs is replaced."""

    def __init__(self, build: Callable[[], Transport], results: queue.SimpleQueue):
        self.build, self.results = build, results
        self.jobs: list[queue.SimpleQueue] = [queue.SimpleQueue() for _ in range(WORKERS)]
        self.room = [threading.Semaphore(QUEUE // WORKERS) for _ in range(WORKERS)]
        self.watched = [_Watched() for _ in range(WORKERS)]
        self.threads = [self._thread(i) for i in range(WORKERS)]
        for t in self.threads:
            t.start()
        threading.Thread(target=self._watch, daemon=True).start()

    def _thread(self, i: int) -> threading.Thread:
        return threading.Thread(target=self._work, args=(self.jobs[i], self.room[i], self.watched[i]), daemon=True)

    def _work(self, jobs: queue.SimpleQueue, room: threading.Semaphore, own: _Watched) -> None:
        transport, _own.watched = None, own
        while (job := jobs.get()) is not None:
            room.release()
            event, sink, text, wait, full = job
            own.job, own.began, error = job, time.monotonic(), None
            try:
                transport = transport or self.build()
                transport.send(json.loads(text))
            except Exception as e:  # one record's failure is an outcome
                error = str(e) or type(e).__name__
            with own.lock:
                if own.dropped:  # the lane has told its outcome
                    return
                self.results.put((event, sink, error is None, error, time.monotonic() - own.began, wait, full))
                own.job = None

    def _watch(self) -> None:
        while any(t.is_alive() for t in self.threads):
            time.sleep(TIMEOUT / 30)
            for i, own in enumerate(self.watched):
                with own.lock:
                    until = own.until
                    if own.job is None or until is None or time.monotonic() < until:
                        continue
                    own.dropped = True
                    event, sink, _, wait, full = own.job
                    self.results.put((event, sink, False, _no_answer(), time.monotonic() - own.began, wait, full))
                    self.watched[i] = _Watched()
                    t = self._thread(i)
                    t.start()
                    self.threads[i] = t  # before the old one can end

    def submit(self, event: str, sink: str, text: str, document: str | None) -> None:
        """Waits while the queue of the document's worker is full."""
        worker = zlib.crc32((document or event or "").encode()) % WORKERS
        began = time.monotonic()
        full = not self.room[worker].acquire(blocking=False)
        if full:
            self.room[worker].acquire()
        self.jobs[worker].put((event, sink, text, time.monotonic() - began, full))

    def close(self) -> None:
        """No more records: what is queued is still sent."""
        for q in self.jobs:
            q.put(None)

    def join(self) -> None:
        for i in range(WORKERS):
            while (t := self.threads[i]).is_alive() or t is not self.threads[i]:
                t.join(TIMEOUT / 30)


def deliver(routed: DataFrame, sinks: list[Sink], text: Column | None = None) -> DataFrame:
    """An outcome for each record and sink: eventId, sinkId, ok, error, seconds of the sending, wait before the sink's queue took it, and whether that was full.

    Sending has effects, so write the result once and read it back. In a task
    each sink has a lane of its own, so a slow sink holds the others only when
    its queue is full. A lane keeps the order of a document's records. text: the
    records' JSON, where it is known already.
    """
    registry, by_id = dict(_REGISTRY), {s.id: s for s in sinks}
    names = ["eventId", "sinkId", "ok", "error", "seconds", "wait", "full"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        results: queue.SimpleQueue = queue.SimpleQueue()
        lanes: dict[str, Lane] = {}

        def gathered() -> pd.DataFrame:
            rows = []
            while not results.empty():
                rows.append(results.get())
            return pd.DataFrame(rows, columns=names)

        try:
            for frame in frames:
                for event, sink, text, document in zip(frame.eventId, frame.sinkId, frame.record, frame.documentId, strict=True):
                    if sink not in lanes:
                        build = (lambda s=by_id[sink]: build_transport(s, registry)) if sink in by_id else (lambda: _Unavailable("no such sink"))
                        lanes[sink] = Lane(build, results)
                    lanes[sink].submit(event, sink, text, document)
                yield gathered()
        finally:  # also where the task ends early: no worker waits for ever
            for lane in lanes.values():
                lane.close()
        for lane in lanes.values():
            lane.join()
        yield gathered()

    return routed.select("eventId", "sinkId", (record_json() if text is None else text).alias("record"), "documentId").mapInPandas(run, OUTCOME)
