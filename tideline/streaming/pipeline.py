"""The event path as a stream: parse, skip what is processed, route, deliver, settle; retries and dead letters.

A micro-batch commits its offsets after `process_batch` returns, that is after
every record is delivered or durably queued. A crash before that delivers again
and loses nothing. Tables are kept in parts, one for each batch or retry tick; a
batch that runs again replaces its part and has the time of its first run, so
nothing counts twice, and what a tick has taken meanwhile stays taken. Batches and
retry ticks of a collection run in one driver loop, so each table has one writer;
parts of outcomes and the like that `compact` drops are older than any reader.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from .. import schema
from ..functions.changes import parse_changes, parse_record, quarantined, record_json, until_terminal
from ..operators.metrics import Delivered, delivery_sums
from ..operators.routing import Sink, Sinks, failures, route, settle
from ..operators.state import MOST_RETRIES, REMEMBER, absent, in_order, retry_rows, retry_step
from ..sources.feed import from_start, start_position, token_is_useless
from ..sources.token_feed import stream_feed
from .sinks import deliver
from .stores import MANY_PARTS, Folders, ProcessedKeys, RetryQueue

#: Days that outcomes and the like are kept, and marks of batches, of which only the last one can run again.
KEEP_DAYS, KEEP_MARKS = 30, 1
TABLES = {"dlq": schema.DLQ, "outcomes": schema.OUTCOME, "quarantine": "eventId string, reason string", "settled": "eventId string, recordType string, state string, error string", "terminal": "operationType string"}
_BEGUN, _DONE = "version long", "token string"
_STEP = "id string, collectionName string, eventData string, maxRetries int, lastError string, version long, action string, retryCount int, delay double, error string, due long"


class Unsettled(Exception):
    """A batch that was neither delivered nor queued: it runs again from the last settled position."""


class StreamEnded(Exception):
    """The collection was dropped, or its feed is invalid: there is nothing to follow any more."""


@dataclass
class Pipeline:
    """One collection's path. `root` is a shared folder; `clock` gives the present as a UTC datetime.

    The first start is after `resume_token`, else at `started_at` (seconds since
    1970), when the stream was enabled, else now; later ones go on at the query's
    own checkpoint.
    """

    spark: SparkSession
    collection: str
    root: str
    load_sinks: Callable[[], list[Sink]]
    clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC)
    old_image: bool = True
    resume_token: str | None = None
    started_at: float | None = None
    sinks: Sinks = field(init=False)

    def __post_init__(self):
        self.sinks = Sinks(self.load_sinks)
        self.folders = Folders(self.spark, f"{self.root}/{self.collection}")
        self.queue, self.keys = RetryQueue(self.folders), ProcessedKeys(self.folders)
        self._ended: bool | None = None
        #: Deliveries of this process, by sink type.
        self.delivered = Delivered()

    # -- tables

    def _path(self, name: str) -> str:
        return self.folders.path(name)

    def table(self, name: str) -> DataFrame:
        """A state table; empty before its first row. Of the retry queue what is in it, of processed keys those that were not dropped."""
        if name == "retry":
            return self.queue.all()
        if name == "processed":
            return self.keys.table()
        return self.folders.read(name, TABLES[name]).drop("part")

    def _put(self, name: str, rows: DataFrame, part: str, until: dt.datetime | None = None) -> None:
        """Rows as this part of a table, in place of what a run before has written. Processed keys last until a time."""
        if name == "retry":
            self.queue.put(rows, part)
        elif name == "processed":
            self.keys.put(rows, f"{until:%Y-%m-%d-%H}", part, F.lit(until).cast("timestamp"))
        else:
            rows.write.mode("overwrite").parquet(f"{self._path(name)}/part={part}")

    def _delete(self, path: str) -> None:
        self.folders.delete(path)

    def parts(self, name: str) -> list[tuple[str, float]]:
        """(path, seconds since 1970 of its last change) of a table's parts."""
        return self.folders.children(name, "part=")

    def _batch(self, batch_id: int) -> str:
        """A batch's part: by the query's checkpoint too, as a new one counts from 0 again."""
        return f"{self.spark.sparkContext.getLocalProperty('sql.streaming.queryId') or 'direct'}-{batch_id}"

    def _begin(self, part: str) -> dt.datetime:
        """The time of a batch's first run."""
        if not self.folders.exists(f"begun/part={part}"):
            self._put("begun", self.spark.createDataFrame([(self._version(),)], _BEGUN), part)
        version = self.folders.read(f"begun/part={part}", _BEGUN).first()[0]
        return dt.datetime.fromtimestamp(0, dt.UTC) + dt.timedelta(microseconds=version)

    def _done(self, part: str) -> bool:
        """Whether a batch has been settled: its keys' filters are there, or, as these may have been merged since, its mark."""
        return self.folders.exists(f"done/part={part}") or self.folders.exists(f"keys/part={part}")

    def position(self) -> str | None:
        """The highest token of all settled batches."""
        return self.folders.read("done", _DONE).agg(F.max("token")).first()[0]

    def compact(self) -> None:
        """Expired keys, removals of retries a day old, and parts of outcomes of KEEP_DAYS go; many parts of filters and marks become one."""
        now = self.clock()
        self.keys.compact(f"{now:%Y-%m-%d-%H}", f"merged-{self._version()}")
        self.queue.forget(now.timestamp())
        for name, days in {"outcomes": KEEP_DAYS, "settled": KEEP_DAYS, "quarantine": KEEP_DAYS, "begun": KEEP_MARKS, "done": KEEP_MARKS}.items():
            for path, at in sorted(self.parts(name), key=lambda x: x[1])[: -1 if name in ("begun", "done") else None]:
                if at < time.time() - days * 86_400:
                    self._delete(path)

    # -- the end of a feed

    def ended(self) -> bool:
        if self._ended is None:
            self._ended = not self.table("terminal").isEmpty()
        return self._ended

    def reopen(self) -> None:
        """After the collection was made anew."""
        self._delete(self._path("terminal"))
        self._ended = False

    def _version(self) -> int:
        return int(self.clock().timestamp() * 1_000_000)

    # -- first delivery

    def process_batch(self, changes: DataFrame, batch_id: int) -> None:
        """Deliver and settle one micro-batch, whose source is read once. Within it a document's events keep their order.

        A batch whose mark is there has all its parts, so one that was done but
        not committed is passed over, also if it delivered nothing.

        Events behind a terminal one, in the order of tokens, are left. The batch
        of a terminal event is settled like others; the next one ends the query.
        """
        if self.ended():
            raise StreamEnded(self.collection)
        part = self._batch(batch_id)
        if self._done(part):
            return
        changes = changes.persist()
        work = f"{self._path('work')}/{batch_id}-{uuid.uuid4().hex}"
        try:
            self._process(changes, part, work, self._begin(part))
        finally:
            changes.unpersist()
            self._delete(work)

    def _process(self, changes: DataFrame, part: str, work: str, began: dt.datetime) -> None:
        active, now = self.sinks.refresh(), F.lit(began).cast("timestamp")
        changes, end, token = until_terminal(changes)
        self._put("quarantine", quarantined(changes, self.collection), part)
        records = parse_changes(changes, self.collection, now, self.old_image).where("eventId <> ''")
        fresh = in_order(self.keys.fresh(records, F.lit(self.clock()).cast("timestamp")))
        fresh.withColumn("record", record_json()).select("eventId", "tableName", "recordType", "record").write.parquet(f"{work}/records")
        fresh = self.spark.read.parquet(f"{work}/records")
        images = fresh.select("record", parse_record(F.col("record")).alias("r")).select("r.*", "record")
        self._deliver(images, active, f"{work}/outcomes", F.col("record"))
        outcomes = self.spark.read.schema(schema.OUTCOME).parquet(f"{work}/outcomes")
        failures(outcomes).write.parquet(f"{work}/failed")  # a table of its own, so that the planner knows its size: few are broadcast
        failed = self.spark.read.schema("eventId string, error string").parquet(f"{work}/failed")
        try:
            self._put("retry", retry_rows(fresh.join(failed, "eventId").select("eventId", "tableName", "record", "error"), now, F.lit(round(began.timestamp() * 1_000_000))), part)
        except Exception as error:
            raise Unsettled(str(error)) from error
        queued = failed.withColumn("_q", F.lit(True))
        state = F.when(F.col("_q"), "queued").otherwise("delivered")  # all that failed are in the queue now
        self._put("settled", fresh.join(queued, "eventId", "left").select("eventId", "recordType", state.alias("state"), "error"), part)
        self._put("outcomes", outcomes, part)
        if end:
            self._put("terminal", self.spark.createDataFrame([(end,)], TABLES["terminal"]), part)
        self._put("processed", fresh.join(failed, "eventId", "left_anti"), part, began + dt.timedelta(seconds=REMEMBER))
        self._put("done", self.spark.range(0, 1, 1, 1).select(F.lit(token).cast("string").alias("token")), part)
        self._ended = self._ended or bool(end)

    def _deliver(self, images: DataFrame, active: list[Sink], path: str, text: Column | None = None) -> None:
        """Send once, write the outcomes, and count them on the way."""
        outcomes, types = deliver(route(images, active), active, text), {}
        for s in active:
            types.setdefault(s.type, []).append(s.id)
        seen = Observation()
        if types:
            outcomes = outcomes.observe(seen, *delivery_sums(types))
        outcomes.write.parquet(path)
        if types:
            self.delivered.add(seen.get)

    # -- retries

    def retry_tick(self) -> dict[str, int]:
        """One round over due events. What is to become of them is written first, as one table; a tick that ended there is carried out by the next one, so a crash loses and repeats nothing that was decided."""
        if len(self.parts("keys")) > MANY_PARTS:
            self.compact()
        for path, _ in self.parts("ticks"):
            self._carry_out(path.rsplit("part=", 1)[1])
        at = self.clock()
        active, now, version = self.sinks.refresh(), F.lit(at).cast("timestamp"), self._version()
        taken = self.queue.due(now, at.timestamp())
        if not taken:
            return {}
        work = f"{self._path('work')}/retry-{uuid.uuid4().hex}"
        try:
            return self._retry(taken, active, version, work)
        finally:
            self._delete(work)

    def _retry(self, taken: list[tuple], active: list[Sink], version: int, work: str) -> dict[str, int]:
        """taken: TICK rows at most."""
        rows = self.spark.createDataFrame([(*r, minute) for minute, r in taken], schema.RETRY + ", due long")
        parsed = parse_record(F.col("eventData"))
        images = rows.where(F.col("retryCount") < F.col("maxRetries")).select("id", parsed.alias("r")).where("r is not null").select("id", "r.*").withColumn("eventId", F.col("id")).dropDuplicates(["eventId"])
        self._deliver(images, active, f"{work}/outcomes")
        outcomes = settle(images, self.spark.read.schema(schema.OUTCOME).parquet(f"{work}/outcomes")).select(F.col("eventId").alias("id"), F.col("settled").alias("ok"), "error")
        tick = f"tick-{version}-{uuid.uuid4().hex[:8]}"
        step = retry_step(rows, parsed.isNotNull(), outcomes).join(rows.select("id", "version", "due"), ["id", "version"])
        step.coalesce(1).write.parquet(self._path(f"ticks/part={tick}"))
        return self._carry_out(tick)

    def _carry_out(self, tick: str) -> dict[str, int]:
        """Dead letters first, then new queue entries, then the removal of the old ones. Runs again to the same end."""
        version = int(tick.split("-")[1])
        now = F.timestamp_micros(F.lit(version))
        step = self.folders.read(f"ticks/part={tick}", _STEP)
        done = {r["action"]: r["count"] for r in step.groupBy("action").count().collect()}
        if "dlq" in done:
            dead = step.where("action = 'dlq'").select(F.sha2(F.concat_ws(":", "collectionName", "id"), 256).alias("_id"), "collectionName", F.lit(None).cast("string").alias("sinkId"), "eventData", "lastError", now.alias("failedAt"), F.col("id").alias("dedupKey"))
            others = self.folders.read("dlq", TABLES["dlq"] + ", part string").where(F.coalesce(F.col("part") != tick, F.lit(True))).drop("part")
            self._put("dlq", absent(others, dead), tick)
        if "requeue" in done:
            wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.coalesce("delay", F.lit(0.0)).cast("decimal(18,6)"))
            again = step.where("action = 'requeue'")
            self._put("retry", again.select("id", "collectionName", "eventData", F.col("retryCount").cast("int").alias("retryCount"), "maxRetries", (now + wait).alias("nextRetryAt"), F.col("error").alias("lastError"), F.lit(version).cast("long").alias("version"), F.lit(False).alias("removed")), tick)
        self.queue.taken(step, tick)
        self._delete(self._path(f"ticks/part={tick}"))
        return done

    # -- running

    def start(self, changes: DataFrame, available_now: bool = True, every: str = "5 seconds") -> StreamingQuery:
        if self.ended():
            raise StreamEnded(self.collection)
        if not self.folders.exists("checkpoint"):
            changes = from_start(changes, start_position(self.resume_token, self.started_at), self.clock().timestamp())
        return self._run(changes, available_now, every)

    def follow(self, feed: str, available_now: bool = True, every: str = "5 seconds", max_rows: int | None = None, deltas: bool = False) -> StreamingQuery:
        """Start on a feed of files by token: nothing before the start position is read. max_rows bounds the batches of a stream that goes on; available_now takes what is there as one. Of a feed of deltas, documents are completed by state."""
        if self.ended():
            raise StreamEnded(self.collection)
        first = not self.folders.exists("checkpoint")
        start = start_position(self.resume_token, self.started_at)  # also when it starts again: it may have ended before its first batch
        changes = stream_feed(self.spark, feed, start, self.clock().timestamp(), None if available_now else max_rows, None if first else self.position(), first, deltas)
        return self._run(changes, available_now, every)

    def lose_position(self, error: str) -> bool:
        """Where an error says that the resume token is of no use, it goes, and the checkpoint with it; the next start is at the stream's enabling or now."""
        if not token_is_useless(None, error):
            return False
        self._delete(self._path("checkpoint"))
        self.resume_token = None
        return True

    def _run(self, changes: DataFrame, available_now: bool, every: str) -> StreamingQuery:
        writer = changes.writeStream.foreachBatch(self.process_batch).option("checkpointLocation", self._path("checkpoint"))
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


@dataclass
class Supervisor:
    """Keeps a stream running for every enabled collection whose feed has not ended: starts, stops and recreates them. `failed` hears of a stream's error before it starts again, see Pipeline.lose_position."""

    enabled: Callable[[], list[str]]
    start: Callable[[str], StreamingQuery]
    ended: Callable[[str], bool] = lambda name: False
    failed: Callable[[str, str], object] = lambda name, error: None
    running: dict[str, StreamingQuery] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    def sync(self) -> None:
        """To be called every 30 seconds, and at once after a change of configuration."""
        wanted = {n for n in self.enabled() if not self.ended(n)}
        for name in [n for n in self.running if n not in wanted]:
            self.running.pop(name).stop()
        for name in wanted:
            query = self.running.get(name)
            if query is not None and query.isActive:
                continue
            if query is not None and query.exception() is not None:
                self.errors[name] = str(query.exception())[:500]
                self.failed(name, str(query.exception()))
            try:
                self.running[name] = self.start(name)
            except Exception as error:  # one collection's failure leaves the others running
                self.errors[name] = str(error)[:500]

    def gauges(self) -> dict[str, int]:
        return {name: int(q.isActive) for name, q in self.running.items()}

    def stop(self) -> None:
        for q in self.running.values():
            q.stop()
        self.running = {}


def health(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """Each path's state: ok, or what is wrong with it."""
    out = {}
    for name, path in paths.items():
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            out[name] = "ok" if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else "missing"
        except Exception as error:
            out[name] = str(error)[:200]
    return out


def wait_ready(ready: Callable[[], bool], deadline: float, every: float = 0.5, sleep=time.sleep, now=time.monotonic) -> bool:
    """Ask every half second until a source is ready or the deadline has passed; an error counts as not ready."""
    until = now() + deadline
    while True:
        try:
            if ready():
                return True
        except Exception:
            pass
        if now() >= until:
            return False
        sleep(every)


class WatcherStats(StreamingQueryListener):
    """Start, events, and the last error of every stream, by query id. Add it with spark.streams.addListener."""

    def __init__(self):
        self.stats: dict[str, dict] = {}

    def _of(self, query_id) -> dict:
        return self.stats.setdefault(str(query_id), {"started": None, "events": 0, "last_error": None, "running": False})

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._of(event.id).update(started=event.timestamp, running=True)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self._of(event.progress.id)["events"] += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._of(event.id).update(running=False, last_error=event.exception)


__all__ = ["MOST_RETRIES", "Pipeline", "StreamEnded", "Supervisor", "Unsettled", "WatcherStats", "health", "wait_ready"]
