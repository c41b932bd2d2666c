"""The stream: delivery, restart, failures, retries, dead letters; and the transports."""

import datetime as dt
import http.server
import json
import sys
import threading
import time

import pytest
from pyspark.sql import functions as F

from pyspark import cloudpickle

from tideline.functions.filters import Filter
from tideline.operators.routing import Sink
from tideline.sources.feed import change_feed, read_changes, stream_changes
from tideline.streaming import sinks as S
from tideline.streaming.pipeline import Pipeline, Supervisor, health

cloudpickle.register_pickle_by_value(sys.modules[__name__])
EVENTS = [(i, 1 + i % 3, "view" if i % 4 else "purchase", float(i * 20)) for i in range(12)]


def file_transport(sink):
    """Appends what it gets to a folder; fails while a flag file exists. Local, so that workers need not import this module."""
    import json
    import os
    import uuid

    class FileTransport:
        def send(self, record):
            folder = sink.spec["folder"]
            if os.path.exists(f"{folder}/fail"):
                raise RuntimeError("down")
            with open(f"{folder}/{uuid.uuid4().hex}.json", "w") as f:
                json.dump(record, f)

    return FileTransport()


def sent(folder):
    return [json.loads(p.read_text()) for p in folder.glob("*.json")]


@pytest.fixture
def world(spark, tmp_path):
    (tmp_path / "out").mkdir()
    S.register_transport("file", file_transport)
    rows = [(e, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=e), u, t, v, '{"k": 1}') for e, u, t, v in EVENTS]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    text = change_feed(events).withColumns({c: F.to_json(c) for c in ("documentKey", "fullDocument", "fullDocumentBeforeChange")}).drop("ts_us")
    for k in range(2):
        text.where(f"event_id % 2 = {k}").drop("event_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    now = [dt.datetime(2024, 2, 1, tzinfo=dt.UTC)]
    sink = Sink("f", "users", "file", {"folder": str(tmp_path / "out")}, (), Filter.parse({"newImage": {"event_type": {"eq": "purchase"}}}))
    pipe = Pipeline(spark, "users", f"file://{tmp_path}/state", lambda: [sink], lambda: now[0], started_at=0.0)
    return pipe, tmp_path, now, text


def run(spark, pipe, path):
    q = pipe.start(stream_changes(spark, str(path / "in"), max_files=1))
    q.awaitTermination()
    assert q.exception() is None


def test_delivery_and_restart(spark, world):
    pipe, path, now, text = world
    run(spark, pipe, path)
    assert sorted(r["newImage"]["value"] for r in sent(path / "out")) == [0.0, 80.0, 160.0]
    assert pipe.table("processed").count() == 12 and pipe.table("retry").count() == 0
    run(spark, pipe, path)  # nothing new
    assert len(sent(path / "out")) == 3
    text.drop("event_id").coalesce(1).write.mode("append").parquet(str(path / "in"))  # all again: processed already
    run(spark, pipe, path)
    assert len(sent(path / "out")) == 3
    now[0] += dt.timedelta(hours=25)  # forgotten by now
    text.drop("event_id").coalesce(1).write.mode("append").parquet(str(path / "in"))
    run(spark, pipe, path)
    assert len(sent(path / "out")) == 6


def test_crash_before_commit(spark, world):
    pipe, path, *_ = world
    keep = pipe._put

    def put(name, rows, part, *more):
        if name == "processed":
            raise OSError("lost")
        keep(name, rows, part, *more)

    pipe._put = put
    q = pipe.start(stream_changes(spark, str(path / "in")))
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination()
    first = len(sent(path / "out"))
    pipe._put = keep
    run(spark, pipe, path)
    assert first == 3 and len(sent(path / "out")) == 6  # again, not lost
    assert pipe.table("processed").count() == 12


def test_a_batch_that_runs_again_counts_once(spark, world):
    pipe, path, *_ = world
    from tideline.sources.feed import read_changes

    changes = read_changes(spark, str(path / "in"))
    keep, failed = pipe._put, []

    def put(name, rows, part, *more):
        keep(name, rows, part, *more)
        if name == "outcomes" and not failed:
            failed.append(part)
            raise OSError("lost")

    pipe._put = put
    with pytest.raises(OSError):
        pipe.process_batch(changes, 7)
    assert pipe.table("processed").count() == 0
    pipe.process_batch(changes, 7)
    assert pipe.table("outcomes").count() == 3 and pipe.table("settled").count() == 12
    assert {r.state for r in pipe.table("settled").collect()} == {"delivered"}
    assert not list((path / "state" / "users" / "work").glob("[!.]*"))


def test_a_batch_that_was_done_is_passed_over(spark, world):
    """A crash after all parts are written, before the offsets are."""
    pipe, path, *_ = world
    keep, failed = pipe._put, []

    def put(name, rows, part, *more):
        keep(name, rows, part, *more)
        if name == "processed" and not failed:
            failed.append(part)
            raise OSError("lost")

    pipe._put = put
    q = pipe.start(stream_changes(spark, str(path / "in")))
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination()
    run(spark, pipe, path)
    assert len(sent(path / "out")) == 3
    assert pipe.table("outcomes").count() == 3 and pipe.table("settled").count() == 12 and pipe.table("processed").count() == 12


def test_a_batch_is_settled_without_shuffles_of_its_records(spark, world):
    """Few failures meet all records of a batch as a broadcast table, and the feed is asked once for its end and its highest token. States, errors, queue and keys are those of a plain count."""
    pipe, tmp, now, text = world
    records = [{"event_id": i, "purchase": t == "purchase"} for i, u, t, v in EVENTS]
    (tmp / "out" / "fail").touch()
    ok = Sink("g", "users", "file", {"folder": str(tmp / "ok")}, (), Filter.parse({"newImage": {"event_type": {"eq": "view"}}}))
    (tmp / "ok").mkdir()
    load = pipe.load_sinks
    pipe.sinks.load = lambda: [*load(), ok]
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    pipe.process_batch(read_changes(spark, str(tmp / "in")), 0)
    runs, joins = store.executionsList(), []
    for i in range(before, runs.size()):
        nodes = store.planGraph(runs.apply(i).executionId()).allNodes()
        joins += [nodes.apply(k).name() for k in range(nodes.size()) if "Join" in nodes.apply(k).name()]
    assert joins and all(j.startswith("BroadcastHashJoin") for j in joins) and len(joins) == 3
    got = {int(r.eventId[6:], 16): (r.state, r.error) for r in pipe.table("settled").collect()}
    assert got == {r["event_id"]: ("queued", "down") if r["purchase"] else ("delivered", None) for r in records}
    assert {int(r.id[6:], 16) for r in pipe.table("retry").collect()} == {r["event_id"] for r in records if r["purchase"]}
    assert {int(r.eventId[6:], 16) for r in pipe.table("processed").collect()} == {r["event_id"] for r in records if not r["purchase"]}
    assert pipe.position() == f"{max(r['event_id'] for r in records):016X}"
    queued = {r.id: json.loads(r.eventData) for r in pipe.table("retry").collect()}
    assert all(x["newImage"]["event_type"] == "purchase" for x in queued.values()) and len(sent(tmp / "ok")) == sum(not r["purchase"] for r in records)


def test_unsettled(spark, world):
    """What is neither delivered nor queued is an error: its batch runs again."""
    from tideline.sources.feed import read_changes
    from tideline.streaming.pipeline import Unsettled

    pipe, path, *_ = world
    (path / "out" / "fail").touch()
    keep = pipe._put

    def put(name, rows, part, *more):
        if name == "retry":
            raise OSError("no queue")
        keep(name, rows, part, *more)

    pipe._put = put
    changes = read_changes(spark, str(path / "in"))
    with pytest.raises(Unsettled, match="no queue"):
        pipe.process_batch(changes, 0)
    assert pipe.table("processed").count() == 0
    pipe._put = keep
    pipe.process_batch(changes, 0)
    assert pipe.table("retry").count() == 3 and {r.state: r.n for r in pipe.table("settled").groupBy("state").agg(F.count("*").alias("n")).collect()} == {"delivered": 9, "queued": 3}


def test_retry_queue_by_due_time(spark, world):
    """A tick reads the minutes that have come, whatever waits in others; past minutes go, what was taken stays taken."""
    pipe, path, now, _ = world
    (path / "out" / "fail").touch()
    run(spark, pipe, path)
    queue = pipe.queue
    first = int(now[0].timestamp()) + 1
    row = pipe.table("retry").first()
    for minutes in (30, 60, 90):  # entries that are not due, in thousands
        later = spark.range(2000).select(F.concat(F.lit(f"m{minutes}-"), F.col("id").cast("string")).alias("id"), *(F.lit(row[c]).alias(c) for c in ("collectionName", "eventData", "retryCount", "maxRetries")), F.timestamp_seconds(F.lit(first + 60 * minutes)).alias("nextRetryAt"), F.lit("x").alias("lastError"), F.lit(5).cast("long").alias("version"), F.lit(False).alias("removed"))
        queue.put(later, f"later-{minutes}")
    assert pipe.retry_tick() == {} and queue.seen == [first // 60]
    now[0] += dt.timedelta(seconds=2)
    assert pipe.retry_tick() == {"requeue": 3} and queue.seen == [first // 60]
    assert pipe.table("retry").count() == 6003
    (path / "out" / "fail").unlink()
    now[0] += dt.timedelta(seconds=200)
    assert pipe.retry_tick() == {"done": 3}
    pipe.retry_tick()
    assert first // 60 not in queue._minutes() and pipe.table("retry").count() == 6000
    now[0] += dt.timedelta(minutes=27)
    assert pipe.retry_tick() == {"done": 10} and queue.seen == [first // 60 + 30] and pipe.table("retry").count() == 5990
    now[0] += dt.timedelta(days=2)
    pipe._delete(pipe._path(f"retry/due={first // 60 + 30}"))
    pipe.compact()
    assert not pipe.folders.children("taken", "due=")


def test_a_tick_that_ended_halfway_is_carried_out(spark, world):
    pipe, path, now, _ = world
    (path / "out" / "fail").touch()
    run(spark, pipe, path)
    for crash in ("retry", "taken", "dlq"):
        now[0] += dt.timedelta(seconds=400)
        keep_put, keep_taken = pipe._put, pipe.queue.taken

        def put(name, rows, part, *more, crash=crash, keep=keep_put):
            keep(name, rows, part, *more)
            if name == crash:
                raise OSError("lost")

        def taken(rows, part, crash=crash, keep=keep_taken):
            if crash == "taken":
                raise OSError("lost")
            keep(rows, part)

        pipe._put, pipe.queue.taken = put, taken
        counts = {r.retryCount for r in pipe.table("retry").collect()}
        if crash == "dlq":
            pipe._put, pipe.queue.taken = keep_put, keep_taken
            for _ in range(3):
                assert pipe.retry_tick() == {"requeue": 3}
                now[0] += dt.timedelta(seconds=400)
            pipe._put = put
        with pytest.raises(OSError):
            pipe.retry_tick()
        pipe._put, pipe.queue.taken = keep_put, keep_taken
        assert pipe.retry_tick() == {}  # carries out what was decided; nothing else is due
        if crash != "dlq":
            assert {r.retryCount for r in pipe.table("retry").collect()} == {c + 1 for c in counts} and pipe.table("retry").count() == 3
    assert pipe.table("retry").count() == 0 and pipe.table("dlq").count() == 3


def test_a_batch_again_does_not_bring_back_dead_letters(spark, world):
    """A batch that ended before its mark was written, and whose entries a tick has taken meanwhile."""
    from tideline.sources.feed import read_changes

    pipe, path, now, _ = world
    (path / "out" / "fail").touch()
    keep = pipe._put

    def without_keys(name, *rest):
        if name == "processed":
            raise OSError("lost")
        keep(name, *rest)

    pipe._put = without_keys
    changes = read_changes(spark, str(path / "in"))
    with pytest.raises(OSError):
        pipe.process_batch(changes, 0)
    now[0] += dt.timedelta(seconds=400)
    assert pipe.retry_tick() == {"requeue": 3}
    pipe._put = keep
    pipe.process_batch(changes, 0)
    assert {r.retryCount for r in pipe.table("retry").collect()} == {1} and pipe.table("retry").count() == 3


def test_a_batch_without_deliveries_is_known_as_done(spark, world):
    from tideline.sources.feed import read_changes

    pipe, path, *_ = world
    pipe.sinks.load = lambda: [Sink("x", "users", "nothing")]
    changes = read_changes(spark, str(path / "in"))
    pipe.process_batch(changes, 0)
    assert pipe.table("processed").count() == 0 and pipe.table("retry").count() == 12 and pipe.position() == f"{11:016X}"
    pipe._put = None
    pipe.process_batch(changes, 0)  # passed over: writes nothing


def test_events_behind_an_end_are_left(spark, world):
    pipe, path, *_ = world
    changes = spark.sql("""SELECT named_struct('_data', d) AS _id, op AS operationType, cast(null AS struct<t:bigint,i:int>) AS clusterTime, parse_json('{"_id":1}') AS documentKey, parse_json('{"_id":1,"event_type":"purchase","value":1}') AS fullDocument, cast(null AS variant) AS fullDocumentBeforeChange
      FROM VALUES ('0D', 'insert'), ('0A', 'insert'), ('0c', 'invalidate'), ('0B', 'insert'), ('0F', 'drop') AS t(d, op)""")
    pipe.process_batch(changes, 0)
    assert {r.eventId for r in pipe.table("processed").collect()} == {"users:0A", "users:0B"} and len(sent(path / "out")) == 2
    assert [r.operationType for r in pipe.table("terminal").collect()] == ["invalidate"] and pipe.ended()


def test_compaction(spark, world, monkeypatch):
    """Old parts and expired keys go; a tick compacts many filters; a batch whose filter was merged is still known as done, and the position stays."""
    import os

    from tideline.sources.feed import read_changes
    from tideline.streaming import pipeline, stores

    pipe, path, now, _ = world
    run(spark, pipe, path)
    changes = read_changes(spark, str(path / "in"))
    pipe.process_batch(changes.where("false"), 50)
    monkeypatch.setattr(pipeline, "MANY_PARTS", 1)
    monkeypatch.setattr(stores, "MANY_PARTS", 1)
    assert len(pipe.parts("keys")) == 3 and pipe.retry_tick() == {} and len(pipe.parts("keys")) == 1
    assert pipe._done("direct-50") and pipe.position() == f"{11:016X}"
    for name in ("settled", "done", "begun"):
        for part, _ in pipe.parts(name):
            os.utime(part.removeprefix("file:"), (0, 0))
    now[0] += dt.timedelta(days=3)
    pipe.compact()
    assert pipe.parts("settled") == [] and len(pipe.parts("done")) == 1 and pipe.table("processed").count() == 0 and pipe.parts("outcomes")


def test_observed_deliveries(spark, world):
    """Counts and histograms of a delivery's own pass are those of the stored outcomes, over batches and ticks."""
    from tideline.operators import metrics

    pipe, path, now, _ = world
    (path / "out" / "fail").touch()
    run(spark, pipe, path)
    (path / "out" / "fail").unlink()
    assert pipe.delivered.counters() == [("file", "failure", 3)]
    now[0] += dt.timedelta(seconds=5)
    pipe.retry_tick()
    assert pipe.delivered.counters() == [("file", "failure", 3), ("file", "success", 3)]
    (kind, *le, n, total), stored = pipe.delivered.histograms()[0], metrics.histogram(pipe.table("outcomes"), "seconds", metrics.DELIVERY_BUCKETS).first()
    assert (kind, n) == ("file", 6) and le == sorted(le) and le[-1] == 6 and total > stored["total"] and stored["n"] == 3
    pipe.sinks.load = lambda: []
    assert pipe.sinks.refresh() == []


def test_processed_keys_are_looked_up_in_few_files(spark, tmp_path):
    """100,000 keys in 50 parts: a batch of new ones reads none, stragglers read their own parts, expired ones none."""
    from tideline.streaming.stores import Folders, ProcessedKeys

    keys, at = ProcessedKeys(Folders(spark, f"file://{tmp_path}")), dt.datetime(2024, 1, 1, 12, tzinfo=dt.UTC)
    number = F.format_string("k:%08d", "id")
    until = F.lit(at + dt.timedelta(hours=20)).cast("timestamp")
    for part in range(50):
        keys.put(spark.range(part * 2000, part * 2000 + 2000).select(number.alias("eventId")), "2024-01-02-08", f"p{part}", until)
    now = F.lit(at).cast("timestamp")
    ids = lambda *n: spark.createDataFrame([(f"k:{i:08d}",) for i in n], "eventId string")
    got = lambda df: sorted(int(r.eventId[2:]) for r in keys.fresh(df, now).collect())
    assert got(ids(*range(100_000, 101_000))) == list(range(100_000, 101_000)) and keys.seen == []
    assert got(ids(100_000, 100_001, 17, 99_999)) == [100_000, 100_001]
    rows = spark.read.parquet(*keys.seen).count()
    assert len(keys.seen) <= 3 and rows <= 6000
    assert got(ids(*range(4000, 4100), *range(4000, 4050), 200_000)) == [200_000] and len(keys.seen) <= 2
    assert got(spark.createDataFrame([], "eventId string")) == []
    keys.compact("2024-01-01-12", "merged")
    assert len(keys.folders.children("keys", "part=")) == 50  # few enough
    import tideline.streaming.stores as stores

    stores.MANY_PARTS, keep = 10, stores.MANY_PARTS
    keys.compact("2024-01-01-12", "merged")
    stores.MANY_PARTS = keep
    assert len(keys.folders.children("keys", "part=")) == 1 and got(ids(5, 100_000)) == [100_000]
    later = F.lit(at + dt.timedelta(hours=21)).cast("timestamp")
    assert sorted(r.eventId for r in keys.fresh(ids(5), later).collect()) == ["k:00000005"] and keys.seen == []
    keys.compact("2024-01-02-09", "merged")
    assert keys.table().count() == 0


def test_filters_never_miss():
    import random

    from tideline.operators.fileindex import bloom, may_hold

    rng = random.Random(4)
    keys = [f"{rng.getrandbits(80):x}" for _ in range(5000)]
    bits = bloom(keys)
    assert may_hold(bits, keys).all()
    assert may_hold(bits, [f"no{i}" for i in range(20_000)]).mean() < 0.01


def test_first_start(spark, world):
    """After a token, at the stream's enabling, or now; a second start goes on where the first one ended."""
    from dataclasses import replace

    pipe, path, now, text = world
    late = replace(pipe, root=f"file://{path}/late", started_at=None)
    run(spark, late, path)
    assert late.table("processed").count() == 0  # all events were before now
    text.drop("event_id").coalesce(1).write.mode("append").parquet(str(path / "in"))
    run(spark, late, path)
    assert late.table("processed").count() == 12  # came after the first start, whatever their time
    token = replace(pipe, root=f"file://{path}/token", resume_token=f"{7:016X}")
    run(spark, token, path)
    assert token.table("processed").count() == 4
    since = replace(pipe, root=f"file://{path}/since", started_at=dt.datetime(2024, 1, 1, 0, 9, tzinfo=dt.UTC).timestamp())
    run(spark, since, path)
    assert since.table("processed").count() == 3


def test_feed_by_token(spark, world):
    """A start at a token reads later files only; a restart goes on behind the committed token; a token that is lost is dropped."""
    from dataclasses import replace

    from tideline.sources import token_feed as tf
    from tideline.sources.feed import _documents

    pipe, path, now, text = world
    feed = f"file://{path}/feed"
    changes = _documents(text.drop("event_id"))
    token = lambda n: f"{n:016X}"
    tf.write_feed(changes.where(F.col("_id._data") <= token(7)), feed, 4)
    follow = lambda p, **k: p.follow(feed, **k)

    def rows(q):
        q.awaitTermination(120)
        assert q.exception() is None
        return [p.numInputRows for p in q.recentProgress if p.numInputRows]

    index = tf.Index(f"{path}/feed")
    span = tf.spans(index, {"token": token(3), "with": False}, {"token": "F" * 16, "with": False})
    assert len(index.groups()) == 4 and len(span) == 2 and sum(g.rows for g in index.groups()) == 8
    assert sum(tf.Index(f"{path}/feed").since(0)["token"] == token(0) for _ in range(1)) == 1
    late = replace(pipe, root=f"file://{path}/late", resume_token=token(3).lower())
    assert rows(follow(late)) == [4] and late.table("processed").count() == 4 and late.position() == token(7)
    assert rows(follow(late)) == []
    tf.write_feed(changes.where(F.col("_id._data") > token(7)), feed, 2)
    assert rows(follow(late)) == [4] and late.table("processed").count() == 8
    since = replace(pipe, root=f"file://{path}/since2", started_at=dt.datetime(2024, 1, 1, 0, 9, tzinfo=dt.UTC).timestamp())
    assert rows(follow(since)) == [3]
    fresh = replace(pipe, root=f"file://{path}/now", started_at=None)
    assert rows(follow(fresh)) == []
    steady = replace(pipe, root=f"file://{path}/steady")
    q = follow(steady, available_now=False, every="0 seconds", max_rows=2)
    for _ in range(60):
        if q.lastProgress and steady.table("processed").count() == 12:
            break
        time.sleep(1)
    batches = [p.numInputRows for p in q.recentProgress if p.numInputRows]
    q.stop()
    assert q.exception() is None and max(batches) <= 3 and steady.table("processed").count() == 12

    gone = tf.trim_feed(spark, feed, token(5))
    assert len(gone) == 3
    lost = replace(pipe, root=f"file://{path}/lost", resume_token=token(2), started_at=0.0)
    heard = []
    s = Supervisor(lambda: ["users"], lambda n: follow(lost), failed=lambda n, e: heard.append(lost.lose_position(e)))
    s.sync()
    with pytest.raises(Exception, match="resume token was not found"):
        s.running["users"].awaitTermination(60)
    s.sync()
    assert heard == [True] and lost.resume_token is None and rows(s.running["users"]) == [6]
    assert not lost.lose_position("disk full")
    behind = replace(pipe, root=f"file://{path}/behind", resume_token=token(5))
    assert rows(follow(behind)) == [6]
    with pytest.raises(Exception, match="valid hex"):
        tf.read_feed(spark, feed, after="xyz").count()
    assert tf.read_feed(spark, feed, after=token(6), until=token(9)).count() == 3
    spark.range(3).select(F.struct(F.lit(None).cast("string").alias("_data")).alias("_id")).write.parquet(f"{path}/bare")
    with pytest.raises(Exception, match="without tokens"):
        tf.read_feed(spark, f"file://{path}/bare").count()
    assert tf.read_feed(spark, f"file://{path}/nothing").count() == 0


def test_terminal_event_ends_the_stream(spark, world):
    from tideline.streaming.pipeline import StreamEnded

    pipe, path, *_ = world
    drop = spark.sql("SELECT named_struct('_data', 'FF') AS _id, 'drop' AS operationType, named_struct('t', 1893456000L, 'i', 1) AS clusterTime, cast(null AS string) AS documentKey, cast(null AS string) AS fullDocument, cast(null AS string) AS fullDocumentBeforeChange")
    drop.coalesce(1).write.mode("append").parquet(str(path / "in"))
    time.sleep(1.1)
    insert = drop.selectExpr("named_struct('_data', 'FFF') AS _id", "'insert' AS operationType", "clusterTime", "'{\"_id\":1}' AS documentKey", "'{\"_id\":1,\"event_type\":\"purchase\"}' AS fullDocument", "fullDocumentBeforeChange")
    insert.coalesce(1).write.mode("append").parquet(str(path / "in"))
    q = pipe.start(stream_changes(spark, str(path / "in"), max_files=1))
    with pytest.raises(Exception, match="StreamEnded"):
        q.awaitTermination()
    assert pipe.table("processed").count() == 12 and pipe.ended()
    again = Pipeline(spark, "users", pipe.root, pipe.load_sinks, pipe.clock)  # a new process knows it too
    with pytest.raises(StreamEnded):
        again.start(stream_changes(spark, str(path / "in")))
    stopped = []
    s = Supervisor(lambda: ["users", "b"], lambda n: stopped.append(n), lambda n: n == "users" and again.ended())
    s.sync()
    assert stopped == ["b"]
    again.reopen()
    run(spark, again, path)
    assert again.table("processed").count() == 13


def test_retry_and_dead_letters(spark, world):
    pipe, path, now, _ = world
    (path / "out" / "fail").touch()
    run(spark, pipe, path)
    assert pipe.table("retry").count() == 3 and pipe.table("processed").count() == 9
    assert pipe.retry_tick() == {}  # not due
    waits = []
    for _ in range(5):
        now[0] += dt.timedelta(seconds=400)
        assert pipe.retry_tick() == {"requeue": 3}
        last = pipe.table("retry").agg(F.max(F.unix_seconds("nextRetryAt"))).first()[0]
        waits.append(last - int(now[0].timestamp()))
    assert waits == [1, 2, 4, 8, 16]
    now[0] += dt.timedelta(seconds=400)
    assert pipe.retry_tick() == {"dlq": 3} and pipe.retry_tick() == {}
    dead = pipe.table("dlq").collect()
    assert len(dead) == 3 and {r.lastError for r in dead} == {"down"} and all(json.loads(r.eventData)["eventId"] == r.dedupKey for r in dead)


def test_retry_succeeds(spark, world):
    pipe, path, now, _ = world
    (path / "out" / "fail").touch()
    run(spark, pipe, path)
    (path / "out" / "fail").unlink()
    now[0] += dt.timedelta(seconds=2)
    assert pipe.retry_tick() == {"done": 3} and len(sent(path / "out")) == 3 and pipe.retry_tick() == {}


def test_quarantine_and_terminal(spark, world):
    pipe, path, *_ = world
    changes = spark.sql("""SELECT named_struct('_data', d) AS _id, op AS operationType, cast(null AS struct<t:bigint,i:int>) AS clusterTime, cast(null AS variant) AS documentKey, parse_json('{}') AS fullDocument, cast(null AS variant) AS fullDocumentBeforeChange
      FROM VALUES ('1', 'insert'), ('2', 'rename'), ('3', null), (null, 'insert'), ('4', 'drop') AS t(d, op)""")
    pipe.process_batch(changes, 0)
    assert sorted((r.eventId, r.reason) for r in pipe.table("quarantine").collect()) == [("", "no event identity"), ("users:2", "unknown operation type: rename"), ("users:3", "missing operationType")]
    assert [r.operationType for r in pipe.table("terminal").collect()] == ["drop"]
    assert pipe.table("processed").count() == 1


def test_unknown_sink_fails_closed(spark, world):
    pipe, path, *_ = world
    pipe.sinks.load = lambda: [Sink("x", "users", "nothing")]
    run(spark, pipe, path)
    assert pipe.table("retry").count() == 12 and "no transport" in pipe.table("retry").first().lastError


def test_supervisor():
    class Query:
        def __init__(self):
            self.isActive = True

        def stop(self):
            self.isActive = False

        def exception(self):
            return RuntimeError("died")

    made, names = [], ["a", "b"]

    def start(name):
        if name == "b" and len(made) < 1:
            raise OSError("later")
        made.append(name)
        return Query()

    s = Supervisor(lambda: names, start)
    s.sync()
    s.sync()
    assert s.gauges() == {"a": 1, "b": 1} or set(made) == {"a", "b"}
    s.running["a"].isActive = False
    s.sync()
    assert made.count("a") == 2 and "died" in s.errors["a"]
    names.remove("b")
    s.sync()
    assert set(s.running) == {"a"}
    s.stop()
    assert s.gauges() == {}


def test_stats(spark, world):
    from tideline.streaming.pipeline import WatcherStats

    pipe, path, *_ = world
    stats = WatcherStats()
    spark.streams.addListener(stats)
    run(spark, pipe, path)
    for _ in range(100):
        if stats.stats and not any(s["running"] for s in stats.stats.values()):
            break
        time.sleep(0.1)
    spark.streams.removeListener(stats)
    (got,) = stats.stats.values()
    assert got["events"] == 12 and got["last_error"] is None and got["started"]


def test_wait_ready():
    from tideline.streaming.pipeline import wait_ready

    clock, answers = [0.0], iter([False, 1 / 2 > 1, True])

    def sleep(s):
        clock[0] += s

    assert wait_ready(lambda: next(answers), 10, sleep=sleep, now=lambda: clock[0]) and clock[0] == 1.0
    assert not wait_ready(lambda: 1 / 0, 2, sleep=sleep, now=lambda: clock[0])


def test_health(spark, tmp_path):
    assert health(spark, {"here": f"file://{tmp_path}", "there": f"file://{tmp_path}/no"}) == {"here": "ok", "there": "missing"}


# -- transports

RECORD = {"recordType": "INSERT", "newImage": {"_id": 1}, "documentId": "1"}


def test_http():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.headers.get("Authorization"), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response({"/ok": 204, "/no": 500, "/move": 302}[self.path])
            self.send_header("Location", "/ok")
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    S.HttpTransport(f"{base}/ok", "t").send(RECORD)
    assert seen[0] == ("/ok", "Bearer t", RECORD)
    for path in ("no", "move"):
        with pytest.raises(S.DeliveryError):
            S.HttpTransport(f"{base}/{path}").send(RECORD)
    server.shutdown()
    with pytest.raises(S.DeliveryError):
        S.HttpTransport("http://127.0.0.1:9/x").send(RECORD)


class Client:
    def __init__(self, **answers):
        self.calls, self.answers = [], answers

    def __getattr__(self, name):
        def call(*args, **kwargs):
            self.calls.append((name, args, kwargs))
            return self.answers.get(name)

        return call


def test_http_keeps_its_connection():
    ports = []

    class Handler(http.server.BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            ports.append(self.client_address[1])
            self.rfile.read(int(self.headers["Content-Length"]))
            body = b"x" * (10 if len(ports) != 2 else 100_000)
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)
            if len(ports) == 4:
                self.close_connection = True

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    t = S.HttpTransport(f"http://127.0.0.1:{server.server_port}/x?y=1")
    for _ in range(5):
        t.send(RECORD)
    server.shutdown()
    assert ports[0] == ports[1] and ports[1] != ports[2] == ports[3] != ports[4]  # a long answer is not read to its end; a closed connection is replaced


def test_hung_clients(monkeypatch):
    monkeypatch.setattr(S, "TIMEOUT", 0.2)

    class Hung:
        def __getattr__(self, name):
            return lambda *args, **kwargs: time.sleep(60)

    began = time.monotonic()
    for t in (S.RedisTransport("s", Hung()), S.EventBridgeTransport("bus", client=Hung()), S.MeilisearchTransport("i", Hung())):
        with pytest.raises(S.DeliveryError, match="no answer"):
            t.send(RECORD)
    assert time.monotonic() - began < 5


def test_other_transports():
    c = Client()
    S.RedisTransport("s", c).send(RECORD)
    assert c.calls == [("xadd", ("s", {"event": json.dumps(RECORD)}), {})]
    c = Client(put_events={"FailedEntryCount": 0})
    S.EventBridgeTransport("bus", client=c).send(RECORD)
    assert c.calls[0][2]["Entries"][0]["EventBusName"] == "bus"
    with pytest.raises(S.DeliveryError, match="large"):
        S.EventBridgeTransport("bus", client=c).send(RECORD | {"x": "y" * S.ENTRY_BYTES})
    with pytest.raises(S.DeliveryError, match="failed"):
        S.EventBridgeTransport("bus", client=Client(put_events={"FailedEntryCount": 1, "Entries": [{"ErrorMessage": "m"}]})).send(RECORD)
    c = Client(task="succeeded")
    S.MeilisearchTransport("i", c).send(RECORD)
    S.MeilisearchTransport("i", c).send({"recordType": "MODIFY", "oldImage": {"_id": 3}, "documentId": "2"})
    assert [x[0] for x in c.calls] == ["upsert", "task", "delete", "task"] and c.calls[2][1] == ("i", "2")
    for state in ("failed", "canceled"):
        began = time.monotonic()
        with pytest.raises(S.DeliveryError, match=state):
            S.MeilisearchTransport("i", Client(task=state)).send(RECORD)
        assert time.monotonic() - began < 2


MISSING, OBJECT, OID, OTHER = "missing", {"_id": 5, "a": 1}, {"_id": {"$oid": "ab"}}, "text"


@pytest.mark.parametrize("kind", ["INSERT", "MODIFY", "REMOVE", "UPSERT", None])
def test_search_actions(kind):
    """Every record type with every pair of images, with and without an id: what is done, or an error."""
    for new in (MISSING, None, OBJECT, OID, OTHER):
        for old in (MISSING, None, OBJECT, OID, OTHER):
            for key in (MISSING, "", "9"):
                record = {"recordType": kind} | {k: v for k, v in (("newImage", new), ("oldImage", old), ("documentId", key)) if v is not MISSING}
                if kind in ("INSERT", "MODIFY") and new in (OBJECT, OID):
                    want = ("upsert", new)
                elif kind == "REMOVE" and key == "9":
                    want = ("delete", "9")
                elif kind in ("INSERT", "MODIFY") and record.get("newImage") is None and record.get("oldImage") is not None and key == "9":
                    want = ("delete", "9")
                else:
                    want = None
                if want:
                    assert S.search_action(record) == want
                else:
                    with pytest.raises(S.DeliveryError):
                        S.search_action(record)


def slow_or_fast(sink):
    import time

    class Sleeps:
        def send(self, record):
            time.sleep(sink.spec["seconds"])
            sink.spec["seen"](sink.id, record)

    return Sleeps()


def test_lanes(spark, tmp_path):
    """Every record reaches every sink once; a document's records arrive in order."""
    log = str(tmp_path / "log")

    def seen(sink, record):
        with open(log, "a") as f:
            f.write(f"{sink} {record['documentId']} {record['eventId']}\n")

    S.register_transport("sleeps", slow_or_fast)
    sinks = [Sink(f"s{i}", "c", "sleeps", {"seconds": 0.1 if i == 0 else 0.01, "seen": seen}) for i in range(10)]
    rows = [("c", "INSERT", None, None, None, f"e{i:03d}", f"d{i % 8}") for i in range(60)]
    records = spark.createDataFrame(rows, "tableName string, recordType string, newImage string, oldImage string, timestamp timestamp, eventId string, documentId string").withColumns({c: F.try_parse_json(c) for c in ("newImage", "oldImage")}).coalesce(1)
    from tideline.operators.routing import route

    got = S.deliver(route(records, sinks), sinks).collect()
    assert len(got) == 600 and all(r.ok and r.seconds >= 0.009 and r.wait >= 0 for r in got) and not any(r.full for r in got)
    order = {}
    for line in open(log):
        sink, doc, event = line.split()
        order.setdefault((sink, doc), []).append(event)
    assert len(order) == 80 and all(x == sorted(x) for x in order.values())


def test_a_slow_lane_holds_no_other():
    """One slow and nine fast sinks end in the slow one's time, the fast ones long before."""
    import queue

    class Sleeps:
        def __init__(self, seconds):
            self.seconds = seconds

        def send(self, record):
            time.sleep(self.seconds)

    results, began = queue.SimpleQueue(), time.monotonic()
    lanes = [S.Lane(lambda s=0.2 if i == 0 else 0.005: Sleeps(s), results) for i in range(10)]
    for e in range(40):
        for i, lane in enumerate(lanes):
            lane.submit(f"e{e}", f"s{i}", "{}", f"d{e % 8}")
    for lane in lanes:
        lane.close()
    for lane in lanes[1:]:
        lane.join()
    fast = time.monotonic() - began
    lanes[0].join()
    slow = time.monotonic() - began
    rows = [results.get() for _ in range(400)]
    assert results.empty() and not any(r[6] for r in rows)
    assert fast < 0.7 * slow and slow < 0.7 * sum(r[4] for r in rows)


def test_full_lanes_wait(monkeypatch):
    import queue

    monkeypatch.setattr(S, "QUEUE", 4)
    results = queue.SimpleQueue()

    class Slow:
        def send(self, record):
            time.sleep(0.05)

    lane = S.Lane(Slow, results)
    for i in range(6):
        lane.submit(f"e{i}", "s", "{}", "one document")
    lane.close()
    lane.join()
    rows = [results.get() for _ in range(6)]
    assert [r[0] for r in rows] == [f"e{i}" for i in range(6)]
    assert any(r[6] and r[5] > 0.01 for r in rows) and not rows[0][6]


def test_feed_tasks_hold_a_batch(spark, tmp_path, monkeypatch):
    """Files are written in small row groups, each a partition, and a task reads one by batches; no row group is held whole."""
    from pyspark.sql import functions as F

    from tideline.sources import token_feed as tf

    monkeypatch.setattr(tf, "GROUP", 64 << 10)
    monkeypatch.setattr(tf, "BATCH", 500)
    monkeypatch.setattr(tf.pq.ParquetFile, "read_row_group", None)
    n = F.col("id")
    token = F.lpad(F.hex("id"), 16, "0")
    document = F.parse_json(F.concat(F.lit('{"_id":"'), F.sha2(n.cast("string"), 256), F.lit('"}')))
    none = F.lit(None).cast("variant")
    changes = spark.range(20_000).select(F.struct(token.alias("_data")).alias("_id"), F.lit("insert").alias("operationType"), F.struct(n.alias("t"), F.lit(1).alias("i")).alias("clusterTime"), document.alias("documentKey"), none.alias("fullDocument"), none.alias("fullDocumentBeforeChange"))
    tf.write_feed(changes, f"file://{tmp_path}/feed", 1)
    index = tf.Index(str(tmp_path / "feed"))
    start, end = {"token": f"{4999:016X}", "with": False}, {"token": f"{14_999:016X}", "with": False}
    spans = tf.spans(index, start, end)
    assert len({g.path for g in index.groups()}) == 1 and len(index.groups()) > len(spans) > 2
    batches = [b for s in spans for b in tf._read({"path": str(tmp_path / "feed")}, s)]
    assert max(map(len, batches)) <= 500 and [x["_data"] for b in batches for x in b.column("_id").to_pylist()] == [f"{i:016X}" for i in range(5_000, 15_000)]


def test_lanes_replace_hung_workers(monkeypatch):
    """A call that hangs is an outcome; the records behind it are sent, in order. Calls need no thread of their own."""
    import queue
    import threading

    monkeypatch.setattr(S, "TIMEOUT", 0.3)
    called, started = [], []
    plain = threading.Thread.start
    monkeypatch.setattr(threading.Thread, "start", lambda t: (started.append(t), plain(t))[1])

    class Hangs:
        def xadd(self, stream, entry):
            event = json.loads(entry["event"])["eventId"]
            called.append(event)
            time.sleep(60 if event == "e2" else 0)

    results = queue.SimpleQueue()
    lane = S.Lane(lambda: S.RedisTransport("s", Hangs()), results)
    for i in range(200):
        lane.submit(f"e{i}", "s", json.dumps({"eventId": f"e{i}"}), "one document")
    lane.close()
    lane.join()
    rows = [results.get() for _ in range(200)]
    assert results.empty() and called == [r[0] for r in rows] == [f"e{i}" for i in range(200)]
    assert [r[3] for r in rows if not r[2]] == ["no answer within 0.3 s"] and 0.3 <= rows[2][4] < 5
    assert len(started) == S.WORKERS + 2


def test_building():
    unknown = S.build_transport(Sink("x", "c", "zzz"), S._REGISTRY)
    refused = S.build_transport(Sink("x", "c", "http", {}), S._REGISTRY)
    for t in (unknown, refused):
        with pytest.raises(S.DeliveryError):
            t.send(RECORD)
    assert S.build_transport(Sink("x", "c", "meilisearch", {"client": None}), S._REGISTRY).indexName == "c"
    assert {"http", "redis", "eventbridge", "meilisearch"} <= set(S.registered_types())
