"""Documents completed from deltas: what an update does to a document, and a stream of them across restarts."""

import json
import random

import pytest
from pyspark.sql import functions as F
from tideline.sources import token_feed as tf
from tideline.streaming.images import updated, use_rocksdb

DELTA = "_id struct<_data string>, operationType string, clusterTime struct<t bigint, i int>, documentKey string, fullDocument string, fullDocumentBeforeChange string, updateDescription string"


@pytest.mark.parametrize(
    ("document", "told", "after"),
    [
        ({"a": 1}, {"updatedFields": {"a": 2, "b": {"c": 1}}}, {"a": 2, "b": {"c": 1}}),
        ({"a": {"b": {"c": 1, "d": 2}}}, {"updatedFields": {"a.b.c": 9}, "removedFields": ["a.b.d"]}, {"a": {"b": {"c": 9}}}),
        ({"a": 1}, {"updatedFields": {"x.y.z": 1}}, {"a": 1, "x": {"y": {"z": 1}}}),
        ({"a": [1, 2, 3]}, {"updatedFields": {"a.1": 7, "a.4": 8}}, {"a": [1, 7, 3, None, 8]}),
        ({"a": [{"b": 1}, {"b": 2}]}, {"updatedFields": {"a.0.b": 5}, "removedFields": ["a.1.b"]}, {"a": [{"b": 5}, {}]}),
        ({"a": [1, 2, 3, 4], "b": {"c": [1, 2]}}, {"truncatedArrays": [{"field": "a", "newSize": 2}, {"field": "b.c", "newSize": 0}]}, {"a": [1, 2], "b": {"c": []}}),
        ({"a": 1, "b": None}, {"removedFields": ["zz", "a.b", "b"]}, {"a": 1}),
        ({"a": 1}, {"updatedFields": {"a.b": 2}}, {"a": 1}),
        ({"a": "é"}, None, {"a": "é"}),
        ({"a": [1]}, {"updatedFields": {"a.x": 2}, "truncatedArrays": [{"field": "q", "newSize": 1}, {"field": "a.7", "newSize": 1}]}, {"a": [1]}),
    ],
)
def test_updates(document, told, after):
    assert json.loads(updated(json.dumps(document), told and json.dumps(told))) == after


def text(x):
    return None if x is None else json.dumps(x)


def event(n, op, key, full=None, told=None, before=None):
    return ((f"{n:04X}",), op, (n, 1), text(key), text(full), text(before), text(told))


def followed(spark, folder):
    got = tf.stream_feed(spark, f"{folder}/in", deltas=True).select(F.col("_id._data").alias("token"), "operationType", F.to_json("fullDocument").alias("after"), F.to_json("fullDocumentBeforeChange").alias("before"))
    q = got.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    load = lambda x: x if x is None else json.loads(x)
    return {(int(r.token, 16), r.operationType): (load(r.before), load(r.after)) for r in spark.read.parquet(f"{folder}/out").collect()}


def test_documents_from_deltas(spark, tmp_path):
    use_rocksdb(spark)
    folder, a, b = f"file://{tmp_path}", {"_id": 1}, {"_id": {"$oid": "ab"}}
    write = lambda rows: tf.write_feed(spark.createDataFrame(rows, DELTA).withColumns({c: F.parse_json(c) for c in ("documentKey", "fullDocument", "fullDocumentBeforeChange")}).repartition(3), f"{folder}/in", 2)
    write([
        event(1, "insert", a, {"_id": 1, "v": 0}), event(3, "update", a, told={"updatedFields": {"v": 1}}), event(2, "insert", b, {"_id": {"$oid": "ab"}, "w": [1]}),
        event(4, "update", {"_id": 9}, told={"updatedFields": {"v": 1}}), event(5, "update", a, told={"updatedFields": {"x.y": 2}, "removedFields": ["v"]}),
    ])
    got = followed(spark, folder)
    assert got[1, "insert"] == (None, {"_id": 1, "v": 0}) and got[3, "update"] == ({"_id": 1, "v": 0}, {"_id": 1, "v": 1})
    assert got[5, "update"] == ({"_id": 1, "v": 1}, {"_id": 1, "x": {"y": 2}}) and got[4, "update"] == (None, None)
    write([
        event(6, "update", b, told={"updatedFields": {"w.1": 2}}), event(7, "replace", a, {"_id": 1, "n": 1}), event(8, "delete", a), event(9, "insert", a, {"_id": 1, "v": 5}),
        event(10, "update", a, {"_id": 1, "looked": "up"}, {"updatedFields": {"v": 6}}), event(11, "update", a, told={"updatedFields": {"z": 1}}), event(12, "drop", None), event(13, "invalidate", None),
    ])
    got = followed(spark, folder)
    assert got[6, "update"] == ({"_id": {"$oid": "ab"}, "w": [1]}, {"_id": {"$oid": "ab"}, "w": [1, 2]})
    assert got[7, "replace"] == ({"_id": 1, "x": {"y": 2}}, {"_id": 1, "n": 1}) and got[8, "delete"] == ({"_id": 1, "n": 1}, None)
    assert got[9, "insert"] == (None, {"_id": 1, "v": 5}) and got[10, "update"] == ({"_id": 1, "v": 5}, {"_id": 1, "looked": "up"})
    assert got[11, "update"] == ({"_id": 1, "looked": "up"}, {"_id": 1, "looked": "up", "z": 1}) and got[12, "drop"] == got[13, "invalidate"] == (None, None)
    assert len(got) == 13


def test_random_deltas(spark, tmp_path):
    """Many documents, in two parts, against a plain fold."""
    rng, rows, docs, want = random.Random(6), [], {}, {}
    for n in range(1, 200):
        key = rng.randrange(6)
        before = docs.get(key)
        if before is None:
            op, full, told, after = "insert", {"_id": key, "v": n}, None, {"_id": key, "v": n}
        elif rng.random() < 0.1:
            op, full, told, after = "delete", None, None, None
        else:
            name = rng.choice("abv")
            op, full, told, after = "update", None, {"updatedFields": {name: n}} if rng.random() < 0.7 else {"removedFields": [name]}, dict(before)
            after.update(told.get("updatedFields", {}))
            for x in told.get("removedFields", []):
                after.pop(x, None)
        docs[key] = after
        want[n, op] = (before, after)
        rows.append(event(n, op, {"_id": key}, full, told))
    use_rocksdb(spark)
    folder = f"file://{tmp_path}"
    for part in (rows[:120], rows[120:]):
        tf.write_feed(spark.createDataFrame(part, DELTA).withColumns({c: F.parse_json(c) for c in ("documentKey", "fullDocument", "fullDocumentBeforeChange")}), f"{folder}/in", 2)
        got = followed(spark, folder)
    assert got == want


def test_a_call_handles_many_documents(spark):
    """Documents share calls: each call gives one frame, in which every document's events are in the order of tokens, with its own state."""
    import pandas as pd

    from tideline.streaming.images import Images

    class Map(dict):
        containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.pop  # noqa: N815

    images = Images(None)
    images.last = Map({("d0",): ('{"n":0}', "00")})
    names = ["key", "token", "t", "i", "operationType", "documentKey", "fullDocument", "fullDocumentBeforeChange", "updateDescription"]
    events = [(f"d{d}", f"{n}{d}", n, 1, "insert" if n == 1 and d else "update", f"d{d}", f'{{"n":{d}}}' if n == 1 and d else None, None, f'{{"updatedFields":{{"n":{10 * n + d}}}}}') for n in (3, 1, 2) for d in range(200)]
    frames = [pd.DataFrame(events[at : at + 100], columns=names) for at in range(0, 600, 100)]
    (got,) = images.handleInputRows(("0",), iter(frames), None)
    assert len(got) == 600 and len(images.last) == 200
    for d, own in got.groupby("documentKey"):
        n = int(d[1:])
        assert [*own.token] == [f"{k}{n}" for k in (1, 2, 3)] and own.fullDocument.iloc[-1] == f'{{"n":{30 + n}}}' == images.last[d,][0]
        assert own.fullDocumentBeforeChange.iloc[-1] == f'{{"n":{20 + n}}}' and (own.fullDocumentBeforeChange.iloc[0] == '{"n":0}' if not n else own.fullDocumentBeforeChange.iloc[0] is None)
