"""Deep pages, expiry and unique keys: the same rows as plain Python gives, and only the files they need."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from tideline.operators import paging
from tideline.plans import catalog
from tideline.streaming.expiry import Expiry
from tideline.streaming.stores import Folders


def test_deep_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paging, "ROWS", 100)
    rng = random.Random(1)
    rows = [(rng.randrange(10**6) * 10 + i % 10, "ab"[i % 3 == 0], i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, g string, n long").dropDuplicates(["k"])
    rows = [tuple(r) for r in df.collect()]
    path, order = f"file://{tmp_path}/all", [("k", True)]
    paging.write_clustered(df, path, order, files=4)
    want = sorted(rows)
    for limit, skip in ((10, 0), (100, 1950), (7, len(rows) - 3), (1000, 500), (5, len(rows)), (5, 10**9)):
        got = [tuple(r) for r in paging.deep_page(spark, path, df.schema, order, limit, skip).collect()]
        assert got == want[skip : skip + limit]
        files, before = paging.page_files(spark, path, limit, skip)
        assert len(files) <= 2 + limit // 60 and (not files or before > skip - 101)
    path, order = f"file://{tmp_path}/groups", [("n", False), ("k", True)]
    paging.write_clustered(df, path, order, "g", 4)
    own = sorted((r for r in rows if r[1] == "a"), key=lambda r: (-r[2], r[0]))
    assert [tuple(r) for r in paging.deep_page(spark, path, df.schema, order, 50, 1200, ("g", "a")).collect()] == own[1200:1250]
    assert paging.deep_page(spark, path, df.schema, order, 5, 0, ("g", "zz")).collect() == []
    empty = f"file://{tmp_path}/empty"
    paging.write_clustered(df.where("false"), empty, [("k", True)])
    assert paging.deep_page(spark, empty, df.schema, [("k", True)], 5, 0).collect() == []


def test_clustered_tables_are_sorted_in_bounded_tasks(spark, tmp_path, monkeypatch):
    """However many rows, no task sorts more than about SORTED of them."""
    monkeypatch.setattr(paging, "SORTED", 100)
    path = f"file://{tmp_path}/many"
    paging.write_clustered(spark.range(3000).withColumnRenamed("id", "k"), path, [("k", True)])
    sizes = [r["rows"] for r in spark.read.parquet(f"{path}/places").collect()]
    assert len(sizes) >= 25 and max(sizes) < 250 and sum(sizes) == 3000


def images(spark, rows):
    df = spark.createDataFrame(rows, "eventId string, recordType string, documentId string, new string, old string")
    return df.select("eventId", "recordType", "documentId", F.parse_json("new").alias("newImage"), F.parse_json("old").alias("oldImage"))


def test_expiry(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    doc = lambda minutes: f'{{"until":{{"$date":{int(start.timestamp() * 1000) + minutes * 60_000}}}}}'
    e = Expiry(Folders(spark, f"file://{tmp_path}"), "c", "until")
    e.apply(images(spark, [("1", "INSERT", "a", doc(30), None), ("2", "INSERT", "b", doc(90), None), ("3", "INSERT", "x", '{"until":5}', None), ("4", "INSERT", "y", "{}", None), ("5", "INSERT", "far", doc(6000), None), ("6", "INSERT", "back", doc(40), None)]), "p1")
    swept = lambda minutes: sorted(r.documentId for r in e.sweep(start + dt.timedelta(minutes=minutes)).collect())
    assert swept(10) == [] and len(e.seen) == 1
    change = [("7", "MODIFY", "back", doc(50), doc(40)), ("8", "MODIFY", "back", doc(40), doc(50)), ("9", "REMOVE", "b", None, doc(90)), ("A", "INSERT", "c", doc(20), None)]
    e.apply(images(spark, change), "p2")
    e.apply(images(spark, change), "p2")  # a batch that runs again
    assert swept(45) == ["a", "back", "c"] and swept(46) == []
    e.apply(images(spark, [("B", "INSERT", "a", doc(30), None)]), "p3")  # came back with a time that has passed
    keep, e._complete = e._complete, lambda sweep: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        swept(50)
    e._complete = keep
    assert swept(51) == [] and swept(200) == []
    assert sorted(r.documentId for r in e.removed().collect()) == ["a", "a", "back", "c"]
    assert e.folders.children("expiry", "due=")[0][0].endswith(str((int(start.timestamp()) + 6000 * 60) // 3600)) and len(e.folders.children("expiry", "due=")) == 1
    got = e.sweep(start + dt.timedelta(minutes=6001)).first()
    assert (got.recordType, got.documentId, got.eventId, "$date" in got.oldImage) == ("REMOVE", "far", "c:expired:far:20240105040000000000", True)


def test_unique_keys(spark, tmp_path):
    keys = catalog.UniqueKeys(Folders(spark, f"file://{tmp_path}"), ["a", "b"])
    rows = lambda *r: spark.createDataFrame(list(r), "a long, b string")
    for part in range(5):
        keys.insert(spark.range(part * 1000, part * 1000 + 1000).select(F.col("id").alias("a"), F.lit("x").alias("b")), f"p{part}")
    told = lambda df: {r.reason: r.n for r in keys.violations(df).collect()}
    assert told(rows((9000, "x"), (9001, "x"), (1, "y"))) == {"missing": 0, "duplicate": 0, "stored": 0}
    assert told(rows((1, "x"), (1, "x"), (2500, "x"), (None, "x"), (3, None), (8, "z"), (8, "z"))) == {"missing": 2, "duplicate": 4, "stored": 3}
    assert told(rows((2500, "x"))) == {"missing": 0, "duplicate": 0, "stored": 1} and spark.read.parquet(*keys.seen).count() <= 2000
    assert told(rows((12, "x1:x"), (1, "2:x"))) == {"missing": 0, "duplicate": 0, "stored": 0}
    with pytest.raises(catalog.Refused, match="1 stored"):
        keys.insert(rows((2500, "x"), (99_999, "x")), "late")
    keys.insert(rows((99_999, "x")), "late")
    assert told(rows()) == {"missing": 0, "duplicate": 0, "stored": 0}
