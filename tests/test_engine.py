"""All engine queries against DuckDB at sf0.001, and the rules that are no queries."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tideline import queries as engine
from tideline.functions.changes import display_columns, key_labels, parse_record, record_json
from tideline.functions.filters import Filter
from tideline.operators import metrics, reads, routing, state
from tideline.operators.routing import Sink, Sinks
from tideline.plans.catalog import Catalog, Refused, catalog_tables, fingerprint, parse_config, reserved, validate_sink
from tideline.sources.feed import from_start, start_position, token_is_useless

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def norm(rows, order):
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, duck, name):
    df, rel = engine.QUERIES[name](spark, SF), duck.sql(engine.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    assert norm(df.collect(), [df.columns.index(c) for c in columns]) == norm(rel.fetchall(), [rel.columns.index(c) for c in columns])


def test_waits_in_all_buckets(spark):
    """The query shows each bucket, the number and the sum, and not the last bucket alone."""
    rows = engine.QUERIES["m_enqueue_wait"](spark, SF).collect()
    assert {r.sinkId for r in rows} == {"purchases", "low_k", "all"}
    for r in rows:
        le = [r[f"le_{i}"] for i in range(len(metrics.WAIT_BUCKETS))]
        assert le == sorted(le) and le[-1] <= r.n == r.within_33_s and r.total > 0 and r.ordered
    assert sum(r.le_0 for r in rows) >= 1  # the last record itself waits for nothing


def test_flagship_counts(spark):
    assert engine.flagship(spark, SF).count() == 33


def test_paging():
    assert reads.page_params() == (100, 0)
    assert reads.page_params("5000", "3") == (1000, 3)
    for bad in (("abc", None), ("0", None), ("-5", None), (None, "xyz"), (None, "-1")):
        with pytest.raises(reads.BadRequest):
            reads.page_params(*bad)
    assert reads.has_more(20, 20) and not reads.has_more(19, 20)


def test_lookup(spark):
    df = spark.range(3)
    assert reads.one(df.where("id = 2"), "row").id == 2
    with pytest.raises(reads.NotFound):
        reads.one(df.where("id = 9"), "row")


def test_start_position():
    assert start_position("82AB", "c") == ("token", "82AB")
    assert start_position("zz", "c") == ("checkpoint", "c")
    assert start_position(None, None) == ("now", None) and start_position(None, 0.0) == ("checkpoint", 0.0)
    assert token_is_useless(286) and token_is_useless(280, "x: cannot resume stream; the resume token was not found")
    assert not token_is_useless(280) and not token_is_useless(None, "timeout")


def test_from_start(spark):
    rows = [("0A", 10), ("0B", 20), ("0C", None)]
    df = spark.createDataFrame(rows, "k string, t long").select(F.struct(F.col("k").alias("_data")).alias("_id"), F.when(F.col("t").isNotNull(), F.struct(F.col("t"), F.lit(1).alias("i"))).alias("clusterTime"))
    got = lambda position, now=0: sorted(r[0] for r in from_start(df, position, now).select("_id._data").collect())
    assert got(start_position("0a", None)) == ["0B", "0C"] and got(start_position(None, 20.0)) == ["0B", "0C"]
    assert got(start_position(None, None), now=30) == ["0C"] and got(start_position("zz", None), now=5) == ["0A", "0B", "0C"]


def test_document_lookup(spark):
    df = spark.createDataFrame([("0123456789abcdef01234567", 1), ("plain", 2)], "_id string, n int")
    assert [r.n for r in reads.document(df, "0123456789ABCDEF01234567").collect()] == [1]
    assert reads.document(df, "plain").collect() == [] == reads.document(df.select(F.col("n").alias("_id")), "x").collect()
    sinks = spark.createDataFrame([("s", "a"), ("t", "b")], "id string, collectionId string")
    assert reads.sink(sinks, "a", "s").count() == 1 and reads.sink(sinks, "b", "s").count() == 0


def test_removals(spark):
    df = spark.sql("SELECT 1 AS _id, timestamp'2024-01-01 00:00:00' AS at, 'soon' AS note UNION ALL SELECT 2, timestamp'2024-03-01 00:00:00', 'late' UNION ALL SELECT 3, null, 'never'")
    now = F.expr("timestamp'2024-02-01 00:00:00'")
    (r,) = state.removals(df, "c", "at", now).select("*", F.to_json("oldImage").alias("j")).drop("newImage", "oldImage").collect()
    assert (r.recordType, r.documentId, r.eventId) == ("REMOVE", "1", "c:expired:1:20240101000000000000") and '"note":"soon"' in r.j
    assert state.removals(df, "c", "note", now).count() == 0  # no time, no expiry


def test_metric_lines(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.002), ("b", 40.0)], "sink string, seconds double")
    h = metrics.histogram(df, "seconds", metrics.WAIT_BUCKETS, "sink")
    assert {r.line for r in metrics.snapshot_histogram(h, "wait", "sink").collect()} == {"wait{sink=a} count=2 sum=0.502000", "wait{sink=b} count=1 sum=40.000000"}
    assert {r.line for r in metrics.snapshot(h, "n", "sink").collect()} == {"n{sink=a} 2", "n{sink=b} 1"}


def test_backoff(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (20,)], "n int").select(state.backoff(F.col("n")))
    assert [r[0] for r in df.collect()] == [1.0, 2.0, 4.0, 8.0, 300.0]


def test_record_json(spark):
    df = spark.sql("""SELECT 'p' AS tableName, 'MODIFY' AS recordType, parse_json('{"_id":"p1"}') AS newImage, cast(null AS variant) AS oldImage, timestamp'2024-01-02 03:04:05' AS timestamp, 'p:1' AS eventId, '' AS documentId""")
    text = df.select(record_json().alias("j")).first().j
    assert '"oldImage"' not in text and '"documentId"' not in text and '"eventId":"p:1"' in text
    back = spark.createDataFrame([(text,), ("broken",), ('{"tableName":"t","newImage":null,"timestamp":"no"}',)], "j string").select(parse_record(F.col("j")).alias("r")).select("r.eventId", "r.timestamp", F.col("r").isNull().alias("none"), F.col("r.newImage").isNull().alias("no_image")).collect()
    assert back[0].eventId == "p:1" and back[0].timestamp.year == 2024
    assert back[1].none and back[2].timestamp is None and back[2].no_image and not back[2].none


def test_display_columns(spark):
    df = spark.createDataFrame([(1, '{"b":1,"_id":"x"}'), (2, '{"c":1,"b":2}')], "i int, t string").coalesce(1).select(F.parse_json("t").alias("v"))
    assert display_columns(df, "v") == ["_id", "b", "c"]
    assert display_columns(df, "v", "c", "b") == ["c", "b", "_id"]
    assert key_labels("c", "b") == {"c": "PK", "b": "SK"}


def test_settlement_matrix(spark):
    events = spark.createDataFrame([("a",), ("b",), ("c",), ("none",)], "eventId string")
    outcomes = spark.createDataFrame([("a", "s", True, None), ("a", "t", True, None), ("b", "s", False, "x"), ("b", "t", True, None), ("c", "s", False, "y")], "eventId string, sinkId string, ok boolean, error string")
    settled = routing.settle(events, outcomes)
    assert {r.eventId: (r.settled, r.error) for r in settled.collect()} == {"a": (True, None), "b": (False, "x"), "c": (False, "y"), "none": (True, None)}
    assert {r.eventId: r.state for r in routing.settlement(settled, events.where("eventId = 'b'")).collect()} == {"a": "delivered", "b": "queued", "c": "unsettled", "none": "delivered"}


def test_live_sinks():
    a, b = Sink("a", "c", "http"), Sink("b", "c", "http", event_types=("INSERT",))
    loads = [[a, b], [a, Sink("b", "c", "http", event_types=("MODIFY",)), Sink("d", "c", "http")]]
    sinks = Sinks(lambda: loads[0])
    assert sinks.count() == 0 and len(sinks.refresh()) == 2
    assert sinks.apply(loads[1]) == {"removed": [], "added": ["d"], "updated": ["b"]}
    sinks.load = lambda: 1 / 0
    assert len(sinks.refresh()) == 3  # the last good ones
    assert sinks.remove("a") and not sinks.remove("a")
    sinks.register(Sink("r", "c", "http"))
    assert sinks.active["r"].type == "http" and sinks.count() == 3
    sinks.clear()
    with pytest.raises(ZeroDivisionError):
        sinks.refresh()


def test_gauge():
    values = iter([1, None, 3])

    def sample():
        v = next(values)
        if v is None:
            raise OSError
        return v

    g = metrics.Refreshed(sample)
    assert [g.read(t) for t in (0, 10, 15, 30)] == [1, 1, 1, 3]


def code(f, *args, **kwargs):
    with pytest.raises(Refused) as e:
        f(*args, **kwargs)
    return e.value.code


def test_catalog(spark):
    told, purged, dropped = [], [], []
    c = Catalog(publish=told.append, purge=purged.append)
    assert code(c.create, "") == "INVALID_NAME" and code(c.create, "system.x") == "RESERVED_NAME" and code(c.create, "config.dlq") == "RESERVED_NAME"
    assert code(c.create, "u", None, "s") == "INVALID_KEY" and code(c.create, "u", "k", "k") == "INVALID_KEY"
    assert c.create("u", "k", "s").protected and code(c.create, "u") == "COLLECTION_EXISTS" and reserved("system.") and not reserved("System.x")
    assert code(c.delete, "u") == "DELETION_PROTECTED" and code(c.protect, "u") == "PROTECTION_ENABLED"
    spec = {"endpoint": "http://x"}
    assert code(c.create_sink, "u", "1", "http", spec) == "STREAM_DISABLED"
    c.enable_stream("u", old_image=True)
    assert code(c.enable_stream, "u") == "STREAM_ENABLED"
    c.create_sink("u", "1", "http", spec, ["INSERT"], {"newImage": {"v": {"gt": 1}}})
    assert code(c.create_sink, "u", "2", "http", spec) == "SINK_EXISTS"
    assert code(c.update_sink, "u", "1", {"type": "redis"}) == "SINK_IMMUTABLE" and code(c.update_sink, "u", "1", {"type": "http"}) == "NOTHING_TO_UPDATE"
    assert c.update_sink("u", "1", {"eventTypes": ["REMOVE"]}).event_types == ("REMOVE",)
    assert code(c.get_sink, "u", "9") == "SINK_NOT_FOUND" and code(c.get, "v") == "COLLECTION_NOT_FOUND"
    assert code(c.enable_ttl, "u", "") == "INVALID_TTL"
    c.enable_ttl("u", "at")
    assert code(c.enable_ttl, "u", "other") == "TTL_ENABLED"
    assert c.disable_ttl("u").ttl_attribute is None and c.disable_ttl("u").ttl_attribute is None
    c.create("w"), c.enable_stream("w"), c.create_sink("w", "5", "http", spec)
    assert code(c.delete_sink, "u", "5") == "SINK_NOT_FOUND" and c.get_sink("w", "5").collection == "w"  # of another collection
    c.delete_sink("w", "5")
    assert code(c.get_sink, "w", "5") == "SINK_NOT_FOUND" == code(c.delete_sink, "w", "5") and told[-1] == "w"
    c.unprotect("w"), c.delete("w")
    purged.clear()
    collections, sinks = catalog_tables(spark, c)
    assert collections.count() == 1 and sinks.first().fingerprint == fingerprint("http", spec)
    c.disable_stream("u")
    assert code(c.disable_stream, "u") == "STREAM_DISABLED"
    c.unprotect("u"), c.unprotect("u")
    c.delete("u", dropped.append)
    assert not c.sinks and dropped == ["u"] and purged == ["u"] and told[-1] == "u"


def test_sink_rules():
    assert fingerprint("http", {"a": 1, "b": 2}) == fingerprint("http", {"b": 2, "a": 1}) != fingerprint("redis", {"a": 1, "b": 2})
    assert code(validate_sink, "mail", {"x": 1}) == "INVALID_SINK_TYPE" and code(validate_sink, "http", {}) == "INVALID_SINK_SPEC"
    assert code(validate_sink, "http", {"endpoint": "no"}) == "INVALID_SINK_SPEC" and code(validate_sink, "redis", {"url": "http://x", "stream": "s"}) == "INVALID_SINK_SPEC"
    assert code(validate_sink, "http", {"endpoint": "http://x"}, ["insert"]) == "INVALID_EVENT_TYPE"
    validate_sink("eventbridge", {"eventBusName": "b"})
    assert code(parse_config, "[]", set()) == "INVALID_BODY" and code(parse_config, '{"x":1}', {"y"}) == "INVALID_BODY"
    assert parse_config('{"x":1}', {"y"}, strict=False) == {"x": 1}


def test_plans_stay_narrow(spark):
    """Parsing, filtering and routing need the feed's one shuffle for old images, and no Python."""
    plan = engine.QUERIES["route"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan
    # what filters ask of an image is extracted once, whatever the number of sinks
    many = [Sink(f"s{i}", engine.COLLECTION, "http", {}, (), Filter.parse({"newImage": {"value": {"gt": i}, "event_type": {"eq": "purchase"}}})) for i in range(60)]
    plan = routing.route(engine.records(spark, SF), many)._jdf.queryExecution().optimizedPlan().toString()
    few = routing.route(engine.records(spark, SF), many[:2])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get") == few.count("try_variant_get") and plan.count("schema_of_variant") == few.count("schema_of_variant")
    scan = engine.QUERIES["get_document"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,33)" in scan and "o_totalprice" not in scan
    page = engine.QUERIES["scan_documents"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in page
