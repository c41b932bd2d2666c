"""Queries for the engine's operators, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import shared_dir
from .functions.changes import display_columns, event_id, key_labels, parse_changes, parse_record, quarantined, record_json, until_terminal
from .functions.filters import Filter, event_type_allowed, filter_to_form, form_to_filter, match_image
from .functions.text import display_value, id_text, plain
from .operators import matching, metrics, paging, reads, routing, state
from .operators.routing import Sink, Sinks
from .plans import catalog
from .sources.feed import change_feed, delta_feed, micros, start_position
from .sources.token_feed import read_feed, stream_feed, write_feed
from .streaming import expiry
from .streaming.images import use_rocksdb
from .streaming.pipeline import Pipeline
from .streaming.sinks import DeliveryError, deliver, entry_too_large, register_transport, registered_transport
from .streaming.stores import Folders, ProcessedKeys, RetryQueue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- the feed over `events`

COLLECTION = "users"

FEED = """
WITH b AS (SELECT event_id, epoch_us(ts) AS ts_us, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
l AS (SELECT *, lag(event_type) OVER w AS pt, lag(value) OVER w AS pv, lag(k) OVER w AS pk FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
feed AS (SELECT *, CASE WHEN event_type = 'error' AND (pt IS NULL OR pt = 'error') THEN 'rename' WHEN event_type = 'error' THEN 'delete'
  WHEN pt IS NULL OR pt = 'error' THEN 'insert' WHEN event_type = 'signup' THEN 'replace' ELSE 'update' END AS op FROM l),
rec AS (SELECT *, 'users:' || upper(printf('%016x', event_id)) AS eid, CAST(user_id AS VARCHAR) AS did,
  CASE op WHEN 'insert' THEN 'INSERT' WHEN 'delete' THEN 'REMOVE' ELSE 'MODIFY' END AS rt,
  op <> 'delete' AS has_new, op <> 'insert' AS has_old FROM feed WHERE op <> 'rename')
"""


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_feed(table(spark, sf_dir, "events"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = feed(spark, sf_dir)
    return parse_changes(changes, COLLECTION, F.timestamp_micros("ts_us"))


def number(image: str, path: str, kind: str = "double"):
    return F.try_variant_get(image, path, kind)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share; it goes when the driver ends."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(p)
    files.deleteOnExit(p)
    return folder


def followed(spark: SparkSession, changes: DataFrame, *arrivals, position=None, now: float = 0.0) -> DataFrame:
    """operationType and token of what a stream takes: each arrival is written as files of a feed, and the stream started to take it to its end."""
    folder = new_folder(spark, "change-stream")
    for n, arrived in enumerate(arrivals):
        write_feed(changes.where(arrived), f"{folder}/in")
        got = stream_feed(spark, f"{folder}/in", None if n else position, now).select("operationType", F.col("_id._data").alias("token"))
        taken = got.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        taken.awaitTermination()
    return spark.read.schema("operationType string, token string").parquet(f"{folder}/out")


@query("src_change_stream", FEED + "SELECT op AS operation, count(*) AS n, sum(event_id)::BIGINT AS ids FROM feed GROUP BY op")
def _(spark, sf_dir):
    """The feed as files of change events, taken as a stream to its end."""
    out = followed(spark, feed(spark, sf_dir), F.lit(True))
    return out.groupBy(F.col("operationType").alias("operation")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv("token", 16, 10).cast("long")).alias("ids"))


@query("s_resume", FEED + "SELECT event_id, op AS operation, 1::BIGINT AS times FROM feed")
def _(spark, sf_dir):
    """The feed's first half, then the rest, by a stream that is stopped between them."""
    changes = feed(spark, sf_dir)
    half = changes.agg(F.floor(F.avg("event_id"))).first()[0]
    out = followed(spark, changes, F.col("event_id") <= half, F.col("event_id") > half)
    return out.groupBy(F.conv("token", 16, 10).cast("long").alias("event_id"), F.col("operationType").alias("operation")).agg(F.count(F.lit(1)).alias("times"))


def second_of(changes: DataFrame, event: int) -> int:
    """When an event of the feed was, in whole seconds."""
    return changes.where(F.col("event_id") == event).select("clusterTime.t").first()[0]


_SECOND = "(SELECT min(event_id) FROM feed WHERE ts_us // 1000000 >= (SELECT ts_us // 1000000 FROM feed WHERE event_id = {}))"


@query("src_stream_options", FEED + f"""SELECT 'token' AS start, event_id FROM feed WHERE event_id > 50 UNION ALL SELECT 'checkpoint', event_id FROM feed WHERE event_id >= {_SECOND.format(60)}
  UNION ALL SELECT 'now', event_id FROM feed WHERE event_id >= {_SECOND.format(70)}""")
def _(spark, sf_dir):
    """After a token; at the checkpoint where the token is broken; else now. Files before the start are not read."""
    changes, folder = feed(spark, sf_dir), new_folder(spark, "feed")
    checkpoint, now = second_of(changes, 60), second_of(changes, 70)
    write_feed(changes, folder)
    positions = [start_position(f"{50:016X}", checkpoint), start_position("broken", checkpoint), start_position(None, None)]

    def taken(position):
        kind, value = position
        read = read_feed(spark, folder, after=value) if kind == "token" else read_feed(spark, folder, since=now if kind == "now" else value)
        return read.select(F.lit(kind).alias("start"), F.conv("_id._data", 16, 10).cast("long").alias("event_id"))

    return taken(positions[0]).unionByName(taken(positions[1])).unionByName(taken(positions[2]))


@query("s_first_start", FEED + f"SELECT op AS operation, count(*) AS n FROM feed WHERE event_id >= {_SECOND.format(80)} GROUP BY op")
def _(spark, sf_dir):
    """A stream that starts at the second of its enabling."""
    changes = feed(spark, sf_dir)
    out = followed(spark, changes, F.lit(True), position=start_position(None, second_of(changes, 80)))
    return out.groupBy(F.col("operationType").alias("operation")).agg(F.count(F.lit(1)).alias("n"))


@query("parse_terminal", FEED + "SELECT event_id, CASE event_id WHEN 400 THEN 'invalidate' ELSE op END AS operation FROM feed WHERE event_id <= 400")
def _(spark, sf_dir):
    """What is behind an invalidation is left, whatever else ends there."""
    e = F.col("event_id")
    changes = feed(spark, sf_dir).withColumn("operationType", F.when(e == 400, "invalidate").when(e % 600 == 599, "drop").otherwise(F.col("operationType")))
    return until_terminal(changes)[0].select("event_id", F.col("operationType").alias("operation"))


@query("parse_change", FEED + """SELECT eid AS eventId, did AS documentId, rt AS recordType, 'users' AS tableName, ts_us,
  CASE WHEN has_new THEN event_type END AS new_type, CASE WHEN has_new THEN value END AS new_value, CASE WHEN has_old THEN pt END AS old_type, CASE WHEN has_old THEN pk END AS old_k FROM rec""")
def _(spark, sf_dir):
    return records(spark, sf_dir).select("eventId", "documentId", "recordType", "tableName", F.unix_micros("timestamp").alias("ts_us"), number("newImage", "$.event_type", "string").alias("new_type"), number("newImage", "$.value").alias("new_value"), number("oldImage", "$.event_type", "string").alias("old_type"), number("oldImage", "$.props.k", "long").alias("old_k"))


@query("update_lookup", FEED + """SELECT eid AS eventId, rt AS recordType, CASE WHEN has_new THEN event_type END AS new_type, CASE WHEN has_new THEN value END AS new_value, CASE WHEN has_new THEN k END AS new_k,
  CASE WHEN has_old THEN pt END AS old_type, CASE WHEN has_old THEN pv END AS old_value, CASE WHEN has_old THEN pk END AS old_k FROM rec""")
def _(spark, sf_dir):
    """A feed of deltas alone, by a stream that keeps documents in state and is stopped halfway: the images of the whole feed."""
    use_rocksdb(spark)
    deltas, folder = delta_feed(table(spark, sf_dir, "events")), new_folder(spark, "deltas")
    half = deltas.agg(F.floor(F.avg("event_id"))).first()[0]
    for arrived in (F.col("event_id") <= half, F.col("event_id") > half):
        write_feed(deltas.where(arrived), f"{folder}/in")
        records = parse_changes(stream_feed(spark, f"{folder}/in", deltas=True), COLLECTION)
        asked = {f"{side}_{name}": number(f"{side}Image", path, kind) for side in ("new", "old") for name, path, kind in (("type", "$.event_type", "string"), ("value", "$.value", "double"), ("k", "$.props.k", "long"))}
        got = records.select("eventId", "recordType", *(c.alias(n) for n, c in asked.items()))
        got.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(got.schema).parquet(f"{folder}/out")


@query("parse_unknown_skip", FEED + "SELECT 'users:' || upper(printf('%016x', event_id)) AS eventId, 'unknown operation type: rename' AS reason FROM feed WHERE op = 'rename'")
def _(spark, sf_dir):
    return quarantined(feed(spark, sf_dir), COLLECTION)


@query("event_id", FEED + """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'users:' || upper(printf('%016x', event_id)) WHEN 1 THEN 'users:' || (ts_us // 1000000) || ':1:{"_id":' || user_id || '}'
  WHEN 2 THEN 'users:{"_id":' || user_id || '}' ELSE '' END AS eventId FROM feed""")
def _(spark, sf_dir):
    r = F.col("event_id") % 4
    df = feed(spark, sf_dir).withColumns({"_id": F.when(r == 0, F.col("_id")), "clusterTime": F.when(r == 1, F.col("clusterTime")), "documentKey": F.when(r < 3, F.col("documentKey"))})
    return df.select("event_id", event_id(COLLECTION).alias("eventId"))


@query("document_id", FEED + """SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN 'u-' || user_id WHEN 2 THEN printf('%024x', user_id) ELSE '' END AS documentId FROM feed""")
def _(spark, sf_dir):
    r, user = F.col("event_id") % 4, F.col("user_id")
    key = F.when(r == 0, F.to_json(F.struct(user.alias("_id")))).when(r == 1, F.to_json(F.struct(F.concat(F.lit("u-"), user.cast("string")).alias("_id")))).when(r == 2, F.to_json(F.struct(F.struct(F.lpad(F.lower(F.hex(user)), 24, "0").alias("$oid")).alias("_id")))).otherwise("{}")
    return table(spark, sf_dir, "events").select("event_id", id_text(F.try_variant_get(F.parse_json(key), "$['_id']", "variant")).alias("documentId"))


@query("old_image_toggle", FEED + "SELECT rt AS recordType, kept, count(*) AS n, (CASE WHEN kept THEN count(*) FILTER (has_old) ELSE 0 END)::BIGINT AS old_images FROM rec, (VALUES (true), (false)) AS k(kept) GROUP BY rt, kept")
def _(spark, sf_dir):
    one = lambda kept: parse_changes(feed(spark, sf_dir), COLLECTION, F.timestamp_micros("ts_us"), old_image=kept).groupBy("recordType").agg(F.count(F.lit(1)).alias("n"), F.count("oldImage").alias("old_images")).withColumn("kept", F.lit(kept))
    return one(True).unionByName(one(False))


@query("parse_record_json", FEED + "SELECT eid AS eventId, did AS documentId, rt AS recordType, ts_us, has_new, has_old, CASE WHEN has_new THEN k END AS new_k FROM rec")
def _(spark, sf_dir):
    back = records(spark, sf_dir).select(parse_record(record_json()).alias("r")).select("r.*")
    return back.select("eventId", "documentId", "recordType", F.unix_micros("timestamp").alias("ts_us"), F.col("newImage").isNotNull().alias("has_new"), F.col("oldImage").isNotNull().alias("has_old"), number("newImage", "$.props.k", "long").alias("new_k"))


@query("sink_json", FEED + """SELECT eid AS eventId, '{"tableName":"users","recordType":"' || rt || '"' || CASE WHEN has_new THEN ',"newImage":' || '{"_id":' || user_id || ',"event_type":"' || event_type || '","props":{"k":' || k || '},"value":#}' ELSE '' END
  || CASE WHEN has_old THEN ',"oldImage":' || '{"_id":' || user_id || ',"event_type":"' || pt || '","props":{"k":' || pk || '},"value":#}' ELSE '' END
  || ',"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","eventId":"' || eid || '","documentId":"' || did || '"}' AS json, CASE WHEN has_new THEN value END AS new_value FROM rec""")
def _(spark, sf_dir):
    text = record_json()
    # numbers have several spellings: they are compared as numbers
    return records(spark, sf_dir).select("eventId", F.regexp_replace(text, r'"value":[-+0-9.eE]+', '"value":#').alias("json"), F.get_json_object(text, "$.newImage.value").cast("double").alias("new_value"))


@query("display_value", FEED + """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '–' WHEN 1 THEN 'null' WHEN 2 THEN event_type WHEN 3 THEN '{"k":' || k || '}' ELSE repeat('x', 120) || '…' END AS shown FROM feed""")
def _(spark, sf_dir):
    r = F.col("event_id") % 5
    text = F.when(r == 0, "{}").when(r == 1, '{"v":null}').when(r == 2, F.concat(F.lit('{"v":"'), F.col("event_type"), F.lit('"}'))).when(r == 3, F.concat(F.lit('{"v":'), F.col("props"), F.lit("}"))).otherwise(F.concat(F.lit('{"v":"'), F.repeat(F.lit("x"), 130), F.lit('"}')))
    return table(spark, sf_dir, "events").select("event_id", display_value(F.try_variant_get(F.parse_json(text), "$.v", "variant")).alias("shown"))


@query("display_columns", """WITH page AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS r, ['_id', 'p_' || o_orderpriority[1], 'price', 's_' || o_orderstatus] AS keys FROM orders ORDER BY o_orderkey LIMIT 20),
  k AS (SELECT r, unnest(keys) AS name, generate_subscripts(keys, 1) AS pos FROM page), f AS (SELECT name, min(r * 10 + pos) AS first FROM k GROUP BY name)
  SELECT name, (row_number() OVER (ORDER BY name <> 'price', first) - 1)::BIGINT AS place, CASE name WHEN 'price' THEN 'PK' END AS label FROM f""")
def _(spark, sf_dir):
    page = reads.documents(table(spark, sf_dir, "orders"), 20, key="o_orderkey")
    text = F.concat(F.lit('{"_id":'), F.col("o_orderkey").cast("string"), F.lit(',"price":1,"s_'), F.col("o_orderstatus"), F.lit('":1,"p_'), F.substring("o_orderpriority", 1, 1), F.lit('":1}'))
    labels = key_labels("price")
    names = display_columns(page.select(F.parse_json(text).alias("image")), "image", "price")
    return spark.createDataFrame([(n, i, labels.get(n)) for i, n in enumerate(names)], "name string, place long, label string")


# -- filters, over images with all kinds of values

_RICH = """SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id FROM events"""


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and an image: note is null, text or missing; tags an array; flag a boolean; n a whole or broken number, or text."""
    e, r = F.col("event_id"), F.col("event_id") % 3
    note = F.when(r == 0, ',"note":null').when(r == 1, ',"note":"x"').otherwise("")
    n = F.when(r == 0, e.cast("string")).when(r == 1, F.concat(e.cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit('"'), e.cast("string"), F.lit('"')))
    text = F.concat(F.lit('{"event_type":"'), F.col("event_type"), F.lit('","value":'), F.col("value").cast("string"), F.lit(',"props":'), F.col("props"), F.lit(',"a":{"b":{"c":'), e.cast("string"), F.lit('}},"tags":["t'), (e % 4).cast("string"), F.lit('",'), (e % 5).cast("string"), F.lit(',true],"flag":'), (e % 2 == 0).cast("string"), F.lit(',"big":9007199254740993,"n":'), n, note, F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", F.parse_json(text).alias("image"))


#: name -> (block of conditions, the same as SQL over event_id, event_type, value, k)
FILTERS = {
    "f_eq": ({"event_type": {"eq": "purchase"}}, "event_type = 'purchase'"),
    "f_eq_number": ({"n": {"eq": 30}}, "event_id % 3 = 0 AND event_id = 30"),
    "f_eq_big": ({"big": {"eq": 9007199254740992}}, "true"),
    "f_eq_bool": ({"flag": {"eq": True}}, "event_id % 2 = 0"),
    "f_eq_object": ({"a.b": {"eq": {"c": 12}}}, "event_id = 12"),
    "f_ne": ({"note": {"ne": "x"}}, "event_id % 3 = 0"),
    "f_gt": ({"value": {"gt": 100}}, "value > 100"),
    "f_gte": ({"props.k": {"gte": 50}}, "k >= 50"),
    "f_lt": ({"n": {"lt": 20}}, "(event_id % 3 = 0 AND event_id < 20) OR (event_id % 3 = 1 AND event_id + 0.5 < 20)"),
    "f_lte": ({"props.k": {"lte": 10}}, "k <= 10"),
    "f_gt_text": ({"event_type": {"gt": 5}}, "false"),
    "f_contains_str": ({"event_type": {"contains": "ur"}}, "contains(event_type, 'ur')"),
    "f_contains_arr": ({"tags": {"contains": 3}}, "event_id % 5 = 3"),
    "f_contains_arr_text": ({"tags": {"contains": "t2"}}, "event_id % 4 = 2"),
    "f_starts": ({"n": {"startsWith": 12}}, "starts_with(CAST(event_id AS VARCHAR), '12')"),
    "f_ends": ({"n": {"endsWith": ".5"}}, "event_id % 3 = 1"),
    "f_starts_bool": ({"flag": {"startsWith": "tr"}}, "event_id % 2 = 0"),
    "f_exists": ({"note": {"exists": True}}, "event_id % 3 <> 2"),
    "f_exists_not": ({"note": {"exists": False}}, "event_id % 3 = 2"),
    "f_in": ({"event_type": {"in": ["purchase", "signup", 7]}}, "event_type IN ('purchase', 'signup')"),
    "f_in_empty": ({"event_type": {"in": []}}, "false"),
    "f_not_in": ({"note": {"notIn": ["x"]}}, "event_id % 3 = 0"),
    "f_not_in_empty": ({"note": {"notIn": []}}, "event_id % 3 <> 2"),
    "f_path": ({"a.b.c": {"lt": 100}}, "event_id < 100"),
    "f_path_missing": ({"a.x.c": {"exists": False}, "event_type.x": {"exists": False}, "tags.0": {"exists": False}}, "true"),
    "f_missing": ({"gone": {"eq": 1}}, "false"),
    "f_and_ops": ({"value": {"gt": 50, "lte": 150, "ne": 100}}, "value > 50 AND value <= 150 AND value <> 100"),
    "f_and_fields": ({"event_type": {"eq": "click"}, "props.k": {"gt": 20}, "flag": {"eq": False}}, "event_type = 'click' AND k > 20 AND event_id % 2 = 1"),
}

for _name, (_block, _sql) in FILTERS.items():
    QUERIES[_name] = lambda spark, sf_dir, b=_block: rich(spark, sf_dir).where(match_image(F.col("image"), b)).select("event_id")
    ORACLES[_name] = f"SELECT event_id FROM ({_RICH}) WHERE {_sql}"

FORM = [("event_type", "in", "purchase, view ,"), ("event_type", "ne", "view"), ("note", "exists", "true"), ("n", "eq", ""), ("", "eq", "x")]


@query("f_form_build", f"SELECT event_id FROM ({_RICH}) WHERE event_type = 'purchase' AND event_id % 3 <> 2")
def _(spark, sf_dir):
    made = form_to_filter([{"image": "newImage", "field": f, "operator": o, "value": v} for f, o, v in FORM])
    return rich(spark, sf_dir).where(match_image(F.col("image"), made["newImage"])).select("event_id")


@query("f_form_read", f"SELECT event_id FROM ({_RICH}) WHERE event_type IN ('purchase', 'click') AND event_id % 3 = 2 AND starts_with(CAST(event_id AS VARCHAR), '1')")
def _(spark, sf_dir):
    config = {"newImage": {"event_type": {"in": ["purchase", "click"]}, "note": {"exists": False}, "n": {"startsWith": 1}}}
    return rich(spark, sf_dir).where(match_image(F.col("image"), form_to_filter(filter_to_form(config))["newImage"])).select("event_id")


FILTER_A = {"newImage": {"event_type": {"eq": "purchase"}, "value": {"gt": 100}}}
FILTER_B = {"oldImage": {"props.k": {"lt": 10}}}
BOTH = {"newImage": {"value": {"gt": 50}}, "oldImage": {"event_type": {"ne": "view"}}}

SQL_A = "(has_new AND event_type = 'purchase' AND value > 100)"
SQL_B = "(has_old AND pk < 10)"


@query("f_blocks", FEED + "SELECT eid AS eventId FROM rec WHERE has_new AND value > 50 AND has_old AND pt <> 'view'")
def _(spark, sf_dir):
    return records(spark, sf_dir).where(Filter.parse(BOTH).column(F.col("newImage"), F.col("oldImage"))).select("eventId")


@query("f_non_map", "SELECT event_id FROM events WHERE event_id % 4 = 3")
def _(spark, sf_dir):
    r = F.col("event_id") % 4
    image = F.parse_json(F.when(r == 0, '"text"').when(r == 1, "42").when(r == 2, "[1]").otherwise("{}"))
    return table(spark, sf_dir, "events").where(match_image(image, {"x": {}})).select("event_id")


@query("f_event_type", FEED + "SELECT eid AS eventId FROM rec WHERE rt IN ('INSERT', 'REMOVE')")
def _(spark, sf_dir):
    return records(spark, sf_dir).where(event_type_allowed(F.col("recordType"), ["insert", "REMOVE"])).select("eventId")


# -- routing and settlement

SINKS = [
    Sink("purchases", COLLECTION, "http", {"endpoint": "http://a"}, (), Filter.parse(FILTER_A)),
    Sink("low_k", COLLECTION, "http", {"endpoint": "http://b"}, ("MODIFY", "REMOVE"), Filter.parse(FILTER_B)),
    Sink("all", COLLECTION, "redis", {"url": "redis://c", "stream": "s"}),
    Sink("elsewhere", "orders", "http", {"endpoint": "http://d"}),
]

ROUTED = FEED + f""", routed AS (
  SELECT *, 'purchases' AS sid FROM rec WHERE {SQL_A} UNION ALL SELECT *, 'low_k' FROM rec WHERE {SQL_B} AND rt <> 'INSERT' UNION ALL SELECT *, 'all' FROM rec),
outcomes AS (SELECT *, CASE sid WHEN 'all' THEN 'redis' ELSE 'http' END AS stype, event_id % 7 <> 0 OR sid = 'all' AS ok, CASE WHEN event_id % 7 <> 0 OR sid = 'all' THEN NULL ELSE sid || ' failed' END AS error FROM routed)
"""


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(records(spark, sf_dir), SINKS)


class _Odd:
    """A transport within the process: it takes every record but those whose event number divides by 7."""

    def __init__(self, sink: Sink):
        self.sink = sink

    def send(self, record: dict) -> None:
        if int(record["eventId"].rsplit(":", 1)[1], 16) % 7 == 0:
            raise DeliveryError(f"{self.sink.id} failed")


class _All(_Odd):
    def send(self, record: dict) -> None:
        pass


register_transport("odd", _Odd)
register_transport("all", _All)
#: The same sinks on transports within the process.
LOCAL = [replace(s, type="all" if s.id == "all" else "odd") for s in SINKS]


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of real deliveries, with the sinks' configured types."""
    kinds = F.create_map(*(F.lit(x) for s in SINKS for x in (s.id, s.type)))
    return deliver(routing.route(records(spark, sf_dir), LOCAL), LOCAL).withColumns({"sinkType": F.element_at(kinds, F.col("sinkId")), "tableName": F.lit(COLLECTION)})


@query("route", ROUTED + "SELECT eid AS eventId, did AS documentId, rt AS recordType, sid AS sinkId FROM routed")
def _(spark, sf_dir):
    return routed(spark, sf_dir).select("eventId", "documentId", "recordType", "sinkId")


#: A sink for every bound, of purchases above it and of clicks below.
BOUNDS = [Sink(f"{kind}{b}", COLLECTION, "http", {}, (), Filter.parse({"newImage": {"event_type": {"eq": kind}, "value": {op: b}}})) for b in range(100) for kind, op in (("purchase", "gt"), ("click", "lte"))]


@query("route_index", FEED + """SELECT event_type || b AS sinkId, count(*) AS n, sum(event_id)::BIGINT AS ids FROM rec, range(100) t(b)
  WHERE has_new AND ((event_type = 'purchase' AND value > b) OR (event_type = 'click' AND value <= b)) GROUP BY 1""")
def _(spark, sf_dir):
    """200 rules by an index over their predicates."""
    number = F.conv(F.substring_index("eventId", ":", -1), 16, 10).cast("long")
    return matching.route_by_index(records(spark, sf_dir), BOUNDS).groupBy("sinkId").agg(F.count(F.lit(1)).alias("n"), F.sum(number).alias("ids"))


@query("flagship_purchases", FEED + f"SELECT eid AS eventId, did AS documentId, rt AS recordType FROM rec WHERE {SQL_A}")
def flagship(spark, sf_dir):
    return routing.route(records(spark, sf_dir), SINKS[:1]).select("eventId", "documentId", "recordType")


@query("f_or", FEED + f"SELECT eid AS eventId FROM rec WHERE {SQL_A} OR ({SQL_B} AND rt <> 'INSERT')")
def _(spark, sf_dir):
    return routing.any_route(records(spark, sf_dir), SINKS[:2]).select("eventId")


@query("dispatch", ROUTED + "SELECT sid AS sinkId, ok, count(*) AS n FROM outcomes GROUP BY 1, 2")
def _(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy("sinkId", "ok").agg(F.count(F.lit(1)).alias("n"))


@query("settle", ROUTED + "SELECT eid AS eventId, bool_and(ok) AS settled, max(error) AS error FROM outcomes GROUP BY eid")
def _(spark, sf_dir):
    got = outcomes(spark, sf_dir)
    return routing.settle(records(spark, sf_dir), got)


AT = dt.datetime(2030, 1, 1, tzinfo=dt.UTC)


@query("process_event", ROUTED + """, said AS (SELECT eid, bool_and(ok) AS ok, max(error) AS error FROM outcomes GROUP BY eid)
  SELECT eid AS eventId, CASE WHEN ok THEN 'delivered' ELSE 'queued' END AS state, error, NOT ok AS retried, ok AS processed FROM said""")
def _(spark, sf_dir):
    """The stream's own path over the whole feed as one batch: states, the retry queue and processed keys that it leaves."""
    pipe = Pipeline(spark, COLLECTION, new_folder(spark, "pipeline"), lambda: LOCAL, lambda: AT)
    pipe.process_batch(feed(spark, sf_dir).drop("event_id", "ts_us"), 0)
    retried = pipe.table("retry").select(F.col("id").alias("eventId"), F.lit(True).alias("retried"))
    keys = pipe.table("processed").select("eventId", F.lit(True).alias("processed"))
    told = pipe.table("settled").join(retried, "eventId", "left").join(keys, "eventId", "left")
    return told.select("eventId", "state", "error", F.coalesce("retried", F.lit(False)).alias("retried"), F.coalesce("processed", F.lit(False)).alias("processed"))


_CURRENT = "SELECT s_suppkey AS id, 'f' || s_nationkey % 3 AS filter, 'INSERT' AS types FROM supplier WHERE s_suppkey % 5 <> 0"
_DESIRED = "SELECT s_suppkey AS id, 'f' || (CASE WHEN s_suppkey % 4 = 0 THEN 9 ELSE s_nationkey % 3 END) AS filter, CASE WHEN s_suppkey % 7 = 0 THEN 'MODIFY' ELSE 'INSERT' END AS types FROM supplier WHERE s_suppkey % 6 <> 0"
RECONCILE = f"""SELECT id, CASE WHEN d.id IS NULL THEN 'removed' WHEN c.id IS NULL THEN 'added' ELSE 'updated' END AS change
  FROM ({_CURRENT}) c FULL JOIN ({_DESIRED}) d USING (id) WHERE c.id IS NULL OR d.id IS NULL OR c.filter <> d.filter OR c.types <> d.types"""


def sink_configurations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """id, filter, eventTypes of the sinks that run, and of those that are wanted."""
    s = table(spark, sf_dir, "supplier")
    key, nation = F.col("s_suppkey"), F.col("s_nationkey") % 3
    current = s.where(key % 5 != 0).select(key.alias("id"), F.concat(F.lit("f"), nation.cast("string")).alias("filter"), F.lit("INSERT").alias("eventTypes"))
    desired = s.where(key % 6 != 0).select(key.alias("id"), F.concat(F.lit("f"), F.when(key % 4 == 0, 9).otherwise(nation).cast("string")).alias("filter"), F.when(key % 7 == 0, "MODIFY").otherwise("INSERT").alias("eventTypes"))
    return current, desired


def sink_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.reconcile(*sink_configurations(spark, sf_dir))


@query("reconcile_sinks", RECONCILE)
def _(spark, sf_dir):
    return sink_changes(spark, sf_dir)


@query("j_sink_diff", f"SELECT change, count(*) AS n FROM ({RECONCILE}) GROUP BY change")
def _(spark, sf_dir):
    return sink_changes(spark, sf_dir).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("reconcile_summary", f"SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'updated') AS updated FROM ({RECONCILE})")
def _(spark, sf_dir):
    return routing.reconcile_summary(sink_changes(spark, sf_dir))


def _configured(rows: DataFrame) -> list[Sink]:
    """A configuration's sinks are few."""
    return [Sink(str(r.id), COLLECTION, "http", {}, (r.eventTypes,), Filter.parse({"newImage": {"x": {"eq": r.filter}}})) for r in rows.collect()]


@query("reconcile_apply", f"SELECT CAST(id AS VARCHAR) AS id, change FROM ({RECONCILE})")
def _(spark, sf_dir):
    """The same by the sinks of a running stream."""
    current, desired = sink_configurations(spark, sf_dir)
    live = Sinks(lambda: _configured(current))
    live.refresh()
    changes = live.apply(_configured(desired))
    return spark.createDataFrame([(i, c) for c, ids in changes.items() for i in ids], "id string, change string")


@query("sink_update", FEED + """SELECT 'purchases' AS sinkId, eid AS eventId FROM rec WHERE has_new AND event_type = 'click' UNION ALL SELECT 'all', eid FROM rec
  UNION ALL SELECT 'late', eid FROM rec WHERE rt = 'REMOVE'""")
def _(spark, sf_dir):
    """Sinks change while a stream runs: a filter, one that goes, one that comes."""
    loads = [SINKS, [replace(SINKS[0], filter=Filter.parse({"newImage": {"event_type": {"eq": "click"}}})), *SINKS[2:], Sink("late", COLLECTION, "http", {}, ("REMOVE",))]]
    live = Sinks(lambda: loads.pop(0))
    live.refresh()
    return routing.route(records(spark, sf_dir), live.refresh()).select("sinkId", "eventId")


ABSENT = [Sink("lost", COLLECTION, "nowhere", {}, ("REMOVE",)), Sink("bare", COLLECTION, "http", {}, ("INSERT",))]


@query("sink_unavailable", FEED + "SELECT CASE rt WHEN 'REMOVE' THEN 'lost' ELSE 'bare' END AS sinkId, eid AS eventId, false AS ok, true AS told FROM rec WHERE rt <> 'MODIFY'")
def _(spark, sf_dir):
    """No such transport, and a spec without its field: every delivery fails and says why."""
    got = deliver(routing.route(records(spark, sf_dir), ABSENT), ABSENT)
    return got.select("sinkId", "eventId", "ok", (F.length("error") > 0).alias("told"))


MEETING = [Sink("u1", COLLECTION, "http"), Sink("u2", COLLECTION, "redis"), Sink("o1", "orders", "http")]


@query("j_records_sinks", FEED + """SELECT sid AS sinkId, count(*) AS n, sum(x)::BIGINT AS keys FROM (
  SELECT event_id AS x, unnest(['u1', 'u2']) AS sid FROM rec UNION ALL SELECT o_orderkey, 'o1' FROM orders) GROUP BY sid""")
def _(spark, sf_dir):
    # records of two collections meet the sinks of theirs
    orders = table(spark, sf_dir, "orders").select(F.lit("orders").alias("tableName"), F.lit("INSERT").alias("recordType"), F.to_variant_object(F.struct("o_orderkey")).alias("newImage"), F.lit(None).cast("variant").alias("oldImage"), F.lit(None).cast("timestamp").alias("timestamp"), F.concat(F.lit("orders:"), F.lpad(F.hex("o_orderkey"), 16, "0")).alias("eventId"), F.col("o_orderkey").cast("string").alias("documentId"))
    met = routing.route(records(spark, sf_dir).unionByName(orders), MEETING)
    key = F.conv(F.substring_index("eventId", ":", -1), 16, 10).cast("long")
    return met.groupBy("sinkId").agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("keys"))


# -- sinks


@query("sink_eventbridge", FEED + "SELECT rt AS recordType, has_new AND event_id % 50 = 0 AS too_large, count(*) AS n FROM rec GROUP BY 1, 2")
def _(spark, sf_dir):
    number = F.conv(F.substring_index("eventId", ":", -1), 16, 10).cast("long")
    large = F.parse_json(F.concat(F.lit('{"text":"'), F.repeat(F.lit("x"), 262_144), F.lit('"}')))
    padded = records(spark, sf_dir).withColumn("newImage", F.when((number % 50 == 0) & F.col("newImage").isNotNull(), large).otherwise(F.col("newImage")))
    return padded.groupBy("recordType", entry_too_large().alias("too_large")).agg(F.count(F.lit(1)).alias("n"))


class _Told:
    """A search client within the process: it says what it was asked for as the state of its task."""

    def upsert(self, index: str, document: dict) -> str:
        return f"upsert {index} {document['_id']}"

    def delete(self, index: str, key: str) -> str:
        return f"delete {index} {key}"

    def task(self, task: str) -> str:
        raise DeliveryError(task)


register_transport("search_told", lambda s: registered_transport(replace(s, type="meilisearch", spec=s.spec | {"client": _Told()})))
TOLD = [Sink("told", COLLECTION, "search_told")]


@query("sink_meilisearch", FEED + """SELECT eid AS eventId, CASE WHEN event_id % 6 = 5 AND rt <> 'REMOVE' THEN 'no image to index or to delete by' WHEN event_id % 6 = 4 AND rt <> 'REMOVE' THEN 'the new image is no object'
  WHEN rt = 'REMOVE' OR event_id % 6 = 3 THEN 'delete users ' || did ELSE 'upsert users ' || did END AS told FROM rec WHERE NOT (event_id % 6 = 3 AND rt = 'INSERT')""")
def _(spark, sf_dir):
    """Through the transport: whole records, changes with an old image alone, new images that are no objects, records without any."""
    r, kind = F.conv(F.substring_index("eventId", ":", -1), 16, 10).cast("long") % 6, F.col("recordType")
    rows = records(spark, sf_dir).where(~((r == 3) & (kind == "INSERT")))
    new = F.when(r == 4, F.parse_json(F.lit('"text"'))).when(r < 3, F.col("newImage"))
    rows = rows.withColumns({"newImage": F.when(kind != "REMOVE", new), "oldImage": F.when(r != 5, F.col("oldImage"))})
    return deliver(routing.route(rows, TOLD), TOLD).select("eventId", F.col("error").alias("told"))


SEARCH = [Sink("named", COLLECTION, "meilisearch", {"indexName": "own", "client": None}, (), Filter.parse(FILTER_A)), Sink("plain", COLLECTION, "meilisearch", {"client": None})]


@query("sink_index_default", FEED + f"SELECT 'own' AS indexName, count(*) FILTER ({SQL_A}) AS n FROM rec UNION ALL SELECT 'users', count(*) FROM rec")
def _(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for s in SEARCH for x in (s.id, registered_transport(s).indexName)))
    return routing.route(records(spark, sf_dir), SEARCH).groupBy(F.element_at(names, F.col("sinkId")).alias("indexName")).agg(F.count(F.lit(1)).alias("n"))


# -- bounded reads; managed collections are order priorities, documents orders, dead letters finished orders

MANAGED = "('1-URGENT', '2-HIGH', '3-MEDIUM')"
_DLQ = "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS c, epoch_us(o_orderdate) AS failed_us, 'orders:' || o_orderkey AS key FROM orders WHERE o_orderstatus = 'F'"


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("collectionName")).distinct()
    return names.where(F.col("collectionName").isin("1-URGENT", "2-HIGH", "3-MEDIUM")).withColumn("streamEnabled", F.col("collectionName") != "2-HIGH")


def dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return o.select(F.col("o_orderkey").cast("string").alias("_id"), F.col("o_orderpriority").alias("collectionName"), micros("o_orderdate").alias("failedAt"), F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string")).alias("dedupKey"))


@query("scan_documents", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 40")
def _(spark, sf_dir):
    return reads.documents(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), *reads.page_params(None, "40"), key="o_orderkey")


def clustered(spark: SparkSession, df: DataFrame, order: list[tuple[str, bool]], group: str | None = None) -> str:
    path = new_folder(spark, "clustered")
    paging.write_clustered(df, path, order, group)
    return path


@query("deep_page_documents", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 100 OFFSET (SELECT count(*) * 3 // 4 FROM lineitem)")
def _(spark, sf_dir):
    """A page far behind, by the places of files."""
    rows, order = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), [("l_orderkey", True), ("l_linenumber", True)]
    return paging.deep_page(spark, clustered(spark, rows, order), rows.schema, order, 100, rows.count() * 3 // 4)


@query("deep_page_dlq", f"SELECT id AS _id, failed_us AS failedAt, key AS dedupKey FROM ({_DLQ}) WHERE c = '3-MEDIUM' ORDER BY failed_us DESC, key LIMIT 20 OFFSET (SELECT count(*) // 2 FROM ({_DLQ}) WHERE c = '3-MEDIUM')")
def _(spark, sf_dir):
    rows, order = dead(spark, sf_dir), [("failedAt", False), ("dedupKey", True)]
    own = rows.where("collectionName = '3-MEDIUM'").count()
    return paging.deep_page(spark, clustered(spark, rows, order, "collectionName"), rows.schema, order, 20, own // 2, ("collectionName", "3-MEDIUM")).select("_id", "failedAt", "dedupKey")


@query("page_params_documents", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1000 OFFSET 3")
def _(spark, sf_dir):
    return reads.documents(table(spark, sf_dir, "orders").select("o_orderkey"), *reads.page_params("5000", "3"), key="o_orderkey")


@query("page_params_dlq", f"SELECT key AS dedupKey, failed_us AS failedAt FROM ({_DLQ}) WHERE c = '3-MEDIUM' ORDER BY failed_us DESC, key LIMIT 100")
def _(spark, sf_dir):
    return reads.dead_letters(dead(spark, sf_dir), collections(spark, sf_dir), "3-MEDIUM", *reads.page_params()).select("dedupKey", "failedAt")


@query("ui_page", "SELECT n_nationkey, r // 20 AS page, count(*) OVER (PARTITION BY r // 20) = 20 AS more FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation)")
def _(spark, sf_dir):
    pages = [reads.documents(table(spark, sf_dir, "nation").select("n_nationkey"), 20, 20 * p, key="n_nationkey").withColumn("page", F.lit(p).cast("long")) for p in range(2)]
    first, second = (p.withColumn("more", F.lit(reads.has_more(p.count(), 20))) for p in pages)
    return first.unionByName(second)


@query("get_document", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 33")
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return reads.document(orders, "33", "o_orderkey").unionByName(reads.document(orders, "33x", "o_orderkey"))


@query("scan_dlq", f"SELECT id AS _id, failed_us AS failedAt, key AS dedupKey FROM ({_DLQ}) WHERE c = '1-URGENT' ORDER BY failed_us DESC, key LIMIT 20 OFFSET 5")
def _(spark, sf_dir):
    return reads.dead_letters(dead(spark, sf_dir), collections(spark, sf_dir), "1-URGENT", 20, 5).select("_id", "failedAt", "dedupKey")


@query("get_dlq", f"SELECT id AS _id, c AS collectionName FROM ({_DLQ}) WHERE c = '2-HIGH' AND id = (SELECT min(id) FROM ({_DLQ}) WHERE c = '2-HIGH')")
def _(spark, sf_dir):
    d = dead(spark, sf_dir)
    first = d.where("collectionName = '2-HIGH'").agg(F.min("_id")).first()[0]
    return reads.dead_letter(d, "2-HIGH", first).select("_id", "collectionName")


@query("count_dlq", f"SELECT c AS collectionName, count(*) AS entries FROM ({_DLQ}) WHERE c IN {MANAGED} GROUP BY c")
def _(spark, sf_dir):
    return reads.count_dead_letters(dead(spark, sf_dir), collections(spark, sf_dir))


@query("m_dlq_entries", f"SELECT c AS collection, count(*) AS n FROM ({_DLQ}) GROUP BY c")
def _(spark, sf_dir):
    return metrics.counter(dead(spark, sf_dir).withColumnRenamed("collectionName", "collection"), "collection")


@query("j_managed_only", f"SELECT id AS _id FROM ({_DLQ}) WHERE c IN {MANAGED}")
def _(spark, sf_dir):
    return reads.managed(dead(spark, sf_dir), collections(spark, sf_dir)).select("_id")


@query("scan_collections", f"SELECT DISTINCT o_orderpriority AS collectionName, o_orderpriority <> '2-HIGH' AS streamEnabled FROM orders WHERE o_orderpriority IN {MANAGED}")
def _(spark, sf_dir):
    return collections(spark, sf_dir)


@query("get_collection", "SELECT DISTINCT o_orderpriority AS collectionName FROM orders WHERE o_orderpriority = '2-HIGH'")
def _(spark, sf_dir):
    return reads.collection(collections(spark, sf_dir), "2-HIGH").select("collectionName")


@query("scan_stream_enabled", f"SELECT DISTINCT o_orderpriority AS collectionName FROM orders WHERE o_orderpriority IN {MANAGED} AND o_orderpriority <> '2-HIGH'")
def _(spark, sf_dir):
    return reads.stream_enabled(collections(spark, sf_dir)).select("collectionName")


def _nation_sinks(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("collectionName"), "n_nationkey")
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("collectionName").alias("collectionId"))
    return s, n


@query("scan_sinks", "SELECT s_suppkey AS id, n_name AS collectionId FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation JOIN supplier ON s_nationkey = n_nationkey)")
def _(spark, sf_dir):
    s, n = _nation_sinks(spark, sf_dir)
    return reads.sinks_of(s, n, s.agg(F.min("collectionId")).first()[0])


@query("j_collection_sinks", "SELECT n_name AS collectionName, count(s_suppkey) AS sinks FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def _(spark, sf_dir):
    s, n = _nation_sinks(spark, sf_dir)
    return reads.with_sinks(n, s).groupBy("collectionName").agg(F.count("id").alias("sinks"))


@query("get_sink", "SELECT s_suppkey AS id, n_name AS collectionId FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 3")
def _(spark, sf_dir):
    s, _ = _nation_sinks(spark, sf_dir)
    own = s.where("id = 3").first()["collectionId"]
    return reads.sink(s, own, 3).unionByName(reads.sink(s, own + "x", 3))


# -- retries and dead letters; the queue is all orders

NOW = "1996-06-01 00:00:00"
_QUEUE = "SELECT 'orders:' || o_orderkey AS id, o_orderpriority AS c, o_orderkey % 6 AS n, 5 AS most, o_orderdate AS due, o_orderkey AS k FROM orders"


def retry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string"))
    body = F.when(F.col("o_orderkey") % 11 == 0, "broken").otherwise('{"tableName":"orders","recordType":"INSERT"}')
    return o.select(key.alias("id"), F.col("o_orderpriority").alias("collectionName"), body.alias("eventData"), (F.col("o_orderkey") % 6).cast("int").alias("retryCount"), F.lit(5).alias("maxRetries"), F.col("o_orderdate").alias("nextRetryAt"), F.lit(None).cast("string").alias("lastError"), F.lit(1).cast("long").alias("version"), F.lit(False).alias("removed"), F.col("o_orderkey"))


def _now():
    return F.expr(f"timestamp_ntz'{NOW}'")


@query("dequeue_retry", f"SELECT id, c AS collectionName, epoch_us(due) AS due_us FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY due, id) AS r FROM ({_QUEUE}) WHERE due <= TIMESTAMP '{NOW}') WHERE r <= 10")
def _(spark, sf_dir):
    return state.due(retry_queue(spark, sf_dir), _now()).select("id", "collectionName", micros("nextRetryAt").alias("due_us"))


def stored_queue(spark: SparkSession, sf_dir: str) -> RetryQueue:
    """The same as a stream keeps it; by months, as orders come over years."""
    queue = RetryQueue(Folders(spark, new_folder(spark, "queue")), 30 * 86_400)
    q = retry_queue(spark, sf_dir).withColumn("nextRetryAt", F.timestamp_micros(micros("nextRetryAt")))
    queue.put(q.drop("o_orderkey").repartition(F.unix_seconds("nextRetryAt").cast("long") / queue.bucket), "first")
    return queue


@query("s_retry_tick", f"SELECT id, epoch_us(due) AS due_us, ((r - 1) // 10)::INTEGER AS tick FROM (SELECT *, row_number() OVER (ORDER BY due, id) AS r FROM ({_QUEUE}) WHERE due <= TIMESTAMP '{NOW}') WHERE r <= 30")
def _(spark, sf_dir):
    """Three ticks, each of which takes the ten earliest that are left."""
    queue, at = stored_queue(spark, sf_dir), dt.datetime.fromisoformat(NOW).replace(tzinfo=dt.UTC)
    out = []
    for tick in range(3):
        rows = [(minute, r.id, r.version, r.nextRetryAt, tick) for minute, r in queue.due(F.lit(at).cast("timestamp"), at.timestamp())]
        taken = spark.createDataFrame(rows, "due long, id string, version long, at timestamp, tick int")
        queue.taken(taken, f"tick-{tick}")
        out.append(taken.select("id", F.unix_micros("at").alias("due_us"), "tick"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("retry_depth", f"SELECT c AS collectionName, count(*) AS depth FROM ({_QUEUE}) GROUP BY c")
def _(spark, sf_dir):
    return state.queue_depth(retry_queue(spark, sf_dir))


@query("m_retry_depth", f"SELECT c AS collection, count(*) AS n FROM ({_QUEUE}) GROUP BY c")
def _(spark, sf_dir):
    return metrics.counter(retry_queue(spark, sf_dir).withColumnRenamed("collectionName", "collection"), "collection")


@query("s_retry_queue", f"SELECT id, (n + 1)::INTEGER AS retryCount FROM ({_QUEUE}) WHERE k % 3 = 0 UNION ALL SELECT id, n::INTEGER FROM ({_QUEUE}) WHERE k % 3 = 1")
def _(spark, sf_dir):
    """A third of the queue is taken and comes again, a third is taken, a third stays."""
    queue = stored_queue(spark, sf_dir)
    key = F.substring_index("id", ":", -1).cast("long") % 3
    taken = queue.all().where(key != 1)
    queue.put(taken.where(key == 0).withColumns({"version": F.lit(2).cast("long"), "retryCount": F.col("retryCount") + 1}).repartition(8, "nextRetryAt"), "second")
    queue.taken(taken.where("version = 1").withColumn("due", queue._bucket()).repartition(8, "due"), "tick")
    return queue.all().select("id", "retryCount")


@query("s_retry_step", f"""SELECT id, CASE WHEN n >= most THEN 'dlq' WHEN k % 11 = 0 THEN 'drop' WHEN k % 2 = 0 THEN 'done' ELSE 'requeue' END AS action,
  (CASE WHEN n < most AND k % 11 <> 0 AND k % 2 = 1 THEN n + 1 ELSE n END)::INTEGER AS retryCount, CASE WHEN n < most AND k % 11 <> 0 AND k % 2 = 1 THEN least(300.0, pow(2.0, n))::DOUBLE END AS delay FROM ({_QUEUE})""")
def _(spark, sf_dir):
    q = retry_queue(spark, sf_dir)
    got = q.where("o_orderkey % 11 <> 0").select("id", (F.col("o_orderkey") % 2 == 0).alias("ok"), F.lit("refused").alias("error"))
    return state.retry_step(q, parse_record(F.col("eventData")).isNotNull(), got).select("id", "action", "retryCount", "delay")


@query("s_backoff", "SELECT DISTINCT l_linenumber * 3 AS attempt, least(300.0, pow(2.0, l_linenumber * 3 - 1))::DOUBLE AS seconds FROM lineitem")
def _(spark, sf_dir):
    attempt = (F.col("l_linenumber") * 3).alias("attempt")
    return table(spark, sf_dir, "lineitem").select(attempt).distinct().select("attempt", state.backoff(F.col("attempt")).alias("seconds"))


@query("s_idempotency", FEED + "SELECT eid AS eventId FROM rec WHERE NOT (event_id % 5 = 0 AND event_id % 2 = 0)")
def _(spark, sf_dir):
    """Records that come twice, against keys of which some are live and some have expired, as a stream keeps them."""
    r = records(spark, sf_dir)
    number = F.conv(F.substring_index("eventId", ":", -1), 16, 10).cast("long")
    keys = ProcessedKeys(Folders(spark, new_folder(spark, "keys")))
    for part, rest, until in (("live", 0, AT + dt.timedelta(hours=3)), ("old", 1, AT - dt.timedelta(minutes=1))):
        keys.put(r.where((number % 5 == 0) & (number % 2 == rest)).select("eventId"), f"{until:%Y-%m-%d-%H}", part, F.lit(until).cast("timestamp"))
    return keys.fresh(r.unionByName(r.where(number % 10 == 3)), F.lit(AT).cast("timestamp")).select("eventId")


QUERIES["j_idempotent_skip"], ORACLES["j_idempotent_skip"] = QUERIES["s_idempotency"], ORACLES["s_idempotency"]


@query("s_dlq_write", f"SELECT key AS dedupKey, failed_us AS failedAt FROM ({_DLQ}) WHERE CAST(id AS BIGINT) % 3 <> 0")
def _(spark, sf_dir):
    d = dead(spark, sf_dir)
    present = d.where(F.col("_id").cast("long") % 3 == 0)
    again = d.withColumn("failedAt", F.col("failedAt") + 1)
    return state.absent(present, d.unionByName(again)).select("dedupKey", "failedAt")


QUERIES["j_dlq_absent"], ORACLES["j_dlq_absent"] = QUERIES["s_dlq_write"], ORACLES["s_dlq_write"]


@query("s_expiry", f"SELECT 'orders' AS tableName, 'REMOVE' AS recordType, 'orders:expired:' || o_orderkey || ':' || strftime(o_orderdate, '%Y%m%d%H%M%S%f') AS eventId, CAST(o_orderkey AS VARCHAR) AS documentId, o_orderkey AS old_key FROM orders WHERE o_orderdate <= TIMESTAMP '{NOW}'")
def _(spark, sf_dir):
    gone = state.removals(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "orders", "o_orderdate", _now(), "o_orderkey")
    return gone.select("tableName", "recordType", "eventId", "documentId", F.try_variant_get("oldImage", "$.o_orderkey", "long").alias("old_key"))


@query("s_expiry_sweep", """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 400 DAY ELSE o_orderdate END AS till FROM orders WHERE o_orderkey % 7 <> 0),
  n(sweep, t) AS (VALUES (1, TIMESTAMP '1994-06-01'), (2, TIMESTAMP '1996-06-01'), (3, TIMESTAMP '1996-06-01'))
  SELECT min(sweep)::INTEGER AS sweep, CAST(k AS VARCHAR) AS documentId, 'orders:expired:' || k || ':' || strftime(any_value(till), '%Y%m%d%H%M%S%f') AS eventId FROM o, n WHERE till <= t GROUP BY k""")
def _(spark, sf_dir):
    """Orders that expire at their dates; some are moved to a later time, some removed before; three sweeps name each once."""
    o = table(spark, sf_dir, "orders")
    key, at = F.col("o_orderkey"), F.timestamp_micros(micros("o_orderdate"))
    image = lambda t: F.to_variant_object(F.struct(key.alias("_id"), t.alias("until")))
    record = lambda df, n, kind, new, old: df.select(F.lit("orders").alias("tableName"), F.lit(kind).alias("recordType"), new.alias("newImage"), old.alias("oldImage"), F.format_string(f"{n}:%012d", key).alias("eventId"), key.cast("string").alias("documentId"))
    none, later = F.lit(None).cast("variant"), F.timestamp_micros(micros("o_orderdate") + 400 * 86_400_000_000)
    swept = expiry.Expiry(Folders(spark, new_folder(spark, "expiry")), "orders", "until", 30 * 86_400)  # orders come over years
    swept.apply(record(o, 1, "INSERT", image(at), none), "batch-1")
    swept.apply(record(o.where(key % 5 == 0), 2, "MODIFY", image(later), image(at)).unionByName(record(o.where(key % 7 == 0), 3, "REMOVE", none, image(F.when(key % 5 == 0, later).otherwise(at)))), "batch-2")
    out = [swept.sweep(dt.datetime(y, 6, 1, 0, 0, n, tzinfo=dt.UTC)).select(F.lit(n).alias("sweep"), "documentId", "eventId") for n, y in ((1, 1994), (2, 1996), (3, 1996))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("s_order", FEED + "SELECT did AS documentId, eid AS eventId, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS place FROM rec")
def _(spark, sf_dir):
    """Places of rows as a task gets them."""
    dealt = state.in_order(records(spark, sf_dir)).select("documentId", "eventId", F.monotonically_increasing_id().alias("at"))
    return dealt.select("documentId", "eventId", F.row_number().over(Window.partitionBy("documentId").orderBy("at")).alias("place"))


# -- metrics


@query("m_events_processed", FEED + "SELECT 'users' AS collection, rt AS eventType, count(*) AS n FROM rec GROUP BY rt")
def _(spark, sf_dir):
    r = records(spark, sf_dir).select(F.col("tableName").alias("collection"), F.col("recordType").alias("eventType"))
    return metrics.counter(r, "collection", "eventType")


@query("m_sink_deliveries", ROUTED + "SELECT 'users' AS collection, stype AS sinkType, CASE WHEN ok THEN 'success' ELSE 'failure' END AS outcome, count(*) AS n FROM outcomes GROUP BY 2, 3")
def _(spark, sf_dir):
    o = outcomes(spark, sf_dir).select(F.col("tableName").alias("collection"), "sinkType", F.when(F.col("ok"), "success").otherwise("failure").alias("outcome"))
    return metrics.counter(o, "collection", "sinkType", "outcome")


@query("m_delivery_duration", ROUTED + "SELECT stype AS sinkType, count(*) AS within_10_s, count(*) AS n, true AS timed FROM outcomes GROUP BY stype")
def _(spark, sf_dir):
    # times differ from run to run; that each delivery has one does not
    h = metrics.histogram(outcomes(spark, sf_dir), "seconds", metrics.DELIVERY_BUCKETS, "sinkType")
    return h.select("sinkType", F.col(f"le_{len(metrics.DELIVERY_BUCKETS) - 1}").alias("within_10_s"), "n", (F.col("total") > 0).alias("timed"))


@query("m_deliveries_observed", ROUTED + """SELECT CASE sid WHEN 'all' THEN 'all' ELSE 'odd' END AS sinkType, CASE WHEN ok THEN 'success' ELSE 'failure' END AS outcome, count(*) AS n, NULL::BOOLEAN AS timed FROM outcomes GROUP BY 1, 2
  UNION ALL SELECT CASE sid WHEN 'all' THEN 'all' ELSE 'odd' END, 'any', count(*), true FROM outcomes GROUP BY 1""")
def _(spark, sf_dir):
    """What the stream's own delivery has counted on its way; its outcomes are not read again."""
    pipe = Pipeline(spark, COLLECTION, new_folder(spark, "observed"), lambda: LOCAL, lambda: AT)
    pipe.process_batch(feed(spark, sf_dir).drop("event_id", "ts_us"), 0)
    rows = [(k, outcome, n, None) for k, outcome, n in pipe.delivered.counters()]
    rows += [(k, "any", n, total > 0 and sorted(le) == le and le[-1] == n) for k, *le, n, total in pipe.delivered.histograms()]
    return spark.createDataFrame(rows, "sinkType string, outcome string, n long, timed boolean")


#: The buckets of waits in whole microseconds, of which sums are exact.
WAIT_MICROS = tuple(round(b * 1_000_000) for b in metrics.WAIT_BUCKETS)
_WAITS = ", ".join(f"count(*) FILTER (us <= {b}) AS le_{i}" for i, b in enumerate(WAIT_MICROS))


@query("m_enqueue_wait", ROUTED + f""", w AS (SELECT sid, (SELECT max(ts_us) FROM rec) - ts_us AS us FROM routed)
  SELECT sid AS sinkId, {_WAITS}, count(*) AS n, sum(us)::DOUBLE / 1e6 AS total, count(*) AS within_33_s, true AS ordered FROM w GROUP BY sid""")
def _(spark, sf_dir):
    """All buckets, of each routed record's wait for a batch that starts with the last record's time; beside them the waits of real deliveries, of whose buckets the times leave this fixed: each delivery has one, and they add up."""
    last = records(spark, sf_dir).agg(F.max(F.unix_micros("timestamp"))).first()[0]
    waits = routed(spark, sf_dir).select("sinkId", (F.lit(last) - F.unix_micros("timestamp")).cast("decimal(20,0)").alias("us"))
    told = metrics.histogram(waits, "us", WAIT_MICROS, "sinkId").withColumn("total", F.col("total").cast("double") / F.lit(1e6))
    h = metrics.histogram(outcomes(spark, sf_dir), "wait", metrics.WAIT_BUCKETS, "sinkId")
    rising = [F.col(f"le_{i}") <= F.col(f"le_{i + 1}") for i in range(len(metrics.WAIT_BUCKETS) - 1)]
    real = h.select("sinkId", F.col(f"le_{len(metrics.WAIT_BUCKETS) - 1}").alias("within_33_s"), reduce(and_, rising, (F.col("total") >= 0) & (F.col("n") > 0)).alias("ordered"))
    return told.join(real, "sinkId", "left")


@query("m_lane_delete", ROUTED + "SELECT sid AS sinkId, count(*) AS n FROM outcomes WHERE sid <> 'all' GROUP BY sid")
def _(spark, sf_dir):
    series = metrics.counter(outcomes(spark, sf_dir).withColumnRenamed("tableName", "collection"), "collection", "sinkId")
    return metrics.without_lane(series, COLLECTION, "all").select("sinkId", "n")


@query("m_snapshot", ROUTED + """ SELECT 'events{collection=users,eventType=' || rt || '} ' || count(*) AS line FROM rec GROUP BY rt
  UNION ALL SELECT 'depth{collection=' || o_orderpriority || '} ' || count(*) FROM orders GROUP BY o_orderpriority UNION ALL SELECT 'wait{sinkId=' || sid || '} count=' || count(*) FROM routed GROUP BY sid""")
def _(spark, sf_dir):
    lines = metrics.snapshot(QUERIES["m_events_processed"](spark, sf_dir), "events", "collection", "eventType")
    gauges = metrics.snapshot(QUERIES["m_retry_depth"](spark, sf_dir), "depth", "collection")
    spans = metrics.snapshot_histogram(metrics.histogram(outcomes(spark, sf_dir), "wait", metrics.WAIT_BUCKETS, "sinkId"), "wait", "sinkId").select(F.substring_index("line", " sum=", 1).alias("line"))  # sums of doubles have their own digits
    return lines.unionByName(gauges).unionByName(spans)


# -- control plane


@query("cp_reserved", "SELECT p_name, p_partkey % 3 = 0 OR p_partkey % 3 = 1 AS reserved FROM part")
def _(spark, sf_dir):
    r = F.col("p_partkey") % 3
    name = F.when(r == 0, F.concat(F.lit("system."), F.col("p_name"))).when(r == 1, F.lit("config.dlq")).otherwise(F.concat(F.lit("System."), F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_name", catalog.is_reserved(name).alias("reserved"))


@query("cp_key_validator", "SELECT 'missing' AS reason, count(*) FILTER (l_linenumber % 5 = 0) AS n FROM lineitem UNION ALL SELECT 'duplicate', coalesce(sum(c), 0)::BIGINT FROM (SELECT count(*) AS c FROM lineitem WHERE l_linenumber % 5 <> 0 GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def _(spark, sf_dir):
    line = F.when(F.col("l_linenumber") % 5 != 0, F.col("l_linenumber")).alias("l_linenumber")
    return catalog.key_violations(table(spark, sf_dir, "lineitem").select("l_orderkey", line), ["l_orderkey", "l_linenumber"])


@query("cp_key_index", "SELECT 'missing' AS reason, count(*) FILTER (l_orderkey % 9 = 0) AS n FROM lineitem UNION ALL SELECT 'duplicate', coalesce(sum(c), 0)::BIGINT FROM (SELECT count(*) AS c FROM lineitem WHERE l_orderkey % 9 <> 0 GROUP BY l_orderkey HAVING count(*) > 1)")
def _(spark, sf_dir):
    key = F.when(F.col("l_orderkey") % 9 != 0, F.col("l_orderkey")).alias("l_orderkey")
    return catalog.key_violations(table(spark, sf_dir, "lineitem").select(key), ["l_orderkey"])


@query("cp_key_arriving", """WITH k AS (SELECT l_orderkey AS o, l_linenumber AS l, count(*) AS c FROM lineitem WHERE l_linenumber > 2 GROUP BY 1, 2)
  SELECT 'missing' AS reason, coalesce(sum(c) FILTER (l = 7), 0)::BIGINT AS n FROM k UNION ALL SELECT 'duplicate', coalesce(sum(c) FILTER (l < 7 AND c > 1), 0)::BIGINT FROM k UNION ALL SELECT 'stored', coalesce(sum(c) FILTER (l = 3), 0)::BIGINT FROM k""")
def _(spark, sf_dir):
    """The first three lines of each order are stored; those from the third on arrive, the seventh without its number."""
    keys = catalog.UniqueKeys(Folders(spark, new_folder(spark, "unique")), ["l_orderkey", "l_linenumber"])
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    keys.insert(rows.where("l_linenumber <= 3").distinct(), "first")
    return keys.violations(rows.where("l_linenumber > 2").withColumn("l_linenumber", F.when(F.col("l_linenumber") < 7, F.col("l_linenumber"))))


@query("cp_fingerprint", """SELECT s_suppkey, sha256('{"spec":{"endpoint":"http://' || s_suppkey || '"},"type":"http"}') AS fingerprint FROM supplier""")
def _(spark, sf_dir):
    spec = F.concat(F.lit('{"endpoint":"http://'), F.col("s_suppkey").cast("string"), F.lit('"}'))
    return table(spark, sf_dir, "supplier").select("s_suppkey", catalog.fingerprint_column(F.lit("http"), spec).alias("fingerprint"))


#: A sink's configuration for each remainder of a nation's key, and what the rules say of it.
CONFIGURED = [("http", {"endpoint": "https://example.org"}, ()), ("ftp", {"endpoint": "https://example.org"}, ()), ("http", {}, ()), ("redis", {"url": "http://example.org", "stream": "s"}, ()), ("http", {"endpoint": "https://example.org"}, ("UPSERT",))]


def _said(sink_type: str, spec: dict, event_types: tuple) -> str:
    try:
        catalog.validate_sink(sink_type, spec, event_types)
    except catalog.Refused as error:
        return error.code
    return "valid"


@query("cp_sink_validate", "SELECT n_nationkey, ['valid', 'INVALID_SINK_TYPE', 'INVALID_SINK_SPEC', 'INVALID_SINK_SPEC', 'INVALID_EVENT_TYPE'][n_nationkey % 5 + 1] AS said FROM nation")
def _(spark, sf_dir):
    said = F.array(*(F.lit(_said(*c)) for c in CONFIGURED))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(said, (F.col("n_nationkey") % 5 + 1).cast("int")).alias("said"))


@query("scalar_plain_text", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '<nil>' WHEN 1 THEN '[' || event_id || ' x true]' WHEN 2 THEN 'map[a:' || event_id || ' b:[0.5 map[c:<nil> d:x y]]]' ELSE '1e+21' END AS shown FROM events")
def _(spark, sf_dir):
    e = F.col("event_id").cast("string")
    text = F.when(F.col("event_id") % 4 == 0, "null").when(F.col("event_id") % 4 == 1, F.concat(F.lit("["), e, F.lit(',"x",true]'))).when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"b":[0.5,{"d":"x y","c":null}],"a":'), e, F.lit("}"))).otherwise("1e21")
    return table(spark, sf_dir, "events").select("event_id", plain(F.parse_json(text)).alias("shown"))

