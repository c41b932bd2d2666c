"""Sources of change events: files as a stream or a batch, and the events table as a feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import CHANGE_TEXT


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.try_parse_json(c) for c in ("documentKey", "fullDocument", "fullDocumentBeforeChange")})


def read_changes(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    return _documents(spark.read.schema(CHANGE_TEXT).format(file_format).load(path))


def stream_changes(spark: SparkSession, path: str, file_format: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A stream of files of change events; max_files bounds a batch, which is the backpressure. Where it starts: `from_start`."""
    reader = spark.readStream.schema(CHANGE_TEXT).format(file_format)
    return _documents((reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path))


def micros(name: str):
    """Microseconds since 1970 of a time without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name})")


def feed_columns(events: DataFrame) -> DataFrame:
    """The events table as operations of documents by user: event_id, ts_us, user_id, op, and the fields of both images (new_, old_)."""
    own = W.partitionBy("user_id").orderBy("ts", "event_id")
    df = events.select("event_id", micros("ts").alias("ts_us"), "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    df = df.withColumns({f"prev_{c}": F.lag(c).over(own) for c in ("event_type", "value", "k")})
    fresh = F.col("prev_event_type").isNull() | (F.col("prev_event_type") == "error")
    op = F.when((F.col("event_type") == "error") & fresh, "rename").when(F.col("event_type") == "error", "delete").when(fresh, "insert").when(F.col("event_type") == "signup", "replace").otherwise("update")
    return df.drop("ts").withColumn("op", op)


def image_json(prefix: str = ""):
    """An image of the feed as JSON text."""
    return F.to_json(F.struct(F.col("user_id").alias("_id"), F.col(f"{prefix}event_type").alias("event_type"), F.col(f"{prefix}value").alias("value"), F.struct(F.col(f"{prefix}k").alias("k")).alias("props")))


def token(event: str = "event_id"):
    return F.lpad(F.hex(event), 16, "0")


def change_feed(events: DataFrame) -> DataFrame:
    """The same in the shape of change events, with event_id and ts_us beside them."""
    return _as_changes(feed_columns(events))


def _as_changes(df: DataFrame, *more: str) -> DataFrame:
    new = F.when(F.col("op").isin("insert", "update", "replace"), F.parse_json(image_json()))
    old = F.when(F.col("op").isin("update", "replace", "delete"), F.parse_json(image_json("prev_")))
    return df.select("event_id", "ts_us", F.struct(token().alias("_data")).alias("_id"), F.col("op").alias("operationType"), F.struct((F.col("ts_us") / 1_000_000).cast("long").alias("t"), F.lit(1).alias("i")).alias("clusterTime"), F.parse_json(F.to_json(F.struct(F.col("user_id").alias("_id")))).alias("documentKey"), new.alias("fullDocument"), old.alias("fullDocumentBeforeChange"), *more)


def as_text(changes: DataFrame, *more: str) -> DataFrame:
    """Change events with their documents as JSON, as files hold them; more: columns that go with them as they are."""
    return changes.select("_id", "operationType", "clusterTime", *(F.to_json(c).alias(c) for c in ("documentKey", "fullDocument", "fullDocumentBeforeChange")), *more)


def delta_feed(events: DataFrame) -> DataFrame:
    """The feed of the events table without what it can spare: documents of inserts and replacements, of updates the fields that changed, no earlier images."""
    changed = lambda c, x: F.when(~F.col(c).eqNullSafe(F.col(f"prev_{c}")), x)
    fields = F.to_json(F.struct(changed("event_type", F.col("event_type")).alias("event_type"), changed("value", F.col("value")).alias("value"), changed("k", F.col("k")).alias("props.k")))
    told = F.when(F.col("op") == "update", F.concat(F.lit('{"updatedFields":'), fields, F.lit("}")))
    whole = _as_changes(feed_columns(events).withColumn("updateDescription", told), "updateDescription")
    return whole.withColumns({"fullDocument": F.when(F.col("operationType") != "update", F.col("fullDocument")), "fullDocumentBeforeChange": F.lit(None).cast("variant")})


# -- options


def start_position(resume_token: str | None, checkpoint: float | None) -> tuple[str, str | float | None]:
    """Where a stream starts: after its token, else at the checkpoint of its enabling (seconds since 1970), else now. A broken token is none."""
    if resume_token and all(c in "0123456789abcdefABCDEF" for c in resume_token):
        return "token", resume_token
    return ("checkpoint", checkpoint) if checkpoint is not None else ("now", None)


def from_start(changes: DataFrame, position: tuple[str, str | float | None], now: float) -> DataFrame:
    """The events from a start position on. Tokens are ordered as text of one case; a time takes events of that second and later, and those without a time."""
    kind, value = position
    if kind == "token":
        return changes.where(F.upper("_id._data") > str(value).upper())
    since = now if kind == "now" else value
    return changes.where(F.coalesce(F.col("clusterTime.t") >= F.lit(int(since)), F.lit(True)))


#: Error codes, and parts of messages, after which a resume token is of no use.
TOKEN_CODES = (9, 50811, 286)
TOKEN_MESSAGES = (
    "resume token string was not a valid hex string",
    "KeyString format error",
    "cannot resume stream; the resume token was not found",
)


def token_is_useless(code: int | None, message: str = "") -> bool:
    return code in TOKEN_CODES or any(m in message for m in TOKEN_MESSAGES)
