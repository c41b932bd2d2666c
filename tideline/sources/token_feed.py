"""A feed of change events as a data source whose offsets are resume tokens.

A feed is a folder of Parquet files of change events. Their footers tell the
lowest and highest token of each row group, so a range of tokens names the row
groups to read: a stream that starts at a token reads nothing before it, and one
that starts again goes on behind the token that it committed. Tokens are texts
of one case, in the order of their events' times. A range is dealt as one
partition for each row group; `maxRows` ends a batch behind the row group that
fills it.

A feed's head may be cut off (`trim_feed`). A start before that place is refused
with the message of a token that is not found, see feed.token_is_useless.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schema import CHANGE_TEXT
from .feed import TOKEN_MESSAGES, _documents, as_text, start_position

NAME = "tideline_feed"
#: The file that holds the token up to which a feed was cut off.
TRIMMED = "_trimmed"
NOT_HEX, NOT_FOUND = TOKEN_MESSAGES[0], TOKEN_MESSAGES[2]
_TEXTS = ("documentKey", "fullDocument", "fullDocumentBeforeChange")
#: Rows that a task holds of a row group, and bytes of each of its columns; bytes of a row group that is written, so that a large feed has many partitions.
BATCH, BUFFER, GROUP = 10_000, 1 << 20, 8 << 20
#: Of feeds of deltas, see streaming/images.py.
_DELTA = "updateDescription"
_SHAPE = pa.schema([("_id", pa.struct([("_data", pa.string())])), ("operationType", pa.string()), ("clusterTime", pa.struct([("t", pa.int64()), ("i", pa.int32())])), *((c, pa.string()) for c in _TEXTS)])


class FeedError(Exception):
    pass


@dataclass(frozen=True)
class Group:
    """A row group: its tokens' and times' bounds. Rows without a token stand at its highest."""

    path: str
    number: int
    rows: int
    low: str
    high: str
    last: int | None  # the latest second, None where a row has none


@dataclass
class Span(InputPartition):
    path: str
    number: int
    start: str
    end: str
    with_start: bool
    high: str

    def __init__(self, path: str, number: int, start: str, end: str, with_start: bool, high: str):
        self.path, self.number, self.start, self.end, self.with_start, self.high = path, number, start, end, with_start, high


class Index:
    """The row groups of a feed's files; a file's footer is read once."""

    def __init__(self, uri: str):
        self.files, self.root = pafs.FileSystem.from_uri(uri)
        self.known: dict[str, list[Group]] = {}

    def _footer(self, path: str) -> list[Group]:
        with self.files.open_input_file(path) as f:
            meta = pq.ParquetFile(f).metadata
        out = []
        for n in range(meta.num_row_groups):
            group = meta.row_group(n)
            stats = {group.column(c).path_in_schema: group.column(c).statistics for c in range(group.num_columns)}
            token, time = stats.get("_id._data"), stats.get("clusterTime.t")
            if not group.num_rows:
                continue
            if token is None or not token.has_min_max:
                raise FeedError(f"events without tokens in {path}")
            timed = time is not None and time.has_min_max and time.null_count == 0
            out.append(Group(path, n, group.num_rows, token.min.upper(), token.max.upper(), time.max if timed else None))
        return out

    def groups(self) -> list[Group]:
        """All row groups, by their highest token."""
        found = self.files.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))
        paths = [f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")) and f.size]
        self.known = {p: self.known[p] for p in paths if p in self.known}
        with ThreadPoolExecutor(8) as pool:
            new = [p for p in paths if p not in self.known]
            self.known |= dict(zip(new, pool.map(self._footer, new), strict=True))
        return sorted((g for p in paths for g in self.known[p]), key=lambda g: (g.high, g.path, g.number))

    def trimmed(self) -> str:
        try:
            with self.files.open_input_stream(f"{self.root}/{TRIMMED}") as f:
                return f.read().decode().strip()
        except FileNotFoundError:
            return ""

    def tokens(self, group: Group, *more: str) -> pa.Table:
        with self.files.open_input_file(group.path) as f:
            return pq.ParquetFile(f).read_row_group(group.number, columns=["_id._data", *more])

    def since(self, second: int) -> dict:
        """The offset of the first token of that second or later; behind the last one where there is none. Only row groups around it are read."""
        groups, first = self.groups(), None
        for g in groups:
            if (g.last is not None and g.last < second) or (first is not None and g.low >= first):
                continue
            rows = self.tokens(g, "clusterTime.t")
            times = pc.struct_field(rows["clusterTime"], "t")
            found = pc.min(pc.utf8_upper(pc.struct_field(rows["_id"], "_data")).filter(pc.fill_null(pc.greater_equal(times, second), True))).as_py()
            first = min(first, found) if first is not None and found is not None else found if first is None else first
        return {"token": first, "with": True} if first is not None else {"token": groups[-1].high if groups else "", "with": False}


def spans(index: Index, start: dict, end: dict) -> list[Span]:
    """A partition for each row group that holds tokens behind start (with it, where that is said) up to end."""
    if start["token"] < index.trimmed():
        raise FeedError(NOT_FOUND)
    reached = lambda g: g.high > start["token"] or (start["with"] and g.high == start["token"])
    return [Span(g.path, g.number, start["token"], end["token"], start["with"], g.high) for g in index.groups() if reached(g) and g.low <= end["token"]]


def _read(options, span: Span | None) -> Iterator[pa.RecordBatch]:
    if span is None:  # what Spark reads where there are no partitions
        return
    files, _ = pafs.FileSystem.from_uri(options["path"])
    shape = _SHAPE.append(pa.field(_DELTA, pa.string())) if options.get("deltas") else _SHAPE
    with files.open_input_file(span.path) as f:
        for batch in pq.ParquetFile(f, buffer_size=BUFFER).iter_batches(BATCH, [span.number], columns=shape.names):
            table = pa.Table.from_batches([batch])
            token = pc.fill_null(pc.utf8_upper(pc.struct_field(table["_id"], "_data")), span.high)
            behind = pc.greater_equal(token, span.start) if span.with_start else pc.greater(token, span.start)
            yield from table.filter(pc.and_(behind, pc.less_equal(token, span.end))).select(shape.names).cast(shape).to_batches()


def first_offset(index: Index, options: dict) -> dict:
    """By `after` (a token), else `since` (a second), else the feed's beginning."""
    token = options.get("after")
    if token is not None:
        if not re.fullmatch(r"[0-9a-fA-F]*", token):
            raise FeedError(NOT_HEX)
        if token.upper() < index.trimmed():
            raise FeedError(NOT_FOUND)
        return {"token": token.upper(), "with": False}
    if options.get("since") is not None:
        return index.since(int(float(options["since"])))
    return {"token": index.trimmed(), "with": False}


def next_offset(groups: list[Group], at: dict, most: int) -> dict:
    """The last token; with `most`, that of the row group that fills a batch behind `at`."""
    rows = 0
    for g in groups:
        if g.high > at["token"] or (at["with"] and g.high == at["token"]):
            rows += g.rows
            if most and rows >= most:
                return {"token": g.high, "with": False}
    last = groups[-1].high if groups else ""
    return {"token": last, "with": False} if rows else at


class TokenStream(DataSourceStreamReader):
    def __init__(self, options):
        self.options, self.index = options, Index(options["path"])
        # what a query that starts again has behind it is in its checkpoint, of which a source is told late
        self.at = {"token": options["position"].upper(), "with": False} if options.get("position") else None

    def initialOffset(self) -> dict:  # noqa: N802
        self.at = first_offset(self.index, self.options)
        return self.at

    def latestOffset(self) -> dict:  # noqa: N802
        groups = self.index.groups()
        if self.at is None and self.options.get("fresh"):  # a first start: Spark asks for the latest offset before the initial one
            self.at = first_offset(self.index, self.options)
        at = self.at or {"token": "", "with": False}
        return next_offset(groups, at, int(self.options.get("maxRows") or 0) if self.at else 0)

    def partitions(self, start: dict, end: dict) -> list[Span]:
        if self.at is None or end["token"] >= self.at["token"]:
            self.at = end
        return spans(self.index, start, end)

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        return _read(self.options, partition)

    def commit(self, end: dict) -> None:
        pass


class TokenBatch(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self) -> list[Span]:
        index = Index(self.options["path"])
        groups = index.groups()
        return spans(index, first_offset(index, self.options), {"token": (self.options.get("until") or (groups[-1].high if groups else "")).upper(), "with": False})

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        return _read(self.options, partition)


class TokenFeed(DataSource):
    """Options: path; after or since; until (batch); maxRows, position, fresh (stream); deltas: events have updateDescription."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return CHANGE_TEXT + (f", {_DELTA} string" if self.options.get("deltas") else "")

    def reader(self, schema) -> TokenBatch:
        return TokenBatch(self.options)

    def streamReader(self, schema) -> TokenStream:  # noqa: N802
        return TokenStream(self.options)


# -- use


def _options(spark: SparkSession, reader, path: str, options: dict):
    spark.dataSource.register(TokenFeed)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    reader = reader.format(NAME).option("path", full.replace("file:/", "file:///", 1) if re.match("file:/[^/]", full) else full)
    for name, value in options.items():
        if value is not None:
            reader = reader.option(name, str(value))
    return reader


def read_feed(spark: SparkSession, path: str, after: str | None = None, since: float | None = None, until: str | None = None) -> DataFrame:
    """The events behind a token, or of a second and later, up to a token; others are not read."""
    return _documents(_options(spark, spark.read, path, {"after": after, "since": since, "until": until}).load())


def stream_feed(spark: SparkSession, path: str, position: tuple[str, str | float | None] | None = None, now: float = 0.0, max_rows: int | None = None, behind: str | None = None, fresh: bool = False, deltas: bool = False) -> DataFrame:
    """The same as a stream. position: what feed.start_position gives, for a first start (none: the beginning). max_rows bounds batches as soon as the source knows where it is: a first start says so (fresh), and one that starts again has its last token behind it. With deltas, documents are completed by state."""
    kind, value = position or (None, None)
    start = {"after": value} if kind == "token" else {"since": now if kind == "now" else value} if kind else {}
    changes = _options(spark, spark.readStream, path, {**start, "maxRows": max_rows, "position": behind, "fresh": fresh or None, "deltas": deltas or None}).load()
    if deltas:
        from ..streaming.images import with_images

        changes = with_images(changes)
    return _documents(changes)


def write_feed(changes: DataFrame, path: str, files: int | None = None) -> None:
    """Append events to a feed as files of disjoint, sorted ranges of tokens, in row groups of about GROUP bytes; as many files as a shuffle has partitions where no number is given."""
    text = as_text(changes, *([_DELTA] if _DELTA in changes.columns else []))
    dealt = (text.repartitionByRange(files, "_id._data") if files else text.repartitionByRange("_id._data")).sortWithinPartitions("_id._data")
    dealt.write.mode("append").option("parquet.block.size", GROUP).parquet(path)


def trim_feed(spark: SparkSession, path: str, token: str) -> list[str]:
    """Cut a feed off behind a token: the mark is written first, then the files that hold nothing later go. Their names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{TRIMMED}"), True)
    out.write(bytearray(token.upper().encode()))
    out.close()
    last = spark.read.schema(CHANGE_TEXT).parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.max(F.upper("_id._data")).alias("high"))
    gone = [r["file"] for r in last.where(F.col("high") <= token.upper()).collect()]
    for name in gone:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(name), False)
    return gone


__all__ = ["FeedError", "TokenFeed", "read_feed", "start_position", "stream_feed", "trim_feed", "write_feed"]
