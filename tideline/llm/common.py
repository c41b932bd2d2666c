"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import shared_dir

#: A word is a longest run of anything but these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\v\f\r"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes that a running sum of hashes holds at a time.
RUN = 1 << 19
#: Bytes of rows that a task hands to its Python worker at a time, where the session has no such limit of its own.
BATCH_BYTES, BATCH_LIMIT = 1 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


#: The paths of each run of `scratch` that is going on in this thread, innermost last.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def _on_disk(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    p, files = _on_disk(spark, path)
    files.delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are saved inside go at the end; those to keep pass to the run around this one, if any. Nothing lazy may still read what goes."""
    mine: list[str] = []
    token = _scratch.set((*_scratch.get(), mine))
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in mine:
            remove(spark, path)


def new_folder(spark: SparkSession, keep: bool = False) -> str:
    """A new path in the shared folder, for a run of `scratch` to remove; what no run removes goes when the driver ends."""
    path = f"{shared_dir(spark)}/tideline-{uuid.uuid4().hex}"
    p, files = _on_disk(spark, path)
    files.mkdirs(p)
    files.deleteOnExit(p)
    runs = _scratch.get()[: -1 if keep else None]
    if runs:
        runs[-1].append(path)
    return path


def save(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = new_folder(spark, keep)
    df.write.parquet(f"{path}/{name}")
    return spark.read.schema(df.schema).parquet(f"{path}/{name}")


def bounded_batches(spark: SparkSession) -> None:
    """From now on tasks of this session hand rows to Python by about BATCH_BYTES, a row at least, instead of Spark's 10,000 rows or 64 MB.

    Operators take about as many bytes at a time as that (`slices`); what a larger
    batch holds beyond them is memory of the executor and of its worker, in each task.
    """
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def native_size(text="text"):
    """Number of words of a text as a Column; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def text_print(text="text"):
    """A 64-bit hash of a text as a Column: with doc_id it tells rows that repeat an id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about `limit` bytes, one row at least: what a task holds stays bounded."""
    size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64))
    at = 0
    while at < len(batch):
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array, and where each text begins (one entry more than texts). Null is empty."""
    big = pa.compute.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(big.buffers()[1], np.int64)[big.offset : big.offset + len(big) + 1] if len(big) else np.zeros(1, np.int64)
    data = np.frombuffer(big.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all else as it is."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def members(member: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all longest runs of marked bytes within texts, and the index of each text's first run (one entry more than texts)."""
    first = np.zeros(len(member) + 1, bool)
    first[at] = True
    begin, end = member.copy(), member.copy()
    begin[1:] &= ~member[:-1] | first[1:-1]
    end[:-1] &= ~member[1:] | first[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and the index of each text's first word."""
    return members(~_SPACE[data], at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, spans in order and apart. Runs of them share one running sum over RUN bytes, longer spans take several."""
    if not len(_POWERS[0]):
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(RUN, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        low = int(starts[i])
        j = int(np.searchsorted(ends, low + RUN, "right"))
        if j > i:
            run = np.zeros(int(ends[j - 1]) - low + 1, np.uint64)
            np.cumsum(_BYTE[data[low : ends[j - 1]]] * _POWERS[0][: len(run) - 1], out=run[1:])
            a, b = starts[i:j] - low, ends[i:j] - low
            out[i:j] = (run[b] - run[a]) * _POWERS[1][a]
        else:
            j, total, high = i + 1, 0, int(ends[i])
            for at in range(low, high, RUN):
                part = data[at : min(at + RUN, high)]
                total += int((_BYTE[part] * _POWERS[0][: len(part)]).sum()) * pow(int(_BASE), at - low, 1 << 64)
            out[i] = np.uint64(total % (1 << 64))
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes; one hash of all of them if there are fewer, none for none."""
    n = len(h)
    if not n:
        return h
    width = min(k, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : n - width + 1 + i]
    return mix(out)
