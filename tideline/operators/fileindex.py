"""Key ranges and Bloom filters of files, so that a few keys are looked up in a few files.

One row for each file, or run of a large one: its lowest and highest key, and a
Bloom filter of BITS bits a key. Files whose range holds none of the wanted keys,
or whose filter knows none of those in its range, need not be read; what is read
is compared exactly. Keys are texts, ordered by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INDEX = "file string, low string, high string, n long, bits binary"
BITS, HASHES = 16, 4
#: Keys of one filter; a file of more has several rows.
RUN = 1 << 20
#: Wanted keys up to which filters are asked; for more, files are chosen by their ranges alone.
MOST_KEYS = 200_000


def _places(keys, size: int) -> np.ndarray:
    h = pd.util.hash_array(np.asarray(keys, object), categorize=False)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) % np.uint64(size) for i in range(HASHES)])


def bloom(keys) -> bytes:
    size = max(64, 1 << (BITS * len(keys) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[_places(keys, size).ravel()] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(bits: bytes, keys) -> np.ndarray:
    """Of each key: False if it was not among those of the filter."""
    data = np.frombuffer(bits, np.uint8)
    at = _places(keys, 8 * len(data))
    return ((data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def index_of(rows: DataFrame, key: str) -> DataFrame:
    """INDEX of the files that rows are read from. A task makes a row for each run of RUN rows that it reads of a file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, part in frame.dropna().groupby("file", sort=False):
                for at in range(0, len(part), RUN):
                    keys = part.key.iloc[at : at + RUN].to_numpy()
                    yield pd.DataFrame({"file": [file], "low": [keys.min()], "high": [keys.max()], "n": [len(keys)], "bits": [bloom(keys)]})

    return rows.select(F.input_file_name().alias("file"), F.col(key).alias("key")).mapInPandas(run, INDEX)


def files_for(index: DataFrame, keys: DataFrame, key: str) -> list[str]:
    """The files that may hold some of the keys. Ranges and filters are read, and no file."""
    low, high, n = keys.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n:
        return []
    near = index.where((F.col("high") >= low) & (F.col("low") <= high))
    if n > MOST_KEYS:
        return sorted(r["file"] for r in near.select("file").distinct().collect())
    wanted = np.array(sorted(r[0] for r in keys.where(F.col(key).isNotNull()).select(key).distinct().collect()), object)

    def hits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            files = []
            for r in frame.itertuples():
                some = wanted[np.searchsorted(wanted, r.low) : np.searchsorted(wanted, r.high, "right")]
                if len(some) and may_hold(r.bits, some).any():
                    files.append(r.file)
            yield pd.DataFrame({"file": files}, dtype=object)

    return sorted(r["file"] for r in near.select("file", "low", "high", "bits").mapInPandas(hits, "file string").distinct().collect())
