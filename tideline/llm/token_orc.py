"""Token ids in ORC files that are read stripe by stripe.

Documents are dealt out by ranges of doc_id and sorted, so file after file and
row after row holds ascending ids. ORC writes the ids with its run-length
encoding for integers, keeps row indexes of each stripe and a Bloom filter on
doc_id: a read of some documents skips files, stripes and row groups by these
alone, and a read of all is split by stripes.

A row holds doc_id, part (the file's number in ascending order), place and
first (the row's number in its file, and the ids in that file before it),
n_tokens and ids. An id's global position is its file's start plus `first`;
the files' starts are a running sum over one row per file.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import new_folder, raw, slices, text_print

END_ID = 2
#: Chunks whose ids a worker remembers; beyond it starts anew.
REMEMBER = 1_000_000
_MARKS = ((", ", " \2 "), (". ", " \3 "), (",\n", " \2\n"), (".\n", " \3\n"), ("\n", " \0"))
_POINTS = ("\2", "\3")
_OTHER = np.zeros(256, bool)
_OTHER[[*range(10), *range(11, 32), 127, *range(0xC9, 256)]] = True
#: One-byte letters and digits: after them a comma or full stop begins a match of its own.
_WORDLY = np.zeros(256, bool)
_WORDLY[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
FORMAT = "doc_id long, part int, place long, first long, n_tokens long, ids array<int>"
WRITE = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "orc.create.index": "true", "compression": "zstd"}


class _Numbers(dict):
    """Chunks numbered in order of appearance; `new` has those without ids yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        self[chunk] = n = len(self)
        return n


class Encoder:
    """encode(texts, add_special_tokens=False) of the tokenizers library, remembering the chunks it has seen.

    A byte-level vocabulary encodes each match of its split pattern on its own,
    and no match goes over a place between a non-space character and a blank
    or newline, or between a letter or digit and a point. So texts are cut
    there, every distinct chunk goes through the library once, many to a call,
    and its ids are used wherever it occurs. Texts with characters beyond Latin
    letters, with other white space or with an added token (which the library
    takes out of a text before it splits) go through it whole, and so do all
    texts of a vocabulary that splits in another way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        self.library = Tokenizer.from_file(path)
        shape = json.loads(self.library.to_str())
        split, model = shape["pre_tokenizer"] or {}, shape["model"]
        self.added = [t["content"] for t in shape["added_tokens"]]
        self.cuts = (
            (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)
            and (model["type"], shape["normalizer"], shape["truncation"], shape["padding"]) == ("BPE", None, None, None)
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
            and all(a.split() == [a] for a in self.added)
        )
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.length = np.zeros(1 + max(vocabulary.values()), np.int64)
        self.length[[*vocabulary.values()]] = [*map(len, vocabulary)]  # its strings have a character for each byte
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbers()
        self.ids, self.ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]  # of all chunks by number

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one entry more than texts)."""
        data, at = raw(texts)
        plain, even = self._classes(data, at)
        texts = ["" if t is None else t for t in texts.to_pylist()]
        plain = [self.cuts and bool(p) and not any(a in t for a in self.added) for p, t in zip(plain, texts, strict=True)]
        if len(self.number) > REMEMBER:
            self._forget()
        cut = [self._cut(t, e) if p else [t] for t, p, e in zip(texts, plain, even, strict=True)]
        heads = [e.ids for e in self.library.encode_batch_fast([c[0] for c in cut], add_special_tokens=False)]
        n = np.array([len(c) - 1 for c in cut])
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(c[1:] for c in cut)), np.int64, int(n.sum()))
        if self.number.new:
            self._learn()
        ids, ends = self.ids[0], self.ends[0]
        size = ends[numbers + 1] - ends[numbers]
        upto = np.concatenate([[0], np.cumsum(size)])
        tail = ids[np.arange(upto[-1]) + np.repeat(ends[numbers] - upto[:-1], size)]
        first = np.concatenate([[0], np.cumsum(n)])
        place = upto[first]  # where each text's tail begins
        head = np.array([*map(len, heads)])
        out = np.insert(tail, np.repeat(place[:-1], head), np.fromiter(chain.from_iterable(heads), np.int32, int(head.sum())))
        return out, place + np.concatenate([[0], np.cumsum(head)])

    @staticmethod
    def _classes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which texts have printable Latin characters, blanks and newlines alone, and which of them have no point after another before white space."""
        odd = _OTHER[data]
        odd[1:] |= (data[:-1] == 0xC2) & (data[1:] <= 0xA0)
        before = np.concatenate([np.zeros(2, np.uint8), data])
        point = np.flatnonzero((data == 44) | (data == 46))
        last, lead = before[point + 1], before[point]
        letter = (lead >= 0xC3) & (lead <= 0xC8) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
        none = lambda x: np.diff(np.searchsorted(x, at)) == 0
        return none(np.flatnonzero(odd)), none(point[~(_WORDLY[last] | letter)])

    def _cut(self, text: str, even: bool) -> list[str]:
        """The text before the first cut, then chunks without the blank they begin with.

        Marks: NUL stands for a chunk's newline; \\2 and \\3 for a comma and a
        full stop that end a word, which are chunks of their own.
        """
        for a, b in _MARKS:
            text = text.replace(a, b)
        chunks = text.split(" ")
        if not even or "  " in text or "\0 " in text or not chunks[0]:  # no cut before a blank or newline that follows white space, nor before a point that follows another
            joined = chunks[:1]
            for c in chunks[1:]:
                if not joined[-1] or joined[-1][-1] == "\0" or c in _POINTS and not joined[-1][-1].isalnum():
                    joined[-1] += " " + c
                else:
                    joined.append(c)
            chunks = joined
        chunks[0] = self._plain(chunks[0])
        return chunks

    @staticmethod
    def _plain(chunk: str) -> str:
        return chunk.replace(" \2", ",").replace(" \3", ".").replace(" \0", "\n")

    def _learn(self) -> None:
        """Ids of the new chunks, many to a call of the library; their bytes tell whose they are."""
        new, self.number.new = self.number.new, []
        runs: list[list[str]] = [[]]
        for c in new:
            text = self._plain(" " + c)
            if not c or c[-1] == "\0" or c in _POINTS:  # ends in white space, or begins in none: nothing may stand beside it
                runs += [[text], []]
            else:
                runs[-1].append(text)
                if len(runs[-1]) == 500:
                    runs.append([])
        runs = [r for r in runs if r]
        for r, found in zip(runs, self.library.encode_batch_fast(["".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.int32)
            sizes = [len(t.encode()) for t in r]
            upto = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(sizes)) + 1
            self.ends.append(upto + (self.ends[-1][-1]))
            self.ids.append(ids)
        self.ids, self.ends = [np.concatenate(self.ids)], [np.concatenate(self.ends)]


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One for each Python worker, whatever tasks it runs."""
    return Encoder(path)


def _encode(path: str, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, place, first = _encoder(path), TaskContext.get().partitionId(), 0, 0
        tail = np.array([] if end is None else [end], np.int32)
        for batch in batches:
            for rows in slices(batch, "text"):
                ids, at = encode(rows.column("text"))
                ids, at = np.insert(ids, np.repeat(at[1:], len(tail)), np.tile(tail, len(rows))), at + len(tail) * np.arange(len(rows) + 1)
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").cast(pa.int64()), pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(place, place + len(n))), pa.array(first + at[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))],
                    names=["doc_id", "part", "place", "first", "n_tokens", "ids"],
                )
                place, first = place + len(n), first + int(at[-1])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int | None = END_ID) -> None:
    """Encode every whole text and write the file format above to path.

    Null texts are empty; `end` (none: nothing) follows each document. Null ids
    come first; rows with the same doc_id are all written, in order of their
    texts' hashes, so that even one id's rows are dealt to several tasks. An
    empty table writes an empty folder. Other columns are left out. A task that
    runs again writes the same rows, as ranges and order depend on ids and texts
    alone. A very long text takes a task several times its size.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_print().alias("_print")).repartitionByRange("doc_id", "_print").sortWithinPartitions("doc_id", "_print").drop("_print")
    ordered.mapInArrow(_encode(vocabulary, end), FORMAT).write.options(**WRITE).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of path; with doc_ids only those documents, found by the statistics, row indexes and Bloom filters."""
    df = spark.read.schema(FORMAT).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(*doc_ids))


def file_starts(tokens: DataFrame) -> DataFrame:
    """part, start: ids in all files before this one. One row per file passes through the window, some 10^5 for 10 TB of text."""
    per_file = tokens.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    return per_file.select("part", F.coalesce(F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("start"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, at = ids.flatten().cast(pa.uint32()).to_numpy().astype("<u4", copy=False), np.asarray(ids.offsets) - ids.offsets[0].as_py()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("first"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "part", "first", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, from the files. Repeated rows stay; an empty folder gives none."""
    tokens = read_tokens(spark, path)
    rows = tokens.select("doc_id", "part", "first", "n_tokens", "ids").mapInArrow(_checksums, "doc_id long, part int, first long, n_tokens long, ids_crc32 long")
    return rows.join(file_starts(tokens), "part").select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def new_path(spark: SparkSession) -> str:
    return f"{new_folder(spark)}/tokens"
