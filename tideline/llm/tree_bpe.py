"""Byte-level BPE as a reduction over a tree of text halves.

A text is halved until its parts are short, the parts are encoded on their
own, and neighbours are joined: only a window around the seam is encoded anew,
and it grows until the tokens outside provably stay as they are. They do where
the window's edge stands between a letter, digit or punctuation mark and a blank
or newline: no match of the split pattern goes over such a place, the pattern
looks at what follows only within white space, and each match is encoded by
itself. Joining is associative, so any tree gives the ids of the whole text. Decoding concatenates
the bytes of the ids up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import slices

#: Texts up to this many characters are encoded without halving.
LEAF = 512
#: The first window reaches this many characters to each side of a seam.
WINDOW = 32

#: Stable places of public_tokenizers.PATTERN, for any reading of \s. Texts of another pattern are encoded whole.
_EDGE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])[ \n]")


class TreeBPE:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF, window: int = WINDOW):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.base = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {b: a for a, b in ranks.items()}
        self.leaf, self.window = leaf if pattern == public_tokenizers.PATTERN else sys.maxsize, window

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self.base.encode_ordinary(text[a:b])
        seam = (a + b) // 2
        return self._join(text, a, seam, b, self._encode(text, a, seam), self._encode(text, seam, b))

    def _join(self, text: str, a: int, seam: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of text[a:b] from those of both sides of the seam."""
        p, q = self._edge_before(text, a, seam), self._edge_after(text, seam, b)
        keep = self._trim(left, len(text[p:seam].encode()), -1)
        drop = self._trim(right, len(text[seam:q].encode()), 1)
        return left[:keep] + self.base.encode_ordinary(text[p:q]) + right[drop:]

    def _edge_before(self, text: str, a: int, seam: int) -> int:
        """The last stable place before the seam, in windows that double; a if there is none."""
        width = self.window
        while True:
            low = max(a, seam - width)
            found = None
            for found in _EDGE.finditer(text, low + 1 if low == a else low, seam):
                pass
            if found:
                return found.start()
            if low == a:
                return a
            width *= 2

    def _edge_after(self, text: str, seam: int, b: int) -> int:
        """The first stable place after the seam; b if there is none."""
        found = _EDGE.search(text, seam + 1, b)
        return found.start() if found else b

    def _trim(self, ids: list[int], n: int, step: int) -> int:
        """How many ids from the left stay (step -1) or go (step 1) when n bytes of that side do."""
        k = len(ids) if step < 0 else 0
        while n > 0:
            k, i = (k - 1, k - 1) if step < 0 else (k + 1, k)
            n -= len(self.bytes[ids[i]])
        if n:
            raise AssertionError("a token lies across a stable place")
        return k

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _digests(path: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBPE(path, leaf=leaf)
        for batch in batches:
            for rows in slices(batch, "text"):
                n, first, second = [], [], []
                for text in rows.column("text").to_pylist():
                    ids = bpe.encode(text or "")
                    n.append(len(ids))
                    first.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                    second.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBPE(path, leaf=leaf)
        for batch in batches:
            for rows in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array([bpe.encode(t or "") for t in rows.column("text").to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _checked(path: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBPE(path, leaf=leaf)
        for batch in batches:
            for rows in slices(batch, "text"):
                texts = [t or "" for t in rows.column("text").to_pylist()]
                ids = [np.array(bpe.encode(t), np.int32) for t in texts]
                back = [bpe.decode(x.tolist()) == t.encode() for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array([*map(len, ids)], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(back)], names=["doc_id", "n_tokens", "ids", "round_trip"])

    return run


def _texts(path: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBPE(path, leaf=leaf)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bpe.decode(x or []).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def encode(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, ids of every row; a null text is empty and has no ids. Row by row: no shuffle, repeated rows stay, other columns go."""
    return docs.select("doc_id", "text").mapInArrow(_ids(path, leaf), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, text of rows of (doc_id, ids); null ids give an empty text."""
    return tokens.select("doc_id", "ids").mapInArrow(_texts(path, leaf), "doc_id long, text string")


def encode_and_check(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip of every row; round_trip: the ids decode to the text's bytes."""
    return docs.select("doc_id", "text").mapInArrow(_checked(path, leaf), "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def token_digests(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 (bytes decoded from those ids) of every row.

    A null text is empty and has no ids; repeated rows stay, other columns go.
    Row by row: no shuffle. A very long text without stable places is encoded
    anew at every level of its tree, n log n work; a task holds some thirty
    times its bytes.
    """
    return docs.select("doc_id", "text").mapInArrow(_digests(path, leaf), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
