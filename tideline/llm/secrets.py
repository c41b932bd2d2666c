"""Secret scans over a trigram index.

From each rule's regular expression a Boolean query of trigrams follows that
every matching text satisfies. Documents are indexed block by block (a run of
rows of one task): postings hold, for each trigram that some query names, the
block's documents that contain it. Queries intersect and unite postings, and
only the documents left are verified with the expression itself. A rule without
mandatory trigrams verifies every document. Blocks need no shuffle, and hot
trigrams cost no more than a block's postings.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from re import _constants as op
from re import _parser as parser

from .common import lower, raw, slices
from .spans import SPANS, count, digest, joined

#: Alternatives that are followed through a concatenation, and characters of a class that are.
MOST_STRINGS, MOST_CHARS = 64, 8
BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """One kind of secret: a pattern, and what else a match must satisfy. Matches that fail are dropped, not retried."""

    kind: str
    pattern: str
    any_case: bool = False
    check: Callable[[re.Match], bool] | None = None

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, lambda m: len(m[2]) >= 8),
    Rule("access", r"AKIA[A-Z0-9]+", check=lambda m: len(m[0]) >= 16),
    # the greedy [0-9a-f]+ takes whole runs, so those of 32 and more are these
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("repository", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"sk_(?:live|test)_[A-Za-z0-9]{16,}"),
    # at the start of a run only: a long run is tried once
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("login", r"(?:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s/:@]+:[^\s/:@]+@", True),
)
BASE_KINDS = tuple(r.kind for r in BASE)


# -- queries: None (every text), ("tri", bytes), ("and", parts), ("or", parts)


def both(a, b):
    return b if a is None else a if b is None else ("and", (a, b))


def either(parts):
    return None if any(p is None for p in parts) else reduce(lambda a, b: a if a == b else ("or", (a, b)), parts)


def of_strings(strings: set[bytes]):
    """Some string of these occurs: its trigrams do."""
    return either([reduce(both, [("tri", s[i : i + 3]) for i in range(len(s) - 2)], None) for s in sorted(strings)])


def _derive(items) -> tuple[set[bytes] | None, tuple | None]:
    """The strings that a sequence of parsed items can match, lower-cased, if they are few; else None and its query."""
    now, query, exact = {b""}, None, True
    for kind, arg in items:
        strings, own = _item(kind, arg)
        if strings is not None and len(now) * len(strings) <= MOST_STRINGS:
            now = {a + b for a, b in product(now, strings)}
            continue
        exact = False
        query = both(query, of_strings(now))
        query, now = (both(query, own), {b""}) if strings is None else (query, strings)
    return (now, None) if exact else (None, both(query, of_strings(now)))


def _item(kind, arg) -> tuple[set[bytes] | None, tuple | None]:
    if kind is op.LITERAL:
        return {chr(arg).encode().lower()}, None
    if kind is op.IN:
        chars = [chr(a).encode().lower() for k, a in arg if k is op.LITERAL]
        return ({*chars}, None) if len(chars) == len(arg) <= MOST_CHARS else (None, None)
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return {b""}, None
    if kind is op.SUBPATTERN:
        return _derive(arg[3])
    if kind is op.BRANCH:
        parts = [_derive(x) for x in arg[1]]
        if all(s is not None for s, _ in parts) and len(union := set().union(*(s for s, _ in parts))) <= MOST_STRINGS:
            return union, None
        return None, either([of_strings(s) if s is not None else q for s, q in parts])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, sub = arg
        strings, query = _derive(sub)
        if most == 1:
            return (strings | {b""}, None) if least == 0 and strings is not None else (strings, query) if least else (None, None)
        if strings is None or len(strings) > 1:
            return None, (query if strings is None else of_strings(strings)) if least else None
        (s,) = strings
        return ({s * least}, None) if least == most and least * len(s) <= MOST_STRINGS else (None, of_strings({s * min(least, MOST_STRINGS)}) if least else None)
    return None, None


def trigram_query(rule: Rule):
    """The Boolean trigram query of a rule, over lower-cased bytes; None if it has no mandatory trigrams."""
    strings, query = _derive(parser.parse(rule.pattern, re.ASCII))
    return query if strings is None else of_strings(strings)


def trigrams(query) -> set[bytes]:
    return set() if query is None else {query[1]} if query[0] == "tri" else set().union(*map(trigrams, query[1]))


class Index:
    """The trigrams that some rule asks for, as numbers of postings."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.queries = [trigram_query(r) for r in rules]
        self.names = sorted(set().union(*map(trigrams, self.queries)))
        self.slot = {t: i for i, t in enumerate(self.names)}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, i in self.slot.items():
            self.table[int.from_bytes(t, "big")] = i + 1

    def postings(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """For each trigram the sorted numbers of the texts that hold it."""
        d = lower(data).astype(np.uint32)
        slots = self.table[(d[:-2] << 16) | (d[1:-1] << 8) | d[2:]] if len(d) > 2 else np.zeros(0, np.uint16)
        hits = np.flatnonzero(slots)
        docs = np.searchsorted(at, hits, "right") - 1
        inside = hits + 3 <= at[docs + 1]
        n = len(at) - 1
        found = np.unique((slots[hits[inside]].astype(np.int64) - 1) * n + docs[inside])
        cut = np.searchsorted(found, np.arange(len(self.names) + 1) * n)
        return [found[a:b] - i * n for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]

    def search(self, query, postings: list[np.ndarray], n: int) -> np.ndarray:
        if query is None:
            return np.arange(n)
        if query[0] == "tri":
            return postings[self.slot[query[1]]]
        return reduce(np.intersect1d if query[0] == "and" else np.union1d, (self.search(q, postings, n) for q in query[1]))


@lru_cache(4)
def _index(rules: tuple[Rule, ...]) -> Index:
    return Index(rules)


def _scan(rules: tuple[Rule, ...], known: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tuple(Rule(r.kind, r.pattern, r.any_case) for r in rules)
        index, patterns = _index(own), [r.compiled() for r in rules]
        for batch in batches:
            for rows in slices(batch, "text", BLOCK_BYTES):
                texts = rows.column("text")
                data, at = raw(texts)
                postings, texts = index.postings(data, at), texts.to_pylist()
                found: list[list[tuple]] = [[] for _ in texts]
                for k, (rule, pattern, query) in enumerate(zip(rules, patterns, index.queries, strict=True)):
                    for i in index.search(query, postings, len(texts)):
                        if texts[i]:
                            found[i] += [(m.start(), k, m.end()) for m in pattern.finditer(texts[i]) if rule.check is None or rule.check(m)]
                spans = [[{"kind": known[k], "start": a, "end": b} for a, k, b in sorted(x)] for x in found]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "spans"])

    return run


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id, spans of every row: all matches of all rules by start, then in the rules' order.

    Matches of one rule don't overlap, those of different rules may. A null or
    empty text has no spans. Row by row: no shuffle, repeated rows stay, other
    columns are left out. A task holds some twenty times the bytes of a very
    long text.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan(rules, tuple(r.kind for r in rules)), f"doc_id long, spans {SPANS}")


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every row: scan as digests; a row without spans has the digest of an empty text."""
    spans: Column = F.col("spans")
    return scan(docs).select("doc_id", *(count(spans, k).alias(f"n_{k}") for k in BASE_KINDS), digest(spans, BASE_KINDS).alias("base_sha256"), joined(spans).alias("spans"))
