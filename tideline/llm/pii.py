"""Personal data: patterns, and terms that give away what the patterns hide.

Besides the values that patterns find, other words can reveal a value: if
a term shares documents with a value again and again and hardly stands anywhere else, whoever
reads the term can guess the value. The corpus tells how strongly. With N
documents, df(e) that hold value e, df(t) that hold term t and df(e, t) that
hold both, knowing t leaves log2(df(t) / df(e, t)) of the
log2(N / df(e)) bits that e carries. Terms whose disclosed share is at least
THRESHOLD, seen together in SUPPORT documents or more, are sanitised wherever
they stand in documents with that value: years, numbers, codes and names are
generalised to their class, other terms are removed.

Values and terms are compared as 64-bit hashes. Co-occurrence is counted over
all documents; only terms met with a repeated value are counted in the corpus, which
a bitmap of bounded size selects before the shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashes, lower, members, raw, save, scratch, slices, text_print
from .graph import maybe, maybe_in
from .spans import count, digest, joined

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3
THRESHOLD = 0.8
#: Bytes of texts whose spans and terms are Python objects at a time.
OBJECTS = 1 << 18
#: Distinct terms that a task holds before it sends their counts.
HELD = 2_000_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[A-Za-z0-9\u0080-\U0010FFFF]+")
_WORDY = np.zeros(256, bool)
_WORDY[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: before each @ the longest local part after the last match, behind it the domain."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if at >= end and (m := _DOMAIN.match(text, at)):
            start = at
            while start > end and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                end = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end), by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def value_of(kind: int, found: str) -> bytes:
    return bytes([kind]) + (found.lower() if kind == 0 else re.sub(r"[^0-9.]" if kind == 1 else r"[^0-9]", "", found)).encode()


def contexts(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[bytes], list[tuple[bytes, int, int]]]:
    """The distinct values of a text with spans, and (term, start, end) of all its terms; terms within values don't count."""
    if not spans:
        return [], []
    ends = sorted((a, b) for _, a, b in spans)
    terms, i, until = [], 0, 0
    for m in _TERM.finditer(text):
        while i < len(ends) and ends[i][0] < m.end():
            until = max(until, ends[i][1])
            i += 1
        if m.start() >= until:
            terms.append((_folded(m[0]), *m.span()))
    return sorted({value_of(k, text[a:b]) for k, a, b in spans}), terms


def _folded(term: str) -> bytes:
    return lower(np.frombuffer(term.encode(), np.uint8)).tobytes()


def keyed(values: list[bytes]) -> np.ndarray:
    """The hashes of byte strings, as the corpus' terms are hashed."""
    at = np.concatenate([[0], np.cumsum([*map(len, values)])]).astype(np.int64)
    return hashes(np.frombuffer(b"".join(values), np.uint8), at[:-1], at[1:]).view(np.int64)


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_TERMS = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
_FOUND = "row long, doc_id long, text_print long, spans array<struct<kind:string,start:int,end:int>>, values array<long>, terms array<struct<term:long,start:int,end:int>>"


def _met(text: str, spans) -> tuple[list[int], list[dict]]:
    values, terms = contexts(text, spans)
    return keyed(values).tolist(), [{"term": t, "start": x[1], "end": x[2]} for t, x in zip(keyed([x[0] for x in terms]).tolist(), terms, strict=True)]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        for rows in slices(batch, "text", OBJECTS):
            texts = [t or "" for t in rows.column("text").to_pylist()]
            spans = [*map(base_spans, texts)]
            named = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in s] for s in spans]
            met = [_met(t, s) if s else ([], []) for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(texts))), rows.column("doc_id").cast(pa.int64()), rows.column("text_print"), pa.array(named, _SPAN), pa.array([x[0] for x in met], pa.list_(pa.int64())), pa.array([x[1] for x in met], _TERMS)], names=["row", "doc_id", "text_print", "spans", "values", "terms"])
            row += len(texts)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents with it), added up as far as a task's memory goes."""
    held: list[np.ndarray] = []

    def send():
        term, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    for batch in batches:
        for rows in slices(batch, "text"):
            data, at = raw(rows.column("text"))
            data = lower(data)
            starts, ends, first = members(_WORDY[data], at)
            h, doc = hashes(data, starts, ends), np.repeat(np.arange(len(rows)), np.diff(first))
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            held.append(h[new])
            if sum(map(len, held)) > HELD:
                yield send()
                held = []
    if held:
        yield send()


def found_values(docs: DataFrame, keep: bool = False) -> DataFrame:
    """row, doc_id, text_print, spans, values, terms of every row of docs, written; row numbers the rows of that table. Rows without values have no terms here."""
    return save(docs.select("doc_id", "text", text_print().alias("text_print")).mapInArrow(_find, _FOUND), "values", keep)


def _together(found: DataFrame, values: DataFrame) -> DataFrame:
    """row, doc_id, text_print, value, term: each of these values (and few others) with each distinct term of its document."""
    held = maybe_in(found.where(F.size("values") > 0).select("row", "doc_id", "text_print", "terms", F.explode("values").alias("value")), values, "value")
    return held.select("row", "doc_id", "text_print", "value", F.explode(F.array_distinct(F.col("terms.term"))).alias("term"))


def _told(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """row, doc_id, text_print, value, term of the documents that hold both of a revealing pair."""
    met = _together(found, pairs.select("value").distinct()).withColumn("_pair", F.xxhash64("value", "term"))
    named = pairs.select("value", "term").withColumn("_pair", F.xxhash64("value", "term"))
    return maybe_in(met, named, "_pair").drop("_pair").join(named.drop("_pair"), ["value", "term"])


def alike(found: DataFrame, support: int = SUPPORT) -> DataFrame:
    """value, df_v, like: values in `support` rows at least, and of all values that stand in exactly the same rows the smallest.

    What a term discloses of them is the same, so one of them is paired with
    terms for all: a list of thousands of values in several copies costs its
    terms, not their product. Sets of rows are compared by 128 bits.
    """
    each = found.select("row", F.explode("values").alias("value"))
    values = each.groupBy("value").agg(F.count(F.lit(1)).alias("df_v"), F.bit_xor(F.xxhash64("row")).alias("_a"), F.bit_xor(F.xxhash64(F.lit(7), "row")).alias("_b")).where(F.col("df_v") >= support)
    values = save(values, "repeated")
    return values.join(values.groupBy("df_v", "_a", "_b").agg(F.min("value").alias("like")), ["df_v", "_a", "_b"]).select("value", "df_v", "like")


def _documents(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, df_t: in how many documents each of these terms (and few others) stands.

    There is no exact join here: the planner takes one below the sum, where a
    term has a row from each task that met it. The sums are joined with pairs anyhow.
    """
    counted = docs.select("text").mapInArrow(_term_counts, "term long, n long")
    return maybe(counted, terms, "term").where("_maybe").groupBy("term").agg(F.sum("n").alias("df_t"))


def _revealing(docs: DataFrame, found: DataFrame, values: DataFrame, threshold: float, support: int) -> DataFrame:
    """value, term, share: for one value of those that are alike, the terms that disclose at least this share of its information."""
    value_df = save(values.where("value = like").select("value", "df_v"), "paired")
    pairs = save(_together(found, value_df).groupBy("value", "term").agg(F.count(F.lit(1)).alias("df_vt")).where(F.col("df_vt") >= support).join(value_df, "value"), "pairs")
    terms = save(pairs.select("term").distinct(), "terms")
    df_t = _documents(docs, terms)
    n = F.lit(float(found.count()))
    share = 1 - F.log2(F.col("df_t") / F.col("df_vt")) / F.log2(n / F.col("df_v"))
    judged = pairs.join(df_t, "term").where(F.col("df_v") < n).withColumn("share", share)
    return save(judged.where(F.col("share") >= threshold).select("value", "term", "share"), "revealing")


def revealing(docs: DataFrame, found: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """value, term, share: pairs whose term discloses at least this share of the value's information, of every value."""
    values = alike(found, support)
    pairs = _revealing(docs, found, values, threshold, support)
    return pairs.withColumnRenamed("value", "like").join(values, "like").select("value", "term", "share")


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, terms: the places of the terms in _hit."""
    for batch in batches:
        marked = []
        for terms, hit in zip(batch.column("terms"), batch.column("_hit"), strict=True):
            at = terms.values
            marked.append(at.filter(pa.compute.is_in(at.field("term"), hit.values)).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(marked, _TERMS)], names=["_row", "terms"])


def _with_terms(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """_row, terms: every place of a revealing term in the rows that hold its value."""
    hit = save(_told(found, pairs).groupBy("row").agg(F.collect_set("term").alias("_hit")), "hits")
    rows = maybe_in(found.where(F.size("values") > 0).select("row", "terms"), hit, "row").join(hit, "row")
    return rows.mapInArrow(_mark, "_row long, terms array<struct<term:long,start:int,end:int>>")


def private_spans(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """doc_id, spans of every row: emails, addresses, cards and phones, then revealing terms (kind term), each by start.

    docs: doc_id, text; other columns are left out. A null text is empty.
    Repeated rows are documents of their own, so copies count as co-occurrence.
    A value that stands in all documents carries no information, and no term
    reveals it. Empty tables give no rows. A task holds some fifteen times the
    bytes of a very long text.
    """
    with scratch(docs.sparkSession):
        found = found_values(docs, keep=True)
        pairs = _revealing(docs, found, alike(found, support), threshold, support)  # rows with one value have all that are like it
        terms = save(_with_terms(found, pairs), "terms", keep=True)
    more = F.transform(F.col("terms"), lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return found.select("row", "doc_id", "spans").join(terms, F.col("row") == F.col("_row"), "left").select("doc_id", F.concat("spans", F.coalesce(more, F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)"))).alias("spans"))


def private_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each kind, base_sha256, spans, n_term, private (has any span) of every row: private_spans as digests; a row without spans has the digest of an empty text."""
    spans = F.col("spans")
    return private_spans(docs).select("doc_id", *(count(spans, k).alias(f"n_{k}") for k in KINDS), digest(spans, KINDS).alias("base_sha256"), joined(spans).alias("spans"), count(spans, "term").alias("n_term"), (F.size(spans) > 0).alias("private"))


# -- sanitised texts


def general(term: str) -> str:
    """The class that stands for a revealing term; nothing for a plain word, which has none."""
    if term.isdigit():
        return "[YEAR]" if len(term) == 4 and term[:2] in ("18", "19", "20") else "[NUMBER]"
    if any(c.isdigit() for c in term):
        return "[CODE]"
    return "[NAME]" if term[0].isupper() else ""


def sanitised_text(text: str, pairs: set[tuple[int, int]]) -> str:
    """Values as [EMAIL] and so on; terms that reveal one of them generalised or removed everywhere. Spans that overlap are one."""
    spans = base_spans(text)
    if not spans:
        return text
    marks = [(a, b, f"[{KINDS[k].upper()}]") for k, a, b in spans]
    if pairs:
        values, terms = _met(text, spans)
        own = {*values}
        hit = {t for v, t in pairs if v in own}
        for x in terms:
            if x["term"] in hit:
                term = text[x["start"] : x["end"]]
                marks.append((x["start"], x["end"], general(term)))
    out, end = [], 0
    for a, b, what in sorted(marks):
        if a >= end:
            out += [text[end:a], what]
        end = max(end, b)
    return "".join([*out, text[end:]])


def _sanitise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch, "text", OBJECTS):
            pairs = [{(x["value"], x["term"]) for x in p or ()} for p in rows.column("_pairs").to_pylist()]
            texts = [None if t is None else sanitised_text(t, p) for t, p in zip(rows.column("text").to_pylist(), pairs, strict=True)]
            arrays = [pa.array(texts, pa.string()) if n == "text" else rows.column(n) for n in rows.schema.names if n != "_pairs"]
            yield pa.RecordBatch.from_arrays(arrays, names=[n for n in rows.schema.names if n != "_pairs"])


def sanitise(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """docs with sanitised texts; all columns and rows stay, null texts are null.

    Only documents with revealing terms meet a join, by doc_id (null or not) and
    the hash of the text, so rows that repeat both share their pairs.
    """
    with scratch(docs.sparkSession):
        found = found_values(docs)
        pairs = _revealing(docs, found, alike(found, support), threshold, support)  # rows with one value have all that are like it
        hit = _told(found, pairs).groupBy(F.col("doc_id").alias("_doc"), F.col("text_print").alias("_own")).agg(F.collect_set(F.struct("value", "term")).alias("_pairs"))
        hit = save(hit, "hits", keep=True)
    told = maybe(docs.withColumn("_print", text_print()), hit.select(F.col("_own").alias("_print")), "_print")
    some = told.where("_maybe").join(hit, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_print") == F.col("_own")), "left").select(*docs.columns, "_pairs")
    rest = told.where("not _maybe").select(*docs.columns, F.expr("cast(null as array<struct<value:long,term:long>>)").alias("_pairs"))
    return some.unionByName(rest).mapInArrow(_sanitise, docs.schema)
