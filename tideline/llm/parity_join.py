"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles, hashed to 64 bits. The hash
range is cut into P equal parts, P doubling with the set's size band, and a
part is kept as the exclusive or of its hashes. A shingle in one set only
changes one part, so sets whose symmetric difference is at most D differ in at
most D parts. Of a document's non-empty parts, in one order for all, the first
D + 1 are its keys, D being the largest difference any partner may have: two
linked documents have one of them in common, as at most D of these differ. The
order is by place, but for parts that many sets have, which come last, the more
frequent the later: so boilerplate is a key only of sets that have little else.
How frequent parts are is counted in a sketch of fixed size. (Sets with fewer parts that are
not empty are rare, and have a key for each other.) A document that may link with
larger ones of the next band has keys there too.

A second parity sketch has one bit to a shingle. Its Hamming distance is never
more than the symmetric difference, so it rejects most candidates without their
texts; the rest are verified on the sets. Equal sets are one node from the
start. To find components without comparing all pairs of a key, each node is
first verified with one leader. Afterwards nodes that share a key and are in
different components are compared, in bounded chunks: first a chunk's nearest
pairs that would join its components are verified, then, with the components
that these give, all pairs still open. Large components of a key have chunks of
their own, and chunks of one component never meet.

No key is brought together as a whole. A key that a task meets twice is known to
be shared, so of a block of its texts one row for the key is enough to tell the
others; minima, maxima and counts of a key are aggregated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hashes, lower, mix, raw, save, scratch, slices, text_print, windows, words
from .graph import components, maybe, maybe_in

#: Sets smaller than this have parts that rarely hold two shingles.
SMALL, SMALL_BITS = 64, 12
#: Nodes of a key that one comparison of two chunks takes from each, and 64-bit words that it holds at a time.
CHUNK, WORDS = 1024, 1 << 19
#: Keys of up to so many nodes list their pairs.
FEW = 8
#: Bytes of sets, and nodes, of a bucket; two buckets meet in a verification.
BUCKET_BYTES, BUCKET_NODES = 12 << 20, 2048
#: Counters of the sketch of frequencies, and sets with a part from which it counts as frequent.
COUNTERS, FREQUENT = 1 << 20, 64


@lru_cache
def load(percent: int) -> float:
    """Most shingles to a part: as many as leave a tenth more non-empty parts than keys are needed, so that sparse sets are rare."""
    t = percent / 100
    need = 1.1 * (1 + 1 / t) * (1 - t) / (1 + t)
    return next((x / 4 for x in range(20, 1, -1) if (1 - math.exp(-x / 4)) / (x / 4) >= need), 0.25)


def band(size: int, percent: int) -> int:
    """log2 of the number of parts."""
    return SMALL_BITS if size < SMALL else max(1, math.ceil(math.log2(size / load(percent))))


def most_apart(a: int, b: int, percent: int) -> int:
    """The largest symmetric difference of two linked sets of these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes, of words with A-Z lower-cased."""
    data, at = raw(texts)
    data = lower(data)
    starts, ends, first = words(data, at)
    h = hashes(data, starts, ends)
    return [np.unique(windows(h[a:b], k)) for a, b in zip(first[:-1], first[1:], strict=True)]


def node_of(s: np.ndarray) -> int:
    """A 64-bit digest of a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.bitwise_xor.reduce(mix(s)) + np.add.reduce(s) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(s))]))[0].view(np.int64))


def bands_of(n: int, percent: int) -> list[int]:
    """The bands that keys of a set's partners may be in."""
    top = n * 100 // percent
    return sorted({band(n, percent), *(range(band(max(n, SMALL), percent), band(top, percent) + 1) if top >= SMALL else ())})


def parts_of(s: np.ndarray, bits: int) -> np.ndarray:
    """A number for each non-empty part and its content, by place."""
    part = s >> np.uint64(64 - bits)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return mix(np.bitwise_xor.reduceat(mix(s), starts) + np.uint64(bits))


def counter_of(parts: np.ndarray) -> np.ndarray:
    return (parts & np.uint64(COUNTERS - 1)).astype(np.int64)


def keys_of(s: np.ndarray, percent: int, levels: np.ndarray | None = None) -> np.ndarray:
    """The first non-empty parts, one more than may differ from a partner's, of each band that a partner's keys may be in. levels: for each counter how late its parts come.

    A sparse set has fewer non-empty parts. It gives all of them: a partner that
    is not sparse has its share of keys among these. For partners that are sparse
    too it goes on to the next finer partition, in which the same holds; at last
    each hash is a part of its own, and all are given.
    """
    n = len(s)
    need = most_apart(n, n * 100 // percent, percent) + 1
    out, todo, done = [], bands_of(n, percent), set()
    while todo:
        bits = todo.pop()
        if bits in done:
            continue
        done.add(bits)
        parts = parts_of(s, bits)
        if len(parts) < need and bits < 64:
            todo.append(bits + 1 if len(parts) < n else 64)
        if levels is not None and len(parts) > need:
            parts = parts[np.argsort(levels[counter_of(parts)], kind="stable")]
        out.append(parts[:need])
    return np.concatenate(out).view(np.int64)


def sketch_of(s: np.ndarray) -> bytes:
    """The parity of the set's bits: two bits to a shingle or more, 512 at least. A larger sketch folds onto a smaller one."""
    size = max(512, 2 << len(s).bit_length())
    odd = np.bincount((mix(s) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


_NODES = "doc_id long, text_print long, n_shingles long, node long, sketch binary"
_SCANNED = _NODES + ", counter int, sets long"
_KEYS = "node long, n int, key long, salt long, known boolean"
#: Keys of a task among which those that it shares with itself are found at a time, and rows of them that it sends at a time.
KEYS, SENT = 1 << 19, 1 << 15


def _fresh(rows: pa.RecordBatch, k: int, seen: set[int]) -> tuple[list[np.ndarray], list[int | None], list[bool]]:
    """Sets, nodes, and whether a node is new to the task."""
    sets = shingle_sets(rows.column("text"), k)
    node = [node_of(s) if len(s) else None for s in sets]
    return sets, node, [d is not None and d not in seen and not seen.add(d) for d in node]


def _nodes(k: int, percent: int):
    """Rows of _NODES, and from each task its counters that stand out (counter, sets): which parts come late needs no exact counts, only the same order for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        counts, none = np.zeros(COUNTERS, np.int64), lambda n, t: pa.nulls(n, t)
        names = [c.split()[0] for c in _SCANNED.split(", ")]
        for batch in batches:
            for rows in slices(batch, "text"):
                sets, node, fresh = _fresh(rows, k, seen)
                sketch = [sketch_of(s) if new else None for s, new in zip(sets, fresh, strict=True)]
                own = [parts_of(s, bits) for s, new in zip(sets, fresh, strict=True) if new for bits in bands_of(len(s), percent)]
                if own:
                    np.add.at(counts, counter_of(np.concatenate(own)), 1)
                n = len(rows)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), rows.column("text_print"), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.binary()), none(n, pa.int32()), none(n, pa.int64())], names=names)
        high = np.flatnonzero(counts >= max(2, 2 * counts.mean()))
        for at in range(0, len(high), 1 << 16):
            some = high[at : at + (1 << 16)]
            n = len(some)
            yield pa.RecordBatch.from_arrays([*(none(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())), pa.array(some.astype(np.int32)), pa.array(counts[some])], names=names)

    return run


def _levels(counted: DataFrame) -> np.ndarray:
    """How late the parts of each counter come: 0, or from FREQUENT sets on the logarithm of their number. A byte for each counter."""
    often = counted.groupBy("counter").agg(F.sum("sets").alias("sets")).where(F.col("sets") >= FREQUENT).toArrow()  # COUNTERS rows at most
    levels = np.zeros(COUNTERS, np.uint8)
    levels[often.column("counter").to_numpy()] = np.log2(often.column("sets").to_numpy().astype(float)).astype(np.uint8)
    return levels


def _keyed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows of _KEYS: `known` where another node here has the key; of these all but one of a key are salted by their node."""
    node, n, key = map(np.concatenate, zip(*held, strict=True))
    order = np.argsort(key, kind="stable")
    node, n, key = node[order], n[order], key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    known = ~first
    known[:-1] |= ~first[1:]
    salt = np.where(first, 0, node)
    for at in range(0, len(key), SENT):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + SENT]) for x in (node, n, key, salt, known)], names=["node", "n", "key", "salt", "known"])


def _keys(k: int, percent: int, levels=None):
    """levels: a broadcast array, or None. Keys go straight to their shuffle: reading texts twice costs less than a table of all keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, total = [], 0
        for batch in batches:
            for rows in slices(batch, "text"):
                sets, node, fresh = _fresh(rows, k, seen)
                for s, d, new in zip(sets, node, fresh, strict=True):
                    if new:
                        keys = np.unique(keys_of(s, percent, levels and levels.value))
                        held.append((np.full(len(keys), d, np.int64), np.full(len(keys), len(s), np.int32), keys))
                        total += len(keys)
                if total > KEYS:
                    yield from _keyed(held)
                    held, total = [], 0
        if held:
            yield from _keyed(held)

    return run


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of two broadcast arrays of sketches (uint64 words)."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _may_link(na, nb, apart, percent: int):
    """Sizes and distance admit the similarity."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    return (100 * small >= percent * large) & (apart <= (na + nb) * (100 - percent) // (100 + percent))


def _near_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = np.asarray(batch.column("na")), np.asarray(batch.column("nb"))
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                size = min(len(x), len(y))
                keep.append(int(_apart(fold(x, size), fold(y, size))))
            yield batch.select(["a", "b"]).filter(pa.array(_may_link(na, nb, np.array(keep, np.int64), percent), pa.bool_()))

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task
        for batch in batches:
            for rows in slices(batch, "text"):
                sets = {node_of(s): s for s in shingle_sets(rows.column("text"), k) if len(s)}
                new = sets.keys() - seen
                seen |= new
                yield pa.RecordBatch.from_arrays([pa.array([*new], pa.int64()), pa.array([sets[d].tobytes() for d in new], pa.binary())], names=["node", "hashes"])

    return run


def _linked(percent: int):
    """The linked pairs of sorted rows: of each block first its sets (node, hashes), then its pairs (node, other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sets = None, {}
        for batch in batches:
            keep = []
            at, node, other, hashes_ = (batch.column(c) for c in ("block", "node", "other", "hashes"))
            for i, (where, a, b) in enumerate(zip(at.to_pylist(), node.to_pylist(), other.to_pylist(), strict=True)):
                if where != block:
                    block, sets = where, {}
                if b is None:
                    sets[a] = np.frombuffer(hashes_[i].as_py(), np.uint64)
                    keep.append(False)
                    continue
                x, y = sets[a], sets[b]
                place = np.searchsorted(y, x)
                both = int((y[np.minimum(place, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            found = batch.select(["node", "other"]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(found.columns, names=["a", "b"])

    return run


def _verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough. The texts of these nodes, one to a node and few others, are read again."""
    needed = save(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "needed")
    own = maybe_in(nodes.select("node", "doc_id", "text_print"), needed, "node").join(needed, "node", "left_semi")
    owner = own.groupBy("node").agg(F.min(F.struct("doc_id", "text_print")).alias("o"))
    owner = save(owner.select(F.xxhash64("o.doc_id", "o.text_print").alias("row")), "owners")
    sets = save(maybe_in(docs.withColumn("row", F.xxhash64("doc_id", "text_print")), owner, "row").select("text").mapInArrow(_sets(k), "node long, hashes binary"), "sets")
    # nodes are dealt into buckets; a set goes once to each pair of buckets that has pairs of its node
    size = sets.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("hashes")).alias("bytes")).first()
    buckets = max(1, size["n"] // BUCKET_NODES, (size["bytes"] or 0) // BUCKET_BYTES)
    p, q = (F.pmod(F.xxhash64(c, F.lit("block")), F.lit(buckets)) for c in ("a", "b"))
    dealt = save(pairs.withColumn("block", F.least(p, q) * buckets + F.greatest(p, q)), "dealt")
    sent = save(dealt.select("block", F.explode(F.array("a", "b")).alias("node")).distinct(), "sent")
    given = sets.join(sent, "node").select("block", "node", F.lit(None).cast("long").alias("other"), "hashes")
    rows = given.unionByName(dealt.select("block", F.col("a").alias("node"), F.col("b").alias("other"), F.lit(None).cast("binary").alias("hashes")))
    rows = rows.repartition("block").sortWithinPartitions("block", F.col("other").asc_nulls_first())
    return save(rows.mapInArrow(_linked(percent), "a long, b long").distinct(), "links")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of sorted batches that agree in keys, together; the caller bounds how many there are."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        change = np.zeros(len(batch), bool)
        for c in keys:
            x = np.asarray(batch.column(c))
            change[1:] |= x[1:] != x[:-1]
            change[0] |= bool(held) and held[-1].column(c)[-1].as_py() != x[0]
        at = 0
        for to in np.flatnonzero(change).tolist():
            if to > at:
                held.append(batch.slice(at, to - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], to
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _forest(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Places of the edges, nearest first, that join components not joined by nearer ones."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    keep, left = [], len(np.unique(np.concatenate([a, b]))) - 1
    order = np.argsort(apart, kind="stable")
    for i, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            up[x] = y
            keep.append(i)
            if len(keep) == left:
                break
    return np.array(keep, np.int64)


def _compare(percent: int, forest: bool):
    """Pairs of two chunks of a key, in different components, that may be similar; with forest only those that would join components, and the key where others were held back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ["key", "i", "j"]):
            if len(rows) < 2:
                continue
            node, comp, n, chunk = (rows.column(c).to_numpy() for c in ("node", "comp", "n", "chunk"))
            sketch = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("sketch").combine_chunks()]
            size = min(map(len, sketch))
            bits = np.stack([fold(x, size) for x in sketch])
            i = rows.column("i")[0].as_py()
            left = np.flatnonzero(chunk == i)
            right = left if rows.column("j")[0].as_py() == i else np.flatnonzero(chunk != i)
            if not len(right):
                continue
            found = []
            some = max(1, WORDS // (len(right) * size))
            for at in range(0, len(left), some):
                x = left[at : at + some, None]
                apart = _apart(bits[x], bits[right])
                ok = (comp[x] != comp[right]) & _may_link(n[x], n[right], apart, percent)
                if right is left:
                    ok &= node[x] < node[right]
                p, q = np.nonzero(ok)
                found.append((left[at + p], right[q], apart[p, q]))
            a, b, apart = map(np.concatenate, zip(*found, strict=True)) if found else (left[:0],) * 3
            held = None
            if forest and len(a):
                keep = _forest(comp[a], comp[b], apart)
                held = rows.column("key")[0].as_py() if len(keep) < len(a) else None
                a, b = a[keep], b[keep]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b])), pa.array([held] * len(a), pa.int64())], names=["a", "b", "held"])

    return run


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches admit a link."""
    both = pairs.join(sketches.toDF("a", "na", "sa"), "a").join(sketches.toDF("b", "nb", "sb"), "b")
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near_pairs(percent), "a long, b long")


def _open_pairs(shared: DataFrame, sketches: DataFrame, comps: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs of nodes that share a key, are in different components and may link (a, b, and held as _compare has it)."""
    told = maybe(shared, comps, "node")
    some = told.where("_maybe").join(comps, "node", "left").select("key", "node", "n", F.coalesce("comp", "node").alias("comp"))
    told = save(some.unionByName(told.where("not _maybe").select("key", "node", "n", F.col("node").alias("comp"))), "told")
    open_keys = save(told.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "m"), "open_keys")
    members = save(maybe_in(told, open_keys, "key").join(open_keys, "key"), "members")
    if not forest:  # what was held back has more nodes
        return save(_many(members, sketches, percent, forest), "open")
    listed = members.where(F.col("m") <= FEW).groupBy("key").agg(F.collect_list(F.struct("node", "comp", "n")).alias("x"))
    fits = lambda x, y: (x["node"] < y["node"]) & (x["comp"] != y["comp"]) & (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"]))
    pairs = F.flatten(F.transform("x", lambda x: F.transform(F.filter("x", lambda y: fits(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    few = _near(listed.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct(), sketches, percent)
    return save(few.withColumn("held", F.lit(None).cast("long")).unionByName(_many(members, sketches, percent, forest)), "open")


def _chunks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of keys of many nodes with their chunk, and the chunks (key, i, j) that meet.

    A component with CHUNK nodes of a key or more has chunks of its own (`comp`);
    the rest of a key is dealt by component into pools (`comp` null), of about
    CHUNK nodes each. A pool meets every chunk and itself, a component's chunk
    those of other components. Chunks are a thousandth of the nodes.
    """
    many = members.where(F.col("m") > FEW)
    size = many.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    large = save(size.where(F.col("c") >= CHUNK).select("key", "comp", F.ceil(F.col("c") / CHUNK).alias("own")), "large")
    pooled = save(size.where(F.col("c") < CHUNK).groupBy("key").agg(F.sum("c").alias("p")).select("key", F.ceil(F.col("p") / CHUNK).alias("pools")), "pools")
    big = large.select(F.col("key").alias("_k"), F.col("comp").alias("_c"), "own")
    dealt = many.join(big, (F.col("key") == F.col("_k")) & (F.col("comp") == F.col("_c")), "left").drop("_k", "_c")
    dealt = dealt.join(pooled, "key", "left").withColumn("chunk", F.when(F.col("own").isNull(), F.xxhash64(F.lit("pool"), F.pmod(F.xxhash64("comp"), F.col("pools")))).otherwise(F.xxhash64("comp", F.pmod(F.xxhash64("node"), F.col("own")))))
    dealt = save(dealt.select("key", "chunk", "node", "comp", F.col("own").isNotNull().alias("alone")), "dealt")
    chunks = save(dealt.groupBy("key", "chunk").agg(F.max(F.when(F.col("alone"), F.col("comp"))).alias("one")), "chunks")
    x, y = chunks.select("key", F.col("chunk").alias("i"), F.col("one").alias("a")), chunks.select("key", F.col("chunk").alias("j"), F.col("one").alias("b"))
    met = x.join(y, "key").where((F.col("i") <= F.col("j")) & F.coalesce(F.col("a") != F.col("b"), F.lit(True)))
    return dealt, save(met.select("key", "i", "j"), "meetings")


def _many(members: DataFrame, sketches: DataFrame, percent: int, forest: bool) -> DataFrame:
    """What _compare finds in keys of many nodes, dealt into chunks."""
    dealt, met = _chunks(members)
    sides = met.select("key", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("chunk"))
    wide = dealt.join(maybe_in(sketches, dealt, "node"), "node").join(sides, ["key", "chunk"])
    dealt = wide.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "chunk", "node", "comp", "n", "sketch")
    return dealt.mapInArrow(_compare(percent, forest), "a long, b long, held long")


def _similar(docs: DataFrame, k: int, percent: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_print().alias("text_print"), "text")
    scanned = save(docs.mapInArrow(_nodes(k, percent), _SCANNED), "nodes")
    nodes = scanned.where("counter is null").drop("counter", "sets")
    levels = docs.sparkSession.sparkContext.broadcast(_levels(scanned.where("counter is not null").select("counter", "sets")))
    keyed = docs.select("text").mapInArrow(_keys(k, percent, levels), _KEYS)
    own = W.partitionBy("key", "salt")
    shared = keyed.withColumn("lo", F.min("node").over(own)).withColumn("hi", F.max("node").over(own)).where("known or lo <> hi")
    shared = save(shared.groupBy("key", "node").agg(F.first("n").alias("n")), "shared")
    sketches = nodes.where("sketch is not null").select("node", F.col("n_shingles").alias("n"), "sketch")
    some = save(shared.select("node").distinct(), "sharing")
    sketches = save(maybe_in(sketches, some, "node").join(some, "node", "left_semi").dropDuplicates(["node"]), "sketches")

    # one leader for each node: of the leaders of its keys the one it shares most with; a key's leader shares most keys
    weighed = save(shared.select("key", "node", F.count(F.lit(1)).over(W.partitionBy("node")).alias("weight")), "weighed")
    leaders = weighed.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("l")).select("key", F.col("l.node").alias("lead"))
    led = weighed.join(leaders, "key").where("node <> lead").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("weight"))
    led = led.groupBy("node").agg(F.max(F.struct("weight", "lead"))["lead"].alias("lead")).select(F.col("lead").alias("a"), F.col("node").alias("b"))
    near = save(_near(led, sketches, percent), "near")
    links = _verify(near, docs, nodes, k, percent)
    comps = components(links)

    # then what may join components, nearest first; at last what was held back meanwhile
    opened = _open_pairs(shared, sketches, comps, percent, forest=True)
    likely = save(opened.select("a", "b").distinct(), "likely")
    if not likely.isEmpty():
        more = _verify(likely, docs, nodes, k, percent)
        links = links.union(more)
        comps = components(links)
        held = save(opened.select("held").where("held is not null").distinct(), "held")
        failed = likely.join(more, ["a", "b"], "left_anti")
        rest = _open_pairs(shared.join(held, F.col("key") == F.col("held"), "left_semi"), sketches, comps, percent, forest=False)
        rest = save(rest.select("a", "b").distinct().join(failed, ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            comps = components(links.union(_verify(rest, docs, nodes, k, percent)))

    least = nodes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("own"))
    named = save(least.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "own"), "named")
    ids = named.groupBy(F.col("comp").alias("_comp")).agg(F.min("own").alias("component_id"))
    named = named.join(ids, F.col("comp") == F.col("_comp")).select("node", "comp", "component_id")
    out = nodes.select("doc_id", "text_print", "n_shingles", "node").join(named, "node", "left").select("doc_id", "text_print", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("comp").alias("component"))
    return save(out, "components", keep=True)


def similar_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_print, n_shingles (distinct shingles of k words), component_id (smallest doc_id reachable by links) and component of every row.

    docs: doc_id, text; other columns are left out. Documents link when their
    sets' Jaccard similarity is at least percent / 100. With fewer than k words
    the whole sequence is the one shingle; a null text or one without words has
    none, links with nothing and is its own component (null). `component` tells
    components apart even where a doc_id is in several. Repeated rows are equal
    sets and share a component. Empty tables give no rows. Two different sets
    pass for one, or unequal parts for equal, only where 64-bit hashes collide.
    A task holds some fifteen times the bytes of a very long text.
    """
    with scratch(docs.sparkSession):
        return _similar(docs, k, percent)
