"""A quality classifier: a convolutional network over bytes, in numpy.

A filter spans WIDTH bytes; its response is a sum of WIDTH looked-up weights, so
a convolution is WIDTH gathers from small tables. Texts are cut into cells, two
neighbouring cells are a chunk (so chunks overlap by half and cover the whole
text), and each filter's largest response in a chunk is the chunk's feature.
Over a text's chunks their maximum, mean and spread, with the text's length,
go through one hidden layer to one probability.

Training takes at most `per_class` labelled texts of each class, those with the
smallest hash of their id; of a text over `longest` bytes a window at a hash-random
place is trained on, though texts are scored whole. The share of each class among all labels that may be
learned from corrects the probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw, save, scratch, slices
from .graph import maybe_in

WIDTH, FILTERS, HIDDEN, CELL = 6, 16, 24, 128
#: The bound on training: texts of each class, and bytes of one.
PER_CLASS, LONGEST = 1500, 1 << 16
EPOCHS, RATE, DECAY = 8, 0.01, 1e-4
#: Bytes of text that go through the network together, and cells of one text that do.
STEP, RUN = 1 << 16, 512


@dataclass
class Net:
    tables: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    shift: float = 0.0

    @staticmethod
    def new(seed: int = 7) -> Net:
        g = np.random.default_rng(seed)
        n = 3 * FILTERS + 1
        draw = lambda size, scale: g.normal(0, scale, size).astype(np.float32)
        return Net(draw((WIDTH, 256, FILTERS), 0.3), np.zeros(FILTERS, np.float32), draw((n, HIDDEN), n**-0.5), np.zeros(HIDDEN, np.float32), draw(HIDDEN, HIDDEN**-0.5), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def cells(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with zeros behind each text up to whole cells (WIDTH - 1 at least), and each text's first cell (one entry more than texts)."""
    size = np.diff(at)
    n = -(-(size + WIDTH - 1) // CELL)
    first = np.concatenate([[0], np.cumsum(n)])
    padded = np.zeros(first[-1] * CELL + WIDTH - 1, np.uint8)
    for a, b, c in zip(at[:-1].tolist(), at[1:].tolist(), (first[:-1] * CELL).tolist(), strict=True):
        padded[c : c + b - a] = data[a:b]
    return padded, first


def _windows(padded: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The byte at each offset of the window at each place; behind its text's cells, which end at `ends`, a window sees zeros."""
    n = len(padded) - WIDTH + 1
    out = [padded[j : j + n].copy() for j in range(WIDTH)]
    for j in range(1, WIDTH):
        for back in range(1, j + 1):
            out[j][ends - back] = 0
    return out


def _peaks(net: Net, windows: list[np.ndarray]) -> np.ndarray:
    r = net.tables[0][windows[0]]
    for table, w in zip(net.tables[1:], windows[1:], strict=True):
        r += table[w]
    return r.reshape(-1, CELL, FILTERS)


def _features(top: np.ndarray, first: np.ndarray, size: np.ndarray):
    """Chunks from cells' peaks, and features of each text."""
    last = np.zeros(len(top), bool)
    last[first[1:] - 1] = True
    after = np.concatenate([top[1:], top[-1:]])
    use_next = (after > top) & ~last[:, None]
    chunk = np.where(use_next, after, top)
    count = np.diff(first)[:, None].astype(np.float32)
    most = np.maximum.reduceat(chunk, first[:-1])
    mean = np.add.reduceat(chunk, first[:-1]) / count
    off = chunk - np.repeat(mean, np.diff(first), axis=0)
    spread = np.add.reduceat(off * off, first[:-1]) / count
    z = np.concatenate([most, mean, spread, np.log1p(size)[:, None].astype(np.float32) / 8 - 1], axis=1)
    return chunk, use_next, most, off, z


def _tops(net: Net, padded: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each filter's largest response in every cell, a run of cells at a time: responses take 16 times the bytes they are of."""
    out = []
    for a in range(0, int(first[-1]), RUN):
        b = min(a + RUN, int(first[-1]))
        ends = first[1:][(first[1:] > a) & (first[1:] <= b)] - a
        out.append(np.maximum(_peaks(net, _windows(padded[a * CELL : b * CELL + WIDTH - 1], ends * CELL)).max(1) + net.bias, 0))
    return np.concatenate(out)


def logits(net: Net, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    padded, first = cells(data, at)
    z = _features(_tops(net, padded, first), first, np.diff(at))[-1]
    return np.maximum(z @ net.hidden + net.hidden_bias, 0) @ net.out + net.out_bias


def gradients(net: Net, data: np.ndarray, at: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy, through the chunks' largest responses only."""
    padded, first = cells(data, at)
    seen = _windows(padded, first[1:] * CELL)
    peaks = _peaks(net, seen)
    where = peaks.argmax(1)
    top = np.maximum(np.take_along_axis(peaks, where[:, None], 1)[:, 0] + net.bias, 0)
    chunk, use_next, most, off, z = _features(top, first, np.diff(at))
    pre = z @ net.hidden + net.hidden_bias
    h = np.maximum(pre, 0)
    d = (1 / (1 + np.exp(-(h @ net.out + net.out_bias))) - y) / len(y)
    dh = d[:, None] * net.out * (pre > 0)
    dz = dh @ net.hidden.T
    n = np.diff(first)
    spread_of = lambda x: np.repeat(x, n, axis=0)
    count = n[:, None].astype(np.float32)
    dc = spread_of(dz[:, FILTERS : 2 * FILTERS] / count) + 2 * off * spread_of(dz[:, 2 * FILTERS : 3 * FILTERS] / count)
    best = chunk == spread_of(most)
    dc += best * spread_of(dz[:, :FILTERS] / np.add.reduceat(best, first[:-1], dtype=np.float32))
    dt = dc * ~use_next
    dt[1:] += (dc * use_next)[:-1]
    dt *= top > 0
    cell, f = np.nonzero(dt)
    g, place = dt[cell, f], cell * CELL + where[cell, f]
    tables = np.stack([np.bincount(seen[j][place].astype(np.int64) * FILTERS + f, g, 256 * FILTERS).reshape(256, FILTERS) for j in range(WIDTH)]).astype(np.float32)
    return [tables, dt.sum(0), z.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])]


def train(texts: list[str], labels: list[int], prior: float, epochs: int = EPOCHS, seed: int = 7) -> Net:
    """Adam on balanced classes; `prior` is class 1's true share, 0 to 1 exclusive. One class alone gives its prior everywhere."""
    net, g = Net.new(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    net.shift = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        return net
    share = float(y.mean())
    net.shift -= float(np.log(share / (1 - share)))
    arrays = pa.array(texts, pa.string())
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    step = 0
    for epoch in range(max(epochs, 1 + 400 * epochs // (1 + len(y)))):
        order = g.permutation(len(y))
        shuffled = pa.RecordBatch.from_arrays([arrays.take(pa.array(order)), pa.array(y[order])], names=["text", "y"])
        for part in slices(shuffled, "text", STEP):
            step += 1
            grads = gradients(net, *raw(part.column("text")), part.column("y").to_numpy())
            rate = RATE * min(1.0, step / 20) / (1 + 0.5 * epoch)
            for p, (m, v), d in zip(net.parts(), moments, grads, strict=True):
                d = d + DECAY * p
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _score(net: Net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", STEP):
                x = logits(net, *raw(rows.column("text"))).astype(float) + net.shift
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(x, -40, 40))), pa.float64())], names=["doc_id", "score"])

    return run


def held_out(name="doc_id"):
    """Rows whose labels are never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, longest: int = LONGEST) -> tuple[list[str], list[int], float]:
    """Training texts, their labels, and class 1's share among all labels outside the held-out part.

    At most 2 * per_class texts of `longest` bytes come to the driver: 196 MB by
    the defaults, if all are as long as that.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
    n = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = save(usable.where("y = 0").orderBy(*order).limit(per_class).union(usable.where("y = 1").orderBy(*order).limit(per_class)), "sample")
    size = F.octet_length("text")
    start = F.pmod(F.xxhash64("doc_id", F.lit("window")), F.greatest(F.length("text") - longest // 4, F.lit(0)) + 1)
    part = F.when(size <= longest, F.col("text")).otherwise(F.substr("text", (start + 1).cast("int"), F.lit(longest // 4)))  # a character has four bytes at most
    rows = maybe_in(docs.select("doc_id", part.alias("text")), chosen, "doc_id").join(chosen, "doc_id")
    # an id that labels or documents repeat could bring more rows than were chosen
    rows = rows.orderBy(*order, "text", "y").limit(2 * per_class).collect()
    return [r["text"] or "" for r in rows], [r["y"] for r in rows], (n.get(1, 0) + 1) / (sum(n.values()) + 2)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Net:
    """A network trained on at most per_class texts of each class. An id with contradicting labels counts under both."""
    with scratch(docs.sparkSession):
        return train(*sample(docs, labels, label, per_class))


def score(docs: DataFrame, net: Net, at_least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    The network sees the text alone. A null text scores as an empty one; without
    labels every score is the prior, 0.5. Row by row: repeated rows stay, other
    columns are left out. The network is under 0.2 MB and goes with the tasks. A
    very long text goes through it in runs of cells: a task holds some ten times
    its bytes.
    """
    scored = docs.select("doc_id", "text").mapInArrow(_score(net), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= at_least, 1).otherwise(0).alias("predicted"))


def in_held_out(doc_id: int) -> bool:
    """held_out for one id, in Python."""
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
