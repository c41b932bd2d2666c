"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is a sequence of tokens: runs of letters and digits, and runs of other
characters that are no white space, each of at most PIECE bytes. A token's input
is a vector of its word and the scaled sum of the vectors of its bytes' n-grams
(hashed, with its ends marked), so unknown forms of known words say something too.
Words have a vector of their own if FEWEST training texts hold them; the others
share one, so that no text can be learned by heart from words that it alone has. Windows of SPAN tokens start every STRIDE tokens; they
overlap and cover the whole text. In each window one recurrent network runs
forward and one backward, attention weighs their states, and the weighted mean
gives a logit. A text's logit is its highest window's.

Inputs are projected once for each distinct token of a batch. Training goes
through each text's highest window only. It takes at most `per_class` labelled
texts of each class, as byte_cnn.sample says; everything is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_cnn import PER_CLASS, held_out, sample
from .common import hashes, lower, mix, raw, scratch, slices

SPAN, STRIDE, PIECE = 32, 24, 24
#: Bytes before and after a byte in its n-grams, and buckets of their vectors.
REACH, GRAMS = (1, 2), 1 << 14
DIM, HIDDEN, ATTEND = 12, 12, 8
#: Training texts that a word with a vector of its own is in.
FEWEST = 3
#: Passes over the training texts (more until there are STEPS steps), bytes of a step, its size, weight decay, and the share of inputs and pooled states that a step leaves out.
EPOCHS, STEPS, BATCH, RATE, DECAY, DROP = 5, 600, 1 << 15, 0.01, 1e-4, 0.6
#: Bytes of text that are tokenised together (of several texts), and windows that go through the network together.
STEP, MANY = 1 << 18, 2048
AT_LEAST = 0.3

_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


# -- tokens


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all tokens in bytes, and the index of each text's first token (one entry more than texts)."""
    kind = _KIND[data]
    begin = np.ones(len(data) + 1, bool)
    begin[1:-1] = kind[1:] != kind[:-1]
    begin[at] = True
    edges = np.flatnonzero(begin)
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] != 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    pieces = -(-(ends - starts) // PIECE)
    if len(pieces) and pieces.max() > 1:
        first = np.repeat(starts, pieces) + PIECE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        ends = np.minimum(first + PIECE, np.repeat(ends, pieces))
        starts = first
    return starts, ends, np.searchsorted(starts, at)


@dataclass
class Vocabulary:
    """Distinct tokens: the number of each one's word, and its n-grams' buckets by their reach, those of token i from first[i] on."""

    word: np.ndarray
    grams: np.ndarray  # (len(REACH), bytes)
    first: np.ndarray

    @staticmethod
    def of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, known: np.ndarray) -> Vocabulary:
        """known: sorted hashes of the words with vectors; all others have the number after the last."""
        size = ends - starts
        first = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(first[-1]) + np.repeat(starts - first[:-1], size)
        here, of = data[place].astype(np.uint64), np.repeat(np.arange(len(size)), size)
        code, grams = here + np.uint64(1), []
        for far in range(1, max(REACH) + 1):
            for step in (-far, far):
                near = np.zeros_like(here)
                src, to = (slice(None, -far), slice(far, None)) if step < 0 else (slice(far, None), slice(None, -far))
                near[to] = np.where(of[to] == of[src], here[src] + np.uint64(1), np.uint64(0))
                code = code * np.uint64(257) + near
            if far in REACH:
                grams.append((mix(code) % np.uint64(GRAMS)).astype(np.int64))
        word = np.searchsorted(known, keys)
        word[np.append(known, known[-1:])[word] != keys if len(known) else slice(None)] = len(known)
        return Vocabulary(word, np.array(grams).reshape(len(REACH), -1), first)

    def take(self, which: np.ndarray) -> Vocabulary:
        size = np.diff(self.first)[which]
        first = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(first[-1]) + np.repeat(self.first[which] - first[:-1], size)
        return Vocabulary(self.word[which], self.grams[:, place], first)


def frequent(texts: Iterator[tuple[np.ndarray, np.ndarray]], fewest: int = FEWEST) -> np.ndarray:
    """Sorted hashes of the words that `fewest` texts hold."""
    found = [np.zeros(0, np.uint64)]
    for data, at in texts:
        data = lower(data)
        starts, ends, first = tokens(data, at)
        keys = hashes(data, starts, ends)
        found += [np.unique(keys[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    keys, n = np.unique(np.concatenate(found), return_counts=True)
    return keys[n >= fewest]


def encoded(data: np.ndarray, at: np.ndarray, known: np.ndarray) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """(vocabulary, windows, first): windows hold numbers of distinct tokens, -1 where a window ends early; first is each text's first window (one entry more than texts). A text has one window at least."""
    data = lower(data)
    starts, ends, token_at = tokens(data, at)
    keys, some, number = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
    vocabulary = Vocabulary.of(data, starts[some], ends[some], keys, known)
    count = np.diff(token_at)
    many = 1 + -(-np.maximum(count - SPAN, 0) // STRIDE)
    first = np.concatenate([[0], np.cumsum(many)])
    begin = np.repeat(token_at[:-1], many) + STRIDE * (np.arange(first[-1]) - np.repeat(first[:-1], many))
    place = begin[:, None] + np.arange(SPAN)
    inside = place < np.repeat(token_at[1:], many)[:, None]
    windows = np.full(place.shape, -1, np.int32)
    windows[inside] = number[place[inside]]
    return vocabulary, windows, first


# -- network


@dataclass
class Net:
    """Arrays with a leading 2 have one entry for each direction; gates are update, reset, candidate."""

    known: np.ndarray
    words: np.ndarray
    grams: np.ndarray
    into: np.ndarray  # (2, 2 * DIM, 3 * HIDDEN)
    bias: np.ndarray  # (2, 3 * HIDDEN)
    again: np.ndarray  # (2, HIDDEN, 3 * HIDDEN)
    attend: np.ndarray  # (2 * HIDDEN, ATTEND)
    attend_bias: np.ndarray
    weigh: np.ndarray  # (ATTEND,)
    out: np.ndarray  # (2 * HIDDEN,)
    out_bias: np.ndarray  # (1,)

    @staticmethod
    def new(known: np.ndarray, seed: int = 7, kind=np.float32) -> Net:
        g = np.random.default_rng(seed)
        draw = lambda size, scale: g.normal(0, scale, size).astype(kind)
        zero = lambda *size: np.zeros(size, kind)
        return Net(
            known, draw((len(known) + 1, DIM), 0.1), draw((GRAMS, DIM), 0.1), draw((2, 2 * DIM, 3 * HIDDEN), (2 * DIM) ** -0.5), zero(2, 3 * HIDDEN), draw((2, HIDDEN, 3 * HIDDEN), HIDDEN**-0.5),
            draw((2 * HIDDEN, ATTEND), (2 * HIDDEN) ** -0.5), zero(ATTEND), draw(ATTEND, ATTEND**-0.5), draw(2 * HIDDEN, (2 * HIDDEN) ** -0.5), zero(1),
        )

    def parts(self) -> list[np.ndarray]:
        """All that is trained."""
        return [getattr(self, f.name) for f in fields(self)[1:]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def inputs(net: Net, v: Vocabulary) -> np.ndarray:
    """(tokens, 2 * DIM): each token's word vector beside its n-grams' sum over the root of their number."""
    if not len(v.word):
        return np.zeros((0, 2 * DIM), net.words.dtype)
    total = np.add.reduceat(sum(net.grams[g] for g in v.grams), v.first[:-1])
    return np.concatenate([net.words[v.word], total / _root(v)], axis=1)


def _root(v: Vocabulary) -> np.ndarray:
    return np.sqrt(np.diff(v.first) * len(REACH)).astype(np.float32)[:, None]


def projected(net: Net, x: np.ndarray) -> np.ndarray:
    """(2, tokens + 1, 3 * HIDDEN): the gates' inputs; the last row is for places without a token."""
    return np.concatenate([x @ net.into + net.bias[:, None], np.zeros((2, 1, 3 * HIDDEN), x.dtype)], axis=1)


def forward(net: Net, gates: np.ndarray, windows: np.ndarray, keep: bool = False, scale: np.ndarray | float = 1.0):
    """Logits of windows; with `keep` also what the way back needs. scale multiplies pooled states."""
    n, span, h2 = len(windows), windows.shape[1], 2 * HIDDEN
    kind = gates.dtype
    there = (windows >= 0).astype(kind)
    h = np.zeros((2, n, HIDDEN), kind)
    states = np.empty((span, n, h2), kind)
    steps = []
    for t in range(span):
        back = span - 1 - t
        g = np.stack([gates[0][windows[:, t]], gates[1][windows[:, back]]])
        live = np.stack([there[:, t], there[:, back]])[:, :, None]
        r = h @ net.again
        zr = _sigmoid(g[:, :, :h2] + r[:, :, :h2])
        z, reset, own = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:], r[:, :, h2:]
        c = np.tanh(g[:, :, h2:] + reset * own)
        was, h = h, (c + z * (h - c)) * live
        states[t, :, :HIDDEN], states[back, :, HIDDEN:] = h[0], h[1]
        if keep:
            steps.append((was, z, reset, own, c, live))
    a = np.tanh(states @ net.attend + net.attend_bias)
    e = a @ net.weigh
    e[there.T == 0] = -np.inf
    top = e.max(axis=0)
    w = np.exp(e - np.where(np.isfinite(top), top, 0))
    w /= np.maximum(w.sum(axis=0), np.finfo(kind).tiny)
    pooled = np.einsum("tn,tnh->nh", w, states) * scale
    logit = pooled @ net.out + net.out_bias[0]
    return (logit, (steps, states, a, w, pooled)) if keep else logit


def window_logits(net: Net, vocabulary: Vocabulary, windows: np.ndarray) -> np.ndarray:
    gates = projected(net, inputs(net, vocabulary))
    return np.concatenate([forward(net, gates, windows[i : i + MANY]) for i in range(0, len(windows), MANY)])


# -- training


def _back(net: Net, windows: np.ndarray, gates: np.ndarray, y: np.ndarray, scale: np.ndarray | float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of the mean cross-entropy of windows: the gradient of the gates' inputs, and of the network behind them (bias to out_bias, in the order of parts)."""
    logit, (steps, states, a, w, pooled) = forward(net, gates, windows, True, scale)
    span, h2 = windows.shape[1], 2 * HIDDEN
    d = ((_sigmoid(logit) - y) / len(y)).astype(gates.dtype)
    d_pooled = d[:, None] * net.out * scale
    d_states = w[:, :, None] * d_pooled
    d_w = np.einsum("tnh,nh->tn", states, d_pooled)
    d_e = w * (d_w - (w * d_w).sum(axis=0))
    d_a = d_e[:, :, None] * net.weigh * (1 - a * a)
    d_states += d_a @ net.attend.T
    flat = d_a.reshape(-1, ATTEND)
    rest = [states.reshape(-1, h2).T @ flat, flat.sum(0), (d_e[:, :, None] * a).sum((0, 1)), pooled.T @ d, np.array([d.sum()])]
    d_gates, d_again = np.zeros_like(gates), np.zeros_like(net.again)
    dh = np.zeros((2, len(windows), HIDDEN), gates.dtype)
    for t in reversed(range(span)):
        back = span - 1 - t
        was, z, reset, own, c, live = steps[t]
        dh = (dh + np.stack([d_states[t, :, :HIDDEN], d_states[back, :, HIDDEN:]])) * live
        dc = dh * (1 - z) * (1 - c * c)
        dz, dr = dh * (was - c) * z * (1 - z), dc * own * reset * (1 - reset)
        np.add.at(d_gates[0], windows[:, t], np.concatenate([dz[0], dr[0], dc[0]], axis=1))
        np.add.at(d_gates[1], windows[:, back], np.concatenate([dz[1], dr[1], dc[1]], axis=1))
        d_r = np.concatenate([dz, dr, dc * reset], axis=2)
        d_again += was.transpose(0, 2, 1) @ d_r
        dh = dh * z + d_r @ net.again.transpose(0, 2, 1)
    return d_gates, [d_gates[:, :-1].sum(1), d_again, *rest]


def gradients(net: Net, vocabulary: Vocabulary, windows: np.ndarray, first: np.ndarray, y: np.ndarray, drop=None) -> list[np.ndarray]:
    """Of the mean cross-entropy of texts, through each one's highest window. drop(shape): what inputs and pooled states are multiplied with."""
    every = window_logits(net, vocabulary, windows)
    best = np.array([a + int(every[a:b].argmax()) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
    used, number = np.unique(windows[best], return_inverse=True)
    number = number.reshape(-1, windows.shape[1])
    if len(used) and used[0] < 0:
        used, number = used[1:], number - 1
    v = vocabulary.take(used)
    x = inputs(net, v)
    kept, scale = (drop(x.shape), drop((len(best), 2 * HIDDEN))) if drop else (1.0, 1.0)
    x = x * kept
    d_gates, behind = _back(net, number, projected(net, x), y, scale)
    d_gates = d_gates[:, :-1]
    dx = (d_gates @ net.into.transpose(0, 2, 1)).sum(0) * kept
    d_words, d_grams = np.zeros_like(net.words), np.zeros_like(net.grams)
    np.add.at(d_words, v.word, dx[:, :DIM])
    each = np.repeat(dx[:, DIM:] / _root(v), np.diff(v.first), axis=0)
    for g in v.grams:
        np.add.at(d_grams, g, each)
    return [d_words, d_grams, x.T @ d_gates, *behind]


@dataclass
class Model:
    """prior: the log odds of class 1. shift: these against the odds among the training texts."""

    net: Net
    prior: float
    shift: float

    def log_odds(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each text. One without tokens says nothing: the prior."""
        vocabulary, windows, first = encoded(data, at, self.net.known)
        x = np.maximum.reduceat(window_logits(self.net, vocabulary, windows), first[:-1]).astype(float)
        return np.where(windows[first[:-1], 0] < 0, self.prior, x + self.shift)


def train(texts: list[str], labels: list[int], prior: float, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Adam; `prior` is class 1's true share, 0 to 1 exclusive. One class alone gives its prior everywhere."""
    array, y, g = pa.array(texts, pa.string()), np.array(labels, np.float32), np.random.default_rng(seed)
    net = Net.new(frequent(raw(array.slice(i, 1)) for i in range(len(array))), seed)
    log_prior = shift = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        return Model(net, log_prior, shift)
    share = float(y.mean())
    shift -= float(np.log(share / (1 - share)))
    drop = lambda shape: ((g.random(shape) >= DROP) / (1 - DROP)).astype(np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    step = 0
    epochs = max(epochs, -(-STEPS * BATCH // (1 + sum(len(t.encode()) for t in texts))))
    for epoch in range(min(epochs, STEPS)):
        order = g.permutation(len(y))
        shuffled = pa.RecordBatch.from_arrays([array.take(pa.array(order)), pa.array(y[order])], names=["text", "y"])
        for part in slices(shuffled, "text", BATCH):
            step += 1
            grads = gradients(net, *encoded(*raw(part.column("text")), net.known), part.column("y").to_numpy(), drop)
            rate = RATE * min(1.0, step / 20) / (1 + 2.5 * epoch / epochs)
            for p, (m, v), d in zip(net.parts(), moments, grads, strict=True):
                d = d + DECAY * p
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
    return Model(net, log_prior, shift)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """A network trained on at most per_class texts of each class, none of them held out. An id with contradicting labels counts under both."""
    with scratch(docs.sparkSession):
        return train(*sample(docs, labels, label, per_class))


# -- scoring


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", STEP):
                x = model.log_odds(*raw(rows.column("text")))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(x, -40, 40))), pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, at_least: float = AT_LEAST) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    The network sees the text alone. A null text, and one of white space only,
    scores as an empty one: the share of class 1 among the labels; without labels,
    or with labels of one class, every score is that. Row by row: repeated rows
    stay, a null id stays null, other columns are left out. The network is under
    1 MB and goes with the tasks. A task holds some ten times the bytes of a very
    long text.
    """
    scored = docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= at_least, 1).otherwise(0).alias("predicted"))
