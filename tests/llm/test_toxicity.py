"""The recurrent network against a plain one, its gradients against differences, and its accuracy on texts held out."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from tideline.llm import gru_toxicity as gt
from tideline.llm.byte_cnn import in_held_out
from tideline.llm.common import hashes, raw
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["", "   \n", "One two, three!! café ☃☃ x", "abc " * 100, "a" * 100 + " b", "### $$ no-one's", "w1 w2 w3 " * 11, "\x00\x01 ok", None]


def plain_tokens(text):
    out, last = [], 0
    for b in (text or "").encode():
        b += 32 if 65 <= b <= 90 else 0
        kind = 0 if b in b" \t\n\v\f\r" else 1 if b >= 128 or chr(b).isalnum() else 2
        if kind and kind == last and len(out[-1]) < gt.PIECE:
            out[-1] += bytes([b])
        elif kind:
            out.append(bytes([b]))
        last = kind
    return out


def plain_inputs(net, token):
    key = hashes(np.frombuffer(token, np.uint8), np.array([0]), np.array([len(token)]))[0]
    at = int(np.searchsorted(net.known, key))
    word = net.words[at if at < len(net.known) and net.known[at] == key else len(net.known)]
    total = np.zeros(gt.DIM)
    for i, b in enumerate(token):
        code = b + 1
        for far in (1, 2):
            for j in (i - far, i + far):
                code = (code * 257 + (token[j] + 1 if 0 <= j < len(token) else 0)) % 2**64
            total += net.grams[int(gt.mix(np.array([code], np.uint64))[0] % np.uint64(gt.GRAMS))]
    return np.concatenate([word, total / math.sqrt(2 * len(token))])


def plain_logit(net, text):
    sig = lambda x: 1 / (1 + np.exp(-x))
    seq, h, best = plain_tokens(text), gt.HIDDEN, []
    windows = [seq[: gt.SPAN]]
    while (len(windows) - 1) * gt.STRIDE + gt.SPAN < len(seq):
        windows.append(seq[len(windows) * gt.STRIDE :][: gt.SPAN])
    for window in windows:
        states = np.zeros((len(window), 2 * h))
        for way in (0, 1):
            state = np.zeros(h)
            for t in range(len(window))[:: 1 - 2 * way]:
                g = plain_inputs(net, window[t]) @ net.into[way] + net.bias[way]
                r = state @ net.again[way]
                update, reset = sig(g[:h] + r[:h]), sig(g[h : 2 * h] + r[h : 2 * h])
                state = (1 - update) * np.tanh(g[2 * h :] + reset * r[2 * h :]) + update * state
                states[t, way * h : (way + 1) * h] = state
        pooled = np.zeros(2 * h)
        if len(window):
            e = np.exp(np.tanh(states @ net.attend + net.attend_bias) @ net.weigh)
            pooled = (e / e.sum()) @ states
        best.append(float(pooled @ net.out + net.out_bias[0]))
    return max(best)


def logits(net, data, at):
    return gt.Model(net, -9.0, 0.0).log_odds(data, at)


def small_net(kind):
    known = gt.frequent([raw(pa.array([t])) for t in ("one two x ok", "abc b one", "one abc w1 w2")], 1)
    net = gt.Net.new(known, 3, kind)
    g = np.random.default_rng(4)
    for p in net.parts():
        p += g.normal(0, 0.3, p.shape).astype(kind)
    return net


def test_tokens():
    data, at = raw(pa.array(TEXTS))
    starts, ends, first = gt.tokens(gt.lower(data), at)
    low = gt.lower(data).tobytes()
    found = [[low[a:b] for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert found == [plain_tokens(t) for t in TEXTS]


def test_logits_equal_a_plain_network():
    net = small_net(np.float64)
    got = logits(net, *raw(pa.array(TEXTS)))
    assert np.allclose(got, [plain_logit(net, t) if plain_tokens(t) else -9 for t in TEXTS], atol=1e-5)
    alone = [logits(net, *raw(pa.array([t], pa.string())))[0] for t in TEXTS]
    assert np.allclose(got, alone, atol=1e-9)


def test_windows_cover_every_token():
    rng = random.Random(2)
    texts = [" ".join(f"t{i}" for i in range(rng.choice([0, 1, 31, 32, 33, 55, 56, 57, 200]))) for _ in range(20)]
    _, windows, first = gt.encoded(*raw(pa.array(texts)), np.zeros(0, np.uint64))
    for text, a, b in zip(texts, first[:-1], first[1:], strict=True):
        n = len(text.split())
        assert b - a == max(1, 1 + -(-(n - gt.SPAN) // gt.STRIDE))
        assert len(set(windows[a:b].ravel().tolist()) - {-1}) == n
        assert all((w >= 0).all() for w in windows[a : b - 1])


def test_gradients():
    net = small_net(np.float64)
    texts, y = [t for t in TEXTS if t] + ["one two"], np.array([0, 1, 0, 1, 1, 0, 1, 0], float)
    coded = gt.encoded(*raw(pa.array(texts)), net.known)
    g = np.random.default_rng(9)
    masks = {}

    def drop(shape):
        return masks.setdefault(shape, (g.random(shape) > 0.3) / 0.7)

    def loss():
        every = gt.window_logits(net, coded[0], coded[1])
        best = [a + int(every[a:b].argmax()) for a, b in zip(coded[2][:-1], coded[2][1:], strict=True)]
        used = np.unique(coded[1][best])
        used, v = used[used >= 0], None
        v = coded[0].take(used)
        x = gt.inputs(net, v)
        number = np.searchsorted(used, coded[1][best])
        number[coded[1][best] < 0] = -1
        x = gt.forward(net, gt.projected(net, x * drop(x.shape)), number, scale=drop((len(best), 2 * gt.HIDDEN)))
        return float(np.mean(np.logaddexp(0, x) - y * x))

    loss()
    grads = gt.gradients(net, *coded, y, drop)
    for p, d in zip(net.parts(), grads, strict=True):
        assert p.shape == d.shape
        places = np.argsort(np.abs(d), axis=None)[-4:]
        for i in places:
            at = np.unravel_index(i, p.shape)
            keep, e = p[at], 1e-6
            p[at] = keep + e
            up = loss()
            p[at] = keep - e
            down = loss()
            p[at] = keep
            assert math.isclose((up - down) / (2 * e), d[at], rel_tol=2e-3, abs_tol=1e-8)


def labelled(n, seed):
    rng = random.Random(seed)
    base = ["ka", "lo", "mi", "né", "tu", "sa"]
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choices(base, k=rng.randint(1, 4))) for _ in range(rng.randint(5, 150))]
        toxic = int(rng.random() < 0.25)
        for _ in range(2 * toxic):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["vile", "Rotten", "zug" + rng.choice(base)]))
        rows.append((i, " ".join(w) + ".", "en", "a", 1))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy_and_rows(spark):
    rows, labels = labelled(900, 1)
    docs = spark.createDataFrame([*rows, (5000, None, None, None, None), (5001, "", "en", "a", 1), (5001, "", "en", "a", 1), (None, "vile Rotten vile", "en", "a", 1)], SCHEMA).withColumns({"score": F.lit("s"), "held_out": F.lit(1)})
    table = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    model = gt.fit(docs, table)
    out = gt.score(docs, model)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = out.collect()
    assert len(got) == 904 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    empty = {r["score"] for r in got if r["doc_id"] in (5000, 5001)}
    assert len(empty) == 1 and 0.2 < empty.pop() < 0.3
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and in_held_out(r["doc_id"])]
    assert all(r["held_out"] for r in held) and len(held) > 150
    right = sum(r["predicted"] == labels[r["doc_id"]][2] for r in held)
    assert right / len(held) > 0.95
    flipped = spark.createDataFrame([(i, q, 1 - t if in_held_out(i) else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    sample = lambda x: sorted(zip(*gt.sample(docs, x, "toxic")[:2], strict=True))
    with gt.scratch(spark):
        assert sample(flipped) == sample(table.where("doc_id < 900"))


def test_without_labels_or_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = gt.fit(docs, none)
    assert {round(r["score"], 6) for r in gt.score(docs, model).collect()} == {0.5}
    assert gt.score(empty, model).collect() == []


def test_one_class_gives_its_prior():
    model = gt.train(["a b", "c"], [1, 1], 0.75)
    assert np.allclose(model.log_odds(*raw(pa.array(["x", "", "a b"]))), math.log(3))


@pytest.mark.parametrize("text", ["idiot " * 400_000, "x" * 2_400_000, "é" * 1_200_000, "#" * 2_400_000])
def test_very_long_texts(text):
    """In bounded memory, and every window counts: one word at the end is found as one in the middle is."""
    net = small_net(np.float32)
    import tracemalloc

    tracemalloc.start()
    x = logits(net, *raw(pa.array([text], pa.large_string())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(x).all() and peak < 60 * len(text.encode()) + 5e7


def test_last_window_counts():
    net = small_net(np.float64)
    quiet = "abc " * 3000
    loud = max(("one", "two", "ok", "w1", "x", "b"), key=lambda w: plain_logit(net, w + " abc" * 31))
    a, b = logits(net, *raw(pa.array([quiet, quiet + loud])))
    assert a != b and math.isclose(b, plain_logit(net, quiet + loud), abs_tol=1e-5)
