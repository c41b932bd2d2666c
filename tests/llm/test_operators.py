"""Every operator against a plain version on a small fixture, and on empty tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideline.llm import bitsliced, byte_cnn, licenses, parity_join, pii, quality_mcd, secrets, token_orc, tree_bpe
from tideline.llm.mixing import mix_sources, mixed_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
words = lambda t: WORD.findall(t or "")
lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
sha = lambda t: hashlib.sha256(t.encode() if isinstance(t, str) else t).hexdigest()
same = lambda got, want: sorted(map(repr, got)) == sorted(map(repr, want))


# -- 1


def plain_stats(t):
    w, t = words(t), t or ""
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), base


def test_statistics(docs, texts):
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_mcd.quality(docs).collect()]
    assert same(got, [(i, *plain_stats(t)) for i, t in texts])


def test_outliers(spark):
    """Junk goes and clean texts stay, also where a group is too small for an estimate of its own; reruns agree."""
    g = np.random.default_rng(1)
    vocabulary = ["".join(g.choice(list("abcdefghij"), 5)) for _ in range(300)]
    rows = []
    for i in range(700):
        w = [str(x) for x in g.choice(vocabulary, int(g.integers(60, 200)))]
        junk = i % 20 == 0
        rows.append((i, " ".join(x + "###" if junk else x for x in w) + ".", "en", "big" if i < 500 else f"small{i % 3}", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.kept, r.distance) for r in quality_mcd.quality(df).collect()}
    assert all(kept == (i % 20 != 0) for i, (kept, _) in got.items())
    assert got == {r.doc_id: (r.kept, r.distance) for r in quality_mcd.quality(df.repartition(7)).collect()}


def plain_vector(t):
    """The statistics' vector of a text on its grid."""
    n, chars, symbols, dups, repeats, _ = plain_stats(t)
    n, chars = max(n, 1), max(chars, 1)
    upper, points = sum("A" <= c <= "Z" for c in t), sum(c in "!?.,;:()-" for c in t)
    v = [np.log(chars / n), np.arcsinh(50 * symbols / chars), np.arcsinh(2 * dups / n**0.5), np.arcsinh(5 * repeats / n), np.arcsinh(20 * upper / chars), np.arcsinh(20 * points / chars)]
    return np.floor(np.array(v) * 1024 + 0.5) / 1024


def plain_mcd(x, draws=400):
    """Centre and scatter of rows x: the best of many starts, steps until nothing moves, rows near it, both scaled by the median."""
    g, n, p = np.random.default_rng(99), len(x), 6
    floor = np.diag(np.square([0.02, 0.1, 0.1, 0.1, 0.1, 0.1]))
    fit = lambda rows: (rows.mean(0), np.cov(rows.T, bias=True).reshape(p, p) + floor)
    far = lambda mu, s: np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(s), x - mu)
    bins = lambda d2: np.floor(np.log2(d2 + 1e-3) * 16)
    half = min(n, (n + p + 1) // 2)

    def step(mu, s):
        b = bins(far(mu, s))
        return fit(x[b <= np.sort(b)[half - 1]])

    def volume(mu, s):
        d2 = far(mu, s)
        return round(np.linalg.slogdet(s)[1] + p * np.log(np.sort(d2)[half - 1] + 1e-3), 9)

    def scaled(mu, s):
        b = np.sort(bins(far(mu, s)))[(n + 1) // 2 - 1]
        return mu, s * max(1.0, 2 ** ((b + 0.5) / 16) / 5.348)

    starts = [(np.median(x, 0), np.diag(np.square(1.4826 * np.median(np.abs(x - np.median(x, 0)), 0))) + floor)]
    starts += [fit(x[g.integers(0, n, p + 1)]) for _ in range(draws)]
    best = None
    for mu, s in starts:
        for _ in range(12):
            mu, s = step(mu, s)
        if best is None or volume(mu, s) < best[0]:
            best = volume(mu, s), mu, s
    mu, s = best[1:]
    for _ in range(20):
        mu, s = step(mu, s)
    mu, wide = scaled(mu, s)
    return scaled(*fit(x[far(mu, wide) <= 14.449]))


def plain_quality(rows):
    """(kept, distance) of rows (doc_id, text, lang, source, ...); a distance only where the group has an estimate."""
    x = np.array([plain_vector(r[1] or "") for r in rows])
    failed = np.array([plain_stats(r[1])[-1] for r in rows])
    found = {}
    for name in (lambda r: (r[2], r[3]), lambda r: (r[2],), lambda r: ()):
        for key in {name(r) for r, f in zip(rows, failed, strict=True) if not f}:
            own = x[[not f and name(r) == key for r, f in zip(rows, failed, strict=True)]]
            found[key] = len(own), *plain_mcd(own)
    out = []
    for r, v, f in zip(rows, x, failed, strict=True):
        if (r[2], r[3]) not in found:
            out.append((False, None))
            continue
        _, mu, s = found[()]
        for key in ((r[2],), (r[2], r[3])):
            n, m, c = found[key]
            free = max(0, (n - 7) / 2)
            u, w = min(1, 3 * free / n), free / (free + 24)
            mu, s = u * m + (1 - u) * mu, w * c + (1 - w) * s
        d = float((v - mu) @ np.linalg.inv(s) @ (v - mu))
        out.append((bool(not f and d <= 200), d))
    return out


def test_whole_estimate(spark):
    """Every group's estimate, those on which it leans and all verdicts against numpy; groups of 1 to 150 rows, some with junk, null names."""
    g = np.random.default_rng(11)
    vocabulary = ["".join(g.choice(list("abcdefghij"), int(g.integers(3, 8)))) for _ in range(400)]
    rows = []
    for lang, source, n in (("en", "a", 150), ("en", "b", 40), ("en", None, 9), ("fr", "a", 60), ("fr", "c", 2), (None, "a", 1), (None, None, 30)):
        for i in range(n):
            w = [str(v) for v in g.choice(vocabulary, int(g.integers(60, 160)))]
            w = [v.capitalize() if g.random() < 0.1 else v for v in w]
            w = [v + ("##$" if i % 4 == 3 and g.random() < 0.8 else "." if g.random() < 0.1 else "") for v in w]
            rows.append((len(rows), " ".join(w), lang, source))
    rows += [(1000, "too short", "en", "a"), (1001, None, "de", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.kept, r.distance) for r in quality_mcd.quality(df).collect()}
    for r, (kept, d) in zip(rows, plain_quality(rows), strict=True):
        assert got[r[0]][0] == kept, r[0]
        assert (d is None) == (got[r[0]][1] is None) and (d is None or np.isclose(d, got[r[0]][1], rtol=1e-6)), (r[0], d, got[r[0]])
    assert all(got[i][0] == (i % 4 != 3) for i in range(150))


def test_step_is_exact(spark):
    """One concentration step against numpy."""
    g = np.random.default_rng(2)
    x = np.round(g.normal(0, 1, (400, quality_mcd.P)) * 1024).astype(int)
    df = spark.createDataFrame([(i, "g", [int(v) for v in r]) for i, r in enumerate(x)], "doc_id long, gid string, x array<long>")
    first = quality_mcd._starts(df)
    step = quality_mcd._step(df, first).first()
    r = first.first()
    d = x / 1024 - np.array(r.mu)
    d2 = np.einsum("ij,jk,ik->i", d, np.array(r.inverse).reshape(quality_mcd.P, -1), d)
    b = np.floor(np.log2(d2 + 1e-3) * quality_mcd.OCTAVE)
    near = x[b <= np.sort(b)[202]] / 1024
    assert np.allclose(step.mu, near.mean(0))
    assert np.isclose(step.logdet, np.linalg.slogdet(np.cov(near.T, bias=True) + np.diag(np.square(quality_mcd.FLOOR)))[1])


def test_much_junk(spark):
    """30 and 40 % junk, copies and varied: all of it goes, and no other row."""
    g = np.random.default_rng(4)
    rows = []
    for share in (30, 40):
        for kind in ("copies", "varied"):
            bad = 5 * share
            x = g.normal(0, 0.1, (500, quality_mcd.P))
            x[:bad, 1:3] += (g.uniform(3, 5, (bad, 2)) if kind == "varied" else 4) * np.ones(2)
            if kind == "copies":
                x[:bad] = x[0]
            rows += [(i, f"{kind}{share}", [int(v) for v in np.round(r * quality_mcd.GRID)], i < bad) for i, r in enumerate(x)]
    fit = spark.createDataFrame(rows, "doc_id long, gid string, x array<long>, bad boolean")
    d = quality_mcd._distance(F.col("x"), F.col("mu"), F.col("inverse")) / F.col("scale")
    got = fit.join(quality_mcd.fit_groups(fit.drop("bad")), "gid").select("bad", (d > quality_mcd.CUT).alias("out")).collect()
    assert len(got) == 2000 and all(r.bad == r.out for r in got)


def test_small_tables_are_judged(spark):
    """Every group has an estimate, however few its rows."""
    g = np.random.default_rng(5)
    vocabulary = ["".join(g.choice(list("abcdefghij"), 5)) for _ in range(300)]
    rows = []
    for i in range(90):
        w = [str(x) for x in g.choice(vocabulary, int(g.integers(60, 200)))]
        lang = "en" if i < 60 else f"x{i % 3}"
        rows.append((i, " ".join(x + "###" if i % 10 == 0 else x for x in w) + ".", lang, "a"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality_mcd.quality(df).collect()
    assert len(got) == 90 and all(r.distance is not None and r.kept == (r.doc_id % 10 != 0) for r in got)


# -- 2


def test_licenses(docs, texts):
    by_id = dict(texts)
    got = licenses.license_blocks(docs).collect()
    assert {(r.doc_id, r.license, r.missing_words) for r in got} == {(130, "Apache-2.0-notice", 0), (131, "Apache-2.0-notice", 1)}
    for r in got:
        assert "icensed under the Apache" in by_id[r.doc_id][r.block_start : r.block_end]
    assert [c for r in got if r.doc_id == 131 for c in r.changes] == ["-license+licence"]
    scan = licenses.Templates(licenses.TEMPLATES).scan
    for name, text in licenses.TEMPLATES.items():
        assert [(x["license"], x["missing"]) for x in scan("So. " + text + " Next")] == [(name, 0)]
    assert scan("nothing of that kind here") == [] == scan("")


def test_licenses_side_by_side():
    """Each of several licenses is found, at its words, repeats too."""
    t = licenses.TEMPLATES
    scan = licenses.Templates(t).scan
    for names in (["MIT", "Apache-2.0"], ["MIT-notice", "Apache-2.0-notice"], ["MIT-notice", "CC-BY-4.0"], ["MIT-notice", "MIT-notice"], ["MIT", "MIT", "ISC"], ["BSD-3-Clause", "GPL-2.0", "Zlib", "CC-BY-NC-4.0"], ["CC-BY-4.0", "CC-BY-SA-4.0"]):
        for gap in (" ", " and one\n", " é " * 40):
            text = "Été: " + gap.join(t[n] for n in names) + " end"
            got = scan(text)
            assert [x["license"] for x in got] == names
            for x, n in zip(got, names, strict=True):
                assert licenses.plain_words(text[slice(*x["span"])]) == licenses.plain_words(t[n])
    assert [(x["license"], x["changes"]) for x in scan("Released under a MIT License.")] == [("MIT-notice", ["-the+a"])]
    inserted = t["MIT-grant"].replace("free of charge", "entirely free of any charge").replace("sublicense", "license")
    assert [(x["license"], x["missing"]) for x in scan(inserted)] == [("MIT-grant", 1)]


def plain_matches(model, w):
    """(first word, last word + 1) of every stretch of w whose closest alignment to its end agrees with a template, by plain edit distances."""
    n, out = len(model), []
    best = {}
    for a in range(len(w)):
        row = [(i, i) for i in range(n + 1)]  # (missing and extra, missing) of model[:i] and nothing
        for b in range(a, min(len(w), a + 2 * n)):
            new = [(row[0][0] + 1, row[0][1])]
            for i in range(1, n + 1):
                options = [(row[i][0] + 1, row[i][1]), (new[i - 1][0] + 1, new[i - 1][1] + 1)]
                if model[i - 1] == w[b]:
                    options.append(row[i - 1])
                new.append(min(options))
            row = new
            if b + 1 not in best or (row[n], -a) < best[b + 1]:
                best[b + 1] = row[n], -a
    for b, ((d, missing), a) in best.items():
        shared = n - missing
        if shared >= licenses.WORDING * n and shared >= licenses.WORDING * (b + a) and d - missing == b + a - shared:
            out.append((-a, b))
    return out


def test_a_notice_file_of_many_licenses(monkeypatch):
    """Licenses with headings of their own, side by side and of several kinds: each is found at its words, by work that grows with their number alone."""
    templates, cells = licenses.Templates(licenses.TEMPLATES), []
    plain = templates.matches

    def counted(t, ids, p, q):
        cells.append((q - p) * len(templates.models[t]))
        return plain(t, ids, p, q)

    monkeypatch.setattr(templates, "matches", counted)
    work = []
    for n in (50, 200):
        names = [("MIT", "MIT", "ISC", "BSD-3-Clause", "MIT-notice")[i % 5] for i in range(n)]
        text = "".join(f"Package {i} by author {i}\n\n" * (i % 3 > 0) + licenses.TEMPLATES[name] + "\n" for i, name in enumerate(names))
        cells.clear()
        found = templates.scan(text)
        work.append(sum(cells))
        assert [x["license"] for x in found] == names
        assert all(not x["missing"] and not x["changes"] for x in found)
        assert [licenses.plain_words(text[slice(*x["span"])]) for x in found] == [licenses.plain_words(licenses.TEMPLATES[name]) for name in names]
    assert work[1] <= 5 * work[0]
    again = templates.scan(licenses.TEMPLATES["GPL-3.0-notice"] + " " + licenses.TEMPLATES["GPL-2.0-notice"])
    assert [(x["license"], x["changes"]) for x in again] == [("GPL-3.0-notice", []), ("GPL-2.0-notice", [])]


def test_no_license_is_passed_over(monkeypatch):
    """Against all templates at all words of random mixtures, whatever the reduction: every match overlaps one that is found, and every one found is such a match."""
    import random

    monkeypatch.setattr(licenses, "REDUCTION", -9.0)
    rng = random.Random(4)
    chosen = {k: licenses.TEMPLATES[k] for k in ("MIT-notice", "Apache-2.0-notice", "GPL-3.0-notice", "GPL-2.0-notice", "CC-BY-NC-4.0", "CC-BY-4.0", "BSL-1.0-notice", "CC0-1.0")}
    templates = licenses.Templates(chosen)
    common = sorted({w for t in chosen.values() for w in licenses.plain_words(t)})
    count = 0
    for _ in range(40):
        w = []
        for _ in range(rng.randint(1, 4)):
            w += [rng.choice(common) for _ in range(rng.randint(0, 6))]
            for x in licenses.plain_words(rng.choice([*chosen.values()])):
                r = rng.random()
                w += [] if r < 0.05 else [x, rng.choice(common)] if r < 0.1 else ["odd"] if r < 0.15 else [x]
        text, spans = " ".join(w), []
        for t, model in enumerate(templates.words):
            spans += [(templates.names[t], a, b) for a, b in plain_matches(model, w)]
        found = [(x["license"], len(text[: x["span"][0]].split()), len(text[: x["span"][1]].split())) for x in templates.scan(text)]
        count += len(found)
        for name, a, b in spans:
            assert any(a < y and x < b for _, x, y in found), (text, name, a, b, found)
        for name, a, b in found:
            assert any(n == name and x < b and a < y for n, x, y in spans), (text, spans, name, a, b)
    assert count > 40


# -- 3


def test_classifier(spark):
    g = np.random.default_rng(3)
    make = lambda bad: " ".join("".join(g.choice(list("abcde"), 4)) + ("!!" if bad and g.random() < 0.5 else "") for _ in range(int(g.integers(5, 400))))
    rows = [(i, make(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    net = byte_cnn.fit(docs, labels, per_class=100)
    got = byte_cnn.score(docs, net).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held) and len(held) > 100
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in held]) > 0.95
    none = byte_cnn.fit(docs, labels.where("false"))
    assert {r.score for r in byte_cnn.score(docs, none).collect()} == {0.5}


def test_training_leaves_held_out_labels_alone(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    texts, _, _ = byte_cnn.sample(docs, labels, "quality")
    assert {int(t.split()[1]) for t in texts} == {i for i in range(50) if not byte_cnn.in_held_out(i)}


def test_gradients():
    """Against finite differences, and chunks that cover the whole text however it is dealt."""
    import pyarrow as pa

    from tideline.llm.common import raw

    net = byte_cnn.Net.new(1)
    for p in net.parts():
        p[...] = p.astype(np.float32)
    data, at = raw(pa.array(["hello world " * 30, "", None, "x" * 500]))
    y = np.array([1, 0, 1, 0], np.float32)

    def loss():
        z = byte_cnn.logits(net, data, at).astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    for p, g in zip(net.parts(), byte_cnn.gradients(net, data, at, y), strict=True):
        flat, i = p.reshape(-1), int(np.abs(g).argmax())
        h = 1e-2
        flat[i] += h
        up = loss()
        flat[i] -= 2 * h
        down = loss()
        flat[i] += h
        assert np.isclose((up - down) / (2 * h), g.reshape(-1)[i], rtol=0.1, atol=1e-4)
    alone = [byte_cnn.logits(net, *raw(pa.array([t])))[0] for t in ["hello world " * 30, "", "", "x" * 500]]
    assert np.allclose(alone, byte_cnn.logits(net, data, at), atol=1e-4)
    late = byte_cnn.logits(net, *raw(pa.array(["a" * 5000, "a" * 4990 + "ZQZQZQZQZQ"])))
    assert late[0] != late[1]


def test_forward_pass():
    """Against a convolution written out place by place; in runs of cells too, and for one long text in bounded memory."""
    import resource

    import pyarrow as pa

    from tideline.llm.common import raw

    net, w, c = byte_cnn.Net.new(3), byte_cnn.WIDTH, byte_cnn.CELL
    texts = ["", "short", "hello wörld " * 40, "x" * 700]
    data, at = raw(pa.array(texts))
    got = byte_cnn.logits(net, data, at)
    for t, value in zip(texts, got, strict=True):
        b = t.encode()
        cells = -(-(len(b) + w - 1) // c)
        b += bytes(cells * c + w - len(b))
        top = []
        for k in range(cells):
            peak = [max(sum(float(net.tables[j, b[i + j] if i + j < cells * c else 0, f]) for j in range(w)) for i in range(k * c, k * c + c)) for f in range(byte_cnn.FILTERS)]
            top.append(np.maximum(np.array(peak) + net.bias, 0))
        chunk = np.array([np.maximum(x, y) for x, y in zip(top, top[1:] + top[-1:], strict=True)])
        z = np.concatenate([chunk.max(0), chunk.mean(0), chunk.var(0), [np.log1p(len(t.encode())) / 8 - 1]])
        want = np.maximum(z @ net.hidden + net.hidden_bias, 0) @ net.out + net.out_bias
        assert np.isclose(want[0], value, atol=1e-3)
    long = pa.array(["ab cd " * (4 << 20)])  # 25 MB
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    byte_cnn.logits(net, *raw(long))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # kB; all responses at once would take 1.6 GB and more


def test_long_texts_in_runs(monkeypatch):
    """Hashes do not depend on the runs they are made in; a run shorter than a word and longer than all."""
    import pyarrow as pa

    from tideline.llm import common

    data, at = common.raw(pa.array(["one two " + "x" * 300 + " é", "", "two"]))
    starts, ends, _ = common.words(data, at)
    want = common.hashes(data, starts, ends)
    assert want[1] == want[4] and len(set(want.tolist())) == 4
    for run in (1, 7, 64, 200):
        monkeypatch.setattr(common, "RUN", run)
        monkeypatch.setattr(common, "_POWERS", [np.zeros(0, np.uint64), np.zeros(0, np.uint64)])
        assert (common.hashes(data, starts, ends) == want).all()


def test_classifier_takes_odd_tables(spark):
    """Clashing columns, repeated rows, contradicting labels, long labelled texts, null ids and texts."""
    rows = [(i % 40, f"text {i % 40} " * (1 + i % 3), 0.5, 1, True) for i in range(80)] + [(None, None, 0.1, 1, None), (50, "long " * 30000, 0.2, 0, None), (51, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int, held_out boolean")
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)] + [(i, 1, "y") for i in range(10)] + [(50, 0, "z"), (None, 1, "n"), (3, None, "m"), (4, 7, "k")], "doc_id long, quality int, text string")
    texts, y, prior = byte_cnn.sample(docs, labels, "quality", longest=1 << 10)
    assert all(len(t.encode()) <= 1 << 10 for t in texts) and {*y} == {0, 1} and 0 < prior < 1
    assert byte_cnn.in_held_out(50) or any(t.startswith(("long", "ong", "ng", "g", " ")) and "long long" in t for t in texts)
    got = byte_cnn.score(docs, byte_cnn.fit(docs, labels)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    assert len({r.score for r in got if r.doc_id == 5}) == len({r[1] for r in rows if r[0] == 5})


# -- 4

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_secrets(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def test_secrets(docs, texts):
    want = []
    for i, t in texts:
        s = plain_secrets(t)
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in s)
        want.append((i, *(sum(x[1] == k for x in s) for k in range(3)), sha(base)))
    got = secrets.secret_digests(docs).collect()
    assert same([(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got], want)
    assert any(r.n_assign == 2 and r.n_access == 1 and r.n_hex == 1 for r in got)


def test_all_rules(spark, docs, texts):
    """Spans of all rules against a plain scan of every text by every rule."""
    more = ["ghp_" + "a1" * 20, "xoxb-" + "1" * 12 + " xoxq-1", "-----BEGIN RSA PRIVATE KEY-----\n-----BEGIN PRIVATE KEY-----", "x sk_live_" + "z" * 20 + " sk_test_short", "eyJhbGciOiJI.eyJzdWIiOiIx.sig-1", "postgresql://u:p@h HTTPS://a:b@c https://x/y", "é token=" + "f" * 40 + " AKIA" + "A" * 12, "Passwd\"='" + "0a" * 20]
    rows = [*texts, *((2000 + i, t) for i, t in enumerate(more))]
    rules = secrets.BASE + secrets.MORE
    want = []
    for i, t in rows:
        found = sorted((m.start(), k, m.end()) for k, r in enumerate(rules) for m in re.compile(r.pattern, re.A | (re.I if r.any_case else 0)).finditer(t or "") if r.check is None or r.check(m))
        want.append((i, ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in found)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.spans) for r in secrets.secret_digests(df).collect()]
    assert same(got, want) and {r.kind for r in rules} == {x.split(":")[0] for _, s in got for x in s.split(",") if x}


def test_trigram_queries():
    import pyarrow as pa

    from tideline.llm.common import raw

    index = secrets.Index(secrets.BASE + secrets.MORE)
    assert [r.kind for r in secrets.BASE + secrets.MORE if secrets.trigram_query(r) is None] == ["hex"]
    texts = ["APIKEY=abcdefgh1", "api_key: 'x'", "to", "ken", "toke n", "gh", "ghp_" + "a" * 40, "xoxb-" + "1" * 12, "-----BEGIN RSA PRIVATE KEY-----", "postgresql://u:p@h", "https://x/y"]
    data, at = raw(pa.array(texts))
    postings = index.postings(data, at)
    found = {r.kind: set(index.search(q, postings, len(texts)).tolist()) for r, q in zip(secrets.BASE + secrets.MORE, index.queries, strict=True)}
    for r in secrets.BASE + secrets.MORE:
        assert {i for i, t in enumerate(texts) if r.compiled().search(t)} <= found[r.kind]
    assert found["assign"] == {0, 1} and found["repository"] == {6} and 3 not in found["assign"]


# -- 5


def test_top_k(spark):
    g = np.random.default_rng(5)
    v = [[float(x) for x in g.normal(0, 0.3, 7)] for _ in range(300)]
    v[10] = v[11] = v[250] = v[20]
    rows = [(i, x) for i, x in enumerate(v)] + [(400, None), (401, [None] + [0.0] * 6), (402, [float("nan")] + [0.0] * 6), (403, [0.5, 0.5]), (450, [float("inf")] * 7), (150, v[3]), (500, [0.25, -0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    ok = [(i, np.floor(256 * np.array(x, np.float32).astype(float)).astype(int)) for i, x in rows if x is not None and None not in x and np.isfinite(x).all()]
    want = []
    for n, (i, q) in enumerate(ok):
        if i % 50 == 0:
            found = sorted((-int(q @ x), j) for m, (j, x) in enumerate(ok) if m != n and len(x) == len(q))[:5]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    assert sum(i == 150 for i, *_ in want) == 10  # two rows of one id are two queries, and find each other
    for size in (16_384, 64):
        usable = bitsliced.numbered(bitsliced.usable(df))
        assert same(sorted(map(tuple, bitsliced.top_k(usable.where("vec_id % 50 = 0"), usable, 5, size).collect())), sorted(want))
    none = bitsliced.numbered(bitsliced.usable(df.where("false")))
    assert bitsliced.top_k(none, none).collect() == []


def test_top_k_of_rows_that_repeat(spark):
    """Equal ids and equal vectors: every row counts, as a candidate and as a query."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.5, 0.0]), (1, [1.0, 1.0])]
    usable = bitsliced.numbered(bitsliced.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    got = sorted(map(tuple, bitsliced.top_k(usable.where("vec_id % 50 = 0"), usable).collect()))
    one, half = 65_536, 32_768
    assert got == sorted([(0, 1, 0, one), (0, 2, 1, one), (0, 3, 0, half)] * 2 + [(0, 1, 0, half), (0, 2, 0, half), (0, 3, 1, half)])


@pytest.mark.parametrize("kind", ["float", "double"])
def test_large_components(spark, kind):
    """Components of any finite size, beside ordinary ones, ranked by exact integers; long scores end at 64 bits."""
    g = np.random.default_rng(12)
    rows = [(i, [float(np.float32(x)) for x in g.normal(0, 1, 4)]) for i in range(120)]
    sizes = [1e6, -1e6, 1e12, 3e18, -1e30, 3e38] + ([1e200, -1e300] if kind == "double" else [])
    for i, x in enumerate(sizes):
        rows.append((100 * i + 150, [float(np.float32(x)) if kind == "float" else x, 0.5, -x / 3 if kind == "double" else float(np.float32(-x / 3)), 1.0]))
        rows.append((100 * i + 151, [0.25, float(np.float32(x / 7)) if kind == "float" else x / 7, 2.0, -1.0]))
    import math

    ok = [(i, [math.floor(256 * int(x)) if abs(x) >= 2**53 else math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for i, q in ok:
        if i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in ok if j != i)[:5]
            want += [(i, r, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(found, 1)]
    usable = bitsliced.numbered(bitsliced.usable(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")))
    for size in (16_384, 16):
        assert same([tuple(r) for r in bitsliced.top_k(usable.where("vec_id % 50 = 0"), usable, 5, size).collect()], want)


def test_bit_slices():
    g = np.random.default_rng(6)
    for low in (-300, 0, 5):
        rows = g.integers(low, low + 400, (130, 5))
        least, bits, slices = bitsliced.slice_block(np.arange(130), rows)
        for query in ([3, -7, 0, 255, -256], [0] * 5, [1] * 5):
            total, constant = bitsliced.add_slices(slices, ~slices, query)
            assert [bitsliced.score_of(total, i) + constant + least * sum(query) for i in range(130)] == (rows @ np.array(query)).tolist()


# -- 6


@pytest.fixture(scope="module")
def vocabulary():
    """As the library reads it, untouched."""
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_files(spark, docs, texts, empty, vocabulary):
    path = token_orc.new_path(spark)
    token_orc.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    want, start = [], 0
    for i, t in order:
        ids = vocabulary.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_orc.token_digests(spark, path).collect()]
    assert same([x for x in got if x[0] not in (114, 117)], [x for x in want if x[0] not in (114, 117)])
    assert sum(x[2] for x in got) == start and len(got) == len(want)
    one = token_orc.read_tokens(spark, path, [118])
    assert one.count() == 1 and "EqualTo(doc_id,118)" in one._jdf.queryExecution().executedPlan().toString()
    none = token_orc.new_path(spark)
    token_orc.write_tokens(empty, none, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_orc.token_digests(spark, none).collect() == []


ODD = ["", "a" * 9000, "  \n\n  x  y\t\tz " * 50, "日本語 " * 300, "x\x1cy \x85 z\xa0w " * 80, "don't we'll " * 200, "!!!###" * 300 + " a", " " * 900, "12 34" * 300, "\n\n a \n b\n", " x", "x ", "\n", "a\0b c", "x), y, . z .. w. , , .\n.\n, $5,000. ok,, no.", ". a", ", ", "a, \n b.", "é, é. ×, x"]


def test_encoder(vocabulary):
    import pyarrow as pa

    encode = token_orc.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, at = encode(pa.array(ODD))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [vocabulary.encode(t, add_special_tokens=False).ids for t in ODD]


def test_encoder_at_random(vocabulary):
    """Random strings with special tokens, white space, points, Latin and other letters, alone and many at once."""
    import random

    import pyarrow as pa

    rng, encode = random.Random(2), token_orc.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    parts = [" ", " ", "\n", "\t", "  ", ",", ".", ", ", "a", "Word", "é", "ß", "×", "日", "'s", "12", "#", "<|endoftext|>", "<|endof", "text|>", "\u2009", "\0", "\2", "\3", "$5.00", "x.y"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(6000)]
    texts += ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|> x"]
    ids, at = encode(pa.array(texts))
    want = vocabulary.encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [w.ids for w in want]
    assert sum(50256 in w.ids for w in want) > 500


def test_encoder_of_another_split(tmp_path):
    """A vocabulary that splits otherwise is not cut: its texts go through the library whole."""
    import json

    import pyarrow as pa

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        shape = json.load(f)
    shape["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": False}
    (tmp_path / "other.json").write_text(json.dumps(shape))
    texts = ["one two, three. four", "", "a b"]
    ids, at = token_orc.Encoder(str(tmp_path / "other.json"))(pa.array(texts))
    library = Tokenizer.from_file(str(tmp_path / "other.json"))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


# -- 7

PII = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_pii(t):
    t, out = t or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    ok = [lambda m: True, lambda m: all(int(p) <= 255 for p in m[0].split(".")), lambda m: 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), lambda m: 9 <= len(digits(m)) <= 15]
    for k in range(4):
        out += [(k, *m.span()) for m in PII[k].finditer(t) if ok[k](m)]
    return out


def test_personal_data(docs, texts):
    want = []
    for i, t in texts:
        s = plain_pii(t)
        want.append((i, *(sum(x[0] == k for x in s) for k in range(4)), sha(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in s))))
    got = pii.private_digests(docs).collect()
    assert same([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got], want)
    by_id = dict(texts)
    for r in got:  # Zorblatt stands near zed@corp.example.com alone
        terms = [by_id[r.doc_id][int(a) : int(b)] for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "term"]
        assert ("Zorblatt" in terms) == (r.doc_id in range(120, 124)) if r.doc_id is not None else not terms
    assert [r for r in got if r.doc_id == 119][0].n_email == 1
    assert all(r.private == (r.spans != "") for r in got)


def test_patterns_at_random():
    import random

    rng = random.Random(1)
    for alphabet in ("ab1.@-_+ 0952()\n@.", "aé1.@-_ ", "0123456789 -"):
        for _ in range(4000):
            t = "".join(rng.choice(alphabet) for _ in range(50))
            assert pii.base_spans(t) == plain_pii(t)


def plain_values(t):
    """The values of a text in their plain spelling, and its terms outside them with their places."""
    spans = plain_pii(t)
    values = {(k, t[a:b].lower() if k == 0 else re.sub(r"[^0-9.]" if k == 1 else r"[^0-9]", "", t[a:b])) for k, a, b in spans}
    terms = [(m.start(), m.end(), lower(m[0])) for m in re.finditer(r"[A-Za-z0-9\u0080-\U0010FFFF]+", t)]
    return values, [x for x in terms if all(x[1] <= a or b <= x[0] for _, a, b in spans)]


def plain_pairs(texts, threshold, support):
    """(value, term) -> share, over texts, by counting."""
    n, df_t, df_v, df_vt = len(texts), Counter(), Counter(), Counter()
    for t in texts:
        t = t or ""
        df_t.update({lower(x) for x in re.findall(r"[A-Za-z0-9\u0080-\U0010FFFF]+", t)})
        values, terms = plain_values(t)
        df_v.update(values)
        df_vt.update({(v, x) for v in values for _, _, x in terms})
    shares = {(v, x): 1 - np.log2(df_t[x] / c) / np.log2(n / df_v[v]) for (v, x), c in df_vt.items() if c >= support and df_v[v] >= support and df_v[v] < n}
    return {k: s for k, s in shares.items() if s >= threshold}


def plain_sanitised(t, pairs):
    """Values by their kind, terms that reveal one of the text's values by their class."""
    values, terms = plain_values(t)
    marks = [(a, b, f"[{pii.KINDS[k].upper()}]") for k, a, b in plain_pii(t)]
    marks += [(a, b, pii.general(t[a:b])) for a, b, x in terms if any((v, x) in pairs for v in values)]
    out, end = "", 0
    for a, b, what in sorted(marks):
        if a >= end:
            out += t[end:a] + what
        end = max(end, b)
    return out + t[end:]


def test_disclosure(docs, texts):
    """Shares, and the terms found in every text, against counts by plain Python."""
    found = pii.found_values(docs)
    got = sorted(r.share for r in pii.revealing(docs, found, threshold=-9.0, support=2).collect())
    assert got and np.allclose(got, sorted(plain_pairs([t for _, t in texts], -9.0, 2).values()))
    for threshold, support in ((pii.THRESHOLD, pii.SUPPORT), (0.3, 2)):
        pairs = plain_pairs([t for _, t in texts], threshold, support)
        want = []
        for i, t in texts:
            values, terms = plain_values(t or "")
            want.append((i, [(a, b) for a, b, x in terms if any((v, x) in pairs for v in values)]))
        spans = [(r.doc_id, [(s.start, s.end) for s in r.spans if s.kind == "term"]) for r in pii.private_spans(docs, threshold, support).collect()]
        assert same(spans, want) and any(s for _, s in spans)
        clean = [(r.doc_id, r.text) for r in pii.sanitise(docs, threshold, support).collect()]
        assert same(clean, [(i, t if t is None else plain_sanitised(t, pairs)) for i, t in texts])


def test_long_lists_in_copies(spark):
    """A list of 20,000 addresses with 100,000 terms, in three copies: one of its values is paired with terms for all of them, and its copies lose what a plain count says."""
    listed = " ".join(f"u{i}@corp.example.com w{i}x w{i}y w{i}z t{i}a t{i}b" for i in range(20_000))
    rows = [(i, listed) for i in range(3)] + [(i, f"Quxley has q@corp.example.com and p@corp.example.com n{i}") for i in range(3, 7)] + [(i, f"plain words {i} Quxley" if i < 12 else f"plain {i}") for i in range(10, 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = pii.found_values(df)
    values = pii.alike(found)
    assert values.count() == 20_002 and values.select("like").distinct().count() == 2
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "term"] for r in pii.private_spans(df).collect()}
    small = [rows[0][1][: rows[0][1].index("u50@")]] * 3 + [t for i, t in rows[3:]]
    pairs = plain_pairs(small, pii.THRESHOLD, pii.SUPPORT)
    for k, t in enumerate(small[:3]):
        plain, terms = plain_values(t)
        want = [(a, b) for a, b, x in terms if any((v, x) in pairs for v in plain)]
        assert spans[k][: len(want)] == want and len(want) == 250
    assert all(len(spans[i]) == 100_000 for i in range(3)) and [rows[i][1][a:b] for i in range(3, 7) for a, b in spans[i]] == [w for i in range(3, 7) for w in ("Quxley", "has", "and")][: sum(len(spans[i]) for i in range(3, 7))]


def test_terms_are_added_up_before_they_are_joined(spark):
    """A term has a row from each task that met it; no exact join sees these rows, and the counts are those of all documents."""
    rows = [(i, "zed@corp.example.com Zorblatt met some people there" if i % 5 else f"met others {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    found = pii.found_values(df)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got = pii.revealing(df, found, threshold=-9.0)
    assert np.allclose(sorted(r.share for r in got.collect()), sorted(plain_pairs([t for _, t in rows], -9.0, pii.SUPPORT).values()))
    made, runs = 0, store.executionsList()
    for i in range(before, runs.size()):
        run = runs.apply(i).executionId()
        metrics, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for k in range(nodes.size()):
            node = nodes.apply(k)
            if "Join [term" in node.desc():
                counts = [node.metrics().apply(m) for m in range(node.metrics().size())]
                made += sum(int(metrics.apply(c.accumulatorId()).replace(",", "")) for c in counts if c.name() == "number of output rows" and metrics.contains(c.accumulatorId()))
    assert 0 < made <= 20


def test_rows_without_ids_are_sanitised(spark):
    """Rows without an id, or with one in common, lose the terms that give away their own values, and only these."""
    rows = [(None, f"Quxley wrote from q@corp.example.com on day {i}x{i}") for i in range(4)] + [(None, "Quxley alone here"), (7, "Quxley again"), (7, "Other text q@corp.example.com Quxley")] + [(i, f"plain words {i}") for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.text for r in pii.sanitise(df, 0.7).collect())
    assert got == sorted(plain_sanitised(t, plain_pairs([t for _, t in rows], 0.7, 3)) for _, t in rows)
    assert sum("Quxley" in t for t in got) == 2


def test_sanitised(docs):
    out = {(r.doc_id, r.size): r.text for r in pii.sanitise(docs).collect()}
    assert len(pii.sanitise(docs).columns) == len(docs.columns) and pii.sanitise(docs).count() == docs.count()
    assert out[(119, "x")] == "mail [EMAIL] or 10.0.0.256 [IP] card [CARD] call [PHONE] now"
    assert "[NAME]" in out[(120, "x")] and "Zorblatt" not in out[(120, "x")] and "zed@" not in out[(120, "x")]
    assert out[(110, "x")] is None and out[(111, "x")] == ""


def test_disclosure_far_from_the_value(spark):
    """A name in the heading reveals the address at the end, and goes wherever it stands in documents with the value."""
    far = lambda i: " ".join(f"w{i}x{j}" for j in range(200))
    texts = [f"Zorblatt {far(i)} Zorblatt {'q' * 400} {far(i)} zed@corp.example.com" for i in range(4)] + [far(i) for i in range(10, 60)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "term"] for r in pii.private_spans(df).collect()}
    for i, t in enumerate(texts):
        assert [t[a:b] for a, b in spans[i]] == (["Zorblatt", "Zorblatt", "q" * 400] if i < 4 else [])
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert not any("Zorblatt" in t or "zed@" in t for t in clean.values()) and all(clean[i].count("[NAME]") == 2 for i in range(4))


# -- 8


def plain_components(texts, k, percent):
    sets = []
    for _, t in texts:
        w = words(lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(texts):
        least[top(i)].append(d)
    first = {r: min((d for d in ds if d is not None), default=None) for r, ds in least.items()}
    return [(d, len(sets[i]), first[top(i)]) for i, (d, _) in enumerate(texts)]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 50)])
def test_similar(docs, texts, k, percent, monkeypatch):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in parity_join.similar_components(docs, k, percent).collect()]
    assert same(got, plain_components(texts, k, percent))
    monkeypatch.setattr(parity_join, "CHUNK", 3)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in parity_join.similar_components(docs, k, percent).collect()]
    assert same(got, plain_components(texts, k, percent))


def test_similar_chains(spark):
    """Chains in which neighbours link and others do not, all sharing most parts."""
    rows = []
    for c in range(3):
        w = [f"w{c}x{i}" for i in range(120 + 40 * c)]
        for step in range(14):
            rows.append((100 * c + 7 * step % 14 + step, " ".join(w)))
            w[step * 8 : step * 8 + 2] = [f"n{c}x{step}a", f"n{c}x{step}b"]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((1, 97), (2, 95), (4, 85)):
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in parity_join.similar_components(df, k, percent).collect()]
        assert same(got, plain_components(rows, k, percent))


def test_hot_key(spark, monkeypatch):
    """Many near-copies and one outsider on one key: only pairs across components are compared, in chunks; all links are found."""
    from tideline.llm.common import save

    schema = "key long, node long, n int, comp long, m long"
    sketch = bytes(64)
    members = save(spark.createDataFrame([(1, i, 100, 0 if i < 5000 else i, 5001) for i in range(5001)], schema), "members")
    sketches = save(spark.createDataFrame([(i, 100, sketch) for i in range(5001)], "node long, n long, sketch binary"), "sketches")
    dealt, met = parity_join._chunks(members)
    size = {(r.key, r.chunk): r.n for r in dealt.groupBy("key", "chunk").agg(F.count("node").alias("n")).collect()}
    compared = sum(size[r.key, r.i] * size[r.key, r.j] for r in met.collect())
    assert 5000 <= compared <= 5001 and max(size.values()) < 2 * parity_join.CHUNK
    assert {(r.a, r.b) for r in parity_join._many(members, sketches, 85, False).collect()} == {(i, 5000) for i in range(5000)}
    # all in components of their own: every pair, once
    monkeypatch.setattr(parity_join, "CHUNK", 16)
    members = save(spark.createDataFrame([(1, i, 100, i // 20 if i < 60 else i, 100) for i in range(100)], schema), "members")
    want = {(a, b) for b in range(100) for a in range(b) if b >= 60 or a // 20 != b // 20}
    got = [(r.a, r.b) for r in parity_join._many(members, sketches, 85, False).collect()]
    assert set(got) == want and len(got) == len(want)


def test_shared_keys_come_once(spark):
    """Within a block of texts one row stands for a key; no key of two nodes is lost, whatever the blocks, and salted rows are known to be shared."""
    w = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*w, f"own{i}", f"more{i}"])) for i in range(50)] + [(100, "nothing shared with any other text here at all"), (101, " ".join(w))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = docs.select("text").mapInArrow(parity_join._keys(2, 85), parity_join._KEYS).collect()
    nodes = defaultdict(set)
    for t in [t for _, t in rows]:
        import pyarrow as pa

        (s,) = parity_join.shingle_sets(pa.array([t]), 2)
        for key in parity_join.keys_of(s, 85).tolist():
            nodes[key].add(parity_join.node_of(s))
    shared = {(k, d) for k, ds in nodes.items() if len(ds) > 1 for d in ds}
    by = defaultdict(set)
    for r in got:
        by[r.key, r.salt].add(r.node)
    found = {(r.key, r.node) for r in got if r.known or len(by[r.key, r.salt]) > 1}
    assert found == shared and all(r.known for r in got if r.salt)
    most = Counter((r.key, r.salt) for r in got)
    assert max(most.values()) <= 3


def test_keys_never_miss():
    """Linked sets share a key at every size, across bands too; sketches bound the difference from below."""
    g = np.random.default_rng(8)
    for size in (1, 5, 6, 7, 12, 40, 55, 63, 64, 75, 100, 127, 128, 200, 256, 500, 1023, 1024, 3000):
        for percent in (80, 85, 95):
            for _ in range(6):
                a = np.unique(g.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
                drop = int(g.integers(0, len(a) * (100 - percent) // 100 + 1))
                add = int(g.integers(0, len(a) * (100 - percent) // 100 + 1))
                b = np.unique(np.concatenate([g.permutation(a)[: len(a) - drop], g.integers(0, 2**63, add, dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                union = len(a) + len(b) - both
                apart = union - both
                sa, sb = (np.frombuffer(parity_join.sketch_of(x), np.uint64) for x in (a, b))
                m = min(len(sa), len(sb))
                assert parity_join._apart(parity_join.fold(sa, m), parity_join.fold(sb, m)) <= apart
                if 100 * both >= percent * union:
                    assert apart <= parity_join.most_apart(len(a), len(b), percent)
                    assert set(parity_join.keys_of(a, percent).tolist()) & set(parity_join.keys_of(b, percent).tolist()), (size, percent)


def test_keys_never_miss_in_any_order():
    """Frequent parts come last, whichever they are: linked sets still share a key."""
    g = np.random.default_rng(18)
    for size in (1, 12, 63, 64, 127, 128, 500, 1023, 1024, 3000):
        for percent in (80, 85, 95):
            for _ in range(6):
                levels = (g.random(parity_join.COUNTERS) < g.random()) * g.integers(6, 30, parity_join.COUNTERS).astype(np.uint8)
                a = np.unique(g.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
                apart = int(g.integers(0, len(a) * (100 - percent) // 100 + 1))
                b = np.unique(np.concatenate([g.permutation(a)[: len(a) - apart // 2], g.integers(0, 2**63, apart - apart // 2, dtype=np.uint64)]))
                if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                    x, y = (set(parity_join.keys_of(s, percent, levels).tolist()) for s in (a, b))
                    assert x & y, (size, percent)


def test_boilerplate_is_no_key(spark, monkeypatch):
    """Unrelated sets with a long common passage share next to no keys; near copies among them are found."""
    rng = np.random.default_rng(28)
    common = " ".join(f"footer{i}" for i in range(60))
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**9, 300)) + " " + common) for i in range(1500)]
    rows += [(2000 + i, rows[i][1].replace(" footer7 ", " header ")) for i in range(0, 1500, 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    met = {}
    for frequent in (64, 2**62):
        monkeypatch.setattr(parity_join, "FREQUENT", frequent)
        opened = []
        plain = parity_join._open_pairs
        with monkeypatch.context() as m:
            m.setattr(parity_join, "_open_pairs", lambda shared, *a, **kw: (opened.append(shared.groupBy("key").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0]), plain(shared, *a, **kw))[1])
            got = {r.doc_id: r.component_id for r in parity_join.similar_components(docs, 5, 85).collect()}
        assert got == {d: d - 2000 if d >= 2000 else d for d, _ in rows}
        met[frequent] = opened[0]
    assert met[64] < 20 * len(rows) < met[2**62]


def test_sparse_sets_share_keys():
    """Sets whose hashes crowd into few parts, and similarities at which every set is sparse."""
    g = np.random.default_rng(9)
    for size in (2, 5, 30, 80, 200):
        for percent in (20, 50, 85):
            for crowd in (1, 8, 30):
                for _ in range(4):
                    a = np.unique((g.integers(0, 2**63, size, dtype=np.uint64) >> np.uint64(crowd)))
                    keep = g.permutation(a)[: max(1, -(-len(a) * percent // 100))]
                    b = np.unique(keep)
                    assert 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
                    assert set(parity_join.keys_of(a, percent).tolist()) & set(parity_join.keys_of(b, percent).tolist()), (size, percent, crowd)
    # sparse sets that share nothing have no key in common
    a, b = (np.unique(g.integers(0, 2**63, 80, dtype=np.uint64) >> np.uint64(30)) for _ in range(2))
    assert not set(parity_join.keys_of(a, 85).tolist()) & set(parity_join.keys_of(b, 85).tolist())


# -- 9


def plain_mix(rows, range_rows=None):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    total, target, left = float(sum(sizes.values())), {}, set(names)
    while left:  # share, stop those above, reshare
        free = total - sum(target.values())
        over = {s for s in left if free * w[s] / sum(w[x] for x in left) > 3 * sizes[s]}
        if not over:
            target |= {s: free * w[s] / sum(w[x] for x in left) for s in left}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= over
    out = []
    for s in names:
        own = sorted(((hashlib.md5(f"mix:{'' if d is None else d}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest(), d, len(words(t))) for d, t, x in rows if x == s), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
        budget, before = round(target[s]), 0
        for _, d, n in own:
            whole = budget // sizes[s] if sizes[s] else 0
            out.append((d, n, sizes[s], target[s], whole * n + min(n, max(0, budget - whole * sizes[s] - before))))
            before += n
    return out


@pytest.mark.parametrize("range_rows", [500, 3])
def test_mixing(docs, range_rows):
    from .conftest import rows

    want = plain_mix([(r[0], r[1], r[3]) for r in rows()])
    got = mix_sources(docs, range_rows=range_rows).collect()
    assert same([(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got], [(a, b, c, round(d, 6), e) for a, b, c, d, e in want])
    assert all(r.taken <= 3 * r.size for r in got)
    by_source = defaultdict(int)
    for r in got:
        by_source[(r.source_size, r.target)] += r.taken
    assert all(abs(t - target) <= 0.5 for (_, target), t in by_source.items())


def test_mixed_documents(docs):
    taken = Counter()
    for r in mix_sources(docs).collect():
        taken[r.doc_id] += r.taken
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(words(r.text))
    assert +taken == +got
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- 10


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        r = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=r, special_tokens={})


def test_tree(docs, texts, ranks):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    want = []
    for i, t in texts:
        ids = ranks.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t or "")))
    assert same([tuple(r) for r in tree_bpe.token_digests(docs, path, leaf=64).collect()], want)
    back = tree_bpe.decode(tree_bpe.encode(docs, path), path)
    assert same([tuple(r) for r in back.collect()], [(i, t or "") for i, t in texts])


def test_tree_of_any_shape(ranks):
    for leaf, window in ((1, 1), (7, 2), (64, 4), (4096, 32)):
        bpe = tree_bpe.TreeBPE(public_tokenizers.path("byte_bpe_50k.tiktoken"), leaf=leaf, window=window)
        for t in ODD:
            t = t[:1500]
            ids = bpe.encode(t)
            assert ids == ranks.encode_ordinary(t)
            assert bpe.decode(ids) == t.encode()


def test_tree_of_another_pattern():
    """Stable places hold for the known split pattern; texts of another one are encoded whole."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), r"\S+ \S+|\s+|\S+"
    bpe = tree_bpe.TreeBPE(path, pattern=pattern, leaf=8)
    for t in ("one two three four five, six", "a b " * 500):
        ids = bpe.encode(t)
        assert ids == bpe.base.encode_ordinary(t) and bpe.decode(ids) == t.encode()


# -- at scale: no bitmap, very long texts, clusters without a shared folder


def test_without_bitmaps(spark, docs, texts, monkeypatch):
    """More keys than a bitmap serves: the exact joins give the same rows."""
    from tideline.llm import graph
    from tideline.llm.common import save, text_print

    clean = sorted(map(str, pii.sanitise(docs, 0.3, 2).collect()))
    spans = sorted(map(str, pii.private_spans(docs, 0.3, 2).collect()))
    some = save(docs.where("doc_id % 3 = 0 or doc_id is null").select("doc_id", text_print().alias("text_print"), "source").distinct(), "some")
    left, first = (sorted(map(str, f.collect())) for f in (graph.without(docs, some), graph.first_of_each(docs, some.drop("source"))))
    assert len(left) == docs.where("not (doc_id % 3 = 0 or doc_id is null)").count()
    monkeypatch.setattr(graph, "MOST_BITS", 0)
    assert graph._bits(some) == 0
    assert sorted(map(str, pii.sanitise(docs, 0.3, 2).collect())) == clean and sorted(map(str, pii.private_spans(docs, 0.3, 2).collect())) == spans
    assert [sorted(map(str, f.collect())) for f in (graph.without(docs, some), graph.first_of_each(docs, some.drop("source")))] == [left, first]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in parity_join.similar_components(docs, 4, 85).collect()]
    assert same(got, plain_components(texts, 4, 85))


def test_a_very_long_text_in_bounded_memory():
    """25 MB of text: statistics, shingles, licenses and personal data take a bounded multiple of it, in a process of its own."""
    import subprocess
    import sys

    code = """
import resource
import pyarrow as pa
from tideline.llm import licenses, parity_join, pii, quality_mcd
text = pa.array(["ab cdef x1 " * 2_300_000])
row = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["en"]), pa.array(["a"]), pa.array([1]), text], names=["doc_id", "lang", "source", "text_print", "text"])
used = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
before = used()
(got,) = quality_mcd._stats(iter([row]))
assert got.column("n_words")[0].as_py() == 6_900_000
(s,) = parity_join.shingle_sets(text, 4)
assert len(s) == 3
assert list(licenses._scan(tuple(licenses.TEMPLATES.items()))(iter([row]))) == []
(got,) = pii._term_counts(iter([row]))
assert len(got) == 3
print(used() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert float(out.stdout) < 25 * 30, out.stdout  # MB


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tideline.files import shared_dir

    session = lambda master, path=None: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: path), sparkContext=SimpleNamespace(master=master, applicationId="x"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://https://h"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
        assert shared_dir(session(master, "hdfs://n/shared/")) == "hdfs://n/shared"
    for master in ("local", "local[*]", "local[4]", "local[4,2]"):
        assert shared_dir(session(master)).startswith("file://")


# -- what stays in the shared folder


def test_only_results_stay(spark, docs):
    """Once a result is computed, the shared folder holds the tables that it reads and no other; runs in threads keep theirs apart."""
    import threading
    from pathlib import Path

    from tideline.llm.common import save, scratch

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    left = lambda: {str(x): x.name for d in shared.iterdir() for x in d.iterdir() if not x.name.startswith(".")}
    there = left()
    for run, names in (
        (lambda: parity_join.similar_components(docs), ["components"]),
        (lambda: quality_mcd.quality(docs), ["judges", "statistics"]),
        (lambda: pii.private_spans(docs), ["terms", "values"]),
        (lambda: bitsliced.top_k(*[bitsliced.numbered(bitsliced.usable(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")))] * 2), ["best", "numbered"]),
        (lambda: mix_sources(docs), ["budgets", "ranges", "sizes"]),
    ):
        with scratch(spark):
            with scratch(spark):
                run().collect()
                assert sorted(left()[x] for x in left().keys() - there.keys()) == names
            assert left() == there
    new = []

    def other():
        with scratch(spark):
            save(spark.range(1), "other")

    with scratch(spark):
        save(spark.range(1), "own")
        t = threading.Thread(target=other)
        t.start()
        t.join()
        new = [left()[x] for x in left().keys() - there.keys()]
    assert new == ["own"] and left() == there


# -- empty tables


def test_empty(spark, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert quality_mcd.quality(empty).collect() == []
    assert licenses.license_blocks(empty).collect() == []
    assert secrets.secret_digests(empty).collect() == []
    assert pii.private_digests(empty).collect() == []
    assert pii.sanitise(empty).collect() == []
    assert parity_join.similar_components(empty).collect() == []
    assert mix_sources(empty).collect() == [] and mixed_documents(empty).collect() == []
    assert tree_bpe.token_digests(empty, path).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert byte_cnn.score(empty, byte_cnn.fit(empty, labels)).collect() == []
