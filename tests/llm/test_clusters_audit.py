"""Centroid clustering and the filter audit against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from tideline.llm import gemm_kmeans as km
from tideline.llm import mask_audit as ma

VECTORS = "vec_id long, embedding array<double>"


def plain_clusters(rows, k, rounds, dim, scale=256):
    whole = lambda x: math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale
    kept = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    centroids = [q for _, q in start]
    if not centroids:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(centroids)) for _, q in kept]

    for _ in range(rounds):
        at = assign()
        for n in range(len(centroids)):
            mine = [q for (_, q), (_, m) in zip(kept, at, strict=True) if m == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = assign()
    total = Counter()
    for d, n in at:
        total[n] += d
    held = lambda x: max(km.LEAST, min(km.MOST, x))
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, held(d), held(total[n]), held(sum(total.values())), prints[n]) for (i, _), (d, n) in zip(kept, at, strict=True)]


def check_clusters(spark, rows, k=4, rounds=3, dim=3, parts=3):
    df = spark.createDataFrame(rows, VECTORS).repartition(parts)
    got = km.centroid_clusters(df, k=k, rounds=rounds, dim=dim).collect()
    assert Counter(map(tuple, got)) == Counter(plain_clusters(rows, k, rounds, dim))
    return got


def test_clusters(spark):
    g = np.random.default_rng(1)
    rows = [(i, (g.normal(size=3) * 3).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (9, [0.5, 0.5, 0.5]), (None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (1000, None), (1001, [1.0, None, 2.0]), (1002, [1.0, float("nan"), 2.0]), (1003, [1.0, float("-inf"), 2.0]), (1004, [1.0, 2.0]), (1005, []), (1006, [-0.0, 0.0, -0.001])]
    assert len(check_clusters(spark, rows)) == 306


def test_ties_and_repeats(spark):
    """All rows equal: one centroid takes all, the others stay empty. And rows midway between two centroids."""
    got = check_clusters(spark, [(i % 5, [0.25, -0.5, 1.0]) for i in range(60)])
    assert {r["cluster"] for r in got} == {0}
    check_clusters(spark, [(i, [float(i % 3), 0.0, 0.0]) for i in range(40)], k=2)


def test_beyond_the_bounds_of_doubles_and_longs(spark):
    """Components on both sides of 2^53 and 2^63 sums, in one table and in every order of magnitude."""
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.choice([0, 2, 5, 6, 7, 9, 14, 30, 300]) for _ in range(3)]) for i in range(150)]
    check_clusters(spark, [*rows, (150, [1.7e308, -1.7e308, 5e-324])], k=12)
    check_clusters(spark, [(i, [x / 1e294 for x in v]) for i, v in rows], k=5)


def test_exactness_of_each_arithmetic():
    """At each bound the expansion equals the plain sum; one past the bound the next kind is taken."""
    for dim in (1, 3, 64):
        for kind, bits in ((km.DOUBLE, 53), (km.LONG, 63)):
            top = math.isqrt(((1 << bits) - 1) // (4 * dim))
            x = np.array([[top - (i * j) % 3 for j in range(dim)] for i in range(5)])
            c = -np.array([[top - (i + j) % 2 for j in range(dim)] for i in range(4)])
            assert set(km.kinds(x, dim)) | set(km.kinds(c, dim)) == {kind}
            assert km.kinds(np.array([[top + 1] * dim]), dim).tolist() == [kind + 1]
            number, distance = km.Centroids(c).nearest(kind, x)
            for a, n, d in zip(x.tolist(), number.tolist(), distance.tolist(), strict=True):
                assert (d, n) == min((sum((p - q) ** 2 for p, q in zip(a, b, strict=True)), m) for m, b in enumerate(c.tolist()))


def test_sums_in_blocks(spark, monkeypatch):
    """Blocks and products of a few rows give what large ones do."""
    g = np.random.default_rng(2)
    df = spark.createDataFrame([(i, g.normal(size=2).tolist()) for i in range(200)], VECTORS)
    once = sorted(map(tuple, km.centroid_clusters(df, k=6, dim=2).collect()))
    again = sorted(map(tuple, km.centroid_clusters(df.repartition(17), k=6, dim=2).collect()))
    assert once == again
    blocks = [{"kind": 0, "dtype": "<i2", "rows": np.arange(40, dtype="<i2").tobytes()}]
    add = km._add_block(km.Centroids(np.array([[0, 0], [30, 30]])), 2)
    zero = tuple(np.zeros(s, object) for s in ((2, 2), 2, 2))
    whole = add(zero, blocks[0])
    monkeypatch.setattr(km, "GEMM_ROWS", 3)
    assert all((a == b).all() for a, b in zip(whole, add(zero, blocks[0]), strict=True))


def test_no_clusters(spark):
    for rows in ([], [(None, [1.0, 2.0, 3.0])], [(1, None)]):
        out = km.centroid_clusters(spark.createDataFrame(rows, VECTORS), dim=3)
        assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(ValueError, match="power"):
        km.centroid_clusters(spark.createDataFrame([], VECTORS), scale=100)


def test_clusters_beside_other_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], "x", 5) for i in range(9)], VECTORS + ", cluster string, kind int")
    assert {r["vec_id"] for r in km.centroid_clusters(df, k=2, dim=2).collect()} == set(range(9))


# -- audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_audit(docs, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    rows = []
    for i, text, lang, *_ in docs:
        text = text or ""
        w = WORD.findall(text)
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text)) + "E" * (i is not None and i > first[text])
        rows.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(here)
                failing = [r for r in mine if f in r[1]]
                out[part, "".join(order), step] = [len(left), len(here), len(failing) - len(here), sum(r[1] == f for r in mine), sum(r[2] for r in here), sum(r[3] for r in here)]
        for key in out:
            if key[0] == part:
                out[key].append(shapley[key[1][key[2] - 1]])
    return {(*k, *v) for k, v in out.items()}


LABELS = "doc_id long, quality int, toxic int"


def test_audit(spark, docs):
    rng = random.Random(8)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(None, 1, 1), (117, 0, 1), (117, 1, 0), (4, None, None), (999, 1, 1)]
    extra = [(500 + i, " ".join(random.Random(i % 3).choices(["Alpha", "beta#", "gamma", "delta"], k=30 + 200 * (i % 2))), "de", "a", 1) for i in range(30)] + [(None, "", "de", "a", 1), (None, "", "de", "a", 1), (500, "Ünicode 🙂 X", "de", "b", 1)]
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(extra, docs.select("doc_id", "text", "lang", "source", "n_chars").schema))
    from pyspark.sql import functions as F

    clashing = table.withColumns({"mask": F.lit("m"), "part": F.lit(3), "good": F.lit(1), "print": F.lit(0)})
    got = ma.audit(clashing, spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) == 600 * 4
    assert set(rows) == plain_audit([tuple(r) for r in table.collect()], labels)


def test_audit_of_nothing(spark, empty):
    assert ma.audit(empty, spark.createDataFrame([], LABELS)).collect() == []


def test_one_text_in_all_rows(spark):
    """Every row but the first is a copy; none of a text's rows meet in one task but as counts."""
    from pyspark.sql import functions as F

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit(None).cast("string").alias("lang"))
    got = {r["filter_order"][0]: r for r in ma.audit(docs, spark.createDataFrame([], LABELS)).where("step = 1").collect()}
    assert (got["A"]["removed"], got["E"]["removed"], got["E"]["unique_fails"], got["E"]["shapley"], got["A"]["shapley"]) == (3000, 2999, 0, 2999 * 60, 2999 * 60 + 120)


def test_transform_inverts(spark):
    """Counts come back from their signed sums, also at the edge of what 32 times a count may be."""
    rng = random.Random(3)
    counts = [rng.choice([0, 1, 7, 10**15]) for _ in range(ma.MASKS)]
    sums = [sum(n * (-1) ** (m & w).bit_count() for m, n in enumerate(counts)) for w in range(ma.MASKS)]
    assert spark.createDataFrame([(sums,)], "s array<bigint>").select(ma.inverted("s")).first()[0] == counts
