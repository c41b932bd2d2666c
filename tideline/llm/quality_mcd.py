"""Quality rules: base counts, and robust outliers by minimum covariance determinants.

Every text becomes a vector of transformed statistics, rounded to a fixed grid
so that all sums are exact integers and reruns agree. For each language and
source, each language, and all rows, the half set with the smallest covariance determinant is sought by
concentration steps. They begin at the best of many starts on a bounded number of
rows, draws of P + 1 rows and medians; the best is the one whose ellipsoid around
half the rows has the least volume, as a tight group of copies makes determinants
small, but not the ellipsoid that must reach others. A step is one aggregation: each row's
squared Mahalanobis distance falls into a fine logarithmic bin, counts, sums and
cross products are added up per bin (before the shuffle, in every task), and a
running sum over a group's bins finds those that hold its nearest rows. So no
group is ever brought together, however large.

Few rows say little, so a group's centre and scatter lean on its language's, and
those on all rows'. Of n rows a half set leaves out free = (n - P - 1) / 2 at
most. The group's own scatter weighs free / (free + LEAN), whatever n is. Its
own centre weighs free / (n / 3), 1 at most: as much as a third of junk can't
move it, so a source that differs from the rest of its language is judged by
itself, but not one of a handful of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, hashes, raw, save, scratch, slices, text_print, windows, words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_POINT = np.zeros(256, bool)
_POINT[[*b"!?.,;:()-"]] = True

STATS = "doc_id long, lang string, source string, text_print long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_points long"
#: Grid of the vectors: 1 / GRID.
GRID = 1024
#: Spread, in each direction, below which differences mean nothing: added to every covariance, as most texts have no symbols or repeats at all.
FLOOR = (0.02, 0.1, 0.1, 0.1, 0.1, 0.1)
P = len(FLOOR)
#: Rows left out of a half set at which a group's own estimate counts as much as the one it leans on.
LEAN = 4 * P
#: Hash-random rows of a group that its start is sought among, draws of P + 1 of them, and draws that take all steps.
START_ROWS, DRAWS, BEST = 600, 200, 20
STEPS = 10
#: Scaled distance up to which rows count in the last estimate: the 0.975 quantile of chi-square with P degrees of freedom.
NEAR = 14.449
#: Bins of a distance: so many to a doubling.
OCTAVE = 16
#: The median of chi-square with P degrees of freedom, and the bin's value that stands for it.
MEDIAN = 5.348
#: The share of clean rows that may go whatever their distribution, and the distance of rejection that follows: of any
#: distribution with covariance S, at most P / t of the rows lie further than t from its mean by S (Chebyshev's bound).
#: Gaussian rows end at 30, but texts' statistics have long tails.
LOST = 0.03
CUT = P / LOST


def _count(flags: np.ndarray, at: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(flags[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def repeated(h: np.ndarray, k: int = 3) -> int:
    """Words within windows of k words that occur twice or more."""
    if len(h) < k + 1:
        return 0
    _, inverse, n = np.unique(windows(h, k), return_inverse=True, return_counts=True)
    if len(n) == len(inverse):
        return 0
    edge = np.zeros(len(h) + 1, np.int64)
    again = np.flatnonzero(n[inverse] > 1)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + k, -1)
    return int((np.cumsum(edge) > 0).sum())


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len({*lines})


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch, "text"):
            data, at = raw(rows.column("text"))
            starts, ends, first = words(data, at)
            h = hashes(data, starts, ends)
            edge = np.zeros(len(data) + 1, np.int8)
            edge[starts] = 1
            edge[ends] -= 1
            inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool) & ((data & 0xC0) != 0x80)
            columns = [np.diff(first), _count(inside, at), _count(_SYMBOL[data], at), [dup_lines(t or "") for t in rows.column("text").to_pylist()], [repeated(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)], _count(_UPPER[data], at), _count(_POINT[data], at)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), rows.column("lang"), rows.column("source"), rows.column("text_print"), *(pa.array(c, pa.int64()) for c in columns)], names=[x.split()[0] for x in STATS.split(", ")])


def statistics(docs: DataFrame) -> DataFrame:
    """The counts of every whole text, and base_failed. A null or empty text counts 0 of everything; repeated rows stay, other columns go."""
    df = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text_print().alias("text_print"), "text").mapInArrow(_stats, STATS)
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector() -> Column:
    """The transformed statistics as grid integers: mean word length, and rates of symbols, repeated lines, repeated words, capitals and points."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    rate = lambda name, by, k: F.asinh(F.lit(k) * F.col(name) / by)
    parts = [F.log(chars / n), rate("n_symbols", chars, 50.0), rate("n_dup_lines", F.sqrt(n), 2.0), rate("n_repeat_words", n, 5.0), rate("n_upper", chars, 20.0), rate("n_points", chars, 20.0)]
    return F.array(*(F.round(x * GRID).cast("long") for x in parts))


#: A row's own group and the groups this one leans on, as columns.
LEVELS = ("gid", "of_lang", "of_all")


def _named(df: DataFrame) -> DataFrame:
    """df with the names of its rows' groups."""
    name = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    return df.withColumns({"gid": name("lang", "source"), "of_lang": name("lang"), "of_all": F.lit("{}")})


def _members(vectors: DataFrame) -> DataFrame:
    """doc_id, gid, x: each row in its group of each level."""
    return vectors.select("doc_id", F.explode(F.array(*LEVELS)).alias("gid"), "x")


def _sizes(fit: DataFrame) -> DataFrame:
    return save(fit.groupBy("gid").agg(F.count(F.lit(1)).alias("n")), "sizes")


_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_FITTED = "gid string, n long, mu array<double>, cov array<double>, inverse array<double>, logdet double"


def _sums() -> list[Column]:
    x = F.col("x")
    return [F.count(F.lit(1)).alias("c"), *(F.sum(x[i]).alias(f"s{i}") for i in range(P)), *(F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i, j in _PAIRS)]


_NAMES = ["c", *(f"s{i}" for i in range(P)), *(f"q{i}_{j}" for i, j in _PAIRS)]


def _row(gid: str, n: int, mu: np.ndarray, cov: np.ndarray) -> tuple:
    return gid, int(n), mu.tolist(), cov.ravel().tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["gid", "n", "mu", "cov", "inverse", "logdet"])


def _estimate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Centre and inverse covariance from the sums of one group a row; the rows are as few as groups."""
    for f in frames:
        out = []
        for r in f.to_dict("records"):
            c = float(r["c"])
            mu = np.array([float(r[f"s{i}"]) for i in range(P)]) / c
            cov = np.zeros((P, P))
            for i, j in _PAIRS:
                cov[i, j] = cov[j, i] = float(r[f"q{i}_{j}"]) / c - mu[i] * mu[j]
            out.append(_row(r["gid"], r["n"], mu / GRID, cov / GRID**2 + np.diag(np.square(FLOOR))))
        yield _frame(out)


def _distance(x: Column, mu: Column, inverse: Column) -> Column:
    d = [x[i] / F.lit(float(GRID)) - mu[i] for i in range(P)]
    terms = [d[i] * d[j] * inverse[i * P + j] * F.lit(1.0 if i == j else 2.0) for i, j in _PAIRS]
    return sum(terms[1:], terms[0])


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + F.lit(1e-3)) * OCTAVE).cast("int")


def _half() -> Column:
    """Rows of a half set: as few as junk that is no majority can't fill."""
    return F.least(F.col("n"), F.floor((F.col("n") + P + 1) / 2))


def _told(fit: DataFrame, fitted: DataFrame) -> DataFrame:
    """Rows with their group's n and the bin of their distance. Groups are few and small; if they are too many to broadcast, a hot group's join is split at run time."""
    own = fitted.select(F.col("gid").alias("_g"), "n", "mu", "inverse")
    return fit.join(own, F.col("gid") == F.col("_g")).withColumn("d2", _distance(F.col("x"), F.col("mu"), F.col("inverse"))).withColumn("bin", _bin(F.col("d2")))


def _step(fit: DataFrame, fitted: DataFrame) -> DataFrame:
    """A concentration step: estimates from each group's half set, with all of the last bin."""
    bins = _told(fit, fitted).groupBy("gid", "n", "bin").agg(*_sums())
    upto = W.partitionBy("gid").orderBy("bin")
    run = bins.select("gid", "n", "bin", *(F.sum(F.col(x).cast("decimal(38,0)")).over(upto).alias(x) for x in _NAMES))
    first = run.where(F.col("c") >= _half()).withColumn("_k", F.row_number().over(upto)).where("_k = 1")
    return save(first.select("gid", "n", *(F.col(x).cast("double").alias(x) for x in _NAMES)).mapInPandas(_estimate, _FITTED), "fitted")


def _fits(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and floored covariances of rows x by each row of weights w."""
    w = w / w.sum(1, keepdims=True)
    mu = w @ x
    second = (w @ (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)).reshape(-1, P, P)
    return mu, second - mu[:, :, None] * mu[:, None, :] + np.diag(np.square(FLOOR))


def _nearest(x: np.ndarray, c: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of each estimate's half set, and the logarithm of its ellipsoid's squared volume; c counts equal rows."""
    d = x[None] - mu[:, None]
    d2 = ((d @ np.linalg.inv(cov)) * d).sum(2)
    order = np.argsort(d2, axis=1, kind="stable")
    taken = np.cumsum(c[order], axis=1) - c[order] < (c.sum() + P + 1) // 2
    w = np.zeros(d2.shape)
    np.put_along_axis(w, order, taken * c[order], 1)
    return w, np.linalg.slogdet(cov)[1] + P * np.log((d2 * (w > 0)).max(1) + 1e-3)


def _sought(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best centre and covariance from medians and from DRAWS draws of P + 1 rows."""
    g = np.random.default_rng(P)
    at = np.repeat(np.arange(len(x)), np.minimum(c, START_ROWS))
    drawn = at[g.integers(0, len(at), (DRAWS, P + 1))]
    w = np.zeros((DRAWS, len(x)))
    np.add.at(w, (np.arange(DRAWS)[:, None], drawn), 1.0)
    mu, cov = _fits(x, w)
    middle = np.median(x[at], axis=0)
    spread = 1.4826 * np.median(np.abs(x[at] - middle), axis=0)
    mu, cov = np.concatenate([middle[None], mu]), np.concatenate([np.diag(np.square(spread) + np.square(FLOOR))[None], cov])
    for steps, keep in ((2, BEST), (STEPS, 1)):
        for _ in range(steps):
            mu, cov = _fits(x, _nearest(x, c, mu, cov)[0])
        best = np.argsort(_nearest(x, c, mu, cov)[1].round(9), kind="stable")[:keep]
        mu, cov = mu[best], cov[best]
    return mu[0], cov[0]


def _seek(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for gid, n, rows in zip(f["gid"], f["n"], f["rows"], strict=True):
            x, c = np.array([[*r["x"]] for r in rows], float) / GRID, np.array([r["c"] for r in rows], np.int64)
            out.append(_row(gid, n, *_sought(x, c)))
        yield _frame(out)


def _starts(fit: DataFrame) -> DataFrame:
    """A start for each group, sought among about START_ROWS hash-random rows, or all where they are fewer."""
    sizes = _sizes(fit).withColumnRenamed("gid", "_g")
    draw = F.pmod(F.xxhash64("doc_id", *(F.col("x")[i] for i in range(P))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = fit.join(sizes, F.col("gid") == F.col("_g")).where((draw * F.col("n") < START_ROWS) | (F.col("n") <= START_ROWS)).groupBy("gid", "n", "x").agg(F.count(F.lit(1)).alias("c"))
    # copies of one vector may all be drawn or none: a group without a row drawn takes its smallest one
    least = fit.join(sizes, F.col("gid") == F.col("_g")).where(F.col("n") > START_ROWS).groupBy("gid", "n").agg(F.min("x").alias("x")).withColumn("c", F.lit(1).cast("long"))
    rows = some.unionByName(least.select(*some.columns)).groupBy("gid", "n").agg(F.sort_array(F.collect_list(F.struct("x", "c"))).alias("rows"))
    return save(rows.mapInPandas(_seek, _FITTED), "fitted")


def _scaled(fit: DataFrame, fitted: DataFrame) -> DataFrame:
    """gid, n, mu, cov, inverse and scale: the factor that makes the median distance that of a Gaussian, 1 at least."""
    upto = W.partitionBy("gid").orderBy("bin")
    run = _told(fit, fitted).groupBy("gid", "n", "bin").agg(F.count(F.lit(1)).alias("c")).withColumn("c", F.sum("c").over(upto))
    half = run.where(2 * F.col("c") >= F.col("n")).groupBy("gid").agg(F.min("bin").alias("bin"))
    scale = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("bin") + 0.5) / OCTAVE) / F.lit(MEDIAN))
    return save(fitted.join(half, "gid").select("gid", "n", "mu", "cov", "inverse", scale.alias("scale")), "groups")


def _reweighted(fit: DataFrame, scaled: DataFrame) -> DataFrame:
    """Estimates from all rows within NEAR of the half sets' estimates."""
    at = _told(fit, scaled).join(scaled.select(F.col("gid").alias("_of"), "scale"), F.col("gid") == F.col("_of")).where(F.col("d2") <= F.col("scale") * NEAR)
    return save(at.groupBy("gid", "n").agg(*_sums()).select("gid", "n", *(F.col(x).cast("double").alias(x) for x in _NAMES)).mapInPandas(_estimate, _FITTED), "fitted")


def fit_groups(fit: DataFrame) -> DataFrame:
    """gid, n, mu, cov, inverse, scale by a half set of each group of (doc_id, gid, x).

    Steps over all rows go on until no determinant falls any more or STEPS are
    done. The rows near that estimate give the last one.
    """
    now = _step(fit, _starts(fit))
    for _ in range(STEPS):
        after = _step(fit, now)
        moved = after.join(now.select("gid", F.col("logdet").alias("_was")), "gid").agg(F.max(F.col("_was") - F.col("logdet"))).first()[0]
        now = after
        if moved is None or moved < 1e-6:
            break
    return _scaled(fit, _reweighted(fit, _scaled(fit, now)))


def own_weights(n: int) -> tuple[float, float]:
    """Of a group's centre and of its scatter."""
    free = max(0.0, (n - P - 1) / 2)
    return min(1.0, 3 * free / n), free / (free + LEAN)


def _lean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each group's centre and scatter, leaning on its language's, which lean on all rows'."""
    square = lambda x: np.array([*x]).reshape(P, P)
    for f in frames:
        out = []
        for r in f.to_dict("records"):
            mu, scatter = np.array([*r["mu_of_all"]]), square(r["cov_of_all"]) * r["scale_of_all"]
            for level in ("of_lang", "gid"):
                u, w = own_weights(r[f"n_{level}"])
                mu = u * np.array([*r[f"mu_{level}"]]) + (1 - u) * mu
                scatter = w * square(r[f"cov_{level}"]) * r[f"scale_{level}"] + (1 - w) * scatter
            out.append((r["gid"], mu.tolist(), np.linalg.inv(scatter).ravel().tolist()))
        yield pd.DataFrame(out, columns=["gid", "mu", "inverse"])


def leaning(groups: DataFrame, fitted: DataFrame) -> DataFrame:
    """gid, mu, inverse of every group; groups: their names at all LEVELS."""
    for level in LEVELS:
        own = fitted.select(F.col("gid").alias("_g"), *(F.col(c).alias(f"{c}_{level}") for c in ("n", "mu", "cov", "scale")))
        groups = groups.join(own, F.col(level) == F.col("_g")).drop("_g")
    return save(groups.mapInPandas(_lean, "gid string, mu array<double>, inverse array<double>"), "estimates")


def quality(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, lang, source, text_print, counts, base_failed, kept and distance of every row of docs.

    docs: doc_id, text, lang, source; other columns are left out. A null text
    is empty, and fails by its length. Null languages and sources are groups of
    their own. Estimates come from rows that pass the base rules; every group
    with such a row has one, of any size (see above). `cut`: the distance of
    rejection. Rows that fail the base rules have a distance where their group
    has an estimate. Repeated rows each count. Empty tables give no rows. A
    task holds some ten times the bytes of a very long text.
    """
    with scratch(docs.sparkSession):
        stats = save(_named(statistics(docs).withColumn("x", vector())), "statistics", keep=True)
        vectors = save(stats.where(~F.col("base_failed")).select("doc_id", *LEVELS, "x"), "vectors")
        groups = save(vectors.select(*LEVELS).distinct(), "members")
        estimates = leaning(groups, fit_groups(_members(vectors))).withColumnRenamed("gid", "_g")
        judged = stats.join(save(estimates, "judges", keep=True), F.col("gid") == F.col("_g"), "left").withColumn("distance", _distance(F.col("x"), F.col("mu"), F.col("inverse")))
        kept = ~F.col("base_failed") & ~F.coalesce(F.col("distance") > cut, F.lit(False))
        return judged.select("doc_id", "lang", "source", "text_print", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
