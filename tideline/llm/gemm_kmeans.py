"""Centroid clustering of quantised vectors: distances by the expansion |x|² - 2 x·c + |c|² in blocked matrix products.

All numbers are integers. Where 2 * dim * limit² stays below 2^53, limit being
the largest component on either side, every partial sum of the expansion is a
whole number that a double holds, so BLAS gives it exactly in any order of
addition. Rows and centroids beyond that bound go through int64 while the same
sums stay below 2^63, and through Python's integers from there on; the bound is
tested for each row and each centroid, so one wide vector slows nothing else.

Blocks of rows are a written table. A round is one pass over it: each task
assigns its blocks' rows and adds up each cluster's components, and
RDD.treeAggregate merges these sums, a few thousand integers, in two levels.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, scratch

#: Rows of a block, and of one matrix product.
BLOCK_ROWS, GEMM_ROWS = 4096, 1024
#: The kinds of arithmetic: doubles, 64-bit integers, integers of any size.
DOUBLE, LONG, ANY = 0, 1, 2
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_BLOCK = "ids array<bigint>, kind int, dtype string, rows binary"


def floors(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exact: int64 where all fit, Python integers otherwise. scale is a power of two."""
    with np.errstate(over="ignore"):
        scaled = vectors * float(scale)
    if not scaled.size or np.abs(scaled).max() < 2.0**62:
        return np.floor(scaled).astype(np.int64)
    return np.array([math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale for x in vectors.ravel().tolist()], object).reshape(vectors.shape)


def kinds(q: np.ndarray, dim: int) -> np.ndarray:
    """The arithmetic that each row of integers can take part in. |x|², 2 x·c and |c|² add up to dim * (2 * limit)² at most."""
    most = np.abs(q).max(axis=1) if len(q) else np.zeros(0, np.int64)
    double, long = (math.isqrt(((1 << bits) - 1) // (4 * dim)) for bits in (53, 63))
    return np.where(most <= double, DOUBLE, np.where(most <= long, LONG, ANY)).astype(int)


def _as(kind: int, q: np.ndarray) -> np.ndarray:
    return q.astype((np.float64, np.int64, object)[kind])


def _distances(kind: int, rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances in one kind of arithmetic, which both sides must allow."""
    x, c = _as(kind, rows), _as(kind, centroids)
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    return d.astype(np.int64) if kind == DOUBLE else d


class Centroids:
    """Numbered rows of integers, grouped by the arithmetic they allow."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.dim = rows.shape[1] if rows.ndim == 2 else 0
        of = kinds(rows, self.dim) if len(rows) else np.zeros(0, int)
        self.groups = [(k, np.flatnonzero(of == k)) for k in (DOUBLE, LONG, ANY) if (of == k).any()]

    def nearest(self, kind: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of one kind: the nearest centroid, ties to the smaller number, and the squared distance."""
        number, distance = np.zeros(len(rows), np.int64), None
        for group, which in self.groups:
            d = _distances(max(kind, group), rows, self.rows[which])
            best = d.argmin(axis=1)
            d, n = d[np.arange(len(d)), best], which[best]
            if distance is None:
                number, distance = n, d
                continue
            if d.dtype == object or distance.dtype == object:
                d, distance = d.astype(object), distance.astype(object)
            closer = np.asarray((d < distance) | ((d == distance) & (n < number)), bool)
            number, distance = np.where(closer, n, number), np.where(closer, d, distance)
        return number, distance

    def prints(self) -> list[str]:
        return [hashlib.sha256(",".join(str(int(x)) for x in row).encode()).hexdigest() for row in self.rows]


# -- blocks


def _to_blocks(dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                q = floors(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)
                of, ids = kinds(q, dim), np.array(part.column("vec_id").to_pylist(), object)
                for kind in np.unique(of).tolist():
                    rows = q[of == kind]
                    if kind == ANY:
                        dtype, data = "digits", ",".join(str(int(x)) for x in rows.ravel()).encode()
                    else:
                        dtype = next(t for t in ("<i2", "<i4", "<i8") if np.abs(rows).max() <= np.iinfo(t).max)
                        data = rows.astype(dtype).tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[of == kind].tolist()], pa.list_(pa.int64())), pa.array([kind], pa.int32()), pa.array([dtype]), pa.array([data], pa.binary())],
                        names=["ids", "kind", "dtype", "rows"],
                    )

    return run


def unpacked(dtype: str, data: bytes, dim: int) -> np.ndarray:
    if dtype == "digits":
        return np.array([int(x) for x in data.decode().split(",")], object).reshape(-1, dim)
    return np.frombuffer(data, dtype).astype(np.int64).reshape(-1, dim)


def _usable(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id, v of the vectors with exactly dim components, none of them null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    df = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return df.where((F.size("v") == dim) & F.forall("v", finite))


def _start(usable: DataFrame, k: int, dim: int, scale: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest hash of salt and id; k rows come to the driver. Rows without an id are none of them; ties go by components."""
    whole = F.transform("v", lambda x: F.when(F.abs(x * scale) < float(1 << 53), F.floor(x * scale).cast("double")).otherwise(x * scale))
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = usable.where("vec_id is not null").select(key.alias("key"), whole.alias("q"), "v").orderBy("key", "q", "v").limit(k).collect()
    return floors(np.array([r["v"] for r in first], float).reshape(-1, dim), scale)


# -- rounds


def _rows_of(block, dim: int) -> Iterator[np.ndarray]:
    q = unpacked(block["dtype"], block["rows"], dim)
    for at in range(0, len(q), GEMM_ROWS):
        yield q[at : at + GEMM_ROWS]


def _add_block(centroids: Centroids, dim: int):
    """Adds a block's rows to (components, counts, distances) of each cluster, integers of any size. Sums within one product are in its rows' arithmetic, which holds them."""

    def add(total, block):
        sums, counts, inertia = (x.copy() for x in total)
        for rows in _rows_of(block, dim):
            number, distance = centroids.nearest(block["kind"], rows)
            order = np.argsort(number, kind="stable")
            found, first = np.unique(number[order], return_index=True)
            sums[found] += np.add.reduceat(rows[order], first, axis=0).astype(object)
            counts[found] += np.diff([*first.tolist(), len(rows)]).astype(object)
            inertia[found] += np.add.reduceat(distance[order].astype(object), first)
        return sums, counts, inertia

    return add


def _merge(a, b):
    return tuple(x + y for x, y in zip(a, b, strict=True))


def totals(blocks: DataFrame, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Component sums, counts and summed distances of each cluster, over all blocks."""
    k, dim = centroids.rows.shape
    zero = tuple(np.zeros(shape, object) for shape in ((k, dim), k, k))
    return blocks.select("kind", "dtype", "rows").rdd.treeAggregate(zero, _add_block(centroids, dim), _merge)


def moved(centroids: Centroids, sums: np.ndarray, counts: np.ndarray) -> Centroids:
    """Floors of exact means; a centroid without vectors stays."""
    rows = centroids.rows.astype(object)
    for i in np.flatnonzero(counts).tolist():
        rows[i] = [s // counts[i] for s in sums[i]]
    return Centroids(rows if np.abs(rows).max() >= 1 << 62 else rows.astype(np.int64))


def _assign(centroids: Centroids, dim: int, inertia: list[int]):
    prints, total = centroids.prints(), sum(inertia)
    held = lambda x: max(LEAST, min(MOST, int(x)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                at = 0
                for rows in _rows_of(block, dim):
                    number, distance = (x.tolist() for x in centroids.nearest(block["kind"], rows))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(block["ids"][at : at + len(rows)], pa.int64()),
                            pa.array(number, pa.int32()),
                            pa.array([held(x) for x in distance], pa.int64()),
                            pa.array([held(inertia[n]) for n in number], pa.int64()),
                            pa.array([held(total)] * len(rows), pa.int64()),
                            pa.array([prints[n] for n in number], pa.string()),
                        ],
                        names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                    )
                    at += len(rows)

    return run


def fit(blocks: DataFrame, centroids: Centroids, rounds: int) -> Centroids:
    for _ in range(rounds if len(centroids.rows) else 0):
        sums, counts, _ = totals(blocks, centroids)
        centroids = moved(centroids, sums, counts)
    return centroids


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector of dim components.

    Columns `vec_id` and `embedding` are read, others are left out. Vectors that
    are null, of another length, or hold null or anything not finite take no
    part; without vectors there are no rows. Rows that repeat count and return
    as often as they stand there, a null id too, though it starts no centroid.
    With fewer than k vectors with an id there are as many centroids; with none
    there are no clusters and no rows. Of equal distances the smaller number
    wins; a centroid without vectors stays where it is. Distances and sums are
    exact at every size and shown as the nearest long where they leave 64 bits.
    `scale` is a power of two. The driver holds centroids and sums only.
    """
    if scale <= 0 or scale & (scale - 1):
        raise ValueError("scale must be a power of two")
    spark: SparkSession = vectors.sparkSession
    with scratch(spark):
        usable = _usable(vectors, dim)
        centroids = Centroids(_start(usable, k, dim, scale, salt))
        if not len(centroids.rows):
            usable = usable.where(F.lit(False))
        blocks = save(usable.mapInArrow(_to_blocks(dim, scale), _BLOCK), "blocks", keep=True)
        centroids = fit(blocks, centroids, rounds)
        inertia = totals(blocks, centroids)[2].tolist() if len(centroids.rows) else []
    found = blocks.mapInArrow(_assign(centroids, dim, inertia), "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    return found
