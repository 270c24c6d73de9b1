"""Centroid clustering of whole-number vectors, with an exact nearest-centroid search.

Components are turned into whole numbers, so sums, distances and centroids are exact and
no result depends on the order or number of partitions. A vector looks for its centroid
by equal averages and equal variances: centroids are sorted by their component sum, the
search goes outward from the vector's own sum, ends where (difference of sums)^2 / d
exceeds the best distance, and skips a centroid where that plus (difference of
deviations)^2 does; what is left is compared in whole numbers. A bound only rejects what
is strictly farther, deviations with a margin for rounding, so ties still fall to the
smaller number.

Each round reads the vectors once; a task holds one batch and, for each centroid, one sum
of vectors, and sends the latter on: rounds shuffle centroids, never vectors. Centroids
(clusters x components) are the only thing the driver holds.

Defined results: vectors that are null, have another number of components than asked for
or a null or non-finite one are left out; components are held within 2^24 on either side
after scaling, so that squared distances fit 64 bits (a float beyond 65,536 at a scale of
256 counts as that); an inertia beyond 64 bits is the largest long; a null vec_id is
hashed as the empty string; repeated rows are vectors of their own, and among equal
hashes the smaller vector comes first; fewer vectors than clusters give as many clusters
as vectors; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import cut

SIZE, CLUSTERS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
LARGEST = 1 << 24
SLICE = 4096  # vectors that are searched together


def whole(x: Column, scale: int = SCALE) -> Column:
    """The vector's components times the scale, floored, within LARGEST; 32 bits each."""
    return F.transform(x, lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))


def usable(x: Column, size: int = SIZE) -> Column:
    """Whether the vector has so many components, all finite numbers."""
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return F.coalesce((F.size(x) == size) & finite, F.lit(False))


def vectors(embeddings: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, x: the usable rows."""
    held = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("x")).filter(usable(F.col("x"), size))
    return held.select("vec_id", whole(F.col("x"), scale).alias("x"))


def first_centroids(held: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hashes; at most `clusters` rows reach the driver."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = held.select("x", h.alias("h")).orderBy("h", "x").limit(clusters).collect()
    return np.array([r.x for r in rows], dtype=np.int64)


class Search:
    """Nearest centroids of many vectors; squared distances are exact."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(axis=1)
        self.number = np.argsort(sums, kind="stable")
        self.c, self.sums = centroids[self.number], sums[self.number]
        self.deviation = _deviation(self.c, self.sums)
        self.compared = 0  # exact distances worked out so far

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the centroid, squared distance) of each row of x, int64."""
        n, d = x.shape
        sums = x.sum(axis=1)
        deviation = _deviation(x, sums)
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.c))
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        open_ = np.arange(n)
        while len(open_):
            lo, hi, s = left[open_], right[open_], sums[open_]
            gap_lo = np.where(lo >= 0, np.abs(s - self.sums[np.maximum(lo, 0)]), -1)
            gap_hi = np.where(hi < len(self.c), np.abs(s - self.sums[np.minimum(hi, len(self.c) - 1)]), -1)
            use_left = (gap_lo >= 0) & ((gap_hi < 0) | (gap_lo <= gap_hi))
            gap = np.where(use_left, gap_lo, gap_hi)
            # gap^2 > d * best, in whole numbers: gap <= 2^31 keeps the square in 64 bits, and best is divided instead of multiplied.
            alive = (gap >= 0) & ((gap * gap) // d <= best[open_])
            open_, gap = open_[alive], gap[alive]
            at = np.where(use_left[alive], lo[alive], hi[alive])
            left[open_] -= use_left[alive]
            right[open_] += ~use_left[alive]
            apart = deviation[open_] - self.deviation[at]
            bound = gap.astype(np.float64) ** 2 / d + apart * apart
            close = bound * (1 - 1e-9) - 1 <= best[open_]
            rows, cols = open_[close], at[close]
            diff = x[rows] - self.c[cols]
            exact = np.einsum("ij,ij->i", diff, diff)
            self.compared += len(rows)
            own = self.number[cols]
            better = (exact < best[rows]) | ((exact == best[rows]) & (own < number[rows]))
            best[rows[better]], number[rows[better]] = exact[better], own[better]
        return number, best


def _deviation(x: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The length of each vector's difference from its own mean."""
    apart = x - sums[:, None] / x.shape[1]
    return np.sqrt(np.einsum("ij,ij->i", apart, apart))


def _blocks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    flat = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    for lo in range(0, len(flat), SLICE):
        yield lo, flat[lo : lo + SLICE].astype(np.int64)


def _round(held: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floored means of the vectors that are nearest to each; one without vectors stays."""
    k, size = centroids.shape
    shared = held.sparkSession.sparkContext.broadcast(centroids)  # clusters x components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, total, count = Search(shared.value), np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, x in _blocks(batch, size):
                number, _ = search.nearest(x)
                count += np.bincount(number, minlength=k)
                order = np.argsort(number, kind="stable")
                first = np.flatnonzero(np.diff(number[order], prepend=-1))
                if len(first):
                    total[number[order][first]] += np.add.reduceat(x[order], first, axis=0)
        for c in np.flatnonzero(count):
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([count[c]]), pa.array([total[c].tolist()], pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = held.select("x").mapInArrow(run, "cluster int, n long, total array<long>")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(size)]).alias("total"))
    out = centroids.copy()
    for r in sums.collect():  # one row a cluster
        out[r.cluster] = [v // r.n for v in r.total]
    return out


def fit(held: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """The final centroids of vec_id, x rows."""
    centroids = first_centroids(held, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _round(held, centroids)
    return centroids


def assign(held: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    shared = held.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shared.value)
        for batch in batches:
            for lo, x in _blocks(batch, shared.value.shape[1]):
                number, best = search.nearest(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(x)), pa.array(number.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])

    return held.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(embeddings: DataFrame, size: int = SIZE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector."""
    held = vectors(embeddings, size, scale)
    centroids = fit(held, clusters, rounds, seed)
    spark = embeddings.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    placed = cut(assign(held, centroids))
    sums = {r.cluster: int(r.total) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # one row a cluster
    most = (1 << 63) - 1
    facts = [(c, min(sums.get(c, 0), most), min(sum(sums.values()), most), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # one row a cluster
