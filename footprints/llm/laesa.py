"""Exact k-means over integer vectors with a table of pivot distances (LAESA).

The distances from every vector to a few fixed pivots are worked out once and stored beside it. In each round a centroid's
distances to the pivots are known to the driver, and the largest difference of the two bounds the distance between vector and
centroid from below. The centroid of the smallest bound is tried first; only centroids whose bound does not exceed the best
distance so far get an exact integer distance. Bounds are rounded down by more than floating point can err, so the result is
that of trying all centroids.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F

from footprints.llm.storage import prepared, written

COMPONENTS, SCALE, CENTROIDS, ROUNDS, PIVOTS = 64, 64, 16, 3, 12
# A squared distance of 64 components of this size still fits into 64 bits.
LARGEST = 1 << 27
_ROWS = 8192


@dataclass
class Clustering:
    assigned: DataFrame  # vec_id, cluster, distance, tested
    centroids: np.ndarray  # (k, components), integers
    inertia: list[int]  # by cluster


def integers(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors with exactly so many components, none null or not finite, as floor(scale * x).

    All others go: null vectors, shorter and longer ones, those with a null, NaN or infinite component.
    """
    kept = vectors.where(
        (F.size("embedding") == components) & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    )
    grown = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    # An integer that is out of range is an error: squared distances would not fit into 64 bits.
    too_large = F.exists("embedding", lambda x: F.abs(x.cast("double")) * scale >= LARGEST)
    checked = F.when(too_large, F.raise_error(F.lit(f"a component times {scale} is {LARGEST} or more"))).otherwise(grown)
    return kept.select("vec_id", checked.cast("array<int>").alias("v"))


def _first(vectors: DataFrame, salt: str, n: int) -> list[Row]:
    """The n vectors whose salted ids have the smallest digests; equal ids go by components, null ids come last."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    return vectors.select(digest.alias("d"), "v").orderBy(F.col("d").asc_nulls_last(), "v").limit(n).collect()


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width).astype(np.int64)


def _exact(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    off = vectors - centre
    return np.einsum("ij,ij->i", off, off)


def nearest(vectors: np.ndarray, pivot_distances: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid's number (ties: the smaller), the squared distance, and how many exact distances it took."""
    n, k = len(vectors), len(centroids)
    to_pivots = np.sqrt(((centroids[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2).astype(float))
    bound = np.zeros((n, k))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(pivot_distances[:, p : p + 1] - to_pivots[None, :, p]), out=bound)
    # Both distances carry relative errors of some 1e-16; this is far more than their sum.
    margin = 1e-9 * (1 + pivot_distances.max(axis=1, initial=0)[:, None] + to_pivots.max(initial=0))
    bound = np.maximum(bound - margin, 0) ** 2 * (1 - 1e-9)
    cluster = bound.argmin(axis=1)
    best = np.empty(n, np.int64)
    for c in range(k):
        of = np.flatnonzero(cluster == c)
        best[of] = _exact(vectors[of], centroids[c])
    tried, tested = cluster.copy(), np.ones(n, np.int64)
    for c in range(k):
        alive = np.flatnonzero((bound[:, c] <= best) & (tried != c))
        if len(alive):
            found = _exact(vectors[alive], centroids[c])
            better = (found < best[alive]) | ((found == best[alive]) & (c < cluster[alive]))
            best[alive[better]], cluster[alive[better]] = found[better], c
            tested[alive] += 1
    return cluster, best, tested


def _stored(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, v, p): every vector with its distances to the pivots, written once."""
    width = pivots.shape[1]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                piece = batch.slice(start, _ROWS)
                v = _matrix(piece.column("v"), width)
                p = np.sqrt(np.stack([_exact(v, pivot) for pivot in pivots], axis=1).astype(float))
                offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * p.shape[1])
                yield pa.RecordBatch.from_arrays([piece.column("vec_id"), piece.column("v"), pa.ListArray.from_arrays(offsets, pa.array(p.reshape(-1)))], names=["vec_id", "v", "p"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return written(vectors.mapInArrow(run, f"vec_id {kind}, v array<int>, p array<double>"), "pivots")


def _sums(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> list[Row]:
    """n and exact componentwise sums of each cluster; tasks send one row a cluster."""
    k, width = centroids.shape

    def run(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                piece = batch.slice(start, _ROWS)
                v = _matrix(piece.column("v"), width)
                cluster, _, _ = nearest(v, piece.column("p").flatten().to_numpy().reshape(-1, len(pivots)), centroids, pivots)
                counts += np.bincount(cluster, minlength=k)
                for c in np.unique(cluster):
                    sums[c] += v[cluster == c].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(counts), *(pa.array(sums[:, i]) for i in range(width))], names=["c", "n", *(f"s{i}" for i in range(width))])

    names = [f"s{i}" for i in range(width)]
    partial = stored.select("v", "p").mapInArrow(run, ", ".join(f"{x} long" for x in ["c", "n", *names]))
    # Sums of sums may need more than 64 bits.
    return partial.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(F.col(x).cast("decimal(20,0)")).alias(x) for x in names]).collect()


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, pivots: int = PIVOTS) -> Clustering:
    """Lloyd's rounds over (vec_id, embedding), exact to the last integer.

    Centroids start as the k vectors whose ids' digests are smallest (fewer if fewer vectors are kept), in that order; pivots are
    chosen alike by another salt. A centroid without vectors stays. Repeated rows count as often as they occur; ids may be null or repeat.
    Without any kept vector the result is empty. The driver holds k centroids and the pivots, and gets k rows a round.
    """
    spark = prepared(vectors.sparkSession)
    kept = integers(vectors, components, scale)
    centres = np.array([r["v"] for r in _first(kept, "1", k)], np.int64).reshape(-1, components)
    if not len(centres):
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return Clustering(spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, tested int"), centres, [])
    fixed = np.array([r["v"] for r in _first(kept, "pivot", pivots)], np.int64)
    stored = _stored(kept, fixed)
    for _ in range(rounds):
        new = centres.copy()
        for row in _sums(stored, centres, fixed):
            if row["n"]:
                new[row["c"]] = [int(row[f"s{i}"]) // row["n"] for i in range(components)]
        centres = new

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                piece = batch.slice(start, _ROWS)
                found = nearest(_matrix(piece.column("v"), components), piece.column("p").flatten().to_numpy().reshape(-1, len(fixed)), centres, fixed)
                yield pa.RecordBatch.from_arrays([piece.column("vec_id"), pa.array(found[0].astype(np.int32)), pa.array(found[1]), pa.array(found[2].astype(np.int32))], names=["vec_id", "cluster", "distance", "tested"])

    kind = stored.schema["vec_id"].dataType.simpleString()
    assigned = written(stored.mapInArrow(run, f"vec_id {kind}, cluster int, distance long, tested int"), "assigned")
    inertia = [0] * len(centres)
    for row in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect():
        inertia[row["cluster"]] = int(row["d"])
    return Clustering(assigned, centres, inertia)


def described(found: Clustering) -> DataFrame:
    """vec_id, cluster, distance, tested, cluster_inertia, inertia, centroid_sha256 of every kept vector; k rows are broadcast."""
    spark = found.assigned.sparkSession
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in found.centroids]
    rows = [(i, found.inertia[i], sum(found.inertia), digest) for i, digest in enumerate(digests)]
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "tested")
