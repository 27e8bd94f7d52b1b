"""Clusters of vectors around centroids, each found by Orchard's search.

Every centroid has a list of the others, nearest first. The search for a vector starts at one
centroid and walks its list; at a closer centroid it jumps to that one's list, a centroid that
it has visited is not measured again, and it stops at a neighbour strictly beyond twice the
distance of the vector to the present centroid: no later one can be as near. Of equally near
centroids the one of the smaller number counts.

All arithmetic is on integers: a component x becomes floor(scale * x), centroids are rounded
down, distances are squared, so results don't depend on the order of summation.

A vector is kept if it has exactly ``dim`` components, none null, infinite or not a number, and
none beyond 2**26 after scaling (its distances would not fit a long). The others, null vectors
too, have no row in the result. Repeated rows are vectors of their own. Null ids come last where
the first centroids are drawn; ties there fall to the smaller vector. With fewer vectors than
clusters there are as many clusters as vectors; an empty table gives an empty result. Other
columns are ignored, whatever their names. A sum of distances that a long can't hold is null.

At scale: vectors are read once, scaled and written; each round is one pass over them that
leaves one row per task, cluster and component to a sum, so a cluster or a vector with a third
of all rows weighs no more than another. The driver holds the centroids, ``MOST`` components at
most, and sends them with the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlytics.storage import settle

#: Components of all centroids together, at most.
MOST = 1 << 22
#: Components in size, at most.
REACH = 1 << 26


def scaled(vectors: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are kept, and their components as integers."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    sized = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim
    flat = vectors.filter(pa.array(sized)).flatten()
    with np.errstate(over="ignore", invalid="ignore"):
        grid = np.floor(scale * flat.to_numpy(zero_copy_only=False).reshape(-1, dim))
        fits = (np.abs(grid) <= REACH).all(axis=1)
    sized[sized] = fits
    return sized, grid[fits].astype(np.int64)


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances between centroids and, per centroid, the others from near to far."""
    gaps = np.stack([((centroids - c) ** 2).sum(axis=1) for c in centroids])
    apart = gaps.copy()
    np.fill_diagonal(apart, -1)
    return gaps, np.argsort(apart, axis=1, kind="stable")[:, 1:]


def nearest(vectors: np.ndarray, centroids: np.ndarray, gaps: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of each vector. All vectors
    take a step of their own search at a time."""
    at = np.zeros(len(vectors), np.int64)
    best = ((vectors - centroids[0]) ** 2).sum(axis=1)
    visited = np.zeros((len(vectors), len(centroids)), bool)
    visited[:, 0] = True
    place = np.zeros(len(vectors), np.int64)
    walking = np.arange(len(vectors))
    while True:
        walking = walking[place[walking] < lists.shape[1]]
        candidate = lists[at[walking], place[walking]]
        near = gaps[at[walking], candidate] <= 4 * best[walking]
        walking, candidate = walking[near], candidate[near]
        if not len(walking):
            return at, best
        place[walking] += 1
        new = ~visited[walking, candidate]
        rows, candidate = walking[new], candidate[new]
        visited[rows, candidate] = True
        distance = ((vectors[rows] - centroids[candidate]) ** 2).sum(axis=1)
        closer = (distance < best[rows]) | ((distance == best[rows]) & (candidate < at[rows]))
        rows, candidate = rows[closer], candidate[closer]
        at[rows], best[rows], place[rows] = candidate, distance[closer], 0


def _grid(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def quantised(vectors: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v``, the scaled components, of the kept vectors, written once."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, grid = scaled(batch.column("v"), dim, scale)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(grid.astype(np.int32).ravel()), dim).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(kept)), lists], ["id", "v"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return settle(rows.mapInArrow(keep, "id long, v array<int>"), "vectors")


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the least seeded hashes, in the order of these."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    least = vectors.select("v", drawn.alias("drawn")).orderBy(F.col("drawn").asc_nulls_last(), "v").limit(clusters)
    return np.array([r["v"] for r in least.select("v").collect()], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the mean of its vectors, rounded down; one without vectors stays."""
    gaps, lists = neighbour_lists(centroids)
    dim = centroids.shape[1]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            grid = _grid(batch, dim)
            at, _ = nearest(grid, centroids, gaps, lists)
            np.add.at(sums, at, grid)
            counts += np.bincount(at, minlength=len(centroids))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(seen, pa.int32()), "n": counts[seen], "sums": pa.array(sums[seen].tolist(), pa.list_(pa.int64()))})

    parts = vectors.select("v").mapInArrow(total, "cluster int, n long, sums array<long>")
    sums = parts.select("cluster", "n", F.posexplode("sums").alias("i", "part")).groupBy("cluster", "i").agg(F.sum("part").alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():
        out[r["cluster"], r["i"]] = r["s"] // r["n"]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``id``, ``cluster`` and ``distance`` of every vector."""
    gaps, lists = neighbour_lists(centroids)
    dim = centroids.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, distance = nearest(_grid(batch, dim), centroids, gaps, lists)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(at, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    return vectors.mapInArrow(place, "id long, cluster int, distance long")


def clustered(
    vectors: DataFrame, *, clusters: int, rounds: int, dim: int, scale: int = 64, seed: int = 1,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Per kept vector its cluster and squared distance, the sums of distances over its cluster
    and over all, and its final centroid's components."""
    if clusters * dim > MOST:
        raise ValueError(f"centroids of {clusters} x {dim} components are more than {MOST}")
    grid = quantised(vectors, dim, scale, id_col, vector_col)
    centroids = first_centroids(grid, clusters, seed)
    schema = "cluster int, centroid array<long>, centroid_sha256 string"
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(grid, centroids)
        placed = settle(assigned(grid, centroids), "assigned")
    else:
        placed = grid.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    named = [(i, c.tolist(), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    # One row per cluster, whose number is checked above.
    sums = placed.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    whole = placed.agg(F.try_sum("distance")).scalar()
    told = vectors.sparkSession.createDataFrame(named, schema).join(F.broadcast(sums), "cluster").withColumn("inertia", whole)
    return placed.join(F.broadcast(told), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
