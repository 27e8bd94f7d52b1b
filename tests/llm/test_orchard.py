import hashlib
import math

import numpy as np
import pytest

from pitchlytics.llm import orchard

SCHEMA = "vec_id long, embedding array<float>, cluster string, v long"


def brute_force(rows, clusters, rounds, dim, scale, seed):
    """Lloyd's rounds with plain loops over Python integers."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:clusters]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        found = [place(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            own = [v for (_, v), f in zip(kept, found, strict=True) if f == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, *place(v)[::-1]) for i, v in kept]
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, k, d, sum(r[2] for r in out if r[1] == k), sum(r[2] for r in out), told[k]) for i, k, d in out)


def columns(df):
    return sorted(tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


@pytest.mark.parametrize("clusters, rounds", [(1, 2), (5, 3), (40, 2)])
def test_clusters_are_those_of_plain_rounds(spark, clusters, rounds):
    rng = np.random.default_rng(clusters)
    # Few distinct values: ties between centroids, equal vectors, empty clusters.
    rows = [(i, (rng.integers(-3, 4, 4) / 2).tolist()) for i in range(120)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    found = orchard.clustered(df, clusters=clusters, rounds=rounds, dim=4, scale=2, seed=7)
    assert columns(found) == brute_force(rows, clusters, rounds, 4, 2, 7)


def test_a_hot_vector_and_vectors_that_are_not_kept(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 0.0]), (904, [nan, 0.0, 0.0]), (905, [0.0, inf, 0.0]), (906, [1.0] * 4)]
    rows = [(i, [0.25, -0.5, 1.0]) for i in range(300)] + [(i, [i / 8, -i / 4, 0.1]) for i in range(300, 330)] + [(5, [0.25, -0.5, 1.0])]
    df = spark.createDataFrame([(i, v, None, None) for i, v in rows + odd], SCHEMA).repartition(4)
    found = orchard.clustered(df, clusters=6, rounds=3, dim=3, scale=64)
    assert columns(found) == brute_force(rows + odd, 6, 3, 3, 64, 1)
    # Beyond what squares in a long can hold.
    huge = spark.createDataFrame([(1, [3e38, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in orchard.clustered(huge, clusters=2, rounds=1, dim=2).collect()] == [2]


def test_few_vectors_null_ids_and_empty_tables(spark):
    rows = [(3, [1.0, 0.0]), (9, [5.0, 5.0])]
    df = spark.createDataFrame([(i, v, "", 0) for i, v in rows], SCHEMA)
    assert columns(orchard.clustered(df, clusters=16, rounds=3, dim=2)) == brute_force(rows, 16, 3, 2, 64, 1)
    named = spark.createDataFrame([(None, [1.0, 0.0], "", 0), (4, [9.0, 9.0], "", 0)], SCHEMA)
    found = orchard.clustered(named, clusters=1, rounds=0, dim=2, scale=1).collect()
    assert {(r["vec_id"], r["distance"]) for r in found} == {(4, 0), (None, 64 + 81)}
    assert orchard.clustered(df.limit(0), clusters=16, rounds=3, dim=2).collect() == []
    with pytest.raises(ValueError):
        orchard.clustered(df, clusters=1 << 20, rounds=1, dim=64)


def test_the_search_measures_fewer_centroids_than_there_are():
    rng = np.random.default_rng(0)
    centroids = rng.integers(-1000, 1000, (64, 3))
    vectors = centroids[rng.integers(0, 64, 500)] + rng.integers(-20, 20, (500, 3))
    gaps, lists = orchard.neighbour_lists(centroids)
    at, best = orchard.nearest(vectors, centroids, gaps, lists)
    every = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    # The lists are from near to far and leave out the centroid itself.
    assert all(i not in lists[i] and (np.diff(gaps[i][lists[i]]) >= 0).all() for i in range(64))
