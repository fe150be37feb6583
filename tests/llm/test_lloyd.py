"""Centroid clustering against plain Lloyd in whole numbers, whatever the partitioning."""

import hashlib
import math
import random

import numpy as np
import pytest

from lumenrec.llm.lloyd import NARROW, cluster, clustered, nearest, whole

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def fine(v, dims):
    return v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, k, rounds, dims, scale, salt="3"):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if fine(v, dims)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{salt}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        homes = [near(v) for _, v in kept]
        new = []
        for c, old in enumerate(centroids):
            own = [v for (_, v), h in zip(kept, homes) if h == c]
            new.append([sum(x) // len(own) for x in zip(*own)] if own else old)
        centroids = new
    got = [(i, near(v), far(v, centroids[near(v)])) for i, v in kept]
    inertia = lambda c: sum(d for _, h, d in got if c in (None, h))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, h, d, inertia(h), inertia(None), sha[h]) for i, h, d in got), key=str)


def made(n=150, dims=6, seed=1):
    rng = random.Random(seed)
    middle = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(middle)]) for i in range(n)]
    rows += [rng.choice(rows) for _ in range(20)] + [(n + i, rows[0][1]) for i in range(80)]  # repeated rows, one vector many times
    rows += [(None, [0.1] * dims), (None, None), (900, None), (901, []), (902, [0.0] * (dims - 1)), (903, [1.0] * (dims + 1))]
    return rows + [(904, [None] + [0.0] * (dims - 1)), (905, [float("nan")] * dims), (906, [float("inf")] + [0.0] * (dims - 1)), (907, [0.0] * dims)]


@pytest.mark.parametrize("parts", [1, 7])
def test_the_result_is_plain_lloyds(spark, parts):
    rows = made()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr("*", "1 AS v", "2 AS cluster", "3 AS distance", "4 AS n", "5 AS sums").repartition(parts)
    got = clustered(df, k=4, rounds=6, dims=6, scale=1024)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 4, 6, 6, 1024)


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_each_round(spark, rounds):
    rows = made(40, 3, 2)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert sorted(map(tuple, clustered(df, k=5, rounds=rounds, dims=3, scale=100).collect()), key=str) == brute(rows, 5, rounds, 3, 100)


def test_fewer_vectors_than_centroids_and_empty_centroids(spark):
    rows = [(1, [0.5, -0.5]), (1, [0.5, -0.5]), (2, [0.5, -0.5])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = sorted(map(tuple, clustered(df, k=8, rounds=3, dims=2).collect()))
    assert got == brute(rows, 8, 3, 2, 1024)
    assert {r[1] for r in got} == {0}  # equal centroids: the smallest number takes all, the others stay


def test_tables_without_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert clustered(none).collect() == [] and cluster(none)[1] == []
    assert clustered(spark.createDataFrame([(1, None, 0), (2, [1.0], 0)], SCHEMA)).collect() == []


def test_components_of_any_size_are_exact():
    big = whole(np.array([[2.0**60, -3.0], [1.0, 2.0]]), 1024)
    assert big.dtype == object and big[0, 0] == 2**70
    assert whole(np.array([[-0.5, 0.0001]]), 1000).tolist() == [[-500, 0]]
    home, far = nearest(big, np.array([[2**70, -3072], [0, 0]], object))
    assert home.tolist() == [0, 1] and far.tolist() == [0, 1024**2 * 5]
    edge = np.array([[NARROW - 1] * 64, [1 - NARROW] * 64])
    assert nearest(edge, edge[:1])[1].tolist() == [0, 64 * (2 * (NARROW - 1)) ** 2]


def test_large_components(spark):
    rows = [(i, [float(i % 3) * 1e6, float(i)]) for i in range(30)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert sorted(map(tuple, clustered(df, k=3, rounds=5, dims=2).collect()), key=str) == brute(rows, 3, 5, 2, 1024)
