"""Centroid clustering: plain Lloyd over integer vectors.

Vectors are turned into whole numbers once and kept as a table. Each round broadcasts the centroids, k rows of dims
numbers; a task computes the integer squared differences to each of them, takes the least and sums its own vectors by
centroid; the sums of the tasks, k rows each, are merged through a groupBy. All arithmetic is exact, so neither the layout
nor a repeated task changes a result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped_after, store, table

K, ROUNDS, DIMS, SCALE, SALT = 8, 10, 64, 1_024, "3"
NARROW = 1 << 27  # components below it in size: a distance over up to 128 of them fits 64 bits
BATCH = 4_096  # vectors whose distances are computed at once


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in 64 bits, or as Python's whole numbers where one is too large for exact sums of squares."""
    y = np.floor(x * scale)
    return y.astype(np.int64) if not y.size or np.abs(y).max() < NARROW else np.array([[math.floor(v) for v in row] for row in y.tolist()], object)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, the smaller of equally near ones, and its squared distance."""
    far = np.empty((len(v), len(centroids)), np.int64 if v.dtype == centroids.dtype == np.int64 else object)
    for c, centroid in enumerate(centroids):
        off = v - centroid
        far[:, c] = (off * off).sum(axis=1)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(v)), best]


def _rows(frame: pd.DataFrame, dims: int, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """Vectors of a batch as whole numbers, some at a time, with the place of the first."""
    for i in range(0, len(frame), BATCH):
        yield i, whole(np.stack(frame["v"].iloc[i : i + BATCH].to_numpy()).astype(np.float64).reshape(-1, dims), scale)


def _centroids(sent) -> np.ndarray:
    c = np.array(sent.value, object)
    return c.astype(np.int64) if max(map(abs, c.flat), default=0) < NARROW else c


def _sums(sent, dims: int, scale: int):
    """Of a task's vectors: how many are nearest to each centroid, and their sum. A row for each centroid that has any."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids = _centroids(sent)
        n, sums = [0] * len(centroids), [[0] * dims for _ in centroids]
        for frame in frames:
            for _, v in _rows(frame, dims, scale):
                home, _ = nearest(v, centroids)
                for c in np.unique(home).tolist():
                    own = v[home == c]
                    n[c] += len(own)
                    sums[c] = [a + int(b) for a, b in zip(sums[c], own.sum(axis=0))]
        some = [c for c in range(len(centroids)) if n[c]]
        if some:
            yield pd.DataFrame({"cluster": np.array(some, np.int32), "n": [n[c] for c in some], "sums": [sums[c] for c in some]})

    return run


def _assigned(sent, dims: int, scale: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids = _centroids(sent)
        for frame in frames:
            for i, v in _rows(frame, dims, scale):
                home, far = nearest(v, centroids)
                yield pd.DataFrame({"vec_id": frame["vec_id"].iloc[i : i + BATCH], "cluster": home.astype(np.int32), "distance": far.astype(np.int64)})

    return run


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dims: int = DIMS) -> DataFrame:
    """vec_id, v of the rows whose vector has dims components, none of them null or non-finite."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where((F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def first_centroids(kept: DataFrame, k: int = K, scale: int = SCALE, salt: str = SALT) -> list[list[int]]:
    """The k vectors of least SHA-256 of salt:vec_id, in that order; under one hash, in the order of their components."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    least = kept.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k)
    return [[math.floor(x * scale) for x in r.v] for r in least.collect()]


def lloyd(kept: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT) -> list[list[int]]:
    """The centroids after all rounds. kept (vec_id, v) is read in each of them, and should be a table.

    A centroid without vectors stays as it is. With fewer than k vectors there are so many centroids, without any none.
    """
    centroids, context = first_centroids(kept, k, scale, salt), kept.sparkSession.sparkContext
    for _ in range(rounds if centroids else 0):
        sent = context.broadcast(centroids)
        parts = kept.select("v").mapInPandas(_sums(sent, dims, scale), "cluster int, n bigint, sums array<bigint>")
        each = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        new = [list(c) for c in centroids]
        for r in each.collect():  # k * dims rows
            new[r["cluster"]][r["at"]] = int(r["x"]) // r["n"]
        sent.unpersist()
        if new == centroids:  # all further rounds would give the same
            break
        centroids = new
    return centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance of every vector with dims finite components, and the centroids.

    Components x count as floor(scale * x). The first centroids are the k vectors of least SHA-256 of salt:vec_id (a null
    vec_id as the empty text; under one hash in the order of their components, so repeated rows may be several of them).
    Vectors that are null, of another length, or hold null or non-finite components are left out, repeated rows each count,
    and an empty table gives none. A squared distance to the nearest centroid that does not fit 64 bits is an error.
    """
    kept, _ = store(kept_vectors(vectors, id_col, vector, dims), "kept-vectors")
    centroids = lloyd(kept, k, rounds, dims, scale, salt)
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)
    schema = f"vec_id {dict(kept.dtypes)['vec_id']}, cluster int, distance bigint"
    return kept.mapInPandas(_assigned(sent, dims, scale), schema), centroids


def clustered(vectors: DataFrame, **settings) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the rows that cluster() gives."""
    spark = vectors.sparkSession
    with dropped_after(spark, keep := []):
        rows, centroids = cluster(vectors, **settings)
        rows, path = store(rows, "assigned-vectors")
        keep.append(path)
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a centroid
    facts = [(c, s, sum(sums.values()), digest(centroids[c])) for c, s in sums.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds one after another; whole-number division is brought from truncation to floor."""
    squares = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c.x[i]) * (v[i] - c.x[i])))"
    assign = "SELECT r, vec_id, v, cluster, d FROM (SELECT r, vec_id, v, c.cluster, {0} AS d FROM kept, c{1} c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1"
    steps = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS cluster, v AS x FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept ORDER BY h, v LIMIT 8))",
    ]
    for k in range(ROUNDS):
        steps.append(f"a{k} AS MATERIALIZED ({assign.format(squares, k)})")
        steps.append(f"""s{k} AS MATERIALIZED (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{k}, range(1, 65) t(i) GROUP BY cluster, i) GROUP BY cluster)""")
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(s.x, c.x)::BIGINT[] AS x FROM c{k} c LEFT JOIN s{k} s USING (cluster))")
    steps.append(f"last AS MATERIALIZED ({assign.format(squares, ROUNDS)})")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(x, ',')) AS centroid_sha256 FROM last JOIN c{ROUNDS} USING (cluster)"""


OP11_SQL = _sql()
