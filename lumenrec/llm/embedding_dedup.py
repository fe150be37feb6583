"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative a group.

Equal vectors are one node, so copies cost one row. Each node has a home cell, that of its nearest centre, and visits its
next nearest cells; a pair is compared wherever one of the two is at home. Vectors of another length have cells of their
own. Where more cells are wanted than are fitted at once, each cell of a first level is fitted and split again; neither level has
more centres than that, and beyond CELLS * CELLS * PER_CELL nodes cells grow instead. A cell of
many rows is cut into blocks whose pairs are compared apart, so no cell is one task. Only links counted and spanning edges
leave a block, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, dropped_after, store, table

CELLS, PER_CELL = 2_048, 256  # cells that are fitted at once; nodes a cell that are aimed at
SAMPLE, PER_CENTRE = 16_384, 16  # nodes that the first centres are fitted on: so many, or so many a centre if that is more (32,768 at most)
VISITS, BLOCK = 4, 2_048  # cells that a node goes to, with its home; rows of a cell that are compared at once
CHUNK = 50_000  # rows of a first-level cell that are placed at once


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit centres of the unit rows v, from its first k rows on."""
    centres = v[:k].copy()
    for _ in range(rounds):
        home = np.concatenate([(v[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(v), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, v)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(-1, dim)


def nearest(v: np.ndarray, centres: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
    """The visits nearest centres of each unit row, nearest first, and their cosines."""
    visits = min(visits, len(centres))
    near = -(v @ centres.T)
    cells = np.argpartition(near, visits - 1, axis=1)[:, :visits] if visits < len(centres) else np.tile(np.arange(visits), (len(near), 1))
    order = np.argsort(np.take_along_axis(near, cells, 1), axis=1, kind="stable")
    cells = np.take_along_axis(cells, order, 1)
    return cells, -np.take_along_axis(near, cells, 1)


def _assign(centres: dict[int, np.ndarray], visits: int):
    """Rows (node, n, v) to (dim, cell, node, n, cells, v), one for each cell that a node visits. Lengths without centres are one cell."""

    def run(batches):
        for b in batches:
            sizes = pa.compute.list_value_length(b.column(2)).to_numpy()
            for dim in np.unique(sizes).tolist():
                rows = b.take(pa.array(np.flatnonzero(sizes == dim)))
                if dim in centres:
                    cells, _ = nearest(unit_rows(_matrix(rows.column(2), dim)), centres[dim], visits)
                else:
                    cells = np.zeros((rows.num_rows, 1), np.int64)
                yield _visits(rows, dim, cells)

    return run


def _visits(rows: pa.RecordBatch, dim: int, cells: np.ndarray) -> pa.RecordBatch:
    each = cells.shape[1]
    at = pa.array(np.repeat(np.arange(len(cells)), each))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, each, dtype=np.int32)), pa.array(cells.ravel(), pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(np.full(cells.size, dim), pa.int32()), pa.array(cells.ravel(), pa.int64()), rows.column(0).take(at), rows.column(1).take(at), lists.take(at), rows.column(2).take(at)], ["dim", "cell", "node", "n", "cells", "v"])


def _fit(per_cell: int, most: int):
    """Centres of the second level, from the sampled rows of one cell of the first."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        dim, cell = (k.as_py() for k in key)
        order = np.argsort(np.asarray(rows.column("h").combine_chunks()), kind="stable")
        v = unit_rows(_matrix(rows.column("v"), dim))[order]
        k = min(len(v), most, max(1, math.ceil(rows.column("total")[0].as_py() / per_cell)))
        return pa.table({"dim": pa.array([dim], pa.int32()), "cell": pa.array([cell], pa.int64()), "centres": pa.array([spherical_kmeans(v, k).tobytes()], pa.binary())})

    return run


def _place(visits: int, most: int):
    """The nearest second-level cells of some rows of a first-level cell."""

    def run(key: tuple, rows: pa.Table, centres: pa.Table) -> pa.Table:
        dim, cell, _ = (k.as_py() for k in key)
        if not rows.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "sub": pa.array([], pa.int64()), "near": pa.array([], pa.float64())})
        own = np.frombuffer(centres.column("centres")[0].as_py()).reshape(-1, dim) if centres.num_rows else np.ones((1, dim))
        cells, near = nearest(unit_rows(_matrix(rows.column("v"), dim)), own, visits)
        node = np.repeat(np.asarray(rows.column("node").combine_chunks()), cells.shape[1])
        return pa.table({"node": node, "sub": cell * most + cells.ravel(), "near": near.ravel()})

    return run


def _second_level(nodes: DataFrame, placed: DataFrame, per_cell: int, visits: int, most: int) -> DataFrame:
    """placed anew by the cells of a second level: each cell is fitted on a sample of about PER_CENTRE rows a centre and split.

    A node looks at the second-level cells of all first-level cells that it visits, and visits the nearest of them.
    """
    kind = dict(placed.dtypes)["v"]
    sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("visitors"), F.count_if(F.col("cells")[0] == F.col("cell")).alias("total"))
    sizes, _ = store(sizes, "first-level")  # a row a cell, so the hint below is for few rows
    rows = placed.join(F.broadcast(sizes), ["dim", "cell"])
    share = F.least(F.lit(1.0), PER_CENTRE * F.least(F.ceil(F.col("total") / per_cell), F.lit(most)) / F.col("total"))
    drawn = rows.where(F.col("cells")[0] == F.col("cell")).withColumn("h", F.xxhash64("v")).where(F.pmod("h", F.lit(1 << 30)) <= share * (1 << 30))
    centres, _ = store(drawn.select("dim", "cell", "h", "total", "v").groupBy("dim", "cell").applyInArrow(_fit(per_cell, most), "dim int, cell bigint, centres binary"), "second-centres")
    parts = F.ceil(F.col("visitors") / CHUNK)
    rows = rows.select("dim", "cell", F.pmod(F.xxhash64("node"), parts).alias("part"), "node", "v")
    copies = centres.join(F.broadcast(sizes), ["dim", "cell"]).select("dim", "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"), "centres")
    near = rows.groupBy("dim", "cell", "part").cogroup(copies.groupBy("dim", "cell", "part")).applyInArrow(_place(visits, most), "node bigint, sub bigint, near double")
    best = near.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("near")).alias("far"), "sub"))), 1, visits)["sub"].alias("cells"))
    out = nodes.join(best, "node").select(F.size("v").alias("dim"), F.explode("cells").alias("cell"), "node", "n", "cells", F.col("v").cast(kind).alias("v"))
    return out


def _compare(threshold: float):
    """One unit: the rows of one block of a cell, or of two blocks that are compared across."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        dim, cell, lo, hi = (k.as_py() for k in key)
        node, n, block = (np.asarray(rows.column(c).combine_chunks()) for c in ("node", "n", "block"))
        v = unit_rows(_matrix(rows.column("v"), dim))
        cells = np.asarray(rows.column("cells").combine_chunks().flatten()).reshape(len(node), -1)
        left = np.flatnonzero(block == lo)
        right = left if lo == hi else np.flatnonzero(block == hi)
        i, j = np.nonzero(v[left] @ v[right].T >= threshold)
        i, j = left[i], right[j]
        keep = (node[i] < node[j] if lo == hi else node[i] != node[j]) & ((cells[i, 0] == cell) | (cells[j, 0] == cell))
        i, j = i[keep], j[keep]
        # A pair of two homes may meet in both; it counts in the smaller one of them.
        own, other = np.where(cells[i, 0] == cell, i, j), np.where(cells[i, 0] == cell, j, i)
        far = cells[other, 0]
        counts = ~((cells[own] == far[:, None]).any(1) & (far < cell))
        links = np.bincount(i[counts], n[j[counts]], len(node)) + np.bincount(j[counts], n[i[counts]], len(node))
        label = np.arange(len(node))
        while True:
            was, low = label.copy(), np.minimum(label[i], label[j])
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
            if (was == label).all():
                break
        out = np.flatnonzero((links > 0) | (label != np.arange(len(node))))
        return pa.table({"node": node[out], "links": links[out].astype(np.int64), "joined": node[label[out]]})

    return run


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, sample: int = SAMPLE, per_cell: int = PER_CELL, visits: int = VISITS, block: int = BLOCK, most: int = CELLS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors.

    Rows link at a cosine of threshold or more in double precision, which takes vectors of one length. n_links counts the
    other rows that were found linked; component_id is the smallest vec_id that links reach. No pair below threshold is
    linked; of those at or above it, a pair is missed only where neither vector visits the other's home cell. Each length
    has its own centres, fitted on the sample nodes of least hash, most at a time; with more cells than that there are two
    levels. Vectors that are null, empty, zero or hold null or non-finite components link with nothing. A row without links
    is its own component, with its vec_id even if null; in a component, null ids are passed over. Repeated rows are copies
    of each other; an empty table gives none.
    """
    kind, spark = dict(vectors.dtypes)[vector], vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(fine, F.col("v")))
    with dropped_after(spark, keep := []):
        nodes = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
        nodes, _ = store(nodes.select(F.monotonically_increasing_id().alias("node"), "rep", "n", "v"), "vectors")
        centres, two_levels = {}, []
        for dim, total in nodes.groupBy(F.size("v").alias("dim")).count().collect():  # a row a length
            cells = total // per_cell
            if cells > 1:
                first = cells if cells <= most else min(most, math.ceil(math.sqrt(cells)))
                if cells > most:
                    two_levels.append(dim)
                drawn = nodes.where(F.size("v") == dim).orderBy(F.xxhash64("v"), "rep").limit(max(sample, PER_CENTRE * first)).select("v").toPandas()["v"]
                centres[dim] = spherical_kmeans(unit_rows(np.stack(drawn.to_numpy())), min(first, len(drawn)))
        placed = nodes.select("node", "n", "v").mapInArrow(_assign(centres, visits), f"dim int, cell bigint, node bigint, n bigint, cells array<bigint>, v {kind}")
        placed, _ = store(placed, "cells")
        if two_levels:
            again = placed.where(F.col("dim").isin(two_levels))
            placed, _ = store(placed.where(~F.col("dim").isin(two_levels)).unionByName(_second_level(nodes, again, per_cell, visits, most)), "second-cells")
        blocks, _ = store(placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "blocks")
        placed = placed.join(blocks, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        units = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        units = units.select("dim", "cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "n", "cells", "block", "v")
        found, _ = store(units.groupBy("dim", "cell", "lo", "hi").applyInArrow(_compare(threshold), "node bigint, links bigint, joined bigint"), "links")

        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        groups, _ = store(components(found.select(F.col("node").alias("a"), F.col("joined").alias("b"))), "vector-components")
        # Each step is a table, so that a join's two sides have shuffles of its own and Spark can split a hot key's partition.
        named, _ = store(nodes.select("node", "rep").join(groups, "node"), "grouped-vectors")
        least, _ = store(named.groupBy("component").agg(F.min("rep").alias("least")), "least-ids")
        named = named.join(least, "component").select("node", "least")
        facts = nodes.join(links, "node", "left").join(named, "node", "left").select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
        facts, path = store(facts, "vector-facts")
        keep.append(path)
    linked = rows.where("v IS NOT NULL").join(facts, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v,
         embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine
  FROM embeddings),
links AS (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.r <> b.r AND a.fine AND b.fine AND len(a.v) = len(b.v) WHERE CASE WHEN a.fine AND b.fine THEN list_cosine_similarity(a.v, b.v) END >= 0.95),
reach(a, b) AS (SELECT r, r FROM e UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS r, min(vec_id) AS component_id FROM reach JOIN e ON e.r = reach.b GROUP BY a),
counted AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM e JOIN least USING (r) LEFT JOIN counted USING (r)
"""
