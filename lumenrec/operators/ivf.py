"""Inverted-file index of a vector field: a coarse quantiser, and the vectors laid out by its cells.

    path/centres               cell, n, radius, centre of each cell that has vectors
    path/vectors/cell=...      id, v, far

A search sends each query to cells and compares it with what they hold, so only the folders of cells that some query
goes to are read. It goes either to the nprobe nearest cells, which with all of them is exact; or, exactly in any case, to
the nearest ones first and then to those whose centre and radius leave room for something better than what was found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .knn import BLOCK, PRODUCTS, Field, compare, nearest_first

#: Cells of an index by metric.
NLIST = {"cosine": 512, "l2": 64}
LEAST_ROWS = 16  # vectors a cell at least, on average: small catalogues get fewer cells
PER_CELL, SAMPLE_VALUES = 64, 1 << 23  # the quantiser is fitted on so many vectors a cell, and on no more numbers than that (64 MB)
CENTRE_VALUES = 1 << 23  # numbers that the centres, which are sent to all tasks, can have
ROUNDS = 8
EMPTY = -1  # the cell of zero vectors, whose cosine is 0 with everything


def _units(v: np.ndarray) -> np.ndarray:
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def _width(column: pa.Array) -> int:
    """Components of the vectors of a column."""
    return len(column.flatten()) // max(1, len(column))


def stretches(b: pa.RecordBatch, numbers: int) -> Iterator[pa.RecordBatch]:
    """b in parts of so many rows that, with numbers numbers made of each row, a part makes no more than PRODUCTS of them."""
    step = max(1, PRODUCTS // max(1, numbers))
    return (b.slice(at, step) for at in range(0, b.num_rows, step))


def away(metric: str, v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """How far each row of v is from each centre: the angle, or the distance."""
    if metric == "cosine":
        return np.arccos(np.clip(_units(v) @ centres.T, -1, 1))
    return np.sqrt(np.maximum((v * v).sum(axis=1)[:, None] - 2 * (v @ centres.T) + (centres * centres).sum(axis=1)[None, :], 0))


def quantiser(metric: str, v: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most cells centres, by Lloyd's rounds from the first distinct rows of v on; for cosines unit vectors, of rows that are not zero."""
    if metric == "cosine":
        v = _units(v[(v != 0).any(axis=1)])
    _, first = np.unique(v, axis=0, return_index=True)
    centres = v[np.sort(first)[:cells]].copy()
    for _ in range(rounds if len(centres) else 0):
        home = away(metric, v, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, v)
        n = np.bincount(home, minlength=len(centres))[:, None]
        new = _units(sums) if metric == "cosine" else sums / np.maximum(n, 1)
        centres = np.where((n > 0) & (new != 0).any(axis=1, keepdims=True) if metric == "cosine" else n > 0, new, centres)
    return centres


def _placed(metric: str, sent):
    """Rows (id, v) with their cell and how far they are from its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            for b in stretches(b, len(centres)):
                v = _matrix(b.column(1))
                if len(centres):
                    off = away(metric, v, centres)
                    cell = off.argmin(axis=1)
                    far = off[np.arange(len(v)), cell]
                else:
                    cell, far = np.full(len(v), EMPTY), np.zeros(len(v))
                if metric == "cosine":
                    zero = ~(v != 0).any(axis=1)
                    cell, far = np.where(zero, EMPTY, cell), np.where(zero, 0.0, far)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(far), pa.array(cell, pa.int32())], ["id", "v", "far", "cell"])

    return run


def build_index(catalogue: DataFrame, field: Field, path: str, nlist: int | None = None) -> VectorIndex:
    """An index of a field of catalogue (id and the field, none of them null), written at path, which has to be new.

    There are nlist cells, NLIST's if it is not given, and fewer where the catalogue has not LEAST_ROWS vectors for each.
    The quantiser is fitted on a sample, the vectors of least hash, bounded as PER_CELL and SAMPLE_VALUES say; all vectors
    are placed. A large cell is written as several files.
    """
    spark = catalogue.sparkSession
    rows = catalogue.select(F.col("id").cast("bigint").alias("id"), F.col(field.name).cast("array<double>").alias("v"))
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    cells = max(1, min(NLIST[field.metric] if nlist is None else nlist, -(-n // LEAST_ROWS)))
    if cells * dims > CENTRE_VALUES:
        raise ValueError(f"{cells} cells of {dims} components are more than {CENTRE_VALUES} numbers")
    drawn = rows.orderBy(F.xxhash64("v"), "id").limit(min(PER_CELL * cells, max(1, SAMPLE_VALUES // max(1, dims)))).select("v").toArrow()
    centres = quantiser(field.metric, _matrix(drawn.column("v")), cells) if n else np.zeros((0, dims))
    sent = spark.sparkContext.broadcast(centres)
    placed = rows.mapInArrow(_placed(field.metric, sent), "id bigint, v array<double>, far double, cell int")
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    facts = _vectors(spark, path).groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    facts = [(r.cell, r.n, r.radius, centres[r.cell].tolist() if r.cell != EMPTY else [0.0] * dims) for r in facts.collect()]  # a row a cell
    spark.createDataFrame(facts, "cell int, n bigint, radius double, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    return VectorIndex(spark, path, field)


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id bigint, v array<double>, far double, cell int").parquet(f"{path}/vectors")


def _visited(metric: str, sent, nprobe: int, rest: bool):
    """Rows (query_id, depth, v) once for each cell that a query goes to: the nprobe nearest, or with rest (and a fourth column,
    the value that a better neighbour has to reach) those beyond them that can hold one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centres, radius = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            for b in stretches(b, len(cells) * max(1, _width(b.column(2)))):  # a row leaves once for each cell, with its vector
                v = _matrix(b.column(2))
                off = away(metric, v, centres)
                order = np.argsort(off, axis=1, kind="stable")[:, :nprobe]
                go = np.zeros(off.shape, bool)
                np.put_along_axis(go, order, True, axis=1)
                if rest:
                    go = ~go & reachable(metric, off, radius, cells == EMPTY, ~(v != 0).any(axis=1), np.asarray(b.column(3), np.float64))
                query, cell = np.nonzero(go)
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(query)) for k in range(3)), pa.array(cells[cell], pa.int32())], [*b.schema.names[:3], "cell"])

    return run


def reachable(metric: str, off: np.ndarray, radius: np.ndarray, zero_cell: np.ndarray, zero_query: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Whether a cell can hold a vector that reaches bound (rounded to 6 digits; NaN is reached by all). The slack covers rounding."""
    nearest = np.maximum(off - radius - 1e-6, 0)
    bound = bound[:, None]
    if metric == "cosine":
        best = np.where(zero_cell[None, :] | zero_query[:, None], 0.0, np.cos(np.minimum(nearest, math.pi)))
        return np.isnan(bound) | (best >= bound - 2e-6)
    return np.isnan(bound) | (nearest * nearest <= bound + 2e-6 + 1e-9 * bound)


class VectorIndex:
    """An index that build_index() has written. The centres, which are bounded, are kept at hand."""

    def __init__(self, spark: SparkSession, path: str, field: Field):
        self.spark, self.path, self.field = spark, path, field
        rows = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r.cell)
        self.sizes = {r.cell: r.n for r in rows}
        self._sent = spark.sparkContext.broadcast((np.array([r.cell for r in rows], np.int32), np.array([r.centre for r in rows]).reshape(len(rows), len(rows[0].centre) if rows else 0), np.array([r.radius for r in rows])))

    def visits(self, queries: DataFrame, nprobe: int, rest: bool = False) -> DataFrame:
        """query_id, depth, q_<field>, cell for each cell that a query (query_id, depth, the field; with rest, bound) goes to."""
        name = self.field.name
        rows = queries.select("query_id", F.col("depth").cast("int").alias("depth"), F.col(name).cast("array<double>").alias(f"q_{name}"), *(["bound"] if rest else []))
        return rows.mapInArrow(_visited(self.field.metric, self._sent, nprobe, rest), f"query_id bigint, depth int, q_{name} array<double>, cell int")

    def vectors(self, cells) -> DataFrame:
        """id, the field, cell of the vectors of some cells; the folders of others are not read."""
        return _vectors(self.spark, self.path).where(F.col("cell").isin(sorted(cells))).select("id", F.col("v").alias(self.field.name), "cell")

    def _near(self, visits: DataFrame, block: int) -> DataFrame:
        """query_id, field, id, raw: of each visit the nearest vectors of its cell, as many as the query's depth."""
        asked = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}  # a row a cell
        plan = [(c, -(-n // block), -(-self.sizes[c] // block)) for c, n in asked.items()]
        cut = lambda: F.broadcast(self.spark.createDataFrame(plan, "cell int, _queries int, _items int"))
        of = lambda key, blocks: F.pmod(F.xxhash64(key), F.col(blocks)).cast("int")
        every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
        left = visits.join(cut(), "cell").withColumn("qb", of("query_id", "_queries")).withColumn("ib", every("_items"))
        right = self.vectors(asked).join(cut(), "cell").withColumn("ib", of("id", "_items")).withColumn("qb", every("_queries"))
        return left.groupBy("cell", "qb", "ib").cogroup(right.groupBy("cell", "qb", "ib")).applyInArrow(compare([self.field]), "query_id bigint, field string, id bigint, raw double")

    def neighbours(self, queries: DataFrame, k: int | None = None, nprobe: int | None = None, first: int = 2, block: int = BLOCK) -> DataFrame:
        """query_id, field, id, raw, rank of the nearest items other than the query itself, best first, ties by id.

        queries holds query_id, the field, and depth, how many are wanted, unless k is given for all. With nprobe, of the
        nprobe nearest cells. Without, of all: the first cells are searched, and then those within reach of what they gave.
        """
        if k is not None:
            queries = queries.withColumn("depth", F.lit(k))
        best = Window.partitionBy("query_id", "field").orderBy(nearest_first([self.field]), "id")
        ranked = lambda near: near.withColumn("rank", F.row_number().over(best)).join(queries.select("query_id", F.col("depth").alias("_depth")), "query_id").where("rank <= _depth").drop("_depth")
        if not self.sizes:
            return self.spark.createDataFrame([], "query_id bigint, field string, id bigint, raw double, rank int")
        if nprobe is not None:
            return ranked(self._near(self.visits(queries, nprobe), block))
        near = self._near(self.visits(queries, first), block)
        return ranked(near.unionByName(self._near(self.rest(queries, ranked(near), first), block)))

    def rest(self, queries: DataFrame, found: DataFrame, first: int) -> DataFrame:
        """The visits that queries (query_id, depth, the field) still need when found is the best of their first cells."""
        last = found.join(queries.select("query_id", F.col("depth").alias("_depth")), "query_id").where("rank = _depth").select("query_id", F.col("raw").alias("bound"))
        return self.visits(queries.join(last, "query_id", "left"), first, rest=True)


class IndexedFields:
    """Indexes of several fields, searched as neighbours() searches a catalogue."""

    def __init__(self, indexes: list[VectorIndex], nprobe: dict[str, int] | None = None):
        self.indexes, self.nprobe = {x.field.name: x for x in indexes}, nprobe or {}

    def __call__(self, queries: DataFrame, fields: list[Field], k: int | None = None) -> DataFrame:
        """nprobe gives the cells of a field's search by its name; fields without are searched exactly."""
        out = [self.indexes[f.name].neighbours(queries, k, self.nprobe.get(f.name)) for f in fields]
        for more in out[1:]:
            out[0] = out[0].unionByName(more)
        return out[0]


def build_indexes(catalogue: DataFrame, fields, path: str, nlist: dict[str, int] | None = None, nprobe: dict[str, int] | None = None) -> IndexedFields:
    """An index of each field, in a folder of its name below path."""
    return IndexedFields([build_index(catalogue, f, f"{path}/{f.name}", (nlist or {}).get(f.name)) for f in fields], nprobe)


def open_indexes(spark: SparkSession, fields, path: str, nprobe: dict[str, int] | None = None) -> IndexedFields:
    return IndexedFields([VectorIndex(spark, f"{path}/{f.name}", f) for f in fields], nprobe)


def recall(index: VectorIndex, queries: DataFrame, k: int, nprobes: list[int], exact: DataFrame) -> DataFrame:
    """nprobe, wanted, found: of the rows (query_id, id) of exact, how many a search of so many cells gives."""
    wanted = exact.select("query_id", "id")
    out = []
    for n in nprobes:
        hits = wanted.join(index.neighbours(queries, k, n).select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left")
        out.append(hits.agg(F.count("*").alias("wanted"), F.count("_hit").alias("found")).select(F.lit(n).alias("nprobe"), "wanted", "found"))
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]
