"""Nearest neighbours through a dictionary of distinct vectors, for fields of few of them, such as multi-hot ones.

Queries and items are searched as the distinct vectors they have. Only those of a query's nearest vectors that its list
can draw on are turned into items, and of each no more than the list can hold; so the work of comparing is that of the
distinct vectors, however many items share one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .knn import BLOCK, Field, raw_values, vectors_of


def dictionary(rows: DataFrame, name: str, *facts) -> DataFrame:
    """_pattern, <name>, facts: the distinct vectors of a field, numbered; a table."""
    return stored(rows.groupBy(name).agg(*facts).withColumn("_pattern", F.monotonically_increasing_id()), "patterns")


def _nearest_patterns(field: Field):
    """Of a block of patterns those that the depth + 1 nearest items of each asked pattern can have, ties and all."""

    def run(key: tuple, asked: pa.Table, items: pa.Table) -> pa.Table:
        out = [[], [], []]
        if asked.num_rows and items.num_rows:
            qid, depth, pid, n = (np.asarray(t.column(c).combine_chunks()) for t, c in ((asked, "_asked"), (asked, "_depth"), (items, "_pattern"), (items, "_n")))
            raw = raw_values(field, vectors_of(asked, "_vector"), vectors_of(items, field.name))
            cost = -raw if field.metric == "cosine" else raw
            order = np.argsort(cost, axis=1, kind="stable")
            for q in range(len(qid)):
                own = order[q]
                so_far = np.cumsum(n[own])
                last = cost[q, own[min(np.searchsorted(so_far, depth[q] + 1), len(own) - 1)]]
                keep = own[: np.searchsorted(cost[q, own], last, "right")]
                out[0].append(np.full(len(keep), qid[q]))
                out[1].append(pid[keep])
                out[2].append(raw[q, keep])
        flat = [np.concatenate(x) if x else [] for x in out]
        return pa.table({"_asked": pa.array(flat[0], pa.int64()), "_pattern": pa.array(flat[1], pa.int64()), "raw": pa.array(flat[2], pa.float64())})

    return run


def nearest_patterns(asked: DataFrame, patterns: DataFrame, field: Field, block: int = BLOCK) -> DataFrame:
    """_asked, _pattern, raw: of all patterns (_pattern, the field, _n items) the nearest to each asked one (_asked, _vector, _depth) that hold depth + 1 items, ties and all."""
    sides = [max(1, -(-x.count() // block)) for x in (asked, patterns)]
    placed = []
    for df, key, (own, other), (mine, theirs) in ((asked, "_asked", sides, ("bq", "bc")), (patterns, "_pattern", sides[::-1], ("bc", "bq"))):
        df = df.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(own)).cast("int"))
        placed.append(df.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(other - 1)))))
    near = placed[0].groupBy("bq", "bc").cogroup(placed[1].groupBy("bq", "bc"))
    near = near.applyInArrow(_nearest_patterns(field), "_asked bigint, _pattern bigint, raw double")
    cost = -F.col("raw") if field.metric == "cosine" else F.col("raw")
    sizes = near.join(patterns.select("_pattern", "_n"), "_pattern").join(asked.select("_asked", "_depth"), "_asked")
    nearer = F.coalesce(F.sum("_n").over(Window.partitionBy("_asked").orderBy("_cost").rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) - F.sum("_n").over(Window.partitionBy("_asked", "_cost"))
    return sizes.withColumn("_cost", cost).withColumn("_nearer", nearer).where("_nearer <= _depth").select("_asked", "_pattern", "raw")


def pattern_neighbours(queries: DataFrame, catalogue: DataFrame, field: Field, k: int | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, field, id, raw, rank of the nearest items other than the query itself, best first, ties by id, as neighbours() gives them.

    queries holds query_id, the field, and depth, how many are wanted, unless k is given for all.
    """
    name = field.name
    if k is not None:
        queries = queries.withColumn("depth", F.lit(k))
    queries, items = queries.select("query_id", "depth", F.col(name).alias("_vector")), catalogue.select("id", name)
    asked = dictionary(queries, "_vector", F.max("depth").cast("int").alias("_depth")).withColumnRenamed("_pattern", "_asked")
    patterns = dictionary(items, name, F.count("*").alias("_n"))
    near = stored(nearest_patterns(asked, patterns, field, block), "near-patterns")
    deepest = asked.agg(F.max("_depth")).first()[0] or 0  # one number
    members = items.join(patterns.select(name, "_pattern"), name).select("id", "_pattern")
    members = members.withColumn("_m", F.row_number().over(Window.partitionBy("_pattern").orderBy("id"))).where(F.col("_m") <= deepest + 1)
    cost = -F.col("raw") if field.metric == "cosine" else F.col("raw")
    lists = near.join(members, "_pattern").join(asked.select("_asked", "_depth"), "_asked")
    lists = lists.withColumn("_place", F.row_number().over(Window.partitionBy("_asked").orderBy(cost, "id"))).where(F.col("_place") <= F.col("_depth") + 1)
    each = queries.join(asked.select("_vector", "_asked"), "_vector").select("query_id", "depth", "_asked").join(lists.select("_asked", "id", "raw"), "_asked").where("id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(cost, "id"))).where("rank <= depth")
    return ranked.select("query_id", F.lit(name).alias("field"), "id", "raw", "rank")
