"""Weighted fusion of neighbour lists, and the hybrid search that it ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import distance_score, similarity_score
from .knn import Field, neighbours
from .patterns import pattern_neighbours

#: The fields of an item, their metrics and their weights.
FIELDS = (Field("synopsis_vec", "cosine", 0.2), Field("title_vec", "cosine", 0.1), Field("genres", "l2", 0.6), Field("studios", "l2", 0.1))


def score(fields, rule: str = "half") -> Column:
    """Weighted score of a row (field, raw) of a neighbour list."""
    out = F.lit(None).cast("double")
    for f in fields:
        own = similarity_score(F.col("raw"), rule) if f.metric == "cosine" else distance_score(F.col("raw"))
        out = F.when(F.col("field") == f.name, F.lit(f.weight) * own).otherwise(out)
    return out


def first_of_each(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows (by rank) of each field's list."""
    best = Window.partitionBy(*keys, "field").orderBy("rank")
    return lists.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= k).drop("_place")


def fuse(lists: DataFrame, keys: list[str], k: int, fields=FIELDS, rule: str = "half") -> DataFrame:
    """keys, id, distance: the sum of an item's weighted scores over the lists that it is in, the k largest, ties by id."""
    total = lists.repartition(*keys).withColumn("_score", score(fields, rule)).groupBy(*keys, "id").agg(F.round(F.sum("_score"), 9).alias("distance"))
    best = Window.partitionBy(*keys).orderBy(F.desc("distance"), "id")
    return total.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= k).drop("_place")


def dictionary_search(catalogue: DataFrame):
    """A search for hybrid_search() that goes through the distinct vectors of the fields compared by distance, which are multi-hot."""

    def search(queries: DataFrame, fields: list[Field], k: int | None = None, exclude: DataFrame | None = None) -> DataFrame:
        dense, hot = ([f for f in fields if (f.metric == "l2") == own] for own in (False, True))
        out = [neighbours(queries, catalogue, dense, k, exclude=exclude)] if dense else []
        if exclude is None:
            out += [pattern_neighbours(queries, catalogue, f, k) for f in hot]
        else:
            deep = deeper(queries, exclude, k)
            out += [first_of_each(pattern_neighbours(deep, catalogue, f).join(exclude, ["query_id", "id"], "left_anti"), ["query_id"], k) for f in hot]
        for more in out[1:]:
            out[0] = out[0].unionByName(more)
        return out[0]

    search.excludes = True
    return search


def deeper(queries: DataFrame, exclude: DataFrame, k: int) -> DataFrame:
    """queries with depth: k, and as many more as a query excludes."""
    extra = exclude.groupBy("query_id").agg(F.count("*").alias("_n"))
    return queries.join(extra, "query_id", "left").withColumn("depth", F.lit(k) + F.coalesce("_n", F.lit(0))).drop("_n")


def hybrid_search(queries: DataFrame, catalogue: DataFrame, k: int = 10, exclude: DataFrame | None = None, fields=FIELDS, rule: str = "half", search=None, by: str = "query_id") -> DataFrame:
    """query_id, id, distance: the k best items of every query by fused score.

    Each field gives its own k nearest, taken from what is not excluded, before they are fused. exclude holds (by, id),
    where by is a column of queries: what one of them excludes, or all that are alike in it. The tasks of a search of the
    catalogue know what is excluded, so k rows leave them whatever a query excludes.
    search(queries, fields, k) gives the lists where they are not to come from the catalogue itself, such as indexes of
    it. Unless it excludes too, its lists are searched deeper by as many items as a query excludes, so what is left after
    the anti-join is whole.
    """
    fields = list(fields)
    if search is None:
        return fuse(neighbours(queries, catalogue, fields, k, exclude=exclude, by=by), ["query_id"], k, fields, rule)
    if exclude is None:
        return fuse(search(queries, fields, k), ["query_id"], k, fields, rule)
    if by != "query_id":
        exclude = queries.select("query_id", by).join(exclude, by)
    exclude = exclude.select("query_id", "id").distinct()
    if getattr(search, "excludes", False):
        return fuse(search(queries, fields, k, exclude), ["query_id"], k, fields, rule)
    left = search(deeper(queries, exclude, k), fields).join(exclude, ["query_id", "id"], "left_anti")
    return fuse(first_of_each(left, ["query_id"], k), ["query_id"], k, fields, rule)
