"""Recommendation queries: items like an item, items for users, and a start for users without a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.fusion import FIELDS, fuse, hybrid_search
from ..operators.knn import user_neighbours
from ..operators.sampling import sample_by_user
from ..operators.titles import search_titles, titles_containing  # noqa: F401
from ..operators.users import best_per_item, liked_items, listed_items, median_scores, scaled

LINK = "https://example.org/item/"


def link(item: Column, prefix: str = LINK) -> Column:
    return F.concat(F.lit(prefix), item.cast("long").cast("string"))


def items_by_id(catalogue: DataFrame, ids: DataFrame) -> DataFrame:
    """The catalogue's rows whose id is in ids."""
    return catalogue.join(ids.select("id").distinct(), "id", "left_semi")


def recommend_by_id(catalogue: DataFrame, ids: DataFrame, k: int = 10, prefix: str = LINK, search=None) -> DataFrame:
    """query_id, id, distance, link: the k items most like each item of ids, never the item itself. Unknown ids give nothing. search: as hybrid_search() takes it."""
    queries = items_by_id(catalogue, ids).withColumnRenamed("id", "query_id")
    return hybrid_search(queries, catalogue, k, search=search).withColumn("link", link(F.col("id"), prefix))


def candidates_by_liked(catalogue: DataFrame, items: DataFrame, k: int = 10, medians: DataFrame | None = None, each=None) -> DataFrame:
    """user_id, query_id, user_score, id, distance: a hybrid search from every liked item of every user, without what the user lists.

    With median, if medians (user_id, median) are given. each, if given, says what is kept of these rows, of some pairs of a
    user and a liked item at a time.
    """
    liked = liked_items(items, catalogue).withColumnRenamed("id", "query_id").withColumnRenamed("score", "user_score")
    if medians is not None:
        liked = liked.join(medians, "user_id", "left")
    facts = liked.columns[2:]

    def fused(near: DataFrame, pairs: DataFrame) -> DataFrame:
        rows = fuse(near, ["user_id", "query_id"], k).join(pairs, ["user_id", "query_id"]).select("user_id", "query_id", facts[0], "id", "distance", *facts[1:])
        return rows if each is None else each(rows)

    return user_neighbours(liked, listed_items(items), catalogue, list(FIELDS), k, each=fused)


def scaled_candidates(catalogue: DataFrame, items: DataFrame, k: int = 10, each=None) -> DataFrame:
    """candidates_by_liked() with factor and scaled_distance; each as there."""
    return candidates_by_liked(catalogue, items, k, median_scores(items), lambda rows: scaled(rows) if each is None else each(scaled(rows)))


def best_by_user(catalogue: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """user_id, id, distance: every item's best scaled distance of a user. What is found at a time is brought down to it first."""
    return best_per_item(scaled_candidates(catalogue, items, k, best_per_item).withColumnRenamed("distance", "scaled_distance"))


def recommend_by_user(catalogue: DataFrame, items: DataFrame, k: int = 10, prefix: str = LINK) -> DataFrame:
    """user_id, id, distance, link: the k best items of every user with a list. Users who like nothing of the catalogue get none.

    An item that is among a user's k best is so too among what is found at a time, where its best distance is; so no more is kept.
    """
    order = Window.partitionBy("user_id").orderBy(F.desc("distance"), "id")
    first = lambda rows: best_per_item(rows).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
    top = first(scaled_candidates(catalogue, items, k, first).withColumnRenamed("distance", "scaled_distance"))
    return top.withColumn("link", link(F.col("id"), prefix))


def random_items(catalogue: DataFrame, n: int = 10, prefix: str = LINK) -> DataFrame:
    """place, id, distance, link: n items drawn without replacement, all if there are fewer. Drawn by MD5, so reruns agree."""
    drawn = catalogue.select("id", F.md5(F.col("id").cast("string")).alias("_h")).orderBy("_h", "id").limit(n)
    place = F.row_number().over(Window.orderBy("_h", "id"))
    return drawn.select(place.alias("place"), "id", F.lit(0.0).alias("distance"), link(F.col("id"), prefix).alias("link"))


def cold_start(catalogue: DataFrame, items: DataFrame, users: DataFrame, n: int = 10, prefix: str = LINK) -> DataFrame:
    """user_id, id, distance, link: random items, each user's own, for those of users whose list is empty."""
    new = users.select("user_id").distinct().join(items.select("user_id"), "user_id", "left_anti")
    return sample_by_user(new, catalogue.select("id"), n).select("user_id", "id", F.lit(0.0).alias("distance"), link(F.col("id"), prefix).alias("link"))


def recommend_for_users(catalogue: DataFrame, items: DataFrame, users: DataFrame, k: int = 10, prefix: str = LINK) -> DataFrame:
    """recommend_by_user() for those of users who have a list, cold_start() for the rest."""
    known = items.join(users.select("user_id").distinct(), "user_id", "left_semi")
    return recommend_by_user(catalogue, known, k, prefix).unionByName(cold_start(catalogue, items, users, k, prefix))
