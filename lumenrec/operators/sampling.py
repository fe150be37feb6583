"""Samples without replacement for many users at once.

Items are numbered, and each user draws numbers by Floyd's method, with draws keyed by user and step: no user's items are
sorted, none is drawn in vain, and no user meets more items than are drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(ids: DataFrame) -> DataFrame:
    """id, place: ids in the order of their MD5, numbered from 0. Counts of 65,536 ranges of it come first, so no task sees all."""
    rows = ids.select("id", F.md5(F.col("id").cast("string")).alias("_h")).withColumn("_range", F.substring("_h", 1, 4))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_h", "id")) - 1
    return rows.withColumn("_within", within).join(sizes, "_range").select("id", (F.col("_before") + F.col("_within")).alias("place"))


def drawn_places(user: Column, size: int, n: int) -> Column:
    """n distinct places below size, every set of them as likely as any other; all of them if there are fewer.

    For each j of the last n places, a place up to j is drawn by the MD5 of user and j; if it has been drawn before, j is
    taken in its stead, which cannot have been.
    """
    n = min(n, size)
    if not n:
        return F.array().cast("array<bigint>")

    def step(taken: Column, j: Column) -> Column:
        number = F.conv(F.substring(F.md5(F.concat_ws(" ", user.cast("string"), j.cast("string"))), 1, 15), 16, 10).cast("bigint")
        place = F.pmod(number, j + 1)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, place), j).otherwise(place)))

    return F.aggregate(F.sequence(F.lit(size - n).cast("bigint"), F.lit(size - 1).cast("bigint")), F.array().cast("array<bigint>"), step)


def sample_by_user(users: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """user_id, id: for each user (user_id, distinct) n distinct ids (id, distinct), as drawn_places() draws them. Reruns agree."""
    places = users.select("user_id", F.explode(drawn_places(F.col("user_id"), ids.count(), n)).alias("place"))
    return places.join(numbered(ids), "place").select("user_id", "id")
