"""What users' lists say: liked items, items to leave out, default factors, scaled recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The states an item can have in a list, and the factor of users who score nothing.
STATES = ("dropped", "on_hold", "watching", "completed", "plan_to_watch")
DEFAULT_FACTOR = 7.0


def first_entries(items: DataFrame, order: str = "seq") -> DataFrame:
    """The first row of each (user_id, id) by order."""
    first = Window.partitionBy("user_id", "id").orderBy(order)
    return items.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def in_catalogue(items: DataFrame, catalogue: DataFrame) -> DataFrame:
    return items.join(catalogue.select("id"), "id", "left_semi")


def liked_items(items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """user_id, id, score of completed items in the catalogue. The first entry of an item decides, whatever later ones say."""
    return first_entries(in_catalogue(items, catalogue)).where(F.col("status") == "completed").select("user_id", "id", "score")


def listed_items(items: DataFrame) -> DataFrame:
    """user_id, id of everything that a user has in any state."""
    return items.where(F.col("status").isin(*STATES)).select("user_id", "id").distinct()


def median_scores(items: DataFrame) -> DataFrame:
    """user_id, median: the exact median of a user's scores other than 0; users without any are left out."""
    return items.where(F.col("score") != 0).groupBy("user_id").agg(F.median("score").alias("median"))


def scaled(recommended: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    """recommended (user_id, user_score, distance, ...) with factor and scaled_distance: the score of the liked item, or the user's median, which recommended has unless medians are given."""
    joined = recommended if medians is None else recommended.join(medians, "user_id", "left")
    factor = F.when(F.col("user_score") != 0, F.col("user_score").cast("double")).otherwise(F.coalesce("median", F.lit(DEFAULT_FACTOR)))
    return joined.withColumn("factor", factor).withColumn("scaled_distance", F.round(F.col("distance") * F.col("factor"), 10)).drop("median")


def best_per_item(recommended: DataFrame) -> DataFrame:
    """user_id, id, distance: an item's best scaled distance over all liked items that led to it."""
    return recommended.groupBy("user_id", "id").agg(F.max("scaled_distance").alias("distance"))
