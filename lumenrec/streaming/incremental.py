"""Recommendations that follow a stream of list entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.recommend import recommend_by_user


def activity(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Entries and mean score of each item and window of a stream (ts, id, score), final once late time has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "id").agg(F.count("*").alias("entries"), F.avg("score").alias("mean_score")).select(F.col("w.start").alias("start"), "id", "entries", "mean_score")


def follow_users(entries: DataFrame, history, catalogue: DataFrame, save, checkpoint: str, k: int = 10) -> StreamingQuery:
    """For each batch of new entries, save(recommendations of the users in it, batch number).

    history() gives the lists with the batch's entries in them; only lists of users in the batch are read from it.
    """

    def batch(new: DataFrame, number: int) -> None:
        users = new.select("user_id").distinct()
        save(recommend_by_user(catalogue, history().join(users, "user_id", "left_semi"), k), number)

    return entries.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
