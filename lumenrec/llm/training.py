"""Bounded samples of labelled rows, and the folds that keep held-out labels out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold


def labelled(labels: DataFrame, column: str, parts: int, held_out: int, limit: int, only: int | None = None) -> DataFrame:
    """_id, _label of at most limit labelled rows outside the held-out fold: those of least hash of the id.

    Rows without an id or a label teach nothing; of several labels of an id the largest counts. The result is small
    enough to broadcast, limit rows of two numbers.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold(F.col("doc_id"), parts) != held_out))
    rows = rows.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col(column)).cast("int").alias("_label"))
    if only is not None:
        rows = rows.where(F.col("_label") == only)
    return rows.orderBy(F.xxhash64("_id"), "_id").limit(limit)
