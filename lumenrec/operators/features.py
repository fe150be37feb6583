"""Items to vectors: cleaned texts, multi-hot genres, hashed studios, and dense vectors from an encoder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import GENRES, distinct_names, multi_hot, names
from ..functions.hashing import signed_hash
from ..functions.text import clean_text

#: Turns a text column into a column of dense vectors, such as an iterator pandas UDF around a model.
Encoder = Callable[[Column], Column]
NEEDED = ["id", "synopsis", "title", "genres", "studios"]


def complete_items(items: DataFrame) -> DataFrame:
    """The needed columns of items that lack none of them; an empty list is not lacking. One row an id."""
    return items.select(NEEDED).na.drop("any", subset=NEEDED).dropDuplicates(["id"])


def cleaned_items(items: DataFrame, fold: bool = True) -> DataFrame:
    """id, synopsis, related (the cleaned title), genres, studios."""
    return items.select("id", clean_text(F.col("synopsis"), fold).alias("synopsis"), clean_text(F.col("title"), fold).alias("related"), "genres", "studios")


def build_features(items: DataFrame, encoder: Encoder | None = None, vocabulary=GENRES, studio_dims: int = 75, fold: bool = True) -> DataFrame:
    """id, genres, studios and, with an encoder, synopsis_embedding and related_embedding of all complete items, in one pass.

    Vectors are columns of their item throughout, so no join by id can multiply rows.
    """
    out = cleaned_items(complete_items(items), fold)
    out = out.withColumn("genres", multi_hot(distinct_names(F.col("genres")), vocabulary)).withColumn("studios", signed_hash(names(F.col("studios")), studio_dims))
    if encoder is None:
        return out
    out = out.withColumn("synopsis_embedding", encoder(F.col("synopsis"))).withColumn("related_embedding", encoder(F.col("related")))
    return out.select("id", "genres", "studios", "synopsis_embedding", "related_embedding")


def with_embeddings(items: DataFrame, *embeddings: DataFrame) -> DataFrame:
    """items left-joined by id with tables (id, vector) that come from elsewhere, each first reduced to one row an id."""
    for e in embeddings:
        items = items.join(e.dropDuplicates(["id"]), "id", "left")
    return items
