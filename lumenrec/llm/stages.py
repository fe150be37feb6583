"""The operators as stages of the corpus pipeline: each takes (spark, docs, sf_dir) and all but the last return docs' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import renamed, store, table, unnamed
from .exact_dedup import exact_dedup
from .packing import pack_documents
from .quality import keep_quality
from .simhash import near_documents
from .substring_dedup import without_repeats


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more; the rest go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def _kept_rows(docs: DataFrame, kept: DataFrame, repeated: bool | None = None) -> DataFrame:
    """The rows of docs whose id and Spark's hash of whose text are in kept, one of each. repeated: whether docs repeats any of them, if it is known."""
    kept = kept.toDF("_id", "_hash")
    own, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    rows = unnamed(docs).withColumn("hash", F.xxhash64(F.coalesce(text, F.lit(""))))
    if repeated is None:
        repeated = not kept.groupBy("_id", "_hash").count().where("count > 1").isEmpty()
    stay = rows.join(kept, own.eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left_semi")
    return renamed(stay.dropDuplicates([f"c{docs.columns.index('doc_id')}", "hash"]) if repeated else stay, docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of rows that repeat both id and text, but for the case of A-Z, one."""
    decided, _ = store(exact_dedup(docs).where("kept").select("doc_id", "text_sha256", "text_hash"), "exact-decisions")
    one = decided.groupBy("doc_id", "text_sha256").agg(F.min("text_hash").alias("text_hash"))
    repeated = not decided.groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty()
    kept, _ = store((one if repeated else decided).select("doc_id", "text_hash"), "kept-rows")
    return _kept_rows(docs, kept, repeated)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 similar shingles of five words join, the one with the smallest doc_id.

    Rows are told apart by id and text, so of two texts with one id each is judged by itself; of rows that repeat both, one
    stays. Rows without an id stay only where no row with one is linked.
    """
    decided, _ = store(near_documents(docs).where("kept").select("doc_id", "text_hash"), "near-decisions")
    return _kept_rows(docs, decided)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that occur twice; those of which nothing is left go."""
    return without_repeats(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their texts and their places in bins."""
    return pack_documents(docs, keep_text=True)
