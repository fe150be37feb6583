"""Corpus pipeline: documents pass five stages, each written as Parquet and read again by the next.

quality classifier -> exact dedup -> SimHash near-dedup -> substring dedup -> best-fit packing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenrec.llm import stages
from lumenrec.llm.common import drop, dropped_after, store, table

STAGES = [
    ("quality_classifier", stages.quality_classifier),
    ("exact_dedup", stages.exact_duplicates),
    ("simhash_near_dedup", stages.near_duplicates),
    ("substring_dedup", stages.repeated_passages),
    ("best_fit_packing", stages.packed_sequences),
]

#: SQL expresses neither the classifier nor the packing; the tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, from all of documents."""
    docs = table(spark, sf_dir, "documents")
    last: list[str] = []
    for name, stage in STAGES:
        with dropped_after(spark, keep := []):
            docs, path = store(stage(spark, docs, sf_dir), name)
            keep.append(path)
        drop(spark, *last)
        last = keep
    return docs
