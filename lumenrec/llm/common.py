"""What the operators share: table access, tables cut out of the lineage, text rules and connected components."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_step = count()
_roots: dict[str, SparkSession] = {}
_stored: list[str] = []  # tables that are not yet dropped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that all executors share: under spark.checkpoint.dir, or where that is unset under the warehouse.

    A warehouse on a machine's own disk will do for a local master only; a cluster without a shared folder is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base, master = spark.conf.get("spark.sql.warehouse.dir") + "/_steps", spark.sparkContext.master
        if base.startswith(("file:", "/")) and not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"{base.rstrip('/')}/lumenrec-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots[root] = spark
    return root


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove tables that store() wrote and that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in _stored:
            _stored.remove(path)


@contextmanager
def dropped_after(spark: SparkSession, keep: list[str] | None = None) -> Iterator[None]:
    """Drops at its end the tables that were stored within, but for those in keep."""
    before = set(_stored)
    yield
    drop(spark, *[p for p in _stored if p not in before and p not in (keep or ())])


@atexit.register
def _clean() -> None:
    for root, spark in _roots.items():
        try:
            drop(spark, root)
        except Exception:  # the session is gone, and its folder is left to whoever set it up
            pass


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: its lineage ends here, and lost executors cost no recomputation.

    The shuffle files of the write go when it is done, as nothing will read them again.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{next(_step)}-{uuid.uuid4().hex[:8]}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    _stored.append(path)
    return spark.read.schema(schema).parquet(path), path


def unnamed(docs: DataFrame) -> DataFrame:
    """docs with columns c0, c1, ..., so that columns which are added clash with none of docs'."""
    return docs.select([F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])


def renamed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns c0, c1, ... of rows under the names that they have in docs."""
    return rows.select([F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only. For short values; translate() looks every character up."""
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the decimal text of doc_id, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: for every node of edges the smallest node that it reaches. The rows are read from a table of store()'s.

    Alternates large-star and small-star steps, which need a logarithmic number of rounds whatever the graph's
    diameter. Each step is an aggregation and an equi-join on the node. A hub is summed map-side; minima and edges are
    tables of their own, so the join shuffles both and Spark can split a hub's partition. Null ends and loops link nothing.
    """
    spark = edges.sparkSession
    x, y = F.col(a), F.col(b)
    now, path = store(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        mid, mid_path = store(large, "large-star")
        low, low_path = store(mid.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = mid.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new, new_path = store(small, "small-star")
        after = state(new)
        drop(spark, least_path, mid_path, low_path, path)
        now, path = new, new_path
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
