"""Collections as managed tables."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def open_or_create(spark: SparkSession, name: str, df: DataFrame | None) -> DataFrame:
    """The table of that name as it stands; where there is none, made of df."""
    if not spark.catalog.tableExists(name):
        if df is None:
            raise FileNotFoundError(f"no collection {name}")
        df.write.mode("errorifexists").saveAsTable(name)
    return spark.table(name)


def replace(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """The table of that name, made anew of df, which may not read it."""
    df.write.mode("overwrite").saveAsTable(name)
    return spark.table(name)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path that all executors share: under spark.checkpoint.dir, or where that is unset under the warehouse.

    A warehouse on a machine's own disk will do for a local master only.
    """
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_steps"
        if base.startswith(("file:", "/")) and not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"{base.rstrip('/')}/records-{spark.sparkContext.applicationId}"
    _roots[root] = spark
    return f"{root}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, path: str | None = None, by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """df written as a table in the shared folder (to path, if given, with what is there) and read again, and its path.

    The shuffle files of the write go when it is done, as nothing will read them again.
    """
    spark, path = df.sparkSession, path or scratch(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("append").option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: numbers drawn in it stay, and nothing before it is computed twice."""
    return store(df, name)[0]


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove tables that store() wrote and that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_roots: dict[str, SparkSession] = {}


@atexit.register
def _clean() -> None:
    for root, spark in _roots.items():
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(root)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone, and its folder is left to whoever set it up
            pass
