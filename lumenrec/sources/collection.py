"""A collection of vectors, an id and a vector a field, that rows are merged into.

Rows lie in buckets by the hash of their id. A merge writes anew the buckets that its rows belong to, in a folder of its
own, and then publishes a version: a small file that says for each bucket which folder holds it. Versions appear by a
rename that fails if there is one of that number already, so a reader sees the old collection or the new one, and of two
merges at once one fails and can be tried again.

    path/versions/00000003.json   {"dims": ..., "buckets": ..., "folders": {bucket: folder}}
    path/data-<version>-<token>/bucket=...
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import validate, vector_table

BUCKETS = 64


class VersionConflict(Exception):
    """Another merge has published the version that this one was to be."""


class Collection:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- files, by Spark's file system, so any path that Spark reads will do --

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, fs = self._at("versions")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdecimal())

    def manifest(self, version: int | None = None) -> dict:
        """What a version says, the latest unless it is given; FileNotFoundError if there is none."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise FileNotFoundError(f"no collection at {self.path}" if not known else f"no version {version} of {self.path}")
        text = self.spark.read.text(f"{self.path}/versions/{known[-1] if version is None else version:08d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, version: int, manifest: dict) -> None:
        draft, fs = self._at(f"versions/_draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        final, _ = self._at(f"versions/{version:08d}.json")
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, options)  # fails if final is there
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise VersionConflict(f"version {version} of {self.path} has been published by another") from e
            raise

    # -- rows --

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")

    def _folders(self, manifest: dict, buckets) -> DataFrame | None:
        """Rows of some buckets of a version."""
        paths = [f"{self.path}/{manifest['folders'][str(b)]}/bucket={b}" for b in buckets if str(b) in manifest["folders"]]
        return self.spark.read.schema(vector_table(**manifest["dims"])[0]).parquet(*paths) if paths else None

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version. What is merged later does not show in it."""
        manifest = self.manifest(version)
        rows = self._folders(manifest, range(manifest["buckets"]))
        return self.spark.createDataFrame([], vector_table(**manifest["dims"])[0]) if rows is None else rows

    def lookup(self, ids: list[int]) -> DataFrame:
        """The rows of a few ids, from the files of their buckets alone."""
        manifest = self.manifest()
        few = self.spark.createDataFrame([(i,) for i in ids], "id long")
        rows = self._folders(manifest, sorted(r[0] for r in few.select(self._bucket(manifest["buckets"])).distinct().collect()))
        return self.read().where("false") if rows is None else rows.where(F.col("id").isin(list(ids)))

    def merge(self, rows: DataFrame | None, remove: DataFrame | None = None) -> int:
        """Puts rows (id, the vectors) in place of those of their ids, takes the ids of remove out, and gives the new version's number.

        Only buckets that one of them belongs to are written; the files of others stay and are part of the new version. A
        vector of a wrong size, a null id, or an id that rows has twice ends the merge before anything is published.
        """
        known = self.versions()
        manifest = self.manifest(known[-1])
        schema, dims = vector_table(**manifest["dims"])
        version, n = known[-1] + 1, manifest["buckets"]
        token = f"{version:08d}-{uuid.uuid4().hex[:8]}"
        new = self.spark.createDataFrame([], schema) if rows is None else rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        gone = self.spark.createDataFrame([], "id long") if remove is None else remove.select(F.col("id").cast("long")).distinct().join(new.select("id"), "id", "left_anti")
        staged = new.unionByName(gone.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        staged = validate(staged.withColumn("id", F.coalesce("id", F.raise_error(F.lit("a row without an id")).cast("long"))), dims)
        staged = staged.withColumn("_rows", F.lit(1)).groupBy("id").agg(F.sum("_rows").alias("_rows"), F.first("_gone").alias("_gone"), *[F.first(c).alias(c) for c in dims])
        staged = staged.withColumn("id", F.when(F.col("_rows") == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("more than one row of id "), F.col("id").cast("string"))).cast("long")))
        staging = f"staged-{token}"
        staged.withColumn("bucket", self._bucket(n)).drop("_rows").write.partitionBy("bucket").parquet(f"{self.path}/{staging}")
        staged = self.spark.read.schema(f"id long, _gone boolean, {', '.join(f'{c} array<float>' for c in dims)}, bucket int").parquet(f"{self.path}/{staging}")
        touched = sorted(r[0] for r in staged.select("bucket").distinct().collect())  # no more than there are buckets
        folder = f"data-{token}"
        out = staged.where("_gone IS NULL").select("id", *dims)
        old = self._folders(manifest, touched)
        if old is not None:
            out = out.unionByName(old.join(staged.select("id"), "id", "left_anti"))
        out.withColumn("bucket", self._bucket(n)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        at, fs = self._at(folder)
        written = {s.getPath().getName().removeprefix("bucket=") for s in fs.listStatus(at) if s.isDirectory()}
        folders = {b: f for b, f in manifest["folders"].items() if int(b) not in touched} | {b: folder for b in written}
        self._publish(version, manifest | {"folders": folders})
        fs.delete(self._at(staging)[0], True)
        return version

    def vacuum(self, keep: int = 1) -> None:
        """Removes all versions but the keep latest, and the folders that none of those names. Not while merges or older readers are at work."""
        known = self.versions()
        named = {f for v in known[-keep:] for f in self.manifest(v)["folders"].values()}
        at, fs = self._at("")
        for v in known[:-keep]:
            fs.delete(self._at(f"versions/{v:08d}.json")[0], False)
        for s in fs.listStatus(at):
            name = s.getPath().getName()
            if name.startswith(("data-", "staged-")) and name not in named:
                fs.delete(s.getPath(), True)


def create_collection(spark: SparkSession, path: str, dims: dict[str, int], rows: DataFrame | None = None, buckets: int = BUCKETS) -> Collection:
    """A new collection of vectors of so many components a field, with rows in it if they are given; VersionConflict if there is one."""
    out = Collection(spark, path)
    out._publish(0, {"dims": dims, "buckets": buckets, "folders": {}})
    if rows is not None:
        out.merge(rows)
    return out
