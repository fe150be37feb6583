"""JSON records: arrays and lines, nested objects, pages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .. import schemas
from ..functions.text import strip_newlines
from .paged import PagedSource


def read_records(spark: SparkSession, path: str, schema: StructType | None = None, lines: bool = False) -> DataFrame:
    """Records of a JSON array (or of lines) at path; FileNotFoundError if there is nothing."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.option("multiLine", not lines).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no records at {path}") from e
        raise


def write_records(df: DataFrame, path: str) -> None:
    """df as JSON lines, written by all tasks."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def flatten(df: DataFrame) -> DataFrame:
    """df with the fields of nested objects as columns of dotted names, at every depth."""
    columns = []

    def add(field, name: str, at) -> None:
        if isinstance(field.dataType, StructType):
            for inner in field.dataType.fields:
                add(inner, f"{name}.{inner.name}", at[inner.name])
        else:
            columns.append(at.alias(name))

    for f in df.schema.fields:
        add(f, f.name, F.col(f"`{f.name}`"))
    return df.select(columns)


def merged_structs(df: DataFrame, left: str, right: str) -> DataFrame:
    """The fields of two objects side by side; of a name that both have, the right one's."""
    own, other = df.schema[left].dataType.names, df.schema[right].dataType.names
    return df.select(*[F.col(f"{left}.{n}") for n in own if n not in other], *[F.col(f"{right}.{n}") for n in other])


def union_rows(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, columns by name, null where a frame lacks one."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def catalogue_pages(spark: SparkSession, path: str, short: bool = False) -> DataFrame:
    """Items of saved pages of the catalogue, line breaks in synopses as spaces."""
    item = schemas.SHORT_CATALOGUE if short else schemas.CATALOGUE
    rows = read_records(spark, path, schemas.page_of(item)).select(F.explode("data").alias("entry")).select("entry.node.*")
    return rows.withColumn("synopsis", F.translate("synopsis", "\n", " "))


def list_pages(spark: SparkSession, path: str, user_id: int) -> DataFrame:
    """A user's list from all its saved pages, in the order of the pages."""
    node = schemas._struct(id=schemas._L, title=schemas._S)
    pages = read_records(spark, path, schemas.page_of(node, schemas.LIST_STATUS)).select(F.input_file_name().alias("file"), F.posexplode("data").alias("at", "entry"))
    rows = pages.select("file", "at", "entry.node.*", "entry.list_status.*")
    return list_rows(rows.withColumn("user_id", F.lit(user_id).cast("long")), F.struct("file", "at"))


def list_rows(rows: DataFrame, order=None) -> DataFrame:
    """Rows of a list in the common schema; seq is the row's position, or numbers a user's rows by order if that is given."""
    from pyspark.sql import Window

    seq = F.col("position") if order is None else (F.row_number().over(Window.partitionBy("user_id").orderBy(order)) - 1).cast("long")
    return rows.select(
        "user_id", "id", "title", F.coalesce("score", F.lit(0)).cast("long").alias("score"), "status",
        F.col("num_episodes_watched").cast("long").alias("episodes_watched"), F.col("is_rewatching").alias("rewatching"), seq.alias("seq"),
    )


def service_entries(spark: SparkSession, options: dict, item: StructType, status: StructType | None = None) -> DataFrame:
    """position, entry of all pages of a service, read by the paged source."""
    spark.dataSource.register(PagedSource)
    entry = schemas.page_of(item, status)["data"].dataType.elementType
    rows = spark.read.format("paged").options(**{k: str(v) for k, v in options.items()}).load()
    return rows.select("position", F.from_json("entry", entry).alias("entry"))


def saved_entries(spark: SparkSession, path: str, item: StructType, status: StructType | None = None, page: int = 500) -> DataFrame:
    """position, entry of pages of page entries that were saved as JSON lines (offset, data, paging) at any path that Spark reads.

    The pages have to be whole: FileNotFoundError if one is missing between the first and the last, or after it because it names a next one.
    """
    pages = read_records(spark, path, StructType([StructField("offset", LongType()), *schemas.page_of(item, status)]), lines=True)
    last = F.max(F.struct("offset", F.coalesce(F.size(F.map_filter("paging", lambda k, v: (k == "next") & v.isNotNull())), F.lit(0)).alias("next")))
    there, last = pages.agg(F.count_distinct("offset"), last).first()
    if last is not None and there <= last["offset"] // page or last is not None and last["next"]:
        raise FileNotFoundError(f"{path} has {there} pages of {last['offset'] // page + 1 + bool(last['next'])} or more")
    return pages.select("offset", F.posexplode("data").alias("at", "entry")).select((F.col("offset") + F.col("at")).alias("position"), "entry")


def _items(entries: DataFrame) -> DataFrame:
    """Items of entries, line breaks in synopses as spaces."""
    return entries.select("entry.node.*").withColumn("synopsis", strip_newlines(F.col("synopsis")))


def service_items(spark: SparkSession, options: dict, short: bool = False) -> DataFrame:
    """Items of the catalogue as a service has them, line breaks in synopses as spaces. short: id, title and synopsis alone."""
    return _items(service_entries(spark, options, schemas.SHORT_CATALOGUE if short else schemas.CATALOGUE))


def saved_items(spark: SparkSession, path: str, short: bool = False, page: int = 500) -> DataFrame:
    """Items as service_items() gives them, from saved pages."""
    return _items(saved_entries(spark, path, schemas.SHORT_CATALOGUE if short else schemas.CATALOGUE, page=page))


def kept_items(items: DataFrame, path: str) -> DataFrame:
    """Writes items as records at path and gives the records."""
    write_records(items, path)
    return read_records(items.sparkSession, path, items.schema, lines=True)


def collect_items(spark: SparkSession, options: dict, path: str, short: bool = False) -> DataFrame:
    """Reads all items of a service, writes them as records at path and gives the records."""
    return kept_items(service_items(spark, options, short), path)


_LISTED = schemas._struct(id=schemas._L, title=schemas._S)


def _list(entries: DataFrame, user_id: int) -> DataFrame:
    return list_rows(entries.select("position", "entry.node.*", "entry.list_status.*", F.lit(user_id).cast("long").alias("user_id")))


def user_list(spark: SparkSession, options: dict, name: str, user_id: int = 0) -> DataFrame:
    """The list of the user of that name in the common schema, under user_id. {name} in the option url stands for the name."""
    return _list(service_entries(spark, options | {"url": options["url"].replace("{name}", name)}, _LISTED, schemas.LIST_STATUS), user_id)


def saved_user_list(spark: SparkSession, path: str, user_id: int = 0, page: int = 1000) -> DataFrame:
    """A list as user_list() gives it, from saved pages."""
    return _list(saved_entries(spark, path, _LISTED, schemas.LIST_STATUS, page), user_id)


def read_splits(spark: SparkSession, paths: dict[str, str], schema: StructType | None = None) -> dict[str, DataFrame]:
    """The records of each split by its name, such as train and test, with the columns of all; FileNotFoundError names the split that is not there."""
    frames = {}
    for name, path in paths.items():
        try:
            frames[name] = read_records(spark, path, schema)
        except FileNotFoundError as e:
            raise FileNotFoundError(f"split {name}: {e}") from e
    kinds = {c: t for f in frames.values() for c, t in f.dtypes}
    return {k: f.select([F.col(f"`{c}`") if c in f.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]) for k, f in frames.items()}
