"""The recommendation tables as views of the general test tables, for Spark and, as SQL, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENRE_SLOTS, STUDIO_SLOTS = 17, 23
VOCABULARY = [f"g{k}" for k in range(GENRE_SLOTS)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and four vector fields of each embedding."""
    slots = lambda n, hot: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(hot(i), F.lit(1.0)).otherwise(F.lit(0.0)))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("synopsis_vec"),
        F.slice("embedding", 1, 32).cast("array<double>").alias("title_vec"),
        slots(GENRE_SLOTS, lambda i: (i == F.col("label")) | (i == F.lit(10) + F.col("vec_id") % 7)).alias("genres"),
        slots(STUDIO_SLOTS, lambda i: i == F.col("vec_id") % STUDIO_SLOTS).alias("studios"),
    )


def raw_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with texts of documents, and genres and studios as arrays of (id, name) with unknown and repeated names."""
    named = lambda number, letter: F.struct(number.cast("bigint").alias("id"), F.concat(F.lit(letter), number.cast("string")).alias("name"))
    v = F.col("vec_id")
    genres = F.array(named(F.col("label"), "g"), named(F.lit(10) + v % 7, "g"))
    genres = F.when(v % 50 == 0, F.concat(genres, F.array(named(F.lit(99), "x")))).otherwise(genres)
    genres = F.when(v % 20 == 0, F.concat(genres, F.array(named(F.col("label"), "g")))).otherwise(genres)
    items = table(spark, sf_dir, "embeddings").select(v.alias("id"), genres.alias("genres"), F.array(named(v % STUDIO_SLOTS, "s"), named(v % 5, "s")).alias("studios"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("synopsis"), F.concat_ws(" ", F.lit("Title"), "source", "doc_id").alias("title"))
    return items.join(docs, "id", "left")


def user_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' lists, of events; a sixth of the items is outside the catalogue."""
    n = table(spark, sf_dir, "embeddings").count() * 12 // 10
    state = F.create_map(*[F.lit(x) for pair in (("purchase", "completed"), ("click", "watching"), ("view", "plan_to_watch"), ("error", "dropped"), ("signup", "on_hold")) for x in pair])
    return table(spark, sf_dir, "events").select(
        "user_id", (F.col("event_id") % n).alias("id"), F.concat(F.lit("Item "), (F.col("event_id") % n).cast("string")).alias("title"),
        (F.floor("value") % 11).cast("bigint").alias("score"), state[F.col("event_type")].alias("status"),
        (F.col("event_id") % 13).alias("episodes_watched"), (F.col("event_id") % 2 == 0).alias("rewatching"), F.col("event_id").alias("seq"),
    )


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.concat_ws(" ", "p_name", "p_brand").alias("title"))


CATALOGUE_SQL = f"""cat AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, (embedding[1:32])::DOUBLE[] AS t,
  list_transform(range({GENRE_SLOTS}), lambda i: CASE WHEN i = label OR i = 10 + vec_id % 7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS g,
  list_transform(range({STUDIO_SLOTS}), lambda i: CASE WHEN i = vec_id % {STUDIO_SLOTS} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS s FROM embeddings)"""

RAW_SQL = f"""items AS (SELECT vec_id AS id,
    [{{'id': label::BIGINT, 'name': 'g' || label}}, {{'id': (10 + vec_id % 7)::BIGINT, 'name': 'g' || (10 + vec_id % 7)}}]
    || CASE WHEN vec_id % 50 = 0 THEN [{{'id': 99::BIGINT, 'name': 'x99'}}] ELSE [] END
    || CASE WHEN vec_id % 20 = 0 THEN [{{'id': label::BIGINT, 'name': 'g' || label}}] ELSE [] END AS genres,
    [{{'id': vec_id % {STUDIO_SLOTS}, 'name': 's' || (vec_id % {STUDIO_SLOTS})}}, {{'id': vec_id % 5, 'name': 's' || (vec_id % 5)}}] AS studios FROM embeddings),
raw AS (SELECT items.*, text AS synopsis, CASE WHEN doc_id IS NOT NULL THEN concat_ws(' ', 'Title', source, doc_id) END AS title FROM items LEFT JOIN documents ON doc_id = id)"""

USER_ITEMS_SQL = """ui AS (SELECT user_id, event_id % n AS id, 'Item ' || (event_id % n) AS title, floor(value)::BIGINT % 11 AS score,
    CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'watching' WHEN 'view' THEN 'plan_to_watch' WHEN 'error' THEN 'dropped' WHEN 'signup' THEN 'on_hold' END AS status,
    event_id % 13 AS episodes_watched, event_id % 2 = 0 AS rewatching, event_id AS seq
  FROM events, (SELECT count(*) * 12 // 10 AS n FROM embeddings))"""

TITLES_SQL = "titles AS (SELECT p_partkey AS seq, concat_ws(' ', p_name, p_brand) AS title FROM part)"
