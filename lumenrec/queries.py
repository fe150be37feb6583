"""The registered queries and, where SQL can express them, their SQL. Searches ask for every id divisible by 20."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.arrays import distinct_names, multi_hot, names
from .functions.hashing import signed_hash
from .functions.vectors import distance_score, similarity_score
from .functions.wordpiece import CLS, GOES_ON, MASK, PAD, SEP, UNKNOWN, WordPiece, encode
from .operators import blocks, features, fusion, users
from .operators.fusion import FIELDS
from .operators.ivf import build_index, build_indexes, recall
from .operators.knn import neighbours
from .operators.patterns import pattern_neighbours
from .operators.titles import build_title_index, search_title_index, search_titles, titles_containing
from .plans import recommend
from .sources import records
from .sources.collection import create_collection
from .sources.tables import scratch, stored
from .views import CATALOGUE_SQL, RAW_SQL, TITLES_SQL, USER_ITEMS_SQL, VOCABULARY, catalogue, raw_catalogue, table, titles, user_items

QUERIES: dict = {}
SQL: dict[str, str] = {}
K = 10
ASKED = "id % 20 = 0"


def query(sql: str | None = None):
    """Register a function under its name, with the SQL of the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- scans, sinks, projections ---------------------------------------------------------------------------------------


def _saved(spark: SparkSession, df: DataFrame, entry, order: str, page: int) -> str:
    """Where rows were saved as the JSON pages that a service answers with."""
    path = scratch(spark, "pages")
    paged = df.withColumn("offset", F.floor(F.col(order) / page) * page).groupBy("offset").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), entry.alias("e")))).alias("all"))
    last = df.agg(F.floor(F.max(order) / page) * page).first()[0]
    after = F.when(F.col("offset") < F.lit(last), F.create_map(F.lit("next"), (F.col("offset") + page).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    records.write_records(paged.select("offset", F.transform("all", lambda x: x["e"]).alias("data"), after.alias("paging")), path)
    return path


@query(f"WITH {RAW_SQL} SELECT id, title, replace(synopsis, chr(10), ' ') AS synopsis, list_transform(genres, lambda x: x.name) AS genres FROM raw")
def scan_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue from its saved pages."""
    raw = raw_catalogue(spark, sf_dir)
    rows = records.saved_items(spark, _saved(spark, raw, F.struct(F.struct(*raw.columns).alias("node")), "id", 500))
    return rows.select("id", "title", "synopsis", names(F.col("genres")).alias("genres"))


@query(f"WITH {RAW_SQL} SELECT id, title, replace(synopsis, chr(10), ' ') AS synopsis FROM raw")
def collect_short_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected from pages and written as records."""
    raw = raw_catalogue(spark, sf_dir)
    items = records.saved_items(spark, _saved(spark, raw, F.struct(F.struct("id", "title", "synopsis").alias("node")), "id", 500), short=True)
    return records.kept_items(items, scratch(spark, "collected"))


@query(f"WITH {USER_ITEMS_SQL} SELECT 7 + 0 * user_id AS user_id, id, title, score, status, episodes_watched, rewatching, row_number() OVER (ORDER BY seq) - 1 AS seq FROM ui")
def scan_user_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries as one user's list, from its saved pages."""
    state = F.struct("score", "status", F.col("episodes_watched").alias("num_episodes_watched"), F.col("rewatching").alias("is_rewatching"))
    entry = F.struct(F.struct("id", "title").alias("node"), state.alias("list_status"))
    return records.saved_user_list(spark, _saved(spark, user_items(spark, sf_dir), entry, "seq", 1000), 7)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), scratch(spark, "documents")
    records.write_records(docs, path)
    return records.read_records(spark, path, docs.schema, lines=True)


@query(f"WITH {USER_ITEMS_SQL}, {CATALOGUE_SQL} SELECT id, e AS synopsis_vec, t AS title_vec, g AS genres, s AS studios FROM cat WHERE id IN (SELECT id FROM ui WHERE status = 'completed')")
def lookup_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.items_by_id(catalogue(spark, sf_dir), user_items(spark, sf_dir).where("status = 'completed'"))


@query(f"WITH {RAW_SQL} SELECT id, synopsis, title, list_transform(genres, lambda x: x.name) AS genres, list_transform(studios, lambda x: x.id) AS studios FROM raw")
def project_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = raw_catalogue(spark, sf_dir).select(features.NEEDED)
    return needed.select("id", "synopsis", "title", F.col("genres.name").alias("genres"), F.col("studios.id").alias("studios"))


@query("SELECT vec_id AS id, 'https://example.org/item/' || vec_id AS link FROM embeddings")
def link_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), recommend.link(F.col("vec_id")).alias("link"))


@query("SELECT doc_id, text, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
def dropna_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.select("doc_id", "text", "quality", "toxic").na.drop("any")


@query(f"WITH {USER_ITEMS_SQL} SELECT user_id, id, score, status FROM ui WHERE status = 'completed'")
def completed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_items(spark, sf_dir).where(F.col("status") == "completed").select("user_id", "id", "score", "status")


@query(f"WITH {USER_ITEMS_SQL} SELECT DISTINCT user_id, id FROM ui WHERE status IN ('dropped', 'on_hold', 'watching', 'completed', 'plan_to_watch')")
def excluded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.listed_items(user_items(spark, sf_dir))


@query(f"WITH {USER_ITEMS_SQL} SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT id FROM ui WHERE status = 'completed')")
def exclude_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = user_items(spark, sf_dir).where("status = 'completed'").select("id").distinct()
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")).join(seen, "id", "left_anti")


@query(f"WITH {USER_ITEMS_SQL} SELECT user_id, id, score + 1 AS score, title, status FROM ui")
def flatten_list_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = user_items(spark, sf_dir)
    both = items.select(F.struct("user_id", "id", "title", "score").alias("node"), F.struct((F.col("score") + 1).alias("score"), "status").alias("list_status"))
    return records.merged_structs(both, "node", "list_status")


@query("SELECT event_id, event_type, (props::JSON->>'k')::BIGINT AS \"props.k\" FROM events")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k bigint").alias("props"))
    return records.flatten(events)


@query("SELECT p_partkey AS id, p_name AS name, p_size::BIGINT AS size, NULL::DOUBLE AS balance FROM part UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("bigint").alias("size"))
    makers = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return records.union_rows(parts, makers)


# -- joins, aggregates and list logic --------------------------------------------------------------------------------


@query(f"WITH {USER_ITEMS_SQL} SELECT id, user_id, score, status FROM ui WHERE id IN (SELECT vec_id FROM embeddings)")
def semi_join_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.in_catalogue(user_items(spark, sf_dir), catalogue(spark, sf_dir)).select("id", "user_id", "score", "status")


@query("SELECT doc_id AS id, lang, embedding::DOUBLE[] AS synopsis_embedding, list_reverse(embedding)::DOUBLE[] AS related_embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def left_join_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("synopsis_embedding"))
    return features.with_embeddings(items, vectors, vectors.select("id", F.reverse("synopsis_embedding").alias("related_embedding")))


@query(f"WITH {USER_ITEMS_SQL} SELECT user_id, id, score, status, seq FROM ui QUALIFY row_number() OVER (PARTITION BY user_id, id ORDER BY seq) = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.first_entries(user_items(spark, sf_dir)).select("user_id", "id", "score", "status", "seq")


@query(f"WITH {USER_ITEMS_SQL} SELECT user_id, median(score) AS median FROM ui WHERE score <> 0 GROUP BY user_id")
def median_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.median_scores(user_items(spark, sf_dir))


_LIKED = """firsts AS (SELECT * FROM ui WHERE id IN (SELECT vec_id FROM embeddings) QUALIFY row_number() OVER (PARTITION BY user_id, id ORDER BY seq) = 1),
liked AS (SELECT user_id, id, score FROM firsts WHERE status = 'completed')"""


@query(f"WITH {USER_ITEMS_SQL}, {_LIKED} SELECT user_id, id, score FROM liked")
def liked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.liked_items(user_items(spark, sf_dir), catalogue(spark, sf_dir))


# -- vector search ---------------------------------------------------------------------------------------------------

_METRICS = f"""p AS (SELECT q.id AS query_id, c.id AS id,
    round(list_cosine_similarity(q.e, c.e), 6) AS m1, round(list_cosine_similarity(q.t, c.t), 6) AS m2,
    list_sum(list_transform(range(1, 18), lambda i: (q.g[i] - c.g[i]) * (q.g[i] - c.g[i]))) AS m3,
    list_sum(list_transform(range(1, 24), lambda i: (q.s[i] - c.s[i]) * (q.s[i] - c.s[i]))) AS m4
  FROM cat q JOIN cat c ON c.id <> q.id WHERE q.{ASKED})"""
_LISTS = """u AS (SELECT {k}, id, 0.2::DOUBLE * ((1 + m1) / 2) AS sc FROM {t} QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY m1 DESC, id) <= 10
  UNION ALL SELECT {k}, id, 0.1::DOUBLE * ((1 + m2) / 2) FROM {t} QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY m2 DESC, id) <= 10
  UNION ALL SELECT {k}, id, 0.6::DOUBLE * (1 - 2 / pi() * atan(m3)) FROM {t} QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY m3, id) <= 10
  UNION ALL SELECT {k}, id, 0.1::DOUBLE * (1 - 2 / pi() * atan(m4)) FROM {t} QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY m4, id) <= 10),
f AS (SELECT {k}, id, round(sum(sc), 9) AS distance FROM u GROUP BY {k}, id QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY round(sum(sc), 9) DESC, id) <= 10)"""


def _asked(cat: DataFrame) -> DataFrame:
    return cat.where(ASKED).withColumnRenamed("id", "query_id")


def _near(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    cat = catalogue(spark, sf_dir)
    return neighbours(_asked(cat), cat, [FIELDS[n]], K).select("query_id", "id", "raw", "rank")


def _near_sql(m: str, order: str) -> str:
    return f"WITH {CATALOGUE_SQL}, {_METRICS} SELECT query_id, id, {m} AS raw, row_number() OVER (PARTITION BY query_id ORDER BY {m} {order}, id) AS rank FROM p QUALIFY rank <= {K}"


@query(_near_sql("m1", "DESC"))
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 0)


@query(_near_sql("m2", "DESC"))
def knn_cosine_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 1)


@query(_near_sql("m3", ""))
def knn_l2_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 2)


@query(_near_sql("m4", ""))
def knn_l2_studios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 3)


def _indexed(spark: SparkSession, sf_dir: str, n: int, nprobe: int | None) -> DataFrame:
    cat = catalogue(spark, sf_dir)
    index = build_index(cat, FIELDS[n], scratch(spark, "index"))
    return index.neighbours(_asked(cat), K, nprobe).select("query_id", "id", "raw", "rank")


@query(_near_sql("m1", "DESC"))
def ivf_cosine_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through an inverted-file index, of which every cell is probed."""
    return _indexed(spark, sf_dir, 0, 512)


@query(_near_sql("m3", ""))
def ivf_l2_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir, 2, 64)


@query(_near_sql("m1", "DESC"))
def ivf_cosine_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through an index, of which the nearest cells are searched and then those that can hold better."""
    return _indexed(spark, sf_dir, 0, None)


@query(_near_sql("m4", ""))
def ivf_l2_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir, 3, None)


@query()
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the exact neighbours a search finds, by the number of cells it probes."""
    cat = catalogue(spark, sf_dir)
    index = build_index(cat, FIELDS[0], scratch(spark, "index"))
    return recall(index, _asked(cat), K, [1, 2, 4, 8, 16, 512], stored(neighbours(_asked(cat), cat, [FIELDS[0]], K), "exact"))


@query(_near_sql("m3", ""))
def knn_patterns_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the distinct vectors of the field."""
    cat = catalogue(spark, sf_dir)
    return pattern_neighbours(_asked(cat), cat, FIELDS[2], K).select("query_id", "id", "raw", "rank")


@query("SELECT event_id, round((1 + (value / 100 - floor(value / 100))) / 2, 9) AS by_cosine, round(1 - 2 / pi() * atan(value), 9) AS by_distance FROM events")
def score_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(similarity_score(v / 100 - F.floor(v / 100)), 9).alias("by_cosine"), F.round(distance_score(v), 9).alias("by_distance"))


@query(f"WITH {CATALOGUE_SQL}, {_METRICS}, {_LISTS.format(k='query_id', t='p')} SELECT query_id, id, distance FROM f")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = catalogue(spark, sf_dir)
    return fusion.hybrid_search(_asked(cat), cat, K)


@query(SQL["hybrid_search"])
def hybrid_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields through inverted-file indexes, as many cells probed as there are."""
    cat = catalogue(spark, sf_dir)
    search = build_indexes(cat, FIELDS, scratch(spark, "indexes"), nprobe={f.name: 512 if f.metric == "cosine" else 64 for f in FIELDS})
    return fusion.hybrid_search(_asked(cat), cat, K, search=search)


_SEEN = "seen AS (SELECT DISTINCT q.id AS query_id, ui.id FROM cat q JOIN ui ON ui.user_id = q.id % 100)"


@query(f"WITH {CATALOGUE_SQL}, {USER_ITEMS_SQL}, {_SEEN}, {_METRICS}, left_over AS (SELECT p.* FROM p ANTI JOIN seen USING (query_id, id)), {_LISTS.format(k='query_id', t='left_over')} SELECT query_id, id, distance FROM f")
def hybrid_search_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query leaves out what one user lists."""
    cat = catalogue(spark, sf_dir)
    asked = _asked(cat).withColumn("user_id", F.col("query_id") % 100)
    return fusion.hybrid_search(asked, cat, K, user_items(spark, sf_dir).select("user_id", "id"), by="user_id")


@query(f"WITH {CATALOGUE_SQL}, {USER_ITEMS_SQL}, {_SEEN}, {_METRICS}, left_over AS (SELECT p.* FROM p ANTI JOIN seen USING (query_id, id)), {_LISTS.format(k='query_id', t='left_over')} SELECT query_id, id, distance FROM f")
def hybrid_search_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As hybrid_search_excluding, with the multi-hot fields searched through their distinct vectors."""
    cat = catalogue(spark, sf_dir)
    asked = _asked(cat)
    seen = asked.select("query_id", (F.col("query_id") % 100).alias("user_id")).join(user_items(spark, sf_dir).select("user_id", "id"), "user_id")
    return fusion.hybrid_search(asked, cat, K, seen, search=fusion.dictionary_search(cat))


@query(f"WITH {CATALOGUE_SQL}, {_METRICS}, {_LISTS.format(k='query_id', t='p')} SELECT query_id, id, distance, 'https://example.org/item/' || id AS link FROM f")
def recommend_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = catalogue(spark, sf_dir)
    return recommend.recommend_by_id(cat, cat.where(ASKED), K)


_USERS = f"""{USER_ITEMS_SQL}, {CATALOGUE_SQL}, {_LIKED},
asked AS (SELECT DISTINCT id FROM liked),
{_METRICS.replace(f"WHERE q.{ASKED}", "WHERE q.id IN (SELECT id FROM asked)")},
own AS (SELECT user_id, query_id, liked.score AS user_score, p.id, m1, m2, m3, m4 FROM liked JOIN p ON query_id = liked.id WHERE NOT EXISTS (SELECT 1 FROM ui WHERE ui.user_id = liked.user_id AND ui.id = p.id)),
{_LISTS.format(k="user_id, query_id, user_score", t="own")},
medians AS (SELECT user_id, median(score) AS m FROM ui WHERE score <> 0 GROUP BY user_id),
scaled AS (SELECT f.*, CASE WHEN user_score <> 0 THEN user_score::DOUBLE ELSE coalesce(m, 7.0) END AS factor FROM f LEFT JOIN medians USING (user_id)),
rated AS (SELECT *, round(distance * factor, 10) AS scaled_distance FROM scaled)"""


@query(f"WITH {_USERS} SELECT user_id, query_id, user_score, id, distance, factor, scaled_distance FROM rated")
def scaled_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.scaled_candidates(catalogue(spark, sf_dir), user_items(spark, sf_dir), K)


@query(f"WITH {_USERS} SELECT user_id, id, max(scaled_distance) AS distance FROM rated GROUP BY user_id, id")
def best_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.best_by_user(catalogue(spark, sf_dir), user_items(spark, sf_dir), K)


@query(f"""WITH {_USERS}, best AS (SELECT user_id, id, max(scaled_distance) AS distance FROM rated GROUP BY user_id, id)
SELECT user_id, id, distance, 'https://example.org/item/' || id AS link FROM best QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY distance DESC, id) <= 10""")
def recommend_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.recommend_by_user(catalogue(spark, sf_dir), user_items(spark, sf_dir), K)


_DRAWN = "drawn AS (SELECT vec_id AS id, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) AS place FROM embeddings)"


@query(f"WITH {_DRAWN} SELECT place, id, 0.0::DOUBLE AS distance, 'https://example.org/item/' || id AS link FROM drawn WHERE place <= 10")
def random_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.random_items(catalogue(spark, sf_dir), K)


@query(f"""WITH {_DRAWN}, new AS (SELECT DISTINCT c_custkey AS user_id, n FROM customer, (SELECT count(*) AS n FROM embeddings) WHERE c_custkey NOT IN (SELECT user_id FROM events)),
tried AS (SELECT user_id, j, ('0x' || md5(concat_ws(' ', user_id, j))[1:15])::BIGINT % (j + 1) AS place FROM (SELECT user_id, unnest(range(n - least(n, 10), n)) AS j FROM new)),
places AS (SELECT user_id, list_reduce(list_prepend([]::BIGINT[][], list([[j, place]] ORDER BY j)), lambda taken, x: taken || [CASE WHEN list_contains(list_transform(taken, lambda y: y[2]), x[1][2]) THEN [x[1][1], x[1][1]] ELSE x[1] END]) AS taken FROM tried GROUP BY user_id)
SELECT user_id, id, 0.0::DOUBLE AS distance, 'https://example.org/item/' || id AS link FROM (SELECT user_id, unnest(list_transform(taken, lambda y: y[2])) + 1 AS place FROM places) JOIN drawn USING (place)""")
def cold_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return recommend.cold_start(catalogue(spark, sf_dir), user_items(spark, sf_dir), asked, K)


@query()
def fuzzy_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five titles that match the name of each region best; the matching itself is tested against its definition."""
    return search_titles(titles(spark, sf_dir), table(spark, sf_dir, "region").select(F.col("r_name").alias("query")))


@query()
def fuzzy_title_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles that match best every twentieth title, mistyped, through an index of their letters; tested against rating all pairs."""
    named = titles(spark, sf_dir)
    typed = named.where("seq % 20 = 0").select(F.concat(F.substring("title", 1, 4), F.expr("substring(title, 6)")).alias("query"))
    return search_title_index(build_title_index(named, scratch(spark, "title-index")), typed)


@query(f"WITH {TITLES_SQL}, q AS (SELECT DISTINCT upper(split_part(p_name, ' ', 1)) AS query FROM part) SELECT query, seq, title FROM titles JOIN q ON contains(lower(title), lower(query))")
def fuzzy_title_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.upper(F.substring_index("p_name", " ", 1)).alias("query"))
    return titles_containing(titles(spark, sf_dir), words)


# -- texts -----------------------------------------------------------------------------------------------------------

_WHITE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _replaced(of: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({of}, '{pattern}', '{by}', 'g')"


def _squeezed(of: str) -> str:
    return _replaced(_replaced(of, _WHITE, " "), "^ | $")


def _docs(spark: SparkSession, sf_dir: str, made) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", made(F.col("text")).alias("cleaned"))


def _with_notes(c):
    """The text with a citation, a credit and an address in it, for rules that plain documents would not try."""
    return F.concat(F.lit("(Source: web) "), c, F.lit(" [Written by me] (source x)) see https://a.example/b?c"))


_NOTES = "'(Source: web) ' || text || ' [Written by me] (source x)) see https://a.example/b?c'"


@query("SELECT doc_id, replace(text, chr(10), ' ') AS cleaned FROM documents")
def strip_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, tx.strip_newlines)


@query(f"SELECT page_id, {_replaced(chr(39) + 'at ' + chr(39) + ' || url || ' + chr(39) + ' end' + chr(39), tx.URL, '<URL>')} AS cleaned FROM pages")
def clean_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.replace_urls(F.concat(F.lit("at "), "url", F.lit(" end"))).alias("cleaned"))


@query(f"SELECT doc_id, {_replaced('text', tx.EMAIL, '<EMAIL>')} AS cleaned FROM documents")
def clean_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, tx.replace_emails)


@query(f"SELECT doc_id, {_replaced('text', tx.PHONE, '<PHONE>')} AS cleaned FROM documents")
def clean_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, tx.replace_phones)


@query(f"SELECT page_id, {_replaced('html', tx.TAG)} AS cleaned FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("cleaned"))


@query(f"SELECT doc_id, {_replaced(_NOTES, tx.SOURCE)} AS cleaned FROM documents")
def strip_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, lambda c: tx.strip_source(_with_notes(c)))


@query(f"SELECT doc_id, {_replaced(_NOTES, tx.CREDIT)} AS cleaned FROM documents")
def strip_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, lambda c: tx.strip_credit(_with_notes(c)))


@query(f"SELECT doc_id, {_squeezed('text')} AS cleaned FROM documents")
def collapse_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, tx.collapse_space)


def _cleaned(of: str) -> str:
    out = _squeezed(f"replace({of}, chr(10), ' ')")
    for pattern, by in ((tx.URL, "<URL>"), (tx.EMAIL, "<EMAIL>"), (tx.PHONE, "<PHONE>"), (tx.EMOJI, ""), (tx.TAG, ""), (tx.SOURCE, ""), (tx.CREDIT, "")):
        out = _replaced(out, pattern, by)
    return _squeezed(out)


@query(f"SELECT doc_id, {_cleaned(_NOTES)} AS cleaned FROM documents")
def clean_text_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps but Unicode folding, which these texts have behind them."""
    return _docs(spark, sf_dir, lambda c: tx.clean_text(_with_notes(c), fold=False))


def _folded(of: str) -> str:
    """Folding, for the letters that these texts have beyond ASCII."""
    return f"strip_accents(replace(replace(replace({of}, 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'))"


@query(f"SELECT doc_id, {_cleaned(_folded('text'))} AS cleaned FROM documents")
def clean_text_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps; folding is also tested by itself, as SQL has but a part of it."""
    return _docs(spark, sf_dir, tx.clean_text)


# -- features and blocks ---------------------------------------------------------------------------------------------

_HOT = "list_transform([" + ", ".join(f"'{v}'" for v in sorted(VOCABULARY)) + "], lambda v: CASE WHEN list_contains(list_transform(genres, lambda x: x.name), v) THEN 1.0::FLOAT ELSE 0.0::FLOAT END)"


@query(f"WITH {RAW_SQL} SELECT id, list_sort(list_distinct(list_transform(genres, lambda x: x.name))) AS genres, list_transform(studios, lambda x: x.name) AS studios FROM raw")
def genre_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_catalogue(spark, sf_dir).select("id", F.sort_array(distinct_names(F.col("genres"))).alias("genres"), names(F.col("studios")).alias("studios"))


@query(f"WITH {RAW_SQL} SELECT id, {_HOT} AS genres FROM raw")
def multi_hot_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_catalogue(spark, sf_dir).select("id", multi_hot(distinct_names(F.col("genres")), VOCABULARY).alias("genres"))


_WORD = "4294967296::UBIGINT"
#: The hash of names of up to three bytes, which is what these have: one block that is not full, and the final mixing.
_HASHED = f"""part AS (SELECT id, list_sum(list_transform(range(len(s)), lambda i: ascii(s[i + 1])::BIGINT * (1 << (8 * i))))::UBIGINT AS k, len(s)::UBIGINT AS n FROM (SELECT id, unnest(list_transform(studios, lambda x: x.name)) AS s FROM raw)),
turned AS (SELECT id, n, ((k * 3432918353) % {_WORD} << 15) % {_WORD} + ((k * 3432918353) % {_WORD} >> 17) AS k FROM part),
mixed0 AS (SELECT id, xor((k * 461845907) % {_WORD}, n) AS h FROM turned), mixed1 AS (SELECT id, (xor(h, h >> 16) * 2246822507) % {_WORD} AS h FROM mixed0),
mixed2 AS (SELECT id, (xor(h, h >> 13) * 3266489909) % {_WORD} AS h FROM mixed1), mixed3 AS (SELECT id, xor(h, h >> 16)::BIGINT AS h FROM mixed2),
signed AS (SELECT id, abs(h) % 75 AS slot, CASE WHEN h < 0 THEN -1 ELSE 1 END AS x FROM (SELECT id, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS h FROM mixed3)),
places AS (SELECT id, map_from_entries(list((slot, x))) AS m FROM (SELECT id, slot, sum(x)::FLOAT AS x FROM signed GROUP BY id, slot) GROUP BY id),
hashed AS (SELECT id, list_transform(range(75), lambda i: coalesce(m[i], 0))::FLOAT[] AS studios FROM places)"""


@query(f"WITH {RAW_SQL}, {_HASHED} SELECT id, studios FROM hashed")
def hash_studios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also tested against published vectors of the hash."""
    return raw_catalogue(spark, sf_dir).select("id", signed_hash(names(F.col("studios")), 75).alias("studios"))


def _measured(c):
    """Stands for a model: a text's length, its words and its vowels."""
    return F.array(*[x.cast("float") for x in (F.length(c), F.size(F.split(c, " ")), F.length(c) - F.length(F.regexp_replace(c, "[aeiou]", "")))])


def _measured_sql(of: str) -> str:
    return f"[length({of}), len(string_split({of}, ' ')), length({of}) - length(regexp_replace({of}, '[aeiou]', '', 'g'))]::FLOAT[]"


@query(f"""WITH {RAW_SQL}, {_HASHED}, texts AS (SELECT id, {_HOT} AS genres, {_cleaned(_folded('synopsis'))} AS synopsis, {_cleaned(_folded('title'))} AS related FROM raw WHERE synopsis IS NOT NULL AND title IS NOT NULL)
SELECT id, genres, studios, {_measured_sql('synopsis')} AS synopsis_embedding, {_measured_sql('related')} AS related_embedding FROM texts JOIN hashed USING (id)""")
def feature_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of it, with a plain function in the encoder's place."""
    return features.build_features(raw_catalogue(spark, sf_dir), _measured, VOCABULARY)


@query(r"""WITH n AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS batch, list_filter(string_split_regex(coalesce(text, ''), '[ \t\r\n\f\x0B]+'), lambda w: w <> '') AS t FROM documents),
a AS (SELECT batch, flatten(list(t ORDER BY doc_id)) AS ids FROM n GROUP BY batch)
SELECT batch, block::INTEGER AS block, ids[block * 128 + 1 : block * 128 + 128] AS input_ids, ids[block * 128 + 1 : block * 128 + 128] AS labels FROM (SELECT batch, ids, unnest(range(len(ids) // 128)) AS block FROM a)""")
def finetune_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.group_texts(table(spark, sf_dir, "documents"), "doc_id", blocks.tokens(F.coalesce("text", F.lit(""))))


@query("SELECT doc_id, CASE WHEN ('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT % 10 < 1 THEN 'test' ELSE 'train' END AS split FROM documents")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.hash_split(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "split")


_BLOCKS = SQL["finetune_blocks"]


@query(f"""SELECT batch, block, list_transform(input_ids, lambda x, k: CASE WHEN ('0x' || md5(concat_ws(' ', '0', batch, block, k - 1, x))[1:8])::BIGINT % 1000000 < 150000 THEN '[MASK]' ELSE x END) AS masked, labels FROM ({_BLOCKS})""")
def mlm_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.mask_tokens(finetune_blocks(spark, sf_dir)).select("batch", "block", "masked", "labels")


@query(r"""WITH n AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS batch, list_filter(string_split_regex(coalesce(text, ''), '[ \t\r\n\f\x0B]+'), lambda w: w <> '') AS t FROM documents),
o AS (SELECT batch, t, (sum(len(t)) OVER (PARTITION BY batch ORDER BY doc_id))::BIGINT - len(t) AS start, (sum(len(t)) OVER (PARTITION BY batch))::BIGINT AS total FROM n),
u AS (SELECT batch, total, start + unnest(range(len(t))) AS pos, unnest(t) AS x FROM o),
t AS MATERIALIZED (SELECT batch, (pos // 128)::INTEGER AS block, pos % 128 AS k, x FROM u WHERE pos // 128 < total // 128),
s AS MATERIALIZED (SELECT token, (hi - n)::BIGINT AS lo, hi::BIGINT AS hi FROM (SELECT x AS token, count(*) AS n, sum(count(*)) OVER (ORDER BY md5(x), x) AS hi FROM t GROUP BY x)),
d AS MATERIALIZED (SELECT *, ('0x' || md5(concat_ws(' ', '0 ask', batch, block, k))[1:15])::BIGINT % 1000000 < 150000 AS asked, ('0x' || md5(concat_ws(' ', '0 kind', batch, block, k))[1:15])::BIGINT % 10 AS kind,
  ('0x' || md5(concat_ws(' ', '0 draw', batch, block, k))[1:15])::BIGINT % (SELECT max(hi) FROM s) AS r FROM t),
fresh AS (SELECT batch, block, k, token FROM (SELECT * FROM d WHERE asked AND kind = 8) ASOF JOIN s ON r >= lo)
SELECT batch, block, list(CASE WHEN asked AND kind < 8 THEN '[MASK]' WHEN asked AND kind = 8 THEN token ELSE x END ORDER BY k) AS input_ids, list(CASE WHEN asked THEN x END ORDER BY k) AS labels
FROM d LEFT JOIN fresh USING (batch, block, k) GROUP BY batch, block""")
def mlm_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with asked tokens masked, replaced by tokens of the corpus, or left; labels for these alone."""
    return blocks.collate(finetune_blocks(spark, sf_dir))


#: Special tokens, signs and digits, letters, and pairs of letters that begin or go on a word.
PIECES = [PAD, UNKNOWN, CLS, SEP, MASK, *string.punctuation, *(g + a for g in ("", GOES_ON) for a in string.digits + string.ascii_lowercase), *(g + a + b for g in ("", GOES_ON) for a in string.ascii_lowercase for b in string.ascii_lowercase)]


@query()
def wordpiece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of texts in a vocabulary of letters and their pairs, 512 a text; tested against a plain tokenizer of the same rules."""
    both = table(spark, sf_dir, "documents").repartition(spark.sparkContext.defaultParallelism).select("doc_id", encode(F.col("text"), WordPiece(PIECES)).alias("t"))
    return both.select("doc_id", "t.input_ids", "t.attention_mask")


@query(f"WITH {CATALOGUE_SQL} SELECT id, CASE WHEN id % 10 = 0 THEN list_transform(e, lambda x: 2 * x) ELSE e END::FLOAT[] AS synopsis_vec, g::FLOAT[] AS genres FROM cat WHERE id % 10 <> 1")
def collection_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection of the catalogue, with a tenth of its rows replaced and another taken out by a merge."""
    cat = catalogue(spark, sf_dir).select("id", "synopsis_vec", "genres")
    dims = {c: len(v) for c, v in zip(("synopsis_vec", "genres"), cat.select("synopsis_vec", "genres").first())}
    made = create_collection(spark, scratch(spark, "collection"), dims, cat, buckets=8)
    made.merge(cat.where("id % 10 = 0").withColumn("synopsis_vec", F.transform("synopsis_vec", lambda x: 2 * x)), cat.where("id % 10 = 1").select("id"))
    return made.read()
