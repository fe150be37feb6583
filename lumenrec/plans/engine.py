"""The facade: settings, a catalogue, and the queries by title, id or user."""

from __future__ import annotations

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import load_config
from ..errors import ItemNotFound, failure_in
from ..operators.features import Encoder, build_features
from ..operators.fusion import FIELDS
from ..schemas import USER_ITEMS
from ..sources.records import collect_items, read_records, user_list
from ..sources.tables import open_or_create, replace
from . import recommend

DEFAULTS = {"items_path": None, "collection": "items", "link": recommend.LINK, "studio_dims": 75, "items_service": None, "lists_service": None}


def prompted(ask, say=print):
    """A choice for run(): shows the rows, asks until a number of one of them comes, and gives that row, or None for an empty reply or q."""

    def choose(rows):
        for n, r in enumerate(rows, 1):
            say(f"{n}. {r['title']}")
        while (reply := ask(f"1 to {len(rows)}, or q: ").strip().lower()) not in ("", "q"):
            if reply.isdecimal() and 1 <= int(reply) <= len(rows):
                return rows[int(reply) - 1]
        return None

    return choose


class Engine:
    """Queries over a collection (id and the vector fields) and the titles of its items (id, title)."""

    def __init__(self, spark: SparkSession, settings: dict | str, collection: DataFrame | None = None, titles: DataFrame | None = None):
        given = load_config(settings) if isinstance(settings, str) else settings
        self.spark, self.settings = spark, DEFAULTS | given
        self.titles = titles if titles is not None else read_records(spark, self.settings["items_path"]).select("id", "title")
        self.collection = collection if collection is not None else open_or_create(spark, self.settings["collection"], None)

    def similar(self, item: int, limit: int = 10) -> DataFrame:
        """id, distance, link of the items most like item; ItemNotFound if the collection lacks it."""
        one = self.spark.createDataFrame([(item,)], "id long")
        if recommend.items_by_id(self.collection, one).isEmpty():
            raise ItemNotFound(f"no item {item}")
        return recommend.recommend_by_id(self.collection, one, limit, self.settings["link"]).select("id", "distance", "link").orderBy(F.desc("distance"), "id")

    def for_users(self, items: DataFrame, users: DataFrame, limit: int = 10) -> DataFrame:
        """user_id, id, distance, link; users without a list get random items."""
        return recommend.recommend_for_users(self.collection, items, users, limit, self.settings["link"])

    def find(self, query: str, limit: int = 5) -> DataFrame:
        """query, seq (the id), title, match of the titles that fit best: what a caller may choose from."""
        queries = self.spark.createDataFrame([(query,)], "query string")
        return recommend.search_titles(self.titles.withColumnRenamed("id", "seq"), queries, limit).orderBy(F.desc("match"), "seq")

    def list_of(self, name: str) -> DataFrame:
        """The list of the user of that name, as the service has it now; UserNotFound and the like if it refuses."""
        try:
            rows = user_list(self.spark, self.settings["lists_service"], name).collect()  # one user's
        except PythonException as e:
            kind = failure_in(str(e))
            if kind is None:
                raise
            raise kind(name) from e
        return self.spark.createDataFrame(rows, USER_ITEMS)

    def run(self, search: str, by_item: bool = True, limit: int = 10, choose=None, items: DataFrame | None = None) -> DataFrame | None:
        """Items like the one whose title fits search, or for the user named search.

        choose picks one of the rows of find(); without it the first is taken. None, from it or for want of titles, ends the
        run. A user's list comes from the service by name, or from items, where search is the user's number.
        """
        if not by_item:
            user = 0 if items is None else int(search)
            return self.for_users(self.list_of(search) if items is None else items, self.spark.createDataFrame([(user,)], "user_id long"), limit)
        found = self.find(search).collect()
        picked = (found[0] if found else None) if choose is None or not found else choose(found)
        return None if picked is None else self.similar(picked["seq"], limit)

    def rebuild(self, source: DataFrame | None, encoder: Encoder) -> DataFrame:
        """Collect, preprocess, write: the collection made anew from raw items, which come from the service if source is None.

        What is collected is kept as records at items_path. The collection takes the place of the old one at once.
        """
        if source is None:
            source = collect_items(self.spark, self.settings["items_service"], self.settings["items_path"])
        made = build_features(source, encoder, studio_dims=self.settings["studio_dims"])
        names = dict(zip(("synopsis_embedding", "related_embedding", "genres", "studios"), (f.name for f in FIELDS)))
        self.collection = replace(self.spark, self.settings["collection"], made.select("id", *[F.col(k).alias(v) for k, v in names.items()]))
        self.titles = source.select("id", "title")
        return self.collection
