"""Fuzzy search among titles through an index of their pairs of letters.

Every title is kept with the tokens of its processed text: its grams, runs of GRAM characters, the second of a kind told
from the first. If two texts match at some ratio, few letters of the shorter one are left out or parted, each of which
costs few grams, so they share a number of tokens that the ratio bounds from below. A query first rates titles that have
its rarest tokens. The k-th best of these is a ratio to beat, and any title that can must have one of so many of the
query's rarest tokens; only titles that have are rated. Where the ratio to beat is so low that a title may share nothing,
the query is put to all titles whose length allows it, as a stated one, in blocks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import processed, ratios
from ..sources.tables import scratch, stored

GRAM = 2
FIRST = 2_000  # titles under the rarest tokens that a query looks at first, if its rarest token alone has not more
STATED = 1_000  # queries that are put to all titles at once


def tokens(text: str) -> list[str]:
    """The grams of a processed text; of one that repeats, the n-th is another token than those before."""
    seen: Counter = Counter()
    out = []
    for k in range(len(text) - GRAM + 1):
        gram = text[k : k + GRAM]
        out.append(f"{gram}{seen[gram] or ''}")
        seen[gram] += 1
    return out


@cache
def highest(size: int, shared: int) -> int:
    """The highest ratio that a shorter text of size characters can have with one that shares so many of its tokens.

    Leaving out one of its characters costs it GRAM grams at most, putting one between two of them GRAM - 1; a window has
    no more characters than the text, so no more are put in than left out.
    """
    lost, best = size - GRAM + 1 - shared, 0.0
    for out in range(size):
        put = max(0, math.ceil((lost - GRAM * out) / (GRAM - 1)))
        if put <= out:
            best = max(best, 200.0 * (size - out) / (2 * (size - out) + out + put))
    return round(best)


@cache
def least_shared(size: int, ratio: int) -> int:
    """The least number of tokens that a shorter text of size characters shares at a ratio of at least so much."""
    return next((c for c in range(max(0, size - GRAM + 1) + 1) if highest(size, c) >= ratio), max(0, size - GRAM + 1))


@dataclass
class TitleIndex:
    """titles: tid, title, first, text, n. grams: token, tid, n. counts: token, titles. rows: the titles as they were given, (seq, title)."""

    titles: DataFrame
    grams: DataFrame
    counts: DataFrame
    rows: DataFrame


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [processed(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int32())], ["title", "first", "text", "n"])


def _tokens_of(key: str):
    """Rows (key, text, n) to a row a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [tokens(t) for t in b.column(1).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([t for x in each for t in x], pa.string()), b.column(2).take(at)], [key, "token", "n"])

    return run


def _plain(titles: DataFrame) -> DataFrame:
    """title, first, text, n of the distinct titles."""
    distinct = titles.groupBy("title").agg(F.min("seq").alias("first"))
    return distinct.mapInArrow(_texts, f"title string, first {dict(distinct.dtypes)['first']}, text string, n int")


def build_title_index(titles: DataFrame, path: str) -> TitleIndex:
    """An index of titles (seq, title), written below path. Tokens are in order, so those of a query are found without reading all."""
    spark = titles.sparkSession
    titles.select("seq", "title").where("title IS NOT NULL").write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    _plain(rows).withColumn("tid", F.monotonically_increasing_id()).write.parquet(f"{path}/titles")
    known = spark.read.parquet(f"{path}/titles")
    grams = known.select("tid", "text", "n").mapInArrow(_tokens_of("tid"), "tid bigint, token string, n int")
    grams.repartitionByRange("token", "tid").sortWithinPartitions("token", "tid").write.parquet(f"{path}/grams")
    spark.read.parquet(f"{path}/grams").groupBy("token").agg(F.count("*").alias("titles")).write.parquet(f"{path}/counts")
    return open_title_index(spark, path)


def open_title_index(spark: SparkSession, path: str) -> TitleIndex:
    return TitleIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("titles", "grams", "counts", "rows")))


# -- rating ---------------------------------------------------------------------------------------------------------


def _rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (query, text, ...) with their match; a batch's rows of one query are rated together."""
    for b in batches:
        queries = b.column(0).dictionary_encode()
        texts, code = np.array(b.column(1).to_pylist(), object), np.asarray(queries.indices)
        match = np.zeros(len(code), np.int32)
        for k, q in enumerate(queries.dictionary.to_pylist()):
            own = np.flatnonzero(code == k)
            match[own] = ratios(processed(q), texts[own].tolist())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(match)], [*b.schema.names, "match"])


def rate(pairs: DataFrame, titles: DataFrame) -> DataFrame:
    """query, title, first, match of pairs (query, tid)."""
    rows = pairs.join(titles, "tid").select("query", "text", "title", "first").hint("rebalance", "query")
    return rows.mapInArrow(_rated, f"query string, text string, title string, first {dict(titles.dtypes)['first']}, match int").drop("text")


def _put_to_all(asked: list[tuple[str, str, list[bool] | None]], k: int):
    """The k best of a task's titles for each of the asked (query, processed, lengths that count or None for all), and how many were rated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list = [None] * len(asked)
        rated = [0] * len(asked)
        kind = None
        for b in batches:
            title, first, text, n = b.columns
            kind, texts, sizes = first.type, np.array(text.to_pylist(), object), np.asarray(n)
            for i, (_, q, lengths) in enumerate(asked):
                own = np.flatnonzero(np.array(lengths, bool)[np.minimum(sizes, len(q))]) if lengths else np.arange(len(sizes))
                if not len(own):
                    continue
                rated[i] += len(own)
                new = pa.table({"title": title.take(pa.array(own)), "first": first.take(pa.array(own)), "match": pa.array(ratios(q, texts[own].tolist()), pa.int32())})
                both = new if best[i] is None else pa.concat_tables([best[i], new])
                best[i] = both.take(pc.sort_indices(both, [("match", "descending"), ("first", "ascending")])[:k])
        for (q, _, _), rows, n in zip(asked, best, rated):
            if rows is not None:
                rows = rows.combine_chunks()
                columns = [c.combine_chunks() for c in (rows["title"], rows["first"].cast(kind), rows["match"])]
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(rows), pa.string()), *columns, pa.array([n] + [0] * (len(rows) - 1), pa.int64())], ["query", "title", "first", "match", "rated"])

    return run


def put_to_all(titles: DataFrame, queries: DataFrame, k: int, block: int = STATED) -> DataFrame:
    """query, title, first, match, rated: k titles of each task for each query (query and, if there is such a column, lengths), rated against all of titles (title, first, text, n).

    rated, summed over a query's rows, is the number of titles it was rated against. Queries go out block by block.
    """
    kind = f"query string, title string, first {dict(titles.dtypes)['first']}, match int, rated bigint"
    out = titles.sparkSession.createDataFrame([], kind)
    lengths = "lengths" if "lengths" in queries.columns else F.lit(None).alias("lengths")
    for some in batched(queries.select("query", lengths).toLocalIterator(), block):
        asked = [(r["query"], processed(r["query"]), r["lengths"]) for r in some]
        out = out.unionByName(titles.select("title", "first", "text", "n").mapInArrow(_put_to_all(asked, k), kind))
    return out


def _best(rated: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query, seq, title, match of the k best rows, from rated (query, title, first, match) distinct titles."""
    order = Window.partitionBy("query").orderBy(F.desc("match"), F.asc_nulls_last("first"))
    few = rated.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)  # k distinct titles hold the k best rows
    every = few.join(rows, "title").select("query", "seq", "title", "match")
    order = Window.partitionBy("query").orderBy(F.desc("match"), "seq")
    return every.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def search_titles(titles: DataFrame, queries: DataFrame, k: int = 5, block: int = STATED) -> DataFrame:
    """query, seq, title, match: the k titles (seq, title) that match each query best, ties in the order of seq. Each query is put to all distinct titles; for one or a few queries, which an index would not repay."""
    titles = titles.where("title IS NOT NULL")
    return _best(put_to_all(_plain(titles), queries.select("query").distinct(), k, block), titles.select("seq", "title"), k)


# -- search by the index --------------------------------------------------------------------------------------------


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [processed(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int32())], ["query", "text", "n"])


def _needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (query, n, ratio) with, for titles of each processed length up to n: how many of the query's rarest tokens they have to be looked for under, and whether they may match without any."""
    for b in batches:
        upto, free = [], []
        for n, ratio in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            need = [least_shared(size, ratio) for size in range(n + 1)]
            upto.append([max(0, n - GRAM + 1) - max(1, c) + 1 for c in need])
            free.append([c == 0 for c in need])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto, pa.list_(pa.int32())), pa.array(free, pa.list_(pa.bool_()))], ["query", "n", "ratio", "upto", "free"])


def _ranked_tokens(index: TitleIndex, queries: DataFrame) -> DataFrame:
    """query, token, titles, place: the tokens of each query, the rarest first."""
    each = queries.select("query", "text", "n").mapInArrow(_tokens_of("query"), "query string, token string, n int").select("query", "token")
    each = each.join(index.counts, "token", "left").withColumn("titles", F.coalesce("titles", F.lit(0)))
    return each.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("titles", "token")))


@dataclass
class TitleSearch:
    """The steps of a search: queries (query, text, n), first and further pairs (query, tid) that are rated, and what was put to all titles."""

    queries: DataFrame
    first: DataFrame
    further: DataFrame
    stated: DataFrame
    best: DataFrame

    def rated(self) -> DataFrame:
        """query, pairs: how many titles each query was rated against."""
        pairs = self.first.unionByName(self.further).groupBy("query").agg(F.count("*").alias("pairs"))
        return pairs.unionByName(self.stated.groupBy("query").agg(F.sum("rated").alias("pairs"))).groupBy("query").agg(F.sum("pairs").alias("pairs"))


def steps_of_search(index: TitleIndex, queries: DataFrame, k: int = 5, first: int = FIRST) -> TitleSearch:
    asked = stored(queries.select("query").distinct().mapInArrow(_sized, "query string, text string, n int"), "queries")
    ranked = stored(_ranked_tokens(index, asked), "query-tokens")
    so_far = F.sum("titles").over(Window.partitionBy("query").orderBy("place")) - F.col("titles")
    early = ranked.where("titles > 0").withColumn("_before", so_far).withColumn("_all", F.col("_before") + F.col("titles")).where(F.col("_all").between(1, first) | (F.col("_before") == 0))
    grams = index.grams
    seen = early.select("query", "token").join(grams.select("token", "tid"), "token").groupBy("query", "tid").agg(F.count("*").alias("_shared"))
    top = Window.partitionBy("query").orderBy(F.desc("_shared"), "tid")
    pairs = stored(seen.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= 4 * k).select("query", "tid"), "first-pairs")
    rated = stored(rate(pairs, index.titles), "first-rated")
    order = Window.partitionBy("query").orderBy(F.desc("match"))
    bar = rated.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == k).select("query", F.col("match").alias("ratio"))
    needs = asked.join(bar, "query", "left").select("query", "n", F.coalesce("ratio", F.lit(0)).alias("ratio"))
    needs = stored(needs.mapInArrow(_needs, "query string, n int, ratio int, upto array<int>, free array<boolean>"), "query-needs")

    limits = ranked.join(needs.select("query", F.col("n").alias("_size"), "upto", "free"), "query").where(F.col("place") <= F.array_max("upto"))
    at = F.least("n", "_size") + 1
    under = limits.join(grams, "token").where((F.col("place") <= F.element_at("upto", at)) & ~F.element_at("free", at)).select("query", "tid")
    short = needs.where(~F.element_at("free", -1)).select("query", F.posexplode("free").alias("n", "_free")).where("_free")
    of_length = short.join(index.titles.select("tid", "n"), "n").select("query", "tid")
    further = stored(under.unionByName(of_length).distinct().join(pairs, ["query", "tid"], "left_anti"), "further-pairs")
    low = needs.where(F.element_at("free", -1)).select("query", F.col("free").alias("lengths"))
    stated = stored(put_to_all(index.titles, low, k), "put-to-all")
    every = rated.unionByName(rate(further, index.titles)).unionByName(stated.drop("rated")).dropDuplicates(["query", "title"])
    return TitleSearch(asked, pairs, further, stated, _best(every, index.rows, k))


def search_title_index(index: TitleIndex, queries: DataFrame, k: int = 5) -> DataFrame:
    """query, seq, title, match as search_titles() gives them, through an index."""
    return steps_of_search(index, queries, k).best


def index_containing(index: TitleIndex, queries: DataFrame, block: int = STATED) -> DataFrame:
    """query, seq, title of all titles that hold a query, whatever the case: those that a search rates 100 first of all.

    A title that holds a query has all its tokens, so those under the rarest one are looked at; queries without tokens are
    put to all titles, block by block.
    """
    asked = stored(queries.select("query").where("query IS NOT NULL").distinct().mapInArrow(_sized, "query string, text string, n int"), "queries")
    rarest = _ranked_tokens(index, asked).where("place = 1").select("query", "token")
    near = rarest.join(index.grams.select("token", "tid"), "token").join(index.titles.select("tid", "title"), "tid").where(F.contains(F.lower("title"), F.lower("query"))).select("query", "title")
    for some in batched(asked.where(F.col("n") < GRAM).select("query").toLocalIterator(), block):
        each = F.explode(F.array(*[F.lit(r["query"]) for r in some])).alias("query")
        near = near.unionByName(index.titles.select("title", each).where(F.contains(F.lower("title"), F.lower("query"))).select("query", "title"))
    return near.join(index.rows, "title").select("query", "seq", "title")


def titles_containing(titles: DataFrame, queries: DataFrame, block: int = STATED) -> DataFrame:
    """query, seq, title as index_containing() gives them, through an index of titles (seq, title) that is made for it."""
    return index_containing(build_title_index(titles, scratch(titles.sparkSession, "title-index")), queries, block)
