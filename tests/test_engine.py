import json
import shutil
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrec import schemas
from lumenrec.config import expand, load_config
from lumenrec.errors import InvalidToken, ItemNotFound, RateLimitExceeded, UserNotFound, check_status
from lumenrec.operators import blocks, knn, users
from lumenrec.operators.features import build_features, complete_items
from lumenrec.operators.fusion import FIELDS, hybrid_search
from lumenrec.operators.knn import _first, neighbours, user_neighbours
from lumenrec.plans import recommend
from lumenrec.plans.engine import Engine, prompted
from lumenrec.sources import paged, records, tables
from lumenrec.streaming.incremental import activity, follow_users

CAT = "id long, synopsis_vec array<double>, title_vec array<double>, genres array<double>, studios array<double>"


def item(i, syn=(1.0, 0.0), title=(1.0, 0.0), genres=(0.0, 0.0), studios=(0.0, 0.0)):
    return (i, list(syn), list(title), list(genres), list(studios))


@pytest.fixture(scope="module")
def cat(spark):
    rows = [item(i, (1.0, i / 10), (1.0, -i / 7), (float(i % 2), float(i % 3 == 0)), (float(i % 5), -1.0 if i % 4 == 0 else 0.0)) for i in range(40)]
    return spark.createDataFrame(rows, CAT).cache()


def plain_hybrid(rows, q, k, excluded=()):
    import math

    me = next(r for r in rows if r[0] == q)
    pool = [r for r in rows if r[0] != q and r[0] not in excluded]
    total = {}
    for n, f in enumerate(FIELDS, 1):
        def raw(r):
            a, b = me[n], r[n]
            if f.metric == "cosine":
                na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
                return round(sum(x * y for x, y in zip(a, b)) / (na * nb), 6) if na * nb else 0.0
            return round(sum((x - y) ** 2 for x, y in zip(a, b)), 6)

        best = sorted(pool, key=lambda r: ((-raw(r) if f.metric == "cosine" else raw(r)), r[0]))[:k]
        for r in best:
            total[r[0]] = total.get(r[0], 0) + f.weight * ((1 + raw(r)) / 2 if f.metric == "cosine" else 1 - 2 / math.pi * math.atan(raw(r)))
    return sorted(((i, round(s, 9)) for i, s in total.items()), key=lambda x: (-x[1], x[0]))[:k]


def test_hybrid_search_truncates_each_list_and_excludes_first(spark, cat):
    rows = [tuple(r) for r in cat.collect()]
    queries = cat.where("id IN (3, 8)").withColumnRenamed("id", "query_id")
    excluded = {3: [4, 5, 9, 15, 21, 27, 33], 8: [2]}
    pairs = spark.createDataFrame([(q, i) for q, ids in excluded.items() for i in [*ids, *ids, 999]], "query_id long, id long")
    for exclude in (None, pairs):
        got = hybrid_search(queries, cat, 5, exclude).orderBy("query_id", F.desc("distance"), "id").collect()
        for q in (3, 8):
            assert [(r.id, r.distance) for r in got if r.query_id == q] == plain_hybrid(rows, q, 5, excluded[q] if exclude is not None else ())
    same = hybrid_search(queries.repartition(7), cat.repartition(5), 5, pairs).orderBy("query_id", F.desc("distance"), "id").collect()
    assert same == got


def test_blocks_do_not_change_neighbours(cat):
    queries = cat.withColumnRenamed("id", "query_id")
    one, many = (neighbours(queries, cat, list(FIELDS), 6, block=b).orderBy("query_id", "field", "rank").collect() for b in (4096, 7))
    assert one == many and len(one) == 40 * 4 * 6
    assert len(neighbours(queries, cat, list(FIELDS), 500).collect()) == 40 * 39 * 4


def test_first_of_large_and_small_values():
    value = np.array([[3.0, 1.0, 1.0, 2.0], [0.0, 0.0, 0.0, 0.0]])
    itself = np.array([[False, False, True, False], [True, False, False, False]])
    for scale in (1.0, 1e12):
        assert _first(value * scale, itself, 3).tolist() == [[1, 3, 0], [1, 2, 3]]


def test_published_scores(spark):
    rows = [item(1, genres=(1.0, 0.0), studios=(1.0, 0.0)), item(2, (0.0, 1.0), (0.0, 1.0), (1.0, 0.0), (1.0, 0.0))]
    rows += [item(k, (1.0, 1e-3 * k), (1.0, 1e-3 * k), (9.0, 9.0), (9.0, 9.0)) for k in range(10, 14)]
    cat = spark.createDataFrame(rows, CAT)
    got = {r.id: r.distance for r in hybrid_search(cat.where("id = 1").withColumnRenamed("id", "query_id"), cat, 1).collect()}
    assert got == {2: 0.7}  # first in genres and studios, in neither text list


LIST = "user_id long, id long, score long, status string, seq long"


def test_list_logic(spark, cat):
    rows = [(1, 5, 8, "watching", 0), (1, 5, 9, "completed", 1), (1, 6, 0, "completed", 2), (1, 7, 4, "completed", 3), (1, 999, 9, "completed", 4), (1, 8, 1, "listed elsewhere", 5), (2, 3, 0, "completed", 0), (3, 999, 0, "completed", 0)]
    items = spark.createDataFrame(rows, LIST)
    assert sorted(tuple(r) for r in users.liked_items(items, cat).collect()) == [(1, 6, 0), (1, 7, 4), (2, 3, 0)]  # 5 is first seen watching, 999 is unknown
    assert (1, 8) not in {tuple(r) for r in users.listed_items(items).collect()}
    assert {r.user_id: r.median for r in users.median_scores(items).collect()} == {1: 8.0}
    scaled = {(r.user_id, r.query_id): r.factor for r in recommend.scaled_candidates(cat, items, 3).collect()}
    assert scaled == {(1, 6): 8.0, (1, 7): 4.0, (2, 3): 7.0}


def test_users_get_the_best_score_of_each_item(spark, cat):
    rows = [(1, 5, 10, "completed", 0), (1, 6, 5, "completed", 1), (1, 7, 0, "dropped", 2), (2, 3, 0, "completed", 0), (4, 999, 3, "completed", 0)]
    items = spark.createDataFrame(rows, LIST)
    got = recommend.recommend_by_user(cat, items, 4).orderBy("user_id", F.desc("distance"), "id").collect()
    plain = [tuple(r) for r in cat.collect()]
    best = {}
    for q, factor in ((5, 10.0), (6, 5.0)):
        for i, d in plain_hybrid(plain, q, 4, (5, 6, 7)):
            best[i] = max(best.get(i, 0), round(d * factor, 10))
    want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:4]
    assert [(r.id, r.distance) for r in got if r.user_id == 1] == want
    assert not [r for r in got if r.user_id == 4]  # likes nothing of the catalogue, which is not a cold start
    everyone = spark.createDataFrame([(1,), (4,), (77,)], "user_id long")
    all_of = recommend.recommend_for_users(cat, items, everyone, 4).collect()
    cold = [r for r in all_of if r.user_id == 77]
    assert len(cold) == len({r.id for r in cold}) == 4 and all(r.distance == 0 for r in cold)
    assert {r.user_id for r in all_of} == {1, 77}
    assert recommend.random_items(cat, 100).count() == 40


def test_features(spark):
    named = "array<struct<id long, name string>>"
    rows = [(1, "A <i>x</i>", "T\n1", [(1, "Action")], [(1, "s")]), (1, "again", "T", [], []), (2, None, "T", [], []), (3, "ok", "T3", [], [])]
    df = spark.createDataFrame(rows, f"id long, synopsis string, title string, genres {named}, studios {named}")
    assert sorted(r.id for r in complete_items(df).collect()) == [1, 3]
    made = build_features(df, encoder=lambda c: F.array(F.length(c).cast("float")), studio_dims=16)
    assert made.columns == ["id", "genres", "studios", "synopsis_embedding", "related_embedding"] and made.count() == 2
    three = made.where("id = 3").first()
    assert sum(three.genres) == 0 and len(three.genres) == 78 and three.studios == [0.0] * 16 and three.synopsis_embedding == [2.0]


def test_token_blocks(spark):
    df = spark.createDataFrame([(i, " ".join(f"{i}.{k}" for k in range(i % 7))) for i in range(2500)], "doc_id long, text string").repartition(5)
    got = blocks.group_texts(df, "doc_id", blocks.tokens(F.col("text")), block=16, rows=1000).orderBy("batch", "block").collect()
    want = []
    for b in range(3):
        flat = [f"{i}.{k}" for i in range(b * 1000, min(2500, b * 1000 + 1000)) for k in range(i % 7)]
        want += [(b, n, flat[n * 16 : n * 16 + 16]) for n in range(len(flat) // 16)]
    assert [(r.batch, r.block, r.input_ids) for r in got] == want and all(r.labels == r.input_ids for r in got)
    masked = [x for r in blocks.mask_tokens(blocks.group_texts(df, "doc_id", blocks.tokens(F.col("text")), 16)).collect() for x in r.masked]
    assert 0.12 < masked.count("[MASK]") / len(masked) < 0.18
    split = blocks.hash_split(df, "doc_id").groupBy("split").count().collect()
    assert {r.split: 150 < r["count"] < 350 if r.split == "test" else r["count"] > 2000 for r in split} == {"test": True, "train": True}


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("STORE", "db")
    assert expand({"a": ["$STORE", {"b": "${STORE}:1"}], "n": 3, "u": "$UNSET_NAME"}) == {"a": ["db", {"b": "db:1"}], "n": 3, "u": "$UNSET_NAME"}
    (tmp_path / "c.json").write_text('{"x": "$STORE"}')
    assert load_config(str(tmp_path / "c.json")) == {"x": "db"}
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none.json"))


def test_statuses():
    check_status(200, "")
    for status, kind in ((401, InvalidToken), (404, UserNotFound), (429, RateLimitExceeded), (500, NotImplementedError)):
        with pytest.raises(kind):
            check_status(status, "list")


def test_pages(spark, tmp_path):
    for n, ids in ((0, [1, 2]), (2, [3, 4]), (4, [5])):
        (tmp_path / f"{n}.json").write_text(json.dumps({"data": [{"node": {"id": i, "title": f"t{i}", "synopsis": "a\nb"}} for i in ids], "paging": {"next": "x"} if n < 4 else {}}))
    spark.dataSource.register(paged.PagedSource)
    read = spark.read.format("paged").options(url=str(tmp_path), page=2, fetcher="lumenrec.sources.paged:file_fetcher")
    ids = lambda df: sorted(json.loads(r.entry)["node"]["id"] for r in df.collect())
    assert ids(read.load()) == [1, 2, 3, 4, 5]
    assert ids(read.option("max_pages", 2).load()) == [1, 2, 3, 4]
    assert ids(read.options(max_pages=3, readers=2).load()) == [1, 2, 3, 4, 5]
    assert [r.synopsis for r in records.catalogue_pages(spark, f"{tmp_path}/0.json", short=True).collect()] == ["a b", "a b"]
    stream = spark.readStream.format("paged").options(url=str(tmp_path), page=2, fetcher="lumenrec.sources.paged:file_fetcher").load()
    run = stream.writeStream.format("memory").queryName("seen").trigger(processingTime="0 seconds").start()
    run.processAllAvailable()
    run.stop()
    assert ids(spark.table("seen")) == [1, 2, 3, 4, 5]  # with the page that still fills
    (tmp_path / "status.json").write_text("404")
    with pytest.raises(Exception, match="UserNotFound"):
        read.option("max_pages", 1).load().collect()


def flaky(options, offset, calls=[]):
    calls.append(offset)
    if len(calls) % 2:
        raise TimeoutError
    return 200, {"data": [offset], "paging": {"next": 1} if offset < 2 else {}}


def test_timeouts_are_asked_again():
    assert [o for o, _ in paged.pages({"fetcher": f"{__name__}:flaky", "page": "1"}, 0)] == [0, 1, 2]


def test_stream_delivers_entries_of_a_filling_page_once(tmp_path):
    def write(n, ids, more):
        (tmp_path / f"{n}.json").write_text(json.dumps({"data": ids, "paging": {"next": "x"} if more else {}}))

    write(0, [10, 11], True)
    write(2, [12], False)
    options = {"url": str(tmp_path), "page": "2", "fetcher": "lumenrec.sources.paged:file_fetcher"}
    stream = paged.PagedStream(options)
    rows, first = stream.read(stream.initialOffset())
    assert list(rows) == [(0, "10"), (1, "11"), (2, "12")] and first == {"offset": 3}
    rows, same = stream.read(first)
    assert list(rows) == [] and same == first
    write(2, [12, 13], True)
    write(4, [14], False)
    rows, last = stream.read(first)
    assert list(rows) == [(3, "13"), (4, "14")] and last == {"offset": 5}
    assert list(stream.readBetweenOffsets({"offset": 1}, {"offset": 4})) == [(1, "11"), (2, "12"), (3, "13")]
    rows, part = paged.PagedStream(options | {"max_pages": "1"}).read({"offset": 0})
    assert len(list(rows)) == 2 and part == {"offset": 2}


def waits(monkeypatch, options):
    slept = []
    monkeypatch.setattr(paged.time, "sleep", slept.append)
    list(paged.pages(options, 0))
    return slept


def test_a_service_is_given_time_between_pages(monkeypatch):
    body = lambda options, offset: (200, {"data": [offset], "paging": {"next": 1} if offset < 2 else {}})
    monkeypatch.setattr(paged, "http_fetcher", body)
    assert waits(monkeypatch, {"url": "x", "page": "1"}) == [4.15, 4.15]
    assert waits(monkeypatch, {"url": "x", "page": "1", "delay": "1"}) == [1.0, 1.0]


def test_engine_with_a_service(spark, cat, tmp_path):
    """Rebuilt from what is collected, and asked for a user by name."""
    named = lambda *x: [{"id": n, "name": v} for n, v in enumerate(x)]
    items = [{"node": {"id": i, "title": f"title {i}", "synopsis": f"a\ntext {i}", "genres": named("Action"), "studios": named("s")}} for i in range(5)]
    lists = [{"node": {"id": 1, "title": "title 1"}, "list_status": {"score": 8, "status": "completed", "num_episodes_watched": 1, "is_rewatching": False}}]
    for folder, pages in (("items", [items[:3], items[3:]]), ("lists/ann", [lists]), ("lists/new", [[]])):
        (tmp_path / folder).mkdir(parents=True)
        for n, data in enumerate(pages):
            (tmp_path / folder / f"{3 * n}.json").write_text(json.dumps({"data": data, "paging": {"next": "x"} if n + 1 < len(pages) else {}}))
    (tmp_path / "lists/gone").mkdir()
    (tmp_path / "lists/gone/status.json").write_text("404")
    service = {"page": 3, "fetcher": "lumenrec.sources.paged:file_fetcher"}
    settings = {"collection": "served_items", "items_path": str(tmp_path / "kept"), "items_service": service | {"url": f"{tmp_path}/items"}, "lists_service": service | {"url": f"{tmp_path}/lists/{{name}}"}}
    engine = Engine(spark, settings, cat, cat.selectExpr("id", "'x' AS title"))
    engine.rebuild(None, lambda c: F.array(F.length(c).cast("float"), F.lit(1.0).cast("float")))
    assert records.read_records(spark, settings["items_path"], lines=True).count() == 5 and engine.titles.count() == 5
    assert {r.synopsis for r in records.collect_items(spark, settings["items_service"], str(tmp_path / "short"), short=True).collect()} == {f"a text {i}" for i in range(5)}
    got = engine.run("ann", by_item=False, limit=2).collect()
    assert len(got) == 2 and {r.user_id for r in got} == {0} and 1 not in {r.id for r in got}
    assert engine.run("new", by_item=False, limit=3).count() == 3
    with pytest.raises(UserNotFound):
        engine.run("gone", by_item=False)
    spark.sql("DROP TABLE served_items")


def test_a_prompt_asks_until_it_gets_a_choice():
    said, replies = [], iter(["7", "x", "0", " 2 "])
    rows = [{"title": "a"}, {"title": "b"}]
    assert prompted(lambda _: next(replies), said.append)(rows) == rows[1] and said == ["1. a", "2. b"]
    assert prompted(lambda _: "q", said.append)(rows) is None and prompted(lambda _: "", said.append)(rows) is None


def test_blocks_do_not_change_users_or_titles(spark, cat):
    rng = np.random.default_rng(3)
    listed = {(int(u), int(i)) for u, i in zip(rng.integers(0, 6, 70), rng.integers(0, 40, 70))} | {(9, i) for i in range(39)}
    rows = [(u, i, int(i % 11), ["completed", "watching"][(u + i) % 2], n) for n, (u, i) in enumerate(sorted(listed))]
    items = spark.createDataFrame(rows, LIST)
    liked = users.liked_items(items, cat).selectExpr("user_id", "id AS query_id")
    near = lambda block: sorted(map(tuple, user_neighbours(liked, users.listed_items(items), cat, list(FIELDS), 4, block).collect()))
    whole = near(4096)
    assert near(7) == near(3) == whole
    vectors = cat.withColumnRenamed("id", "query_id")
    every = neighbours(vectors, cat, list(FIELDS), 40).collect()
    want = []
    for u, q in {(r.user_id, r.query_id) for r in liked.collect()}:
        for f in FIELDS:
            own = [r for r in sorted((r for r in every if r.query_id == q and r.field == f.name), key=lambda r: r["rank"]) if (u, r.id) not in listed][:4]
            want += [(u, q, f.name, r.id, r.raw, n) for n, r in enumerate(own, 1)]
    assert whole == sorted(want)
    titles = spark.createDataFrame([(n, f"{a} {b}") for n, (a, b) in enumerate((a, b) for a in ("red", "blue", "red") for b in ("one", "two", "three"))], "seq long, title string")
    queries = spark.createDataFrame([("RED on",), ("thr",), ("",)], "query string")
    for f in (recommend.search_titles, recommend.titles_containing):
        few, all_of = ({tuple(r) for r in f(titles, queries, block=b).collect()} for b in (2, 1000))
        assert few == all_of and few


def test_user_list_pages(spark, tmp_path):
    for n in range(2):
        body = {"data": [{"node": {"id": 10 * n + k, "title": "t"}, "list_status": {"score": k, "status": "completed", "num_episodes_watched": 3, "is_rewatching": False}} for k in range(3)], "paging": {}}
        (tmp_path / f"p{n}.json").write_text(json.dumps(body))
    got = records.list_pages(spark, str(tmp_path), 9).orderBy("seq")
    assert got.columns == schemas.USER_ITEMS.names and [(r.id, r.seq) for r in got.collect()] == [(0, 0), (1, 1), (2, 2), (10, 3), (11, 4), (12, 5)]  # of all pages


def test_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "s": {"year": 2, "p": {"q": "x"}}}, {"id": 2}]')
    flat = records.flatten(records.read_records(spark, str(tmp_path / "a.json")))
    assert flat.columns == ["id", "s.p.q", "s.year"] and sorted(map(str, flat.collect()))
    with pytest.raises(FileNotFoundError):
        records.read_records(spark, str(tmp_path / "b.json"))
    both = records.union_rows(spark.createDataFrame([(1, "a")], "x int, y string"), spark.createDataFrame([(2.5, 2)], "z double, x int"))
    assert {tuple(r) for r in both.collect()} == {(1, "a", None), (2, None, 2.5)}
    schema, dims = schemas.vector_table(v=2)
    assert schemas.validate(spark.createDataFrame([(1, [1.0, 2.0])], schema), dims).count() == 1
    with pytest.raises(Exception, match="has not 2 components"):
        schemas.validate(spark.createDataFrame([(1, [1.0])], schema), dims).collect()


def test_engine(spark, cat):
    titles = cat.select("id", F.concat(F.lit("Title number "), F.col("id").cast("string")).alias("title"))
    engine = Engine(spark, {"collection": "test_items", "link": "x/"}, cat, titles)
    assert engine.similar(3, 4).count() == 4 and engine.similar(3, 1).first().link.startswith("x/")
    with pytest.raises(ItemNotFound):
        engine.similar(12345)
    assert engine.find("number 17").first().seq == 17
    assert engine.run("number 17", limit=2).collect() == engine.similar(17, 2).collect()
    assert engine.run("number", choose=lambda rows: None) is None
    items = spark.createDataFrame([(1, 5, 10, "completed", 0)], LIST)
    assert {r.user_id for r in engine.run("1", by_item=False, items=items).collect()} == {1}
    named = "array<struct<id long, name string>>"
    source = spark.createDataFrame([(i, f"text {i}", f"title {i}", [(1, "Action")], [(1, "s")]) for i in range(5)], f"id long, synopsis string, title string, genres {named}, studios {named}")
    engine.rebuild(source, lambda c: F.array(F.length(c).cast("float"), F.lit(1.0).cast("float")))
    assert engine.similar(3, 2).count() == 2 and tables.open_or_create(spark, "test_items", None).count() == 5
    spark.sql("DROP TABLE test_items")
    with pytest.raises(FileNotFoundError):
        tables.open_or_create(spark, "test_items", None)


def test_streams(spark, cat, tmp_path):
    rows = [(1, 5, 10, "completed", 0), (2, 6, 5, "completed", 1)]
    spark.createDataFrame(rows, LIST).write.parquet(str(tmp_path / "in"))
    entries, out = spark.readStream.schema(LIST).parquet(str(tmp_path / "in")), {}
    run = follow_users(entries, lambda: spark.read.parquet(str(tmp_path / "in")), cat, lambda df, n: out.update({n: df.collect()}), str(tmp_path / "state"), 3)
    run.awaitTermination()
    assert {r.user_id for rs in out.values() for r in rs} == {1, 2}
    events = spark.createDataFrame([(f"2026-01-01 0{h}:10:00", 1, float(h)) for h in range(4)], "t string, id long, score double").select(F.to_timestamp("t").alias("ts"), "id", "score")
    events.write.parquet(str(tmp_path / "events"))
    seen = activity(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    run = seen.writeStream.format("memory").queryName("activity").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("activity").count() == 3  # the last window is still open
    shutil.rmtree(tmp_path / "state")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def kept_of_users(spark, cat, monkeypatch, f):
    """Rows of f with users' lists made at once, and in rounds with users dealt out in parts; what the rounds kept, and all scaled candidates."""
    rng = np.random.default_rng(5)
    listed = {(int(u), int(i)) for u, i in zip(rng.integers(0, 5, 80), rng.integers(0, 40, 80))}
    items = spark.createDataFrame([(u, i, int(i % 11), ["completed", "watching"][(u + i) % 3 % 2], n) for n, (u, i) in enumerate(sorted(listed))], LIST)
    whole, every, paths, store = sorted(map(tuple, f(cat, items, 3).collect())), recommend.scaled_candidates(cat, items, 3).collect(), set(), knn.store

    def seen(df, name, *args, **kwargs):
        out = store(df, name, *args, **kwargs)
        paths.update([out[1]] if name == "users-found" else [])
        return out

    monkeypatch.setattr(knn, "store", seen)
    monkeypatch.setattr(knn, "PAIRS", 12)
    monkeypatch.setattr(recommend, "user_neighbours", partial(user_neighbours, block=6))
    assert sorted(map(tuple, f(cat, items, 3).collect())) == whole
    return whole, spark.read.parquet(*paths), every


def test_no_more_than_a_users_best_are_kept_of_a_round(spark, cat, monkeypatch):
    whole, kept, every = kept_of_users(spark, cat, monkeypatch, recommend.recommend_by_user)
    assert kept.columns == ["user_id", "id", "distance"] and len(whole) <= kept.count() < len(every)
    best = {}
    for r in every:
        best[r.user_id, r.id] = max(r.scaled_distance, best.get((r.user_id, r.id), 0))
    want = [(u, i, d) for user in {u for u, _ in best} for u, i, d in sorted(((u, i, d) for (u, i), d in best.items() if u == user), key=lambda x: (-x[2], x[1]))[:3]]
    assert [x[:3] for x in whole] == sorted(want)


def test_an_item_is_kept_once_for_a_user_of_a_round(spark, cat, monkeypatch):
    whole, kept, every = kept_of_users(spark, cat, monkeypatch, recommend.best_by_user)
    assert kept.columns == ["user_id", "id", "distance"] and len(whole) <= kept.count() < len(every)
    best = {}
    for r in every:
        best[r.user_id, r.id] = max(r.scaled_distance, best.get((r.user_id, r.id), 0))
    assert whole == sorted((*x, d) for x, d in best.items())
