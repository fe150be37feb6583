"""Searches do their work once and in stretches: the same rows as a plain search, and what is held at once is bounded."""

import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenrec.operators import blocks, fusion, ivf, knn
from lumenrec.operators.knn import Field, nearest, neighbours, raw_values, user_neighbours

COSINE, HOT = Field("v", "cosine", 0.6), Field("h", "l2", 0.4)


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist() if i % 9 else [0.0] * 4, rng.integers(0, 2, 3).astype(float).tolist()) for i in range(90)]
    return spark.createDataFrame(rows, "id long, v array<double>, h array<double>").cache()


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_stretches_give_what_a_plain_search_gives(monkeypatch, metric):
    rng, field = np.random.default_rng(1), Field("x", metric, 1.0)
    for trial in range(120):
        m, n, d = rng.integers(1, 20), rng.integers(1, 120), rng.integers(1, 5)
        draw = (lambda k: rng.integers(0, 2, (k, d)).astype(float)) if trial % 2 else (lambda k: rng.normal(size=(k, d)).round(1))
        q, c, depth = draw(m), draw(n), rng.integers(0, 9, m)
        out = rng.random((m, n)) < rng.choice([0, 0.1, 0.9])
        monkeypatch.setattr(knn, "PRODUCTS", int(rng.choice([1, 50, 300, 1 << 20])))
        rows, cols, _ = nearest(field, q, c, depth, np.nonzero(out))
        full = raw_values(field, q, c)
        for i in range(m):
            own = np.flatnonzero(~out[i])
            want = own[np.lexsort((own, -full[i, own] if metric == "cosine" else full[i, own]))][: depth[i]]
            assert cols[rows == i].tolist() == want.tolist()


def test_an_item_is_searched_once_however_many_like_it(spark, items, monkeypatch):
    """Users are compared with all items only where a list runs out of what they do not list."""
    liked = spark.createDataFrame([(u, q) for u in range(8) for q in (3, 4, 10)], "user_id long, query_id long")
    listed = spark.createDataFrame([(u, i) for u in range(8) for i in range(u, 90, 12 - u)] + [(7, i) for i in range(84)], "user_id long, id long").distinct()
    gave = lambda spare: sorted(map(tuple, user_neighbours(liked, listed, items, [COSINE, HOT], 5, spare=spare).collect()))
    want = gave(90)
    assert gave(0) == gave(4) == want
    every = {(q, f, r): (i, raw) for q, f, i, raw, r in map(tuple, neighbours(items.withColumnRenamed("id", "query_id"), items, [COSINE, HOT], 89).collect())}
    left_out = {tuple(r) for r in listed.collect()}
    plain = []
    for u, q in map(tuple, liked.collect()):
        for f in ("v", "h"):
            own = [every[q, f, r] for r in range(1, 90) if (u, every[q, f, r][0]) not in left_out][:5]
            plain += [(u, q, f, *x, n) for n, x in enumerate(own, 1)]
    assert want == sorted(plain)
    monkeypatch.setattr(knn, "_user_blocks", None)
    few = listed.where("user_id < 3")
    assert user_neighbours(liked.where("user_id < 3"), few, items, [COSINE, HOT], 5, spare=60).count() == 3 * 3 * 2 * 5


def test_users_lists_are_made_in_rounds_that_bound_disk(spark, items, monkeypatch):
    """No copy of the catalogue for each block of what is liked, lists of some pairs at a time, and what is made on the way is removed."""
    liked = spark.createDataFrame([(u, q) for u in range(9) for q in range(u, 90, 4)], "user_id long, query_id long")
    listed = spark.createDataFrame([(u, i) for u in range(8) for i in range(u, 90, 12 - u)] + [(8, i) for i in range(84)], "user_id long, id long").distinct()
    gave = lambda block: sorted(map(tuple, user_neighbours(liked, listed, items, [COSINE, HOT], 3, block).collect()))
    want, steps, store = gave(4096), [], knn.store

    def counted(df, name, *args, **kwargs):
        out = store(df, name, *args, **kwargs)
        steps.append((name, out[1], out[0].count() if name == "round-pairs" else 0))
        return out

    monkeypatch.setattr(knn, "store", counted)
    monkeypatch.setattr(knn, "neighbours", None)
    for name, value in (("FEWEST", 20), ("NUMBERS", 300), ("PAIRS", 60), ("COPIES", 100), ("RUN", 25), ("BLOCK", 8)):
        monkeypatch.setattr(knn, name, value)
    assert gave(20) == want
    rounds = [n for name, _, n in steps if name == "round-pairs"]
    assert len(rounds) == 4 and sum(rounds) == liked.count() and max(rounds) < sum(rounds)
    assert sum(name == "lists" for name, *_ in steps) > 1 and sum(name == "users-nearest" for name, *_ in steps) > 1
    assert {name for name, path, _ in steps if Path(path.removeprefix("file:")).exists()} == {"users-found"}


def test_tasks_give_k_rows_whatever_a_query_excludes(spark, items):
    queries = items.where("id % 7 = 0").withColumnRenamed("id", "query_id")
    seen = spark.createDataFrame([(q, i) for q in range(0, 90, 7) for i in range(q % 3, 80 if q % 2 else 10)], "query_id long, id long")
    whole = neighbours(queries, items, [COSINE, HOT], 89).join(seen, ["query_id", "id"], "left_anti")
    want = fusion.first_of_each(whole, ["query_id"], 4).select("query_id", "field", "id", "raw")
    for block in (4096, 11):
        got = neighbours(queries, items, [COSINE, HOT], 4, block, seen)
        assert sorted(map(tuple, got.select("query_id", "field", "id", "raw").collect())) == sorted(map(tuple, want.collect()))
    rule = fusion.hybrid_search(queries, items, 4, seen, [COSINE, HOT], search=fusion.dictionary_search(items))
    assert sorted(map(tuple, rule.collect())) == sorted(map(tuple, fusion.hybrid_search(queries, items, 4, seen, [COSINE, HOT]).collect()))


def test_queries_of_a_user_share_what_it_lists(spark, items, monkeypatch):
    """A task is told of a user's list once, not once for each query; blocks are cut where tasks would be told of too much."""
    queries = items.where("id % 3 < 2").withColumnRenamed("id", "query_id").withColumn("user", F.when(F.col("query_id") > 9, F.concat(F.lit("u"), F.col("query_id") % 4)))
    listed = spark.createDataFrame([(f"u{u}", i) for u in range(3) for i in range(u, 90, u + 2)] + [("u1", 1), ("u9", 5), (None, 3)], "user string, id long")
    pairs = queries.select("query_id", "user").join(listed, "user").select("query_id", "id")
    gave = lambda *args, **more: sorted(map(tuple, fusion.hybrid_search(queries, items, 4, *args, [COSINE, HOT], **more).collect()))
    want = gave(pairs)
    assert want == gave(pairs, search=lambda asked, fields, k=None: neighbours(asked, items, fields, k))
    assert gave(listed, by="user") == gave(listed, by="user", search=fusion.dictionary_search(items)) == want

    def told(fields):
        def run(key, queries, items):
            n = sum(len(x) for x in queries.column("left_out").to_pylist() if x is not None)
            return pa.table({"query_id": pa.array([hash(key)]), "field": ["v"], "id": pa.array([hash(key)]), "raw": [float(n)]})

        return run

    def of_tasks(limit):
        monkeypatch.setattr(knn, "LEFT_OUT", limit)
        return [r.raw for r in neighbours(queries, items, [COSINE], 4, exclude=listed, by="user").collect()]

    with monkeypatch.context() as m:
        m.setattr(knn, "compare", told)
        assert of_tasks(1000) == [45 + 30 + 22]
        assert len(cut := of_tasks(10)) == 10 and sum(cut) == 97 and max(cut) < 25
    monkeypatch.setattr(knn, "LEFT_OUT", 10)
    assert gave(listed, by="user") == want


class _Sent:
    def __init__(self, value):
        self.value = value


def test_visits_of_all_cells_leave_in_parts(monkeypatch):
    """A query leaves once for each cell with its vector: a batch of them is not made at once."""
    rng = np.random.default_rng(3)
    centres, v = rng.normal(size=(50, 8)), rng.normal(size=(1000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(1000)), pa.array(np.full(1000, 3, np.int32)), pa.array(v.tolist())], ["query_id", "depth", "q_v"])
    monkeypatch.setattr(ivf, "PRODUCTS", 10_000)
    parts = list(ivf._visited("l2", _Sent((np.arange(50, dtype=np.int32), centres, np.ones(50))), 50, False)(iter([batch])))
    assert sum(p.num_rows for p in parts) == 1000 * 50 and max(p.num_rows for p in parts) * 8 <= 10_000
    assert {(q, c) for p in parts for q, c in zip(p.column(0).to_pylist(), p.column(3).to_pylist())} == {(q, c) for q in range(1000) for c in range(50)}


def test_texts_are_shuffled_before_they_are_cut_into_tokens(spark):
    """Lists of tokens take several times the room of their texts; columns of the names used in between do no harm."""
    df = spark.createDataFrame([(i, f"a{i} b c d", "x") for i in range(40)], "doc_id long, text string, batch string")
    made = blocks.group_texts(df, "doc_id", blocks.tokens(F.col("text")), 8, 10)
    plan = made._jdf.queryExecution().executedPlan().toString()
    dealt = [at for at in range(len(plan)) if plan.startswith("Exchange ", at)]
    assert dealt and 0 <= plan.rfind("split(") < dealt[0]
    got = sorted((r.batch, r.block, r.input_ids) for r in made.collect())
    assert got == [(b, k, [x for i in range(10 * b + 2 * k, 10 * b + 2 * k + 2) for x in f"a{i} b c d".split()]) for b in range(4) for k in range(5)]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_a_block_pair_takes_little_memory(metric):
    """What is made of whole blocks beside their vectors stays under 24 MB."""
    rng = np.random.default_rng(7)
    q, c = rng.normal(size=(4096, 16)), rng.normal(size=(4 * 4096, 16))
    none = (np.empty(0, np.int64),) * 2
    tracemalloc.start()
    rows, _, _ = nearest(Field("v", metric, 1.0), q, c, np.full(len(q), 10), none)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == 10 * len(q) and peak < 24 << 20


def test_small_catalogues_are_cut_for_all_cores():
    assert knn.blocks_of(513, 10_256, 4096, 12) == (1, 12)
    assert knn.blocks_of(513, 1_100, 4096, 12) == (1, 2) and knn.blocks_of(0, 0, 4096, 12) == (1, 1)
    for queries, items in ((5_128, 102_560), (30_768, 615_360), (9, 7)):
        a, b = knn.blocks_of(queries, items, 4096, 12)
        assert queries <= 4096 * a and items <= 4 * 4096 * b and (b == 1 or items >= knn.FEWEST * b)
