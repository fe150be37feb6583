"""The inverted-file index, bounds between cells, and the dictionary of distinct vectors, against plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrec.operators import fusion, ivf
from lumenrec.operators.ivf import EMPTY, IndexedFields, VectorIndex, build_index, build_indexes, open_indexes, reachable, recall
from lumenrec.operators.knn import Field, neighbours
from lumenrec.operators.patterns import dictionary, nearest_patterns, pattern_neighbours

COSINE, L2, HOT = Field("v", "cosine", 0.5), Field("v", "l2", 0.5), Field("h", "l2", 0.5)


@pytest.fixture(scope="module")
def items(spark):
    """Vectors in clusters, some alike, some zero; and a multi-hot field of few patterns, one of them that of half the items."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(12, 8))
    rows = []
    for i in range(400):
        v = middles[i % 12] + rng.normal(scale=0.15, size=8)
        hot = [1.0, 0.0, 0.0, 0.0, 0.0] if i % 2 else rng.integers(0, 2, 5).astype(float).tolist()
        rows.append((i, v.tolist() if i % 50 else [0.0] * 8, hot))
    rows += [(1000 + k, rows[7][1], rows[8][2]) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, v array<double>, h array<double>").repartition(4)
    return df.cache()


def asked(items):
    return items.where("id % 7 = 0").select(F.col("id").alias("query_id"), "v", "h")


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "field", "id", "raw", "rank").collect())


@pytest.mark.parametrize("field", [COSINE, L2])
@pytest.mark.parametrize("block", [40])
def test_searches_of_all_cells_and_bounded_ones_are_exact(spark, items, tmp_path, field, block):
    index = build_index(items, field, str(tmp_path / "index"), 20)
    exact = rows(neighbours(asked(items), items, [field], 6))
    assert rows(index.neighbours(asked(items), 6, nprobe=100, block=block)) == exact
    assert rows(index.neighbours(asked(items), 6, first=1, block=block)) == exact
    deep = asked(items).withColumn("depth", (F.col("query_id") % 5 + 1).cast("int"))
    assert rows(index.neighbours(deep, first=2)) == rows(neighbours(deep, items, [field]))
    again = VectorIndex(spark, str(tmp_path / "index"), field)
    assert again.sizes == index.sizes and sum(index.sizes.values()) == items.count() and (EMPTY in index.sizes) == (field.metric == "cosine")
    assert rows(again.neighbours(asked(items), 6)) == exact


@pytest.mark.parametrize("field", [COSINE, L2])
def test_cells_out_of_reach_are_skipped(items, tmp_path, field):
    index = build_index(items, field, str(tmp_path / "index"), 20)
    queries = asked(items).where("query_id % 50 <> 0").withColumn("depth", F.lit(6))
    found = index.neighbours(queries, nprobe=2)
    visits = index.visits(queries, 2).count() + index.rest(queries, found, 2).count()
    assert visits < 0.5 * queries.count() * len(index.sizes)


@pytest.mark.parametrize("field", [COSINE, L2])
def test_a_search_of_few_cells(items, tmp_path, field):
    """Exactly the best of the cells that are probed, and no folder of another cell is read."""
    index = build_index(items, field, str(tmp_path / "index"), 20)
    one = asked(items).where("query_id = 14")
    cells = [r.cell for r in index.visits(one.withColumn("depth", F.lit(4)), 3).collect()]
    assert len(set(cells)) == 3
    held = index.vectors(cells).select("id", "v")
    assert rows(index.neighbours(one, 4, nprobe=3)) == rows(neighbours(one, held, [field], 4))
    plan = index.vectors(cells)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan and f"IN ({','.join(map(str, sorted(cells)))})" in plan
    files = {r[0] for r in index.vectors(cells).select(F.input_file_name()).distinct().collect()}
    assert files and all(any(f"cell={c}/" in f for c in cells) for f in files)


def test_recall_grows_with_the_cells_probed(items, tmp_path):
    index = build_index(items, COSINE, str(tmp_path / "index"), 20)
    exact = neighbours(asked(items), items, [COSINE], 6)
    got = {r.nprobe: (r.found, r.wanted) for r in recall(index, asked(items), 6, [1, 4, 100], exact).collect()}
    assert got[1][0] <= got[4][0] <= got[100][0] == got[100][1] == exact.count()
    assert got[4][0] >= 0.9 * got[4][1]


def test_bounds_never_exclude_what_is_within_reach():
    rng = np.random.default_rng(9)
    for metric in ("cosine", "l2"):
        for _ in range(200):
            centre, q, v = rng.normal(size=(3, 4))
            if metric == "cosine":
                centre /= np.linalg.norm(centre)
                raw = float(q @ v / np.linalg.norm(q) / np.linalg.norm(v))
            else:
                raw = float(((q - v) ** 2).sum())
            off, radius = ivf.away(metric, q[None], centre[None]), ivf.away(metric, v[None], centre[None])[0]
            assert reachable(metric, off, radius, np.array([False]), np.array([False]), np.array([round(raw, 6)]))[0, 0]


def test_indexes_of_little_or_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id long, v array<double>")
    index = build_index(none, COSINE, str(tmp_path / "none"))
    assert index.neighbours(none.withColumnRenamed("id", "query_id"), 3).collect() == []
    zeros = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    assert rows(build_index(zeros, COSINE, str(tmp_path / "zeros")).neighbours(zeros.withColumnRenamed("id", "query_id"), 3)) == [(1, "v", 2, 0.0, 1), (2, "v", 1, 0.0, 1)]
    with pytest.raises(ValueError, match="numbers"):
        build_index(spark.range(40_000).select("id", F.array_repeat(F.lit(1.0), 4_000).alias("v")), L2, str(tmp_path / "wide"), 2_500)


def test_hybrid_search_through_indexes_and_dictionaries(spark, items, tmp_path):
    fields = [Field("v", "cosine", 0.6), Field("h", "l2", 0.4)]
    seen = spark.createDataFrame([(q, i) for q in range(0, 400, 7) for i in range(q % 9, 200, 9)], "query_id long, id long")
    for exclude in (None, seen):
        want = sorted(map(tuple, fusion.hybrid_search(asked(items), items, 5, exclude, fields).collect()))
        for search in (build_indexes(items, fields, str(tmp_path / f"a{exclude is None}")), fusion.dictionary_search(items)):
            assert sorted(map(tuple, fusion.hybrid_search(asked(items), items, 5, exclude, fields, search=search).collect())) == want
    few = open_indexes(spark, fields, str(tmp_path / "aTrue"), {"v": 1, "h": 1})
    assert isinstance(few, IndexedFields) and fusion.hybrid_search(asked(items), items, 5, None, fields, search=few).count() > 0


@pytest.mark.parametrize("block", [12])
def test_search_through_distinct_vectors_is_exact(items, block):
    queries = asked(items)
    assert rows(pattern_neighbours(queries, items, HOT, 9, block)) == rows(neighbours(queries, items, [HOT], 9))
    deep = queries.withColumn("depth", (F.col("query_id") % 40 + 1).cast("int"))
    assert rows(pattern_neighbours(deep, items, HOT, block=block)) == rows(neighbours(deep, items, [HOT]))
    cosine = Field("h", "cosine", 1.0)
    assert rows(pattern_neighbours(queries, items, cosine, 5, block)) == rows(neighbours(queries, items, [cosine], 5))
    assert rows(pattern_neighbours(queries, items.where("id < 4"), HOT, 9)) == rows(neighbours(queries, items.where("id < 4"), [HOT], 9))


def test_the_work_is_that_of_distinct_vectors(items):
    queries = asked(items).select("query_id", F.lit(3).alias("depth"), F.col("h").alias("_vector"))
    one = dictionary(queries, "_vector", F.max("depth").cast("int").alias("_depth")).withColumnRenamed("_pattern", "_asked")
    all_of = dictionary(items.select("id", "h"), "h", F.count("*").alias("_n"))
    distinct = items.select("h").distinct().count()
    assert all_of.count() == distinct < 40 and one.count() <= distinct
    assert nearest_patterns(one, all_of, HOT).count() <= 4 * one.count()  # of each no more than the list can draw on, but for ties
