"""Merging into a collection, and samples by user."""

from collections import Counter

import pytest

from lumenrec.operators.sampling import numbered, sample_by_user
from lumenrec.schemas import vector_table
from lumenrec.sources.collection import Collection, VersionConflict, create_collection

DIMS = {"a": 2, "b": 3}


def rows(spark, ids, x=0.0):
    return spark.createDataFrame([(i, [float(i), x], [x, x, float(i)]) for i in ids], vector_table(**DIMS)[0])


def content(df):
    return {r.id: (list(r.a), list(r.b)) for r in df.collect()}


def files(c):
    return {f: p.stat().st_mtime_ns for p in c.glob("data-*/bucket=*/*.parquet") for f in [str(p.relative_to(c))]}


def test_a_merge_writes_only_the_buckets_it_touches(spark, tmp_path):
    c = create_collection(spark, str(tmp_path / "c"), DIMS, rows(spark, range(200)), buckets=16)
    assert content(c.read()) == content(rows(spark, range(200))) and c.versions() == [0, 1]
    old, before = c.read(), files(tmp_path / "c")
    assert c.merge(rows(spark, [5, 1000], 9.0)) == 2
    want = content(rows(spark, range(200))) | content(rows(spark, [5, 1000], 9.0))
    assert content(c.read()) == want
    assert content(old) == content(rows(spark, range(200))) == content(c.read(1))  # who has read the old version goes on to
    after = files(tmp_path / "c")
    assert before.items() <= after.items() and 1 <= len({f.split("/")[1] for f in after.keys() - before.keys()}) <= 2
    named = c.manifest()["folders"]
    assert sum(f != named["0"] and True for f in named.values()) >= 0 and len({b for b, f in named.items() if f.startswith("data-00000002")}) <= 2
    assert content(c.lookup([5, 7, 12345])) == {i: want[i] for i in (5, 7)}
    assert len(c.lookup([5]).inputFiles()) <= 2
    c.merge(None, spark.createDataFrame([(5,), (6,), (99999,)], "id long"))
    assert content(c.read()) == {i: v for i, v in want.items() if i not in (5, 6)}
    c.vacuum()
    assert content(c.read()) == {i: v for i, v in want.items() if i not in (5, 6)} and c.versions() == [3]


def test_a_row_put_in_and_taken_out_at_once_is_put_in(spark, tmp_path):
    c = create_collection(spark, str(tmp_path / "c"), DIMS, rows(spark, [1, 2]), buckets=2)
    c.merge(rows(spark, [2], 4.0), spark.createDataFrame([(1,), (2,)], "id long"))
    assert content(c.read()) == content(rows(spark, [2], 4.0))


@pytest.mark.parametrize("bad,message", [([(1, [1.0], [1.0, 2.0, 3.0])], "a has not 2 components"), ([(None, [1.0, 2.0], [1.0, 2.0, 3.0])], "without an id"), ([(1, [1.0, 2.0], [1.0, 2.0, 3.0])] * 2, "more than one row of id 1")])
def test_a_bad_row_changes_nothing(spark, tmp_path, bad, message):
    c = create_collection(spark, str(tmp_path / "c"), DIMS, rows(spark, range(20)), buckets=4)
    with pytest.raises(Exception, match=message):
        c.merge(spark.createDataFrame(bad, vector_table(**DIMS)[0]))
    assert c.versions() == [0, 1] and content(c.read()) == content(rows(spark, range(20)))


def test_of_two_merges_at_once_one_fails(spark, tmp_path, monkeypatch):
    c = create_collection(spark, str(tmp_path / "c"), DIMS, buckets=4)
    assert c.read().collect() == [] and c.lookup([1]).collect() == []
    with pytest.raises(VersionConflict):
        create_collection(spark, str(tmp_path / "c"), DIMS)
    other, publish = Collection(spark, str(tmp_path / "c")), Collection._publish

    def late(self, version, manifest):  # the other one is done first
        monkeypatch.setattr(Collection, "_publish", publish)
        other.merge(rows(spark, [2]))
        publish(self, version, manifest)

    monkeypatch.setattr(Collection, "_publish", late)
    with pytest.raises(VersionConflict):
        c.merge(rows(spark, [1]))
    assert set(content(c.read())) == {2}
    c.merge(rows(spark, [1]))
    assert set(content(c.read())) == {1, 2}


def test_no_collection(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Collection(spark, str(tmp_path / "none")).read()
    with pytest.raises(FileNotFoundError):
        create_collection(spark, str(tmp_path / "c"), DIMS).read(7)


# -- samples ---------------------------------------------------------------------------------------------------------


def test_numbers_are_dense_and_by_hash(spark):
    got = sorted((r.place, r.id) for r in numbered(spark.range(3, 500)).collect())
    assert [p for p, _ in got] == list(range(497)) and {i for _, i in got} == set(range(3, 500))


@pytest.mark.parametrize("size,n", [(0, 3), (1, 3), (2, 2), (9, 4), (10, 30), (97, 10)])
def test_each_user_gets_distinct_items(spark, size, n):
    got = sample_by_user(spark.range(50).withColumnRenamed("id", "user_id"), spark.range(size), n).collect()
    by_user = Counter(r.user_id for r in got)
    assert len({(r.user_id, r.id) for r in got}) == len(got)
    assert set(by_user.values()) == ({min(n, size)} if size else set())


def test_items_and_pairs_of_items_are_as_likely_as_others(spark):
    users, size, n = 6000, 20, 5
    got = sample_by_user(spark.range(users).withColumnRenamed("id", "user_id"), spark.range(size), n).collect()
    chi = lambda seen, cells, total: sum((seen[c] - total / len(cells)) ** 2 / (total / len(cells)) for c in cells)
    assert chi(Counter(r.id for r in got), range(size), users * n) < 50
    own = {}
    for r in got:
        own.setdefault(r.user_id, set()).add(r.id)
    pairs = Counter((a, b) for s in own.values() for a in s for b in s if a < b)
    cells = [(a, b) for a in range(size) for b in range(a + 1, size)]
    assert chi(pairs, cells, users * n * (n - 1) / 2) < 300
    assert len({frozenset(s) for s in own.values()}) > 3000
