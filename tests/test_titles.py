"""The title index against rating every pair, and what it leaves unrated."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenrec.functions.fuzzy import partial_ratio, processed, ratios
from lumenrec.operators import titles as ti


@settings(max_examples=150, deadline=None)
@given(st.text("abc d", max_size=12), st.lists(st.text("abc d", max_size=16), max_size=8))
def test_ratios_of_many(q, texts):
    texts = [processed(t) for t in texts]
    assert ratios(processed(q), texts).tolist() == [partial_ratio(q, t) for t in texts]


def test_ratios_of_long_and_foreign_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdé世 ") for _ in range(rng.choice([0, 1, 5, 30, 63, 64, 65, 200]))) for _ in range(60)]
    texts = [processed(t) for t in texts]
    for q in ["a", "abc", *rng.sample(texts, 8), "é" * 63, "世" * 64]:
        assert ratios(q, texts).tolist() == [partial_ratio(q, t) for t in texts]
    assert ratios("", ["a"]).tolist() == [0] and ratios("a", []).tolist() == []


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=14), st.text("abc", min_size=1, max_size=18))
def test_the_bound_holds(a, b):
    short, long = sorted((a, b), key=len)
    shared = len(set(ti.tokens(short)) & set(ti.tokens(long)))
    ratio = partial_ratio(a, b)
    assert ratio <= ti.highest(len(short), shared) and ti.least_shared(len(short), ratio) <= shared


def test_the_bound_is_of_use():
    assert ti.highest(20, 0) < 70 and ti.highest(20, 19) == 100 and ti.least_shared(20, 90) >= 8
    assert all(ti.highest(n, c) <= ti.highest(n, c + 1) for n in range(1, 40) for c in range(n - 1))


@pytest.fixture(scope="module")
def titles(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioubcdfglmnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    series = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 4))).title() for _ in range(250)]
    made = [f"{name}{part}" for part in ("", " 2", ": the Movie", " OVA", " III", "!!") for name in series]
    made += made[:40] + ["a", "Ab", "X-Y", "", "!!", None, "é", "The " + " ".join(words)]
    return made, spark.createDataFrame(list(enumerate(made)), "seq long, title string")


def brute(made, queries, k):
    out = []
    for q in queries:
        rated = sorted((-partial_ratio(q, t), n, t) for n, t in enumerate(made) if t is not None)
        out += [(q, n, t, -m) for m, n, t in rated[:k]]
    return sorted(out)


def test_search_through_the_index(spark, titles, tmp_path):
    made, df = titles
    typed = lambda t: t[:3] + t[4:]
    queries = [typed(made[n]) for n in (3, 99, 120, 240)] + [made[7].upper(), "zzqq", "a", "ab", "", "?", "q" * 70, made[-1][:50], made[20] + made[21] + made[22]]
    asked = spark.createDataFrame([(q,) for q in queries + queries[:2]], "query string")
    index = ti.build_title_index(df, str(tmp_path / "index"))
    want = brute(made, sorted(set(queries)), 5)
    assert sorted(map(tuple, ti.search_titles(df, asked, 5, block=4).collect())) == want
    steps = ti.steps_of_search(ti.open_title_index(spark, str(tmp_path / "index")), asked, 5, first=50)
    assert sorted(map(tuple, steps.best.collect())) == want
    rated, distinct = {r.query: r.pairs for r in steps.rated().collect()}, len({t for t in made if t is not None})
    for q in queries[:5]:  # mistyped titles: few others can do as well as their series
        assert rated[q] < 0.15 * distinct, (q, rated[q], distinct)
    assert rated["zzqq"] >= 0.9 * distinct  # nothing is like it, so nothing can be left out
    assert index.grams.select("tid").distinct().count() <= distinct


def test_no_join_of_all_pairs(spark, titles, tmp_path):
    _, df = titles
    index = ti.build_title_index(df, str(tmp_path / "index"))
    plan = ti.search_title_index(index, spark.createDataFrame([("abc",)], "query string"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_titles_that_hold_a_query(spark, titles):
    made, df = titles
    queries = ["a", "AB", "x-y", "-", "!!", "", made[5][:6], "é", "nothing of it", made[9].upper()]
    got = sorted(map(tuple, ti.titles_containing(df, spark.createDataFrame([(q,) for q in queries], "query string"), block=2).collect()))
    assert got == sorted((q, n, t) for q in set(queries) for n, t in enumerate(made) if t is not None and q.lower() in t.lower())


def test_empty_tables(spark, tmp_path):
    none, asked = spark.createDataFrame([], "seq long, title string"), spark.createDataFrame([("a",)], "query string")
    assert ti.search_title_index(ti.build_title_index(none, str(tmp_path / "index")), asked).collect() == []
    assert ti.search_titles(none, asked).collect() == [] and ti.titles_containing(none, asked).collect() == []
