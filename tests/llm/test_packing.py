from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumenrec.llm.packing import best_fit, pack_documents
from lumenrec.llm.simhash import fingerprint
from tests_support import components_of


def plain_fit(sizes, sources, clusters, capacity, per_source):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters):
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= size and b["s"].count(s) < per_source and c not in b["c"]]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"room": capacity, "s": [], "c": set()})
        bins[k]["room"] -= size
        bins[k]["s"].append(s)
        bins[k]["c"].add(c)
        out.append(k)
    return out, len(bins)


def test_best_fit_against_brute_force():
    import random

    rng = random.Random(9)
    for _ in range(30):
        n = rng.randint(0, 200)
        sizes = sorted((rng.randint(1, 100) for _ in range(n)), reverse=True)
        sources = [rng.choice(["hot", "hot", *map(str, range(12))]) for _ in range(n)]
        clusters = [rng.randint(0, 60) for _ in range(n)]
        for per_source in (1, 2, 3):
            assert best_fit(sizes, sources, clusters, 128, per_source) == plain_fit(sizes, sources, clusters, 128, per_source)


def test_a_hot_source_keeps_to_its_limit(make_docs):
    """One document of a source in a bin however many rows it has; more only if the caller says so."""
    rows = [(k, " ".join(f"w{k}.{j}" for j in range(10 + k % 23))) for k in range(900)]
    docs = make_docs(rows, extra=False).withColumn("source", F.expr("IF(doc_id % 2 = 0, 'hot', concat('s', doc_id % 40))"))
    source = {r.doc_id: r.source for r in docs.collect()}
    fills = {}
    for per_source in (1, 3):
        got = pack_documents(docs, capacity=100, per_source=per_source).collect()
        held = Counter((r.bin_id, source[r.doc_id]) for r in got)
        assert max(held.values()) == per_source
        fills[per_source] = sum(r.n_words for r in got) / len({r.bin_id for r in got}) / 100
    assert fills[1] < 0.7 < 0.9 < fills[3]


@pytest.mark.parametrize("column", [None, "group"])
def test_near_copies_are_in_different_bins(make_docs, column):
    rows = []
    for k in range(40):
        own = [f"w{k}.{j}" for j in range(120)]
        rows += [(10 * k + m, " ".join(own[:m] + ["other"] * (m > 0) + own[m + 1 :])) for m in range(4)]
    docs = make_docs(rows, extra=False).selectExpr("doc_id", "text", "concat('s', doc_id) AS source", "doc_id DIV 10 AS group", "'x' AS fp", "'x' AS node")
    fps = {i: fingerprint(t, 5) for i, t in rows}
    root = components_of(fps, [(a, b) for a in fps for b in fps if a < b and ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 4])
    cluster = root if column is None else {i: i // 10 for i, _ in rows}
    assert 40 <= len(set(cluster.values())) < 100
    bins = defaultdict(list)
    for r in pack_documents(docs, capacity=600, cluster=column).collect():
        bins[r.bin_id].append(cluster[r.doc_id])
    assert all(len(set(x)) == len(x) for x in bins.values()) and max(map(len, bins.values())) == 5


@pytest.mark.parametrize("shard_rows", [4096, 30])
def test_constraints_and_whole_texts(make_docs, texts, shard_rows):
    rows = list(enumerate(texts)) + [(None, "no id"), (2, texts[2])]
    docs = make_docs(rows, extra=False).selectExpr("*", "'x' AS shard", "1 AS cluster", "2 AS bin_id")
    got = pack_documents(docs, capacity=128, keep_text=True, shard_rows=shard_rows, per_source=1).collect()
    by_bin, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        if r.bin_id is not None:
            by_bin[r.bin_id].append(r)
    assert set(by_doc) == {i for i, _ in rows}
    for i, t in rows:
        if [k for k, _ in rows].count(i) > 1:
            continue
        parts = sorted(by_doc[i], key=lambda r: r.part)
        words = (t or "").encode().split()
        assert [r.start for r in parts] == list(range(0, max(1, len(words)), 128))
        assert b" ".join((r.text or "").encode() for r in parts).split() == words
        assert all(r.bin_id is not None for r in parts) == bool(words)
    lookup = dict(rows)
    for rs in by_bin.values():
        rs.sort(key=lambda r: r.position)
        assert sum(r.n_words for r in rs) == rs[0].bin_words <= 128
        assert [r.position for r in rs] == [sum(x.n_words for x in rs[:k]) for k in range(len(rs))]
        assert len({(r.doc_id or 0) % 3 for r in rs}) == len(rs)
        assert len({lookup[r.doc_id].lower() for r in rs}) == len(rs)


def test_empty(make_docs):
    assert pack_documents(make_docs([])).collect() == []
    assert [tuple(r) for r in pack_documents(make_docs([(1, None)])).collect()] == [(1, 0, 0, 0, None, None, None)]


def test_rows_alike_in_everything_go_to_several_shards(make_docs):
    """No id, one text, one source: nothing but the place in the table tells the rows apart."""
    docs = make_docs([(None, "a b c")] * 20_000, extra=False).withColumn("source", F.lit("s")).repartition(8)
    got = pack_documents(docs, shard_rows=1_000).collect()
    assert len(got) == 20_000 and len({r.bin_id for r in got}) == 20_000  # copies, and one source
    sizes = Counter(r.bin_id >> 32 for r in got)
    assert len(sizes) == 20 and max(sizes.values()) < 1_300
