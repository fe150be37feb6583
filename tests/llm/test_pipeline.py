from collections import Counter

import corpus_pipeline
from lumenrec.llm import common, stages
from lumenrec.llm.common import table
from lumenrec.llm.quality import score_quality
from tests_support import alike, components_of, lower, shingles

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5 and corpus_pipeline.ORACLE_SQL is None
    good = stages.quality_classifier(spark, docs, SF)
    assert good.columns == docs.columns
    rows = {r.doc_id: r.text for r in good.collect()}
    scored = score_quality(docs, table(spark, SF, "labels")).collect()
    assert set(rows) == {r.doc_id for r in scored if r.predicted} and 0.6 * len(scored) < len(rows) < len(scored)
    quality = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert sum(quality[i] for i in rows if i in quality) > 0.95 * sum(quality[r.doc_id] for r in scored if r.doc_id in quality)

    best = {}
    for i, t in rows.items():
        best[lower(t)] = max(best.get(lower(t), -1), i)
    rows = {i: rows[i] for i in best.values()}

    sets = {i: shingles(t) for i, t in rows.items()}
    root = components_of(sets, [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b]) >= 0.8])
    assert any(root[i] != i for i in rows)
    rows = {i: t for i, t in rows.items() if root[i] == i}

    split = {i: t.encode().split() for i, t in rows.items()}
    seen = Counter(tuple(w[k : k + 35]) for w in split.values() for k in range(len(w) - 34))
    left = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        kept = [x for k, x in enumerate(w) if k not in gone]
        if kept or not w:
            left[i] = b" ".join(kept)

    got = corpus_pipeline.run(spark, SF).collect()
    pieces = {}
    for r in sorted(got, key=lambda r: r.part):
        pieces.setdefault(r.doc_id, []).append((r.text or "").encode())
    assert {i: b" ".join(b" ".join(p).split()) for i, p in pieces.items()} == left
    source = {r.doc_id: r.source for r in docs.collect()}
    bins = {}
    for r in got:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for rs in bins.values():
        assert sum(r.n_words for r in rs) == rs[0].bin_words <= 2048 and len({source[r.doc_id] for r in rs}) == len(rs)


STAGES = [f for _, f in corpus_pipeline.STAGES]


def test_stages_handle_odd_rows(spark, make_docs, texts):
    """Nulls, repeated rows, and columns whose names are those that the stages use themselves."""
    rows = list(enumerate(texts)) + [(None, "no id at all"), (2, texts[2]), (2, texts[2])]
    docs = make_docs(rows)
    good = stages.quality_classifier(spark, docs, SF)
    assert good.columns == docs.columns and 0 < good.count() <= len(rows)
    kept = stages.exact_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert max(ids.values()) == 1 and ids[None] == 1
    near = stages.near_duplicates(spark, kept, SF)
    assert near.columns == docs.columns and near.count() <= kept.count()
    cut = stages.repeated_passages(spark, near, SF)
    assert cut.columns == docs.columns and all(r.n_chars == len(r.text) for r in cut.collect() if r.text)
    packed = stages.packed_sequences(spark, cut, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in cut.collect()}


def test_exact_duplicates_tell_rows_apart_by_text(spark, make_docs):
    docs = make_docs([(1, "a b"), (3, "A b"), (3, "a B"), (3, "other"), (5, None), (4, ""), (None, "x"), (None, "X")])
    got = sorted((str(r.doc_id), (r.text or "").lower()) for r in stages.exact_duplicates(spark, docs, SF).collect())
    assert got == [("3", "a b"), ("3", "other"), ("5", ""), ("None", "x")]


def test_near_duplicates_tell_rows_apart_by_text(spark, make_docs):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    docs = make_docs([(1, a), (3, a.upper()), (3, b), (4, a + " end"), (4, b + " end"), (5, "of its own"), (5, "of its own"), (None, b + " more")])
    assert sorted((r.doc_id, r.text) for r in stages.near_duplicates(spark, docs, SF).collect()) == [(1, a), (3, b), (5, "of its own")]


def test_stages_of_an_empty_table(spark, make_docs):
    for stage in STAGES:
        empty = make_docs([])
        out = stage(spark, empty, SF)
        assert out.collect() == [] and (stage is STAGES[-1] or out.columns == empty.columns)


def test_tables_in_between_are_dropped(spark):
    before = set(common._stored)
    corpus_pipeline.run(spark, SF)
    assert len(set(common._stored) - before) == 1
