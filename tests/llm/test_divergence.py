"""The divergence audit against its definition, over many layouts of tiles and buckets."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lumenrec.llm import divergence as dv
from lumenrec.llm.divergence import divergence, one_sided, terms

SCHEMA = "doc_id bigint, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, least, top=50):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, t, lang, source in rows:
        lang, source, found = lang or "", source or "", TERM.findall(lower(t or ""))
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: {t: counts[lang, s][t] for t in kept} for x, s in groups if x == lang}
        all_of = {t: sum(c[t] for c in own.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in own.items()}, share(all_of)
        for s in own:
            pairs = [(-sum(abs(p[s][t] - p[h][t]) for t in kept), h.encode(), h) for h in own if h != s]
            used = [(q[t] - p[s][t], t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(used)[:top])):
                out += [(lang, s, part, item, -v, n) for n, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def made(seed, sources, docs, words=60):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["", "Ä", "世"]) + "".join(rng.choice("abcdeFG") for _ in range(rng.randint(1, 4))) for _ in range(words)]
    own = {s: rng.sample(vocabulary, rng.randint(1, 12)) for s in range(sources)}
    rows = []
    for i in range(docs):
        s = 0 if rng.random() < 0.35 else rng.randrange(sources)  # a hot source
        text = rng.choice([" ", "-", "1", "\n"]).join(rng.choice(own[s] + vocabulary[:3]) for _ in range(rng.randint(0, 30)))
        rows.append((i, text, rng.choice(["en", "fr"]), f"src{s}"))
    rows += [rows[0]] * 3 + [(900, None, "en", "src1"), (901, "", "en", "only blank"), (None, "abc abc", None, None), (902, "abc", "de", None), (903, "!!", "de", "x"), (904, "é" * 50000 + " abc" * 5000, "en", "sré")]
    return rows


@pytest.mark.parametrize("heavy,block,size,least", [(4, 128, 500_000, 2), (4, 3, 20, 2), (1, 4, 50, 3), (10**6, 5, 40, 2), (4, 2, 7, 30), (4, 128, 500_000, 10**6)])
def test_the_definition(spark, heavy, block, size, least):
    rows = made(heavy + block, 14, 160)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS term", "2 AS count", "3 AS docs", "'x' AS item", "4 AS value", "5 AS base", "6 AS p").repartition(6)
    got = divergence(df, least_docs=least, heavy=heavy, block=block, rows=size)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = sorted(map(tuple, got.collect()))
    assert got == brute(rows, least) and got


def test_top_terms_and_ties(spark):
    rows = [(i, f"t{i % 9} t{i % 9} é{i % 4}", "en", f"s{i % 3}") for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, divergence(df, least_docs=5, top=2).collect())) == brute(rows, 5, 2)


def test_tables_without_rows_or_pairs(spark):
    assert divergence(spark.createDataFrame([], SCHEMA)).collect() == []
    assert divergence(spark.createDataFrame([(1, "a b", "en", "s")], SCHEMA)).collect() == []
    two = divergence(spark.createDataFrame([(1, "a b", "en", "s"), (2, None, "en", "t")], SCHEMA)).collect()
    assert sorted(map(tuple, two)) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_terms_are_those_of_the_pattern(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(dv, "SLICE", 16)
    for _ in range(200):
        text = "".join(rng.choice("aZ@[`{\x00\x7f\x80é世😀 _-9") for _ in range(rng.randint(0, 120)))
        assert [t.decode() for part in terms(text.encode()) for t in part] == TERM.findall(lower(text))


def test_counts_are_handed_on_when_many_are_held(monkeypatch):
    rows = made(5, 6, 80)
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], pa.string()) for k in (2, 3, 1)], ["lang", "source", "text"]) for part in (rows[:30], rows[30:])]

    def summed():
        out, parts = Counter(), list(dv._counted(iter(batches)))
        for r in (r for b in parts for r in b.to_pylist()):
            out[r["lang"], r["source"], r["term"], "count"] += r["count"]
            out[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        return len(parts), out

    n, want = summed()
    monkeypatch.setattr(dv, "HELD", 5)
    more, got = summed()
    assert n == 1 < more and got == want


def test_one_sided_sums():
    rng = np.random.default_rng(1)
    for _ in range(50):
        own = int(rng.integers(0, 50))
        p, n, bases = rng.integers(own, 100, 12), rng.integers(1, 9, 12), rng.integers(0, 100, 7)
        assert one_sided(p, n, own, bases).tolist() == [int(sum(k * (abs(x - b) - abs(own - b)) for x, k in zip(p, n))) for b in bases.tolist()]
