import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lumenrec.llm import substring_dedup
from lumenrec.llm.packs import _pack_bytes, by_shard
from lumenrec.llm.substring_dedup import Words, located, picked_phrases, remove_repeats


def plain(rows, window):
    split = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, split):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows(texts):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    passages = [" ".join(rng.choice(words) for _ in range(n)) for n in (34, 35, 36, 60, 200)]
    out = list(texts)
    for k in range(150):
        own = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            own += [p, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))]
        out.append(rng.choice([" ", "\n", "\t \x0b"]).join(own))
    out += ["z " * 200, "y " * 35, "y " * 36, "x y " * 60, "q\x1cr s\xa0t " * 40]
    return list(enumerate(out)) + [(3, out[3]), (None, passages[4] + " tail")]


@pytest.mark.parametrize("window,size", [(35, None), (35, 3000), (5, 20_000)])
def test_against_brute_force(make_docs, rows, window, size):
    got = [tuple(r) for r in remove_repeats(make_docs(rows).repartition(3), window=window, size=size).collect()]
    want = plain(rows, window)
    assert sorted(got, key=str) == want
    assert any(r[2] for r in want) and any(not r[2] for r in want)


def test_layout_and_empty(make_docs):
    again = " ".join(f"p{k}" for k in range(50))
    docs = make_docs([(1, f"one\ttwo\n{again}\nthree  four"), (2, f"{again} five"), (3, "six\n\nseven"), (4, None)])
    got = {r.doc_id: r.kept for r in remove_repeats(docs, layout=True).collect()}
    assert got == {1: "one\ttwo\nthree  four", 2: "five", 3: "six\n\nseven", 4: ""}
    assert remove_repeats(make_docs([])).collect() == []
    assert [tuple(r) for r in remove_repeats(make_docs([(7, None)])).collect()] == [(7, 0, 0, "")]


def pack_of(texts):
    return Words(_pack_bytes(pa.table({"text": texts})))


@pytest.mark.parametrize("most", [100_000, 7])
def test_automata_locate_every_occurrence(most):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "z", "a b"]
    words = pack_of(texts)
    flat = [w for t in texts for w in (t or "").encode().split()]
    _, phrases, _ = picked_phrases(words, 9, 4)
    assert len(phrases) > 20
    found = located(words, phrases, 4, most)
    doc = np.repeat(np.arange(len(texts)), words.sizes)
    asked = {p.decode() for p in phrases}
    for k in range(len(flat)):
        own = k + 4 <= len(flat) and doc[k] == doc[k + 3] and b" ".join(flat[k : k + 4]).decode() in asked
        assert found[k] == own
    assert located(words, [], 4).sum() == 0


def test_other_words_under_one_hash_are_another_phrase(monkeypatch):
    words = pack_of(["a b c d e f", "a b c d", "x y z"])
    monkeypatch.setattr(Words, "rolled", lambda self, size, base: np.zeros(len(self.ids) - size + 1, np.uint64))
    _, phrases, twice = picked_phrases(words, 3, 3)
    assert set(phrases) == {b"a b c", b"b c d", b"c d e", b"d e f", b"x y z"}


def test_the_result_comes_from_the_automata(make_docs, rows, monkeypatch):
    """Phrases left out of the automata are not located, and windows that pick them stay."""
    docs = make_docs(rows).repartition(1)
    packed, shards = substring_dedup.pack(docs.selectExpr("doc_id", "text"), 10**9)
    ((number, data),) = packed.select("pack", "data").collect()
    words = Words(data)
    keys, phrases, twice = picked_phrases(words, 35, 8)
    again = [p for p, t in zip(phrases, twice) if t]
    starts, at, _ = words.picks(35, 8)
    every, fewer = located(words, again, 8)[at], located(words, again[1:], 8)[at]
    assert every.sum() > fewer.sum() > 0


def test_shards_of_keys():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64))
    keys[-1] = 2**64 - 1
    for shards in (1, 2, 3, 1000):
        full, bounds = by_shard(keys, shards)
        assert bounds[0] == 0 and bounds[-1] == 500 and (np.diff(bounds) > 0).all() and full.max() < shards
        assert np.repeat(full, np.diff(bounds)).tolist() == [min(int(k) // ((1 << 64) // shards), shards - 1) for k in keys]
    full, bounds = by_shard(keys[:0], 4)
    assert full.tolist() == [] and bounds.tolist() == [0]
