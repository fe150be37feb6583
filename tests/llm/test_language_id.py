"""Cross-parsing against a plain search for substrings, and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from lumenrec.llm import language_id as li
from lumenrec.llm.language_id import Automaton, bits_a_symbol, identify, op12_language_id, suffix_automaton, symbols

SCHEMA = "doc_id bigint, text string, lang string, source string"


def phrases(text, pieces):
    """Of text, taken from left to right the longest stretches that a piece holds, or single symbols."""
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and any(text[at : end + 1] in p for p in pieces):
            end += 1
        n, at = n + 1, end
    return n


def as_text(codes):
    return "".join(map(chr, codes))


def plain_symbols(text):
    out = " "
    for c in text:
        c = c.lower()[0] if c.isalpha() else " "
        out += "" if c == out[-1] == " " else c
    return out


@pytest.mark.parametrize("seed", range(6))
def test_phrases_are_longest_matches(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefghij klé世"
    draw = lambda n: "".join(rng.choice(letters) for _ in range(n))
    pieces = [symbols([draw(rng.randint(1, 120))])[0] for _ in range(rng.randint(1, 8))]
    a, known = Automaton.of(pieces), [as_text(p) for p in pieces]
    texts = [draw(rng.randint(0, 90)) + rng.choice(["", "zq", "Ω", known[0]]) for _ in range(60)] + ["", "Z", *known]
    flat, at, _ = symbols(texts)
    order = np.argsort(-np.diff(at), kind="stable")
    got = np.zeros(len(texts), int)
    got[order] = a.phrases(flat, at[:-1][order], np.diff(at)[order])
    assert got.tolist() == [phrases(as_text(flat[i:j]), known) for i, j in zip(at, at[1:])]


def test_the_automaton_holds_exactly_the_substrings():
    rng = random.Random(3)
    for _ in range(40):
        text = [rng.randrange(3) for _ in range(rng.randint(0, 25))]
        steps = suffix_automaton(text)
        assert len(steps) <= max(2, 2 * len(text))
        own = {tuple(text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1)}
        found, todo = set(), [((), 0)]
        while todo:
            word, s = todo.pop()
            found.add(word)
            todo += [((*word, c), t) for c, t in steps[s].items()]
        assert found == own


def test_symbols():
    texts = ["Ab,c  D", "", " x ", "É!!", "123", "İi", "a\nb"]
    flat, at, letters = symbols(texts)
    assert [as_text(flat[i:j]) for i, j in zip(at, at[1:])] == [plain_symbols(t) for t in texts]
    assert letters.tolist() == [True, False, True, True, False, True, True]


def test_lanes_and_slices_add_up(monkeypatch):
    rng = random.Random(7)
    a = Automaton.of([symbols(["".join(rng.choice("abc ") for _ in range(400))])[0]])
    texts = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (0, 1, 50, 5000, 10, 900)]
    whole, size, _ = bits_a_symbol([a], texts)
    monkeypatch.setattr(li, "HELD", 300)
    sliced, more, _ = bits_a_symbol([a], texts)
    assert np.all(more - size <= [len(t) // 300 + 1 for t in texts])
    assert np.allclose(whole, sliced, rtol=0.1)
    monkeypatch.setattr(li, "LANE", 64)
    flat, at, _ = symbols(texts)
    got = li.parse([a], texts)[0][:, 0]
    known = [as_text(symbols([""])[0])]
    assert known and got.tolist() == [sum(int(a.phrases(flat, np.array([k]), np.array([min(64, j - k)]))[0]) for k in range(i, j, 64)) for i, j in zip(at, at[1:])]


def made(rng, letters, n):
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(4, 60))) for _ in range(n)]


def test_languages_and_edge_cases(spark, monkeypatch):
    rng = random.Random(11)
    rows, kinds = [], {"aa": "abcdefg", "bb": "cdefghij", "cc": "жзийкл", "": "世界人大小"}
    for lang, letters in kinds.items():
        rows += [(len(rows) + k, t, lang, "s") for k, t in enumerate(made(rng, letters, 60))]
    rows += [(1000 + k, rows[k % len(rows)][1], None, None) for k in range(0, 240, 3)]  # no label teaches nothing
    rows += [(2000, None, "aa", "s"), (2001, "", "aa", "s"), (2002, "12 !! 34", "bb", "s"), (2003, "Ωω", None, None), (None, rows[0][1], "aa", None), (3, rows[3][1], "aa", "s")]
    rows.append((2004, " ".join(rows[70][1] for _ in range(4000)), "bb", "s"))  # very long
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS best", "2 AS bits", "3 AS weight", "4 AS size", "5 AS h", "6 AS chars").repartition(5)
    got = identify(df).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    by_id = {r.doc_id: r for r in got}
    truth = {i: lang for i, _, lang, _ in rows} | {1000 + k: rows[k % 240][2] for k in range(0, 240, 3)}
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (2000, 2001, 2002))
    assert by_id[2003].lang_pred in kinds and by_id[2004].lang_pred == "bb"
    judged = [r for r in got if r.doc_id is not None and r.doc_id < 2000]
    assert sum(r.lang_pred == truth[r.doc_id] for r in judged) >= 0.98 * len(judged)
    one_by_one = identify(df, at_once=1).collect()  # in turns
    assert sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in one_by_one) == sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in got)


def test_the_label_of_a_document_does_not_enter(spark):
    rng = random.Random(13)
    rows = [(k, t, lang, "s") for lang, letters in (("aa", "abcd"), ("bb", "wxyz")) for k, t in enumerate(made(rng, letters, 30), 0 if lang == "aa" else 500)]
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    wrong = [(i, t, "bb" if i in held and lang == "aa" else "zz" if i in held else lang, None if i in held else "s") for i, t, lang, _ in rows]
    a, b = (sorted(map(tuple, identify(spark.createDataFrame(x, SCHEMA)).collect())) for x in (rows, wrong))
    assert a == b and held


def test_nothing_learned(spark):
    rows = spark.createDataFrame([(1, "some words", None, "s"), (2, None, None, None)], SCHEMA)
    assert [tuple(r)[2:] for r in identify(rows).collect()] == [("und", 0.0)] * 2
    assert identify(rows.where("doc_id > 5")).collect() == []
    one = spark.createDataFrame([(k, "some words", "xx", "s") for k in range(8)], SCHEMA)
    assert {tuple(r)[2:] for r in identify(one).collect()} == {("xx", 1.0)}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in op12_language_id(spark, sf).collect() if r.held_out]
    assert len(held) > 200 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
