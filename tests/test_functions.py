import random
import re
import time
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenrec.functions import text as tx
from lumenrec.functions.arrays import GENRES, distinct_names, multi_hot
from lumenrec.functions.fuzzy import partial_ratio, processed
from lumenrec.functions.hashing import hashed, murmur3, signed_hash
from lumenrec.functions.vectors import cosine, distance_score, similarity_score, squared_l2


@pytest.mark.parametrize("data,seed,want", [(b"", 0, 0), (b"", 1, 0x514E28B7), (b"hello", 0, 0x248BFA47), (b"hello, world", 0, 0x149BBB7F), (b"\xff\xff\xff\xff", 0, 0x76293B50), (b"!Ce\x87", 0, 0xF55B516B), (b"!Ce", 0, 0x7E4A8634), (b"!C", 0, 0xA0F7B07A), (b"!", 0, 0x72661CF4), (b"The quick brown fox jumps over the lazy dog", 0, 0x2E4FF723)])
def test_murmur3_vectors(data, seed, want):
    assert murmur3(data, seed) == want


def test_signed_hash(spark):
    h = murmur3(b"MAPPA")
    signed = h - (1 << 32) if h >= 1 << 31 else h
    want = [0.0] * 75
    want[abs(signed) % 75] = 1.0 if signed >= 0 else -1.0
    assert hashed(["MAPPA"], 75) == want
    assert hashed(["a", "a"], 8) == [2 * x for x in hashed(["a"], 8)]
    df = spark.createDataFrame([(["a", "b"],), ([],), (None,), (["a", None],)], "n array<string>")
    got = [r.v for r in df.select(signed_hash(F.col("n"), 16).alias("v")).collect()]
    assert got == [hashed(["a", "b"], 16), [0.0] * 16, [0.0] * 16, hashed(["a"], 16)]


def test_multi_hot(spark):
    df = spark.createDataFrame([([(1, "b"), (2, "zz"), (1, "b")],), ([],)], "g array<struct<id long, name string>>")
    assert [r.v for r in df.select(multi_hot(distinct_names(F.col("g")), ["c", "b", "a"]).alias("v")).collect()] == [[0, 1, 0], [0, 0, 0]]
    assert len(GENRES) == len(set(GENRES)) == 78


def test_score_ladder(spark):
    r = spark.range(1).select(*[distance_score(F.lit(float(d))).alias(f"d{d}") for d in (0, 1)], similarity_score(F.lit(0.5)).alias("half"), similarity_score(F.lit(0.5), "raw").alias("raw")).first()
    assert (r.d0, round(r.d1, 12), r.half, r.raw) == (1.0, 0.5, 0.75, 0.5)
    assert round(0.6 * r.d0 + 0.1 * r.d0, 12) == 0.7 and round(0.6 * r.d1, 12) == 0.3


def test_vector_expressions(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    rows = df.select(cosine(F.col("a"), F.col("b")).alias("c"), squared_l2(F.col("a"), F.col("b")).alias("d")).collect()
    assert [(round(r.c, 6), r.d) for r in rows] == [(0.707107, 1.0), (0.0, 2.0)]


DIRTY = [
    ("see https://a.b/c?d=1 now", "see now"), ("www.x.org", ""), ("mail me@x.org!", "mail !"), ("call +49 30 1234 5678 today", "call today"),
    ("<b>bold</b> text", "bold text"), ("Good. (Source: web)", "Good."), ("Good (source: x))", "Good"), ("[Written by some one] end", "end"),
    ("[written by me]", "[written by me]"), ("a\n\n b\tc\x0bd\xa0e", "a b c d e"), ("ﬁne café — naïve", "fine cafe - naive"), ("Straße", "Strasse"),
    ("smile 😀 end", "smile end"), ("数字", "数字"), (None, None), ("", ""), ("   ", ""), ("(a source)", "(a source)"),
]


def test_clean_text(spark):
    df = spark.createDataFrame([(a,) for a, _ in DIRTY], "t string")
    assert [r.c for r in df.select(tx.clean_text(F.col("t")).alias("c")).collect()] == [b for _, b in DIRTY]


def test_nfkc(spark):
    rows = spark.createDataFrame([("ﬁ",), ("①",), (None,), ("plain",)], "t string").select(tx.nfkc("t").alias("n")).collect()
    assert [r.n for r in rows] == ["fi", "1", None, "plain"]


@given(st.text(max_size=40))
def test_folded_has_no_marks(text):
    assert not any(unicodedata.combining(c) for c in tx.folded(text))


def plain_place(short, long):
    best = 0.0
    for lo in range(-len(short) + 1, len(long)):
        w = long[max(0, lo) : lo + len(short)]
        row = [0] * (len(w) + 1)
        for c in short:
            diagonal = 0
            for k, x in enumerate(w, 1):
                diagonal, row[k] = row[k], diagonal + 1 if c == x else max(row[k], row[k - 1])
        best = max(best, 200.0 * row[-1] / (len(short) + len(w)) if w else 0.0)
    return best


def plain_ratio(a, b):
    a, b = processed(a), processed(b)
    if not a or not b:
        return 0
    tries = [plain_place(x, y) for x, y in ((a, b), (b, a)) if len(x) <= len(y)]
    return int(round(max(tries)))


@given(st.text("abcd ", max_size=14), st.text("abcd ", max_size=14))
def test_partial_ratio_against_its_definition(a, b):
    assert partial_ratio(a, b) == plain_ratio(a, b) == partial_ratio(b, a)


@pytest.mark.parametrize("q,t,want", [("One", "Stone Ocean", 100), ("death", "DEATH NOTE", 100), ("", "x", 0), ("abcd", "xyz", 0), ("note!", "Death Note", 100)])
def test_partial_ratio(q, t, want):
    assert partial_ratio(q, t) == want


PIECES = ["a", "b.c", "@", "x@y.z", "+", "a@b.co+x@d.com", "@@", ".", "-", " ", "<", ">", "<b>", "\n", "(source", "( Source: web", "(+source", ")", "))", "(", "[Writ", "[Written by", "by", "]", "[", "ten ", "é", " "]


def test_patterns_that_read_once_match_alike(spark):
    """The functions against the plain patterns, over every kind of broken start."""
    rng = random.Random(12)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    made = {"email": (tx.replace_emails, tx.EMAIL, "<EMAIL>"), "tag": (tx.strip_tags, tx.TAG, ""), "source": (tx.strip_source, tx.SOURCE, ""), "credit": (tx.strip_credit, tx.CREDIT, "")}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", *[f(F.col("t")).alias(k) for k, (f, _, _) in made.items()], tx.collapse_space(F.col("t")).alias("space")).collect()
    for r in got:
        for k, (_, pattern, by) in made.items():
            assert r[k] == re.sub(pattern, by, r.t, flags=re.ASCII if k == "email" else 0), (k, r.t)
        assert r.space == re.sub(r"\s+", " ", r.t).strip(" ")


@pytest.mark.parametrize("piece", ["a", "a.", "<", "<a", "(source", "[Writ", "[Writ by", "[Written by ", "(", "@", "a@", "1 ", "www.", " ", "\t\n"])
def test_one_text_of_a_megabyte(spark, piece):
    df = spark.createDataFrame([(piece * (1_000_000 // len(piece)),)], "t string").select(tx.clean_text(F.col("t"), fold=False).alias("c"))
    df.where("length(c) < 0").count()
    began = time.time()
    df.agg(F.sum(F.length("c"))).collect()
    assert time.time() - began < 4
