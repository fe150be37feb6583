import hashlib
import random

import pytest

from lumenrec.llm.exact_dedup import LEAST, MOST, chunk_ends, exact_dedup


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows):
    out = []
    for i, t in rows:
        same = [k for k, u in rows if lower(u) == lower(t)]
        keep = max((k for k in same if k is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 5])
def test_against_brute_force(make_docs, texts, bits):
    rows = list(enumerate(texts)) + [(7, texts[7]), (None, texts[8]), (None, "of its own"), (1000, "É"), (1001, "é")]
    got = [tuple(r) for r in exact_dedup(make_docs(rows), hash_bits=bits).drop("text_hash").collect()]
    assert sorted(got, key=str) == plain(rows)


def test_empty_table(make_docs):
    assert exact_dedup(make_docs([])).collect() == []


def test_chunks_follow_content():
    rng = random.Random(1)
    data = bytes(rng.choice(b"abcdef ") for _ in range(300_000))
    cut = lambda d: [d[a:b] for a, b in zip([0, *chunk_ends(d)], chunk_ends(d))]
    first, moved = cut(data), cut(b"inserted " + data)
    assert b"".join(first) == data and all(len(c) <= MOST for c in first) and all(len(c) >= LEAST for c in first[:-1])
    assert len(set(first) & set(moved)) > 0.9 * len(first)
    big = bytes(rng.choice(b"abcdef ") for _ in range(2_200_000))
    assert b"".join(cut(big)) == big
    assert chunk_ends(b"") == [] and chunk_ends(b"x") == [1] and cut(b"z" * 20_000)[0] == b"z" * MOST
