import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from lumenrec.llm import byte_bpe
from lumenrec.llm.byte_bpe import WIDEST, Encoder, decode, digests, encode

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def samples(texts):
    rng = random.Random(2)
    odd = ["", " ", "\n\n  x", "it's we'll I'd", "naïve café 数字 12345", "😀🏳️‍🌈", "<|endoftext|>", "a" * 5000, "ab" * 700 + " " * 300 + "c", " 　x\x1c\x85y", "aaaa bbbb!!!???...", "\x00\x7f"]
    odd += ["".join(rng.choice("abcdefgh étx 0123'!\n") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    odd += ["".join(chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x400, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(200)) for _ in range(50)]
    odd += ["".join(rng.choice("theraningo") for _ in range(k)) for k in range(1, 700, 13)]
    return odd + [t for t in texts if t]


def test_same_ids_as_the_library(reference, samples):
    own = Encoder(PATH, P.PATTERN)
    for text, got in zip(samples, own.encode(samples)):
        assert np.frombuffer(got, "<u4").tolist() == reference.encode_ordinary(text), text[:80]
        assert own.decode(got) == text.encode()


def test_query_columns(make_docs, reference, samples):
    rows = list(enumerate(samples)) + [(None, "null id"), (9999, None), (1, samples[1])]
    got = sorted((tuple(r) for r in digests(make_docs(rows), PATH, P.PATTERN).collect()), key=str)
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert digests(make_docs([]), PATH, P.PATTERN).collect() == []


def test_pieces_on_both_sides_of_the_widest_row(reference):
    rng = random.Random(7)
    own = Encoder(PATH, P.PATTERN)
    pieces = ["".join(rng.choice(letters) for _ in range(size)) for letters in ("a", "ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "xyéß") for size in range(WIDEST - 3, WIDEST + 4)]
    pieces += ["".join(rng.choice("etaoinshr") for _ in range(200_000)), "=" * 100_000, "ab" * 50_000 + "a", " " * 70_000]
    for text, got in zip(pieces, own.encode(pieces)):
        assert np.frombuffer(got, "<u4").tolist() == reference.encode_ordinary(text), (len(text), text[:40])


def merged(piece, ranks):
    """The definition: merge the leftmost pair of least rank until there is none."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while pairs := [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        _, k = min(pairs)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


def test_any_ranks_against_the_definition(tmp_path, monkeypatch):
    """Ranks in no order: a merge may make a pair that ranks before it."""
    rng = random.Random(9)
    for trial in range(20):
        tokens = [bytes([k]) for k in range(256)] + [bytes(rng.choice(b"abc") for _ in range(size)) for size in (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 5, 6)]
        tokens = list(dict.fromkeys(tokens))
        order = rng.sample(range(len(tokens)), len(tokens))
        path = tmp_path / f"{trial}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in zip(tokens, order)))
        ranks, own = dict(zip(tokens, order)), Encoder(str(path), P.PATTERN)
        pieces = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 60))) for _ in range(40)] + ["a" * 30, "ab" * 20]
        for widest in (1, 8, 256):
            monkeypatch.setattr(byte_bpe, "WIDEST", widest)
            own.known.clear()
            for text, got in zip(pieces, own.encode(pieces)):
                assert np.frombuffer(got, "<u4").tolist() == merged(text.encode(), ranks) or text.encode() in ranks


def test_one_word_of_megabytes(reference):
    word = "".join(random.Random(8).choice("abcdefghij") for _ in range(1_500_000))
    (got,) = Encoder(PATH, P.PATTERN).encode([word])
    assert np.frombuffer(got, "<u4").tolist() == reference.encode_ordinary(word)


def test_ids_and_bytes_of_a_table(make_docs, reference, samples):
    rows = list(enumerate(samples[:60])) + [(None, "null id"), (9999, None)]
    ids = encode(make_docs(rows), PATH, P.PATTERN)
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), bytes(r.data)) for r in decode(ids, PATH, P.PATTERN).collect()}
    assert got == {i: (reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows}
