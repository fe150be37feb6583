import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with those the operators use."""

    def make(rows, extra=True):
        full = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("key", "fp", "h", "recipe", "score", "kept", "component_id", "node", "a", "b", "block", "path", "_digest", "hash", "_id", "_hash", "pack", "rows", "shard", "train", "body", "data", "answers", "posting", "rep", "cluster", "fps", "text_hash", "c0", "bin_id", "n_words"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


@pytest.fixture(scope="session")
def texts():
    """Random texts with exact copies, near copies, blank, empty, null and very long ones."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(120)]
    for _ in range(60):
        own = rng.choice(out[:120]).split(" ")
        own[rng.randrange(len(own))] = rng.choice(words)
        out.append(" ".join(own))
    out += [rng.choice(out).upper() for _ in range(20)] + [rng.choice(out) for _ in range(40)]
    out += [None, "", "   ", "\n\t", "a", "a b", "É à b c d e", " ".join(rng.choice(words) for _ in range(30000))]
    rng.shuffle(out)
    return out
