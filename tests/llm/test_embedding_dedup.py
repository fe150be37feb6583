import numpy as np
import pytest

from lumenrec.llm.embedding_dedup import near_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, node string, cell string, n string"


def brute(rows, threshold=0.95):
    good, out = [], {}
    for k, (i, v) in enumerate(rows):
        ok = v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if ok else None)
    links = [[b for b in range(len(rows)) if b != a and good[a] is not None and good[b] is not None and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold] for a in range(len(rows))]
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        least = min(ids) if ids else None
        out[a] = (rows[a][0], len(links[a]), least, rows[a][0] == least)
    return list(out.values())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 16)).astype(np.float32)
    near = base[rng.integers(0, 40, 300)] + rng.normal(size=(300, 16)).astype(np.float32) * 0.03
    hot = base[3] + rng.normal(size=(150, 16)).astype(np.float32) * 0.15
    v = [x.tolist() for x in np.concatenate([base, near, hot, base[:60], base[5:6].repeat(30, 0), base[9:10] * 4])]
    rng.shuffle(v)
    return list(enumerate(v))


ODD = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [None] * 16), (5005, [float("inf")] + [0.0] * 15), (5006, [1.0, 2.0]), (5007, [1.0, 2.0]), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "x", "x") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("block,most", [(2048, 2048), (40, 2048), (2048, 5), (40, 5)])
def test_against_brute_force(spark, rows, block, most):
    every = rows + ODD + [(None, rows[0][1]), (rows[1][0], rows[1][1])]
    df = frame(spark, every)
    got = sorted((tuple(r) for r in near_dedup(df, per_cell=50, block=block, most=most).collect()), key=str)
    want = sorted(((i, n, c, k) for i, n, c, k in brute(every)), key=str)
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert len(got) == len(want) and found <= there and found >= 0.9 * there
    exact = sorted((tuple(r) for r in near_dedup(df, per_cell=50, visits=400, block=block, most=most).collect()), key=str)
    assert exact == want


def test_every_length_is_compared(spark):
    rng = np.random.default_rng(2)
    every = [(k, rng.normal(size=8).tolist()) for k in range(6)] + [(10, [1.0, 0.0]), (11, [1.0, 0.01]), (12, [0.0, 1.0]), (13, [3.0]), (14, [5.0]), (15, [-1.0])]
    for m, size in enumerate((3, 5)):  # two lengths that have several cells
        base = rng.normal(size=(150, size))
        every += [(100 * (m + 1) + k, (base[k % 150] + (rng.normal(size=size) * 0.1 if k >= 150 else 0)).tolist()) for k in range(300)]
    every = [(k, v) for k, (_, v) in enumerate(every)]
    got = sorted(tuple(r) for r in near_dedup(frame(spark, every), per_cell=40, visits=100).collect())
    assert got == sorted(brute([(i, np.float32(v).tolist()) for i, v in every]))
    assert got[6][1] == got[7][1] == 1 and got[9][1] == 1 and sum(g[1] > 0 for g in got) > 100


def test_empty(spark):
    assert near_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in near_dedup(spark.createDataFrame([(4, None, 0, "", "", "")], SCHEMA)).collect()] == [(4, 0, 4, True)]
