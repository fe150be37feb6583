import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lumenrec.llm import language_model
from lumenrec.llm.language_model import END, EXACT, FINE, START, Tokens, _tokenised, bucket, expand, hyperparameters, log_seating, log_ways, mixed, recursion, score_documents, slice_step, squeeze, stirling, tables, tallied, unbucket, uniform


def rest(i, parts=5):
    return zlib.crc32(("" if i is None else str(i)).encode()) % parts


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


@pytest.mark.parametrize("size, shards", [(None, 1), (2000, 1), (2000, 9)])
def test_counts_and_base_against_brute_force(make_docs, monkeypatch, texts, size, shards):
    monkeypatch.setattr(language_model, "shards_for", lambda packs: shards)
    rows = list(enumerate(texts)) + [(None, texts[1]), (4, texts[4])]
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in score_documents(make_docs(rows), size=size).collect()), key=str)
    c = Counter(t for i, x in rows if rest(i) != 1 for t in [*words(x), None])
    n, v = sum(c.values()), len(c)
    want = []
    for i, x in rows:
        own = [*words(x), None]
        want.append((i, rest(i) == 1, len(own), sum(c[t] > 0 for t in own), n, round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own), 6)))
    assert got == sorted(want, key=str)


def test_probabilities_of_every_context_add_up(make_docs):
    rng = np.random.default_rng(1)
    vocabulary = ["a", "b", "c", "d", "e"]
    train = [k for k in range(5000) if rest(k) != 1][:300]
    held = iter(k for k in range(5000) if rest(k) == 1)
    rows = [(k, " ".join(rng.choice(vocabulary, rng.integers(0, 9), p=[0.5, 0.2, 0.15, 0.1, 0.05]))) for k in train]
    each = [*vocabulary, "unheard"]
    asked = {t: next(held) for t in ["", *each, *(f"{u} {w}" for u in each for w in each)]}
    rows += [(k, t) for t, k in asked.items()]
    got = {r.doc_id: 10**r.score for r in score_documents(make_docs(rows)).collect()}
    p = {t: got[k] for t, k in asked.items()}
    n = len(each)
    b = np.array([p[w] for w in each])  # P(w | start) P(end | w)
    r = np.array([[p[f"{u} {w}"] / p[w] for w in each] for u in each])  # P(u | start) P(w | u) / P(w | start)
    a = np.linalg.solve(np.eye(n) - r, b)  # as P(w | u) over all w and the end add up to 1
    assert a.min() > 0 and abs(a.sum() + p[""] - 1) < 1e-9
    assert all(0 < x < 1 for x in b / a)


def test_beats_the_base_on_held_out_texts(make_docs):
    rng = np.random.default_rng(2)
    follow = {w: [f"w{k}" for k in rng.integers(0, 60, 4)] for w in [f"w{k}" for k in range(60)]}
    rows = []
    for k in range(600):
        out = ["w0"]
        for _ in range(40):
            out.append(rng.choice(follow[out[-1]]) if rng.random() < 0.9 else f"w{rng.integers(0, 60)}")
        rows.append((k, " ".join(out)))
    got = [r for r in score_documents(make_docs(rows)).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)
    assert all(abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in got)


def test_sweeps_go_on_from_each_other_until_tables_settle(make_docs, monkeypatch):
    rng = np.random.default_rng(4)
    p = 1 / np.arange(1, 801)
    rows = [(k, " ".join(f"w{j}" for j in rng.choice(800, 60, p=p / p.sum()))) for k in range(400)]
    seen, plain = [], language_model._totals
    monkeypatch.setattr(language_model, "_totals", lambda answers: seen.append(plain(answers)) or seen[-1])
    monkeypatch.setattr(language_model, "hyperparameters", lambda d, strength, *rest: (d, strength))
    score_documents(make_docs(rows), burn_in=9, kept=3).count()
    customers = np.array([s["customers"] for s in seen[1:]])  # of the parent: tables of all pairs
    beyond = customers - customers[0]
    settled = beyond[-3:].mean()
    assert len(beyond) == 13 and beyond[1] < 0.95 * settled and abs(beyond[language_model.BURN_IN] - settled) < 0.1 * settled


def plain_scores(rows, burn_in, kept, shards):
    """The same chain with plain dictionaries: the exact conditionals by recursion, the same draws."""
    import xxhash

    key = lambda w: END if w is None else START if w == "" else np.uint64(xxhash.xxh3_64_intdigest(w.encode()))
    chains = {i: ["", *words(x), None] for i, x in rows}
    words_of = sorted({t for c in chains.values() for t in c}, key=key)
    shard = {t: min(int(key(t)) // ((1 << 64) // shards), shards - 1) for t in words_of}
    rank = {t: n - sum(shard[o] < shard[t] for o in words_of) for n, t in enumerate(words_of)}
    pairs, guests = Counter(), Counter()
    for i, c in chains.items():
        if rest(i) != 1:
            pairs.update(zip(c, c[1:]))
            guests.update(c[:-1])
    distinct = len({w for _, w in pairs})
    coin = lambda key, draw: uniform(np.array([key], np.uint64), 100 * draw)[0]
    discount = lambda c: min(0.95, max(0.05, sum(n == 1 for n in c.values()) / max(1, sum(n == 1 for n in c.values()) + 2 * sum(n == 2 for n in c.values()))))
    counts = Counter(w for c in [chains[i] for i, _ in rows if rest(i) != 1] for w in c[1:])
    d, strength = {"pair": discount(pairs), "word": discount(counts)}, {"pair": 1.0, "word": 1.0}
    t = dict.fromkeys(pairs, 1)
    total = lambda at: Counter() if not t else sum((Counter({p[at]: n}) for p, n in t.items()), Counter())
    seats, n = total(0), total(1)
    k = dict.fromkeys(n, 1)
    states = []

    def draw(c, others, parent, level, key, number):
        ways = recursion(d[level], c + 1, c + 1)[c, 1 : c + 1]
        m = np.arange(c)
        w = ways + np.cumsum(np.log((strength[level] + d[level] * (others + m)) * parent)) - np.log((strength[level] + d[level] * others) * parent)
        w = np.cumsum(np.exp(w - w.max()))
        return 1 + int((w < coin(key, number) * w[-1]).sum())

    for sweep in range(burn_in + kept):
        customers, tables_of = sum(n.values()), sum(k.values())
        parent = lambda w: (n[w] - d["word"] * k.get(w, 0) + (strength["word"] + d["word"] * tables_of) / (distinct + 1)) / (strength["word"] + customers)
        t = {(u, w): draw(c, seats[u] - t[u, w], parent(w), "pair", mixed(np.array([key(u)]), np.array([key(w)]))[0], 2 * sweep) if c > 1 else 1 for (u, w), c in pairs.items()}
        seats, n = total(0), total(1)
        k = {w: draw(c, tables_of - k[w], 1 / (distinct + 1), "word", mixed(np.array([rank[w]], np.uint64), np.uint64(shard[w] + 7))[0], 2 * sweep + 1) if c > 1 else 1 for w, c in n.items()}
        level = lambda name, c, m: tallied(np.array([x for w, x in c.items() if x > 1]), np.array([m[w] for w, x in c.items() if x > 1]))
        for name, dishes, seated, guest, number in (("pair", level("pair", pairs, t), tallied(np.array(list(seats.values()))), tallied(np.array(list(guests.values()))), 0), ("word", level("word", n, k), {(int(bucket(sum(k.values()))),): 1}, {(int(bucket(sum(n.values()))),): 1}, 1)):
            d[name], strength[name] = hyperparameters(d[name], strength[name], dishes, seated, guest, 2 * sweep + number)
        if sweep >= burn_in:
            states.append((dict(d), dict(strength), dict(t), Counter(seats), Counter(n), dict(k)))
    out = {}
    for i, c in chains.items():
        total_log = 0.0
        for u, w in zip(c, c[1:]):
            p = 0.0
            for dd, ss, tt, seated, nn, kk in states:
                parent = (nn[w] - dd["word"] * kk.get(w, 0) + (ss["word"] + dd["word"] * sum(kk.values())) / (distinct + 1)) / (ss["word"] + sum(nn.values()))
                p += (pairs[u, w] - dd["pair"] * tt.get((u, w), 0) + (ss["pair"] + dd["pair"] * seated[u]) * parent) / (ss["pair"] + guests[u])
            total_log += math.log10(p / len(states))
        out[i] = total_log
    return out


@pytest.mark.parametrize("burn_in, kept, size, shards", [(0, 1, None, 1), (2, 3, None, 1), (2, 2, 900, 6)])
def test_scores_against_a_plain_sampler(make_docs, monkeypatch, burn_in, kept, size, shards):
    monkeypatch.setattr(language_model, "shards_for", lambda packs: shards)
    rng = np.random.default_rng(11)
    p = 1 / np.arange(1, 61)
    rows = [(k, " ".join(f"w{j}" for j in rng.choice(60, int(rng.integers(0, 30)), p=p / p.sum()))) for k in range(150)] + [(400, None), (401, "unheard of")]
    want = plain_scores(rows, burn_in, kept, shards)
    got = {r.doc_id: r.score for r in score_documents(make_docs(rows), size=size, burn_in=burn_in, kept=kept).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-7 * max(1, abs(want[i])) for i in want)


def one_by_one(rows, burn_in, kept, seed):
    """Scores of a chain in which every dish is drawn after the one before it has been seated, and discounts and strengths from grids."""
    rng = np.random.default_rng(seed)
    chains = {i: ["", *words(x), None] for i, x in rows}
    pairs, guests = Counter(), Counter()
    for i, c in chains.items():
        if rest(i) != 1:
            pairs.update(zip(c, c[1:]))
            guests.update(c[:-1])
    distinct = len({w for _, w in pairs})
    d, strength = {"pair": 0.5, "word": 0.5}, {"pair": 1.0, "word": 1.0}
    t = dict.fromkeys(pairs, 1)
    seats, n = Counter(u for u, _ in t), Counter(w for _, w in t)
    k = dict.fromkeys(n, 1)
    states = []

    def draw(c, others, parent, level):
        m = np.arange(c)
        w = recursion(d[level], c + 1, c + 1)[c, 1 : c + 1] + np.cumsum(np.log((strength[level] + d[level] * (others + m)) * parent))
        w = np.exp(w - w.max())
        return 1 + int(rng.choice(c, p=w / w.sum()))

    for sweep in range(burn_in + kept):
        for (u, w), c in pairs.items():
            if c > 1:
                seats[u] -= t[u, w]
                n[w] -= t[u, w]
                customers, tables_of, own = sum(n.values()), sum(k.values()) - k[w], min(k[w], n[w])
                parent = (n[w] - d["word"] * own + (strength["word"] + d["word"] * (tables_of + own)) / (distinct + 1)) / (strength["word"] + customers)
                t[u, w] = draw(c, seats[u], parent, "pair")
                seats[u] += t[u, w]
                n[w] += t[u, w]
                k[w] = draw(n[w], tables_of, 1 / (distinct + 1), "word")
        for w in n:
            if n[w] > 1:
                k[w] = draw(n[w], sum(k.values()) - k[w], 1 / (distinct + 1), "word")
        tally = lambda c, m: Counter((c[x], m[x]) for x in c if c[x] > 1)
        for name, dishes, seated, guest in (("pair", tally(pairs, t), Counter((x,) for x in seats.values()), Counter((x,) for x in guests.values())), ("word", tally(n, k), {(sum(k.values()),): 1}, {(sum(n.values()),): 1})):
            ways, opened = log_seating({(int(bucket(a)), int(bucket(b))): x for (a, b), x in dishes.items()}, {(int(bucket(a)),): x for (a,), x in seated.items()}, {(int(bucket(a)),): x for (a,), x in guest.items()})
            for grid, log_p in ((np.linspace(0.02, 0.98, 60), lambda x: ways(x) + opened(x, strength[name])), (np.linspace(np.log(0.01), np.log(1e5), 80), lambda x: opened(d[name], np.exp(x)))):  # noqa: B023
                p = np.array([log_p(x) for x in grid])
                x = float(rng.choice(grid, p=np.exp(p - p.max()) / np.exp(p - p.max()).sum()))
                (d if len(grid) == 60 else strength)[name] = x if len(grid) == 60 else float(np.exp(x))
        if sweep >= burn_in:
            states.append((dict(d), dict(strength), dict(t), Counter(seats), Counter(n), dict(k)))
    out = {}
    for i, c in chains.items():
        out[i] = 0.0
        for u, w in zip(c, c[1:]):
            p = 0.0
            for dd, ss, tt, seated, nn, kk in states:
                parent = (nn[w] - dd["word"] * kk.get(w, 0) + (ss["word"] + dd["word"] * sum(kk.values())) / (distinct + 1)) / (ss["word"] + sum(nn.values()))
                p += (pairs[u, w] - dd["pair"] * tt.get((u, w), 0) + (ss["pair"] + dd["pair"] * seated[u]) * parent) / (ss["pair"] + guests[u])
            out[i] += math.log10(p / len(states))
    return out


def test_drawing_side_by_side_gives_the_scores_of_drawing_one_by_one(make_docs):
    """The bias of seating all dishes of a sweep at once, which is small against the spread of scores."""
    rng = np.random.default_rng(12)
    p = 1 / np.arange(1, 61)
    rows = [(k, " ".join(f"w{j}" for j in rng.choice(60, int(rng.integers(5, 30)), p=p / p.sum()))) for k in range(150)]
    plain = [one_by_one(rows, 8, 8, seed) for seed in (1, 2)]
    got = {r.doc_id: r.score for r in score_documents(make_docs(rows), burn_in=language_model.BURN_IN, kept=language_model.KEPT).collect()}
    total = [sum(x.values()) for x in (*plain, got)]
    assert abs(total[2] / total[0] - 1) < 0.01 and abs(total[2] / total[1] - 1) < 0.01
    away = [abs(got[i] - plain[0][i]) / abs(plain[0][i]) for i in got]
    assert np.mean(away) < 0.02 and max(away) < 0.1


def test_hyperparameters_against_the_definition():
    """The probability of a seating by its factors, customer by customer, up to what does not depend on the two numbers."""
    dishes, d, strength = [(5, 2), (3, 3), (40, 6), (2, 1), (33, 32), (7, 7)], 0.4, 2.5
    restaurants = [(45, 9), (30, 12), (15, 15)]  # customers and tables
    ways, opened = log_seating(tallied(*np.array(dishes).T), tallied(np.array([t for _, t in restaurants])), tallied(np.array([c for c, _ in restaurants])))
    want = sum(math.log(strength + d * i) for _, t in restaurants for i in range(1, t)) - sum(math.log(strength + i) for c, _ in restaurants for i in range(1, c))
    assert abs(opened(d, strength) - want) < 1e-8
    assert abs(ways(d) - sum(recursion(d, 41, 41)[int(unbucket(bucket(c))), int(unbucket(bucket(t)))] for c, t in dishes)) < 1e-6


@pytest.mark.parametrize("width", [0.1, 1.0])
@pytest.mark.parametrize("sd", [2.0, 0.3, 0.05, 0.001])
def test_steps_have_the_mean_and_spread_of_their_density(width, sd):
    """As the chain takes them, from a start far from the peak."""
    rng = np.random.default_rng(1)
    coins, x, got = iter(rng.random(400_000)), -4.0, []
    for _ in range(6_000):
        x = slice_step(lambda v: -((v - 0.3) ** 2) / 2 / sd**2, x, -5.0, 5.0, width, coins)
        got.append(x)
    grid = np.linspace(-5, 5, 200_001)
    p = np.exp(-((grid - 0.3) ** 2) / 2 / sd**2)
    mean = (grid * p).sum() / p.sum()
    spread = np.sqrt(((grid - mean) ** 2 * p).sum() / p.sum())
    assert abs(np.mean(got[50:]) - mean) < 0.12 * spread and abs(np.std(got[50:]) / spread - 1) < 0.1


def test_discounts_and_strengths_have_the_spread_of_their_posterior():
    """Of a seating of 40 customers at 12 tables, against a grid over both."""
    dishes, seats, guests = {(9, 3): 2, (7, 2): 2, (8, 2): 1}, {(12,): 1}, {(40,): 1}
    ways, opened = log_seating(dishes, seats, guests)
    d, s = np.linspace(0.02, 0.98, 97), np.linspace(np.log(0.01), np.log(1e5), 120)
    log_p = np.array([[ways(x) + opened(x, np.exp(y)) for y in s] for x in d])
    p = np.exp(log_p - log_p.max())
    p /= p.sum()
    mean, log_mean = (d * p.sum(1)).sum(), (s * p.sum(0)).sum()
    spread, log_spread = np.sqrt((((d - mean) ** 2) * p.sum(1)).sum()), np.sqrt((((s - log_mean) ** 2) * p.sum(0)).sum())
    at, got = (0.9, 1e4), []
    for k in range(2_500):
        at = hyperparameters(*at, dishes, seats, guests, k)
        got.append((at[0], np.log(at[1])))
    own, logs = np.array(got[100:]).T
    assert abs(own.mean() - mean) < 0.25 * spread and abs(own.std() / spread - 1) < 0.2 and spread > 0.1
    assert abs(logs.mean() - log_mean) < 0.25 * log_spread and abs(logs.std() / log_spread - 1) < 0.2


def test_hyperparameters_find_those_of_a_seating():
    rng = np.random.default_rng(2)
    d, strength, restaurants = 0.6, 5.0, []
    for _ in range(200):
        tables_of: list[int] = []
        for c in range(150):
            p = np.array([*[m - d for m in tables_of], strength + d * len(tables_of)])
            at = rng.choice(len(p), p=p / p.sum())
            if at == len(tables_of):
                tables_of.append(0)
            tables_of[at] += 1
        restaurants.append(tables_of)
    dishes = tallied(np.array([sum(r) for r in restaurants]), np.array([len(r) for r in restaurants]))
    seats, guests = tallied(np.array([len(r) for r in restaurants])), tallied(np.array([sum(r) for r in restaurants]))
    got = (0.3, 1.0)
    for k in range(10):
        got = hyperparameters(*got, dishes, seats, guests, k)
    assert abs(got[0] - d) < 0.1 and 2 < got[1] < 10
    assert hyperparameters(0.3, 1.0, {}, {}, {}, 0) == (0.3, 1.0)


def test_buckets():
    x = np.arange(1, 100_000)
    assert (unbucket(bucket(x[:EXACT])) == x[:EXACT]).all() and (np.abs(np.log(unbucket(bucket(x)) / x)) <= np.log(FINE) / 2 + 0.02).all()


def test_edges(make_docs):
    assert score_documents(make_docs([])).collect() == []
    only = next(k for k in range(100) if rest(k) == 1)
    (r,) = score_documents(make_docs([(only, "x y")])).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_tables_follow_the_exact_conditional():
    d, strength, others, parent = 0.6, 1.0, 7, 0.2
    c, n = 5, 40_000
    keys = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    (t,) = tables(np.full(n, c), np.full(n, others), np.full(n, parent), d, strength, keys, [0])
    ways = {(1, 1): 1.0}
    for k in range(1, c):
        for m in range(1, k + 2):
            ways[k + 1, m] = ways.get((k, m - 1), 0.0) + (k - d * m) * ways.get((k, m), 0.0)
    w = np.array([ways[c, m] * np.prod([strength + d * (others + i) for i in range(m)]) * parent**m for m in range(1, c + 1)])
    assert np.allclose(np.exp(stirling(d)[c, 1 : c + 1]), [ways[c, m] for m in range(1, c + 1)])
    assert np.abs(np.bincount(t, minlength=c + 1)[1:] / n - w / w.sum()).max() < 0.01


def test_tables_of_many_customers():
    keys = np.arange(500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for c, parent in ((EXACT + 1, 1e-4), (100_000, 1e-3), (1_000_000, 0.05)):
        (t,) = tables(np.full(500, c), np.full(500, 2000), np.full(500, parent), 0.7, 1.0, keys, [1])
        assert t.min() >= 1 and t.max() <= c
    assert tables(np.array([0, 1, 2]), np.zeros(3), np.full(3, 0.5), 0.5, 1.0, keys[:3], [0])[0][:2].tolist() == [0, 1]


@pytest.mark.parametrize("d, c, others, parent", [(0.7, 33, 50, 0.9), (0.7, 60, 500, 5e-3), (0.7, 1000, 2000, 5e-3), (0.7, 2000, 5000, 1e-2), (0.05, 400, 900, 0.02), (0.95, 300, 40, 0.3)])
def test_tables_of_over_exact_customers_have_the_exact_mean(d, c, others, parent):
    log_s = np.array([0.0])  # log S[n, t] for t from 1 to n
    for n in range(1, c):
        stay = np.r_[np.log(n - d * np.arange(1, n + 1)) + log_s, -np.inf]
        log_s = np.logaddexp(stay, np.r_[-np.inf, log_s])
    t = np.arange(1, c + 1)
    w = log_s + np.cumsum(np.log(1.0 + d * (others + t - 1)) + math.log(parent))
    w = np.exp(w - w.max())
    mean = (w * t).sum() / w.sum()
    sd = math.sqrt((w * (t - mean) ** 2).sum() / w.sum())
    keys = np.arange(20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    (got,) = tables(np.full(len(keys), c), np.full(len(keys), others), np.full(len(keys), parent), d, 1.0, keys, [0])
    assert abs(got.mean() - mean) < 0.03 * sd and abs(got.std() - sd) < 0.03 * sd


@pytest.mark.parametrize("d", [0.05, 0.4, 0.8, 0.95])
def test_ways_beyond_the_recursion(d):
    """By integrals, and between knots, against the recursion."""
    exact = recursion(d, 2400, 600)
    for c, size in ((40, 600), (1100, 128), (2400, 512), (2400, 600), (1500, 600)):
        got, want = log_ways(np.array([c]), size, d)[0], exact[c, 1 : size + 1]
        there = np.isfinite(want)
        assert (np.isfinite(got) == there).all() and np.abs(got[there] - want[there]).max() < 0.01


def test_squeeze():
    for a in ([], [0], [255, 1], [256], [1 << 33, 5]):
        assert expand(squeeze(np.array(a, np.uint64))).tolist() == a


def test_words_are_cut_as_bytes_are_without_an_object_for_each():
    """Words are those that bytes.split() gives, but they stay in Arrow: Python gets the distinct ones."""
    rng = np.random.default_rng(43)
    signs = ["a", "B", "é", "É", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", "\u3000", "\x00"]
    texts = [None, "", "  ", *("".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(300))]
    tokens = Tokens(_tokenised(pa.table({"text": texts, "train": [True] * len(texts)})))
    words = [(t or "").encode().lower().split() for t in texts]
    assert tokens.sizes.tolist() == [len(x) + 1 for x in words]
    assert tokens.keys[tokens.ids].tolist() == [k for x in words for k in (*map(xxhash.xxh3_64_intdigest, x), int(END))]
    long = pa.table({"text": [f"{'a' * 199} " * 50_000], "train": [True]})
    tracemalloc.start()
    _tokenised(long)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 5e6
