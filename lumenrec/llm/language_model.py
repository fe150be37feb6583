"""Scores of a hierarchical Pitman-Yor language model over words.

Every word is a context restaurant whose customers are the words that follow it; all of them share one parent, the
restaurant of single words, over a uniform base. Seatings are drawn by Gibbs, all dishes of a sweep side by side: a sweep
draws the tables of a dish anew given the seating of everything else as it stood before the sweep, from the exact
conditional of the number of tables, and then takes a step of slice sampling for the discount and one for the strength of
each level given the seating. A test compares the chain with one that draws dish after dish. The chain starts from one table a dish; after the
first sweeps, which are let go, predictive probabilities are averaged over the states of the later ones.

The model is as large as the corpus and never in one place. Packs of tokenised documents ask shards for the counts of
their words and word pairs. Of the packs that hold a pair one owns it and seats it; only pairs that occur twice can have
more than one table, so sweeps pass over these alone. Owners report tables to the shards of the two words of a pair, which
seat the parent and answer with what the next sweep has to know. After the last sweep owners tell the shards of pairs,
and these all packs, what the scores need. Draws of pairs depend on nothing but the pair and the state before the sweep,
those of the parent also on how many shards there are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import count
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, dropped_after, fold, store, table
from .packs import ASKED, ask_rows, batch, by_shard, in_order, pack_rows, shards_for, told, trim

EXACT = 32  # customers of a dish up to which all numbers of tables are weighed
ROWS, WIDE = 1024, 256  # customers and tables up to which ways come from the recursion; beyond, from integrals
NODES, CACHED = 36, 1 << 22  # of an integral; numbers of ways that a worker keeps
BURN_IN, KEPT = 4, 3  # sweeps whose states are let go, and those whose states are averaged
FINE = 1.05  # ratio of the steps in which numbers over EXACT enter the draws of discounts and strengths
END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"", b"\n"))  # no word is empty or blank
PACK = 4_000_000  # characters of a pack
FACTS, STATE = -1, -2  # in place of a pack's number: what a shard says of itself, and what it tells itself for the next sweep
_MIX = np.uint64(0x9E3779B97F4A7C15)


def squeeze(a: np.ndarray) -> bytes:
    """Numbers from 0 on, as compressed planes of bytes."""
    kind = np.dtype("<u1" if not len(a) or int(a.max()) < 256 else "<u4" if int(a.max()) < 1 << 32 else "<u8")
    planes = np.ascontiguousarray(a.astype(kind)).view(np.uint8).reshape(-1, kind.itemsize).T
    return bytes([kind.itemsize]) + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def expand(data: bytes) -> np.ndarray:
    size = data[0]
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(size, -1).T
    return np.ascontiguousarray(planes).view(f"<u{size}").ravel().astype(np.uint64)


def squeeze_states(states: list[np.ndarray]) -> list[bytes]:
    """The first of several like arrays, and how the others differ from it."""
    apart = [x - states[0] for x in states[1:]]
    return [squeeze(states[0]), *(squeeze(x << 1 ^ x >> 63) for x in apart)]


def expand_states(data: list[bytes]) -> list[np.ndarray]:
    first, *rest = (expand(x).astype(np.int64) for x in data)
    return [first, *(first + (x >> 1 ^ -(x & 1)) for x in rest)]


def squeeze_sorted(a: np.ndarray) -> bytes:
    return squeeze(np.diff(a.astype(np.uint64), prepend=np.uint64(0)))


def expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data), dtype=np.uint64)


def mixed(a: np.ndarray, b) -> np.ndarray:
    h = (a ^ (np.atleast_1d(b) * _MIX)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(29)


def uniform(keys: np.ndarray, draw: int) -> np.ndarray:
    """In (0, 1), one number for each key and draw."""
    return ((mixed(keys, np.uint64(draw + 1)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


_stirling: dict[float, np.ndarray] = {}


def recursion(d: float, rows: int, wide: int) -> np.ndarray:
    """log S[c, t]: ways to seat c customers at t tables under discount d, weighed by their sizes; c up to rows, t up to wide."""
    s = np.full((rows + 1, wide + 1), -np.inf)
    s[1, 1], t = 0, np.arange(1, wide + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, rows):
            s[c + 1, 1:] = np.logaddexp(s[c, :-1], np.log(np.maximum(c - d * t, 0)) + s[c, 1:])
    return s


def stirling(d: float) -> np.ndarray:
    """recursion() up to ROWS and WIDE, kept for the last few discounts."""
    if d not in _stirling:
        if len(_stirling) > 3:
            _stirling.clear()
        _stirling[d] = recursion(d, ROWS, WIDE)
    return _stirling[d]


_ways: dict[tuple[float, int], np.ndarray] = {}


def _integral(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S[c, t] less lgamma(c + 1), for c > EXACT and t < c - 1.

    S[c, t] t! d^t / c! is the coefficient of x^c in (1 - (1 - x)^d)^t. Its Cauchy integral over x = e^-w is taken by
    the trapezoid rule on a parabola around the cut of w < 0, through the saddle or, where that is flat, further out.
    """
    low, high = np.full(len(c), -60.0), np.full(len(c), 5.0)
    for _ in range(12):
        mid = (low + high) / 2
        w = np.exp(mid)
        z = -np.expm1(-w)
        zd = z**d
        short = t * d * zd / z * np.exp(-w) / (1 - zd) > c
        low, high = np.where(short, mid, low), np.where(short, high, mid)
    mu = np.maximum(np.exp((low + high) / 2), 3.0 / c)
    step = np.minimum(0.65 / np.sqrt(np.maximum(4 * (1 - d) * c * mu, 1)), 0.26)
    v = step[:, None] * np.arange(NODES)
    w = mu[:, None] * (1 + 1j * v) ** 2
    f = c[:, None] * w + t[:, None] * np.log(1 - (-np.expm1(-w)) ** d)
    g = (np.exp(f - f[:, :1].real) * (1 + 1j * v) * (np.abs(w.imag) <= np.pi)).real
    return f[:, 0].real + np.log((g[:, 0] + 2 * g[:, 1:].sum(1)) * step * mu / np.pi) - t * np.log(d)


_between: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def knots(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tables from 1 to size at which ways are computed, and the weights by which these give all: cubics in the logarithm."""
    if size not in _between:
        t = np.unique(np.r_[np.arange(1, min(size, 32) + 1), np.rint(32 * 2 ** (np.arange(0, 8 * max(0, np.log2(size / 32)) + 1) / 8)).astype(np.int64), size])
        t = t[t <= size]
        x, y = np.log(t), np.log(np.arange(1, size + 1))
        weights = np.zeros((size, len(t)))
        start = np.clip(np.searchsorted(t, np.arange(1, size + 1)) - 2, 0, max(0, len(t) - 4))
        near = start[:, None] + np.arange(min(4, len(t)))
        for k in range(near.shape[1]):
            w = np.ones(size)
            for j in range(near.shape[1]):
                if j != k:
                    w *= (y - x[near[:, j]]) / (x[near[:, k]] - x[near[:, j]])
            weights[np.arange(size), near[:, k]] = w
        _between[size] = t, weights
    return _between[size]


def log_ways(c: np.ndarray, size: int, d: float) -> np.ndarray:
    """log S[c, t] for t from 1 to size, a row for each c > EXACT, in order. Beyond ROWS or WIDE by integrals, where c is far above t at knots only."""
    if size <= WIDE and (near := int(np.searchsorted(c, ROWS, "right"))):
        rows = stirling(d)[c[:near], 1 : size + 1]
        return np.concatenate([rows, log_ways(c[near:], size, d)]) if near < len(c) else rows
    if sum(map(len, _ways.values())) > CACHED:
        _ways.clear()
    for n in (todo := [n for n in c.tolist() if len(_ways.get((d, n), ())) < size]):
        _ways[d, n] = np.full(size, -np.inf)
    log_fact = np.cumsum(np.log(np.arange(1, size + 1)))
    at, weights = knots(size)
    far = [n for n in todo if n > 4 * size]
    each = [np.arange(1, min(size, n - 2) + 1) for n in todo if n <= 4 * size]
    x = np.concatenate([np.repeat(far, len(at)), *[np.full(len(t), n) for n, t in zip([n for n in todo if n <= 4 * size], each)], np.empty(0)]).astype(np.float64)
    y = np.concatenate([np.tile(at, len(far)), *each, np.empty(0)]).astype(np.float64)
    found = np.concatenate([np.empty(0), *(_integral(x[k : k + (1 << 14)], y[k : k + (1 << 14)], d) for k in range(0, len(y), 1 << 14))])
    split = len(far) * len(at)
    for n, row in zip(far, found[:split].reshape(len(far), len(at)) @ weights.T):
        _ways[d, n] = row + lgamma(n + 1) - log_fact
    for n, t, row in zip([n for n in todo if n <= 4 * size], each, np.split(found[split:], np.cumsum([len(t) for t in each]))):
        own = _ways[d, n]
        own[: len(t)] = row + lgamma(n + 1) - log_fact[: len(t)]
        if n - 1 <= size:
            own[n - 2] = np.log((1 - d) * n * (n - 1) / 2)
        if n <= size:
            own[n - 1] = 0
    return np.array([_ways[d, n][:size] for n in c.tolist()])


def tables(c: np.ndarray, others: np.ndarray, parent: np.ndarray, d: float, strength: float, keys: np.ndarray, draws: list[int]) -> list[np.ndarray]:
    """For each draw, the tables of dishes of c customers, given the restaurant's others tables and the dish's parent probability.

    By the exact conditional. Its weights have one peak, so beyond EXACT customers tables are looked at up to a number
    that is raised until weights have fallen to e^-40 of the largest.
    """
    out = [np.minimum(c, 1).astype(np.int64) for _ in draws]
    log_s = stirling(d)
    coins = [uniform(keys, 100 * s) for s in draws]

    def weights(own: np.ndarray, ways: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Of 1 to so many tables, up to a factor a dish; by products, and by logarithms where these overflow."""
        new = (strength + d * (others[own, None] + np.arange(ways.shape[1]))) * parent[own, None]
        new[:, 0] = 1
        with np.errstate(over="ignore", invalid="ignore"):
            more = np.exp(np.diff(ways, axis=1, prepend=ways[:, :1]))
            more[np.isnan(more)] = 0  # more tables than customers
            w = np.cumprod(new * more[which], axis=1)
        if len(odd := np.flatnonzero(~(w.max(1) < 1e290))):
            rows = ways[which[odd]] + np.cumsum(np.log(new[odd]), 1)
            w[odd] = np.exp(rows - rows.max(1, keepdims=True))
        return w

    def draw(own: np.ndarray, w: np.ndarray) -> None:
        w = np.cumsum(w, 1)
        for t, coin in zip(out, coins):
            t[own] = 1 + (w < coin[own, None] * w[:, -1:]).sum(1)

    for n in np.unique(c[(c > 1) & (c <= EXACT)]).tolist():
        rows = np.flatnonzero(c == n)
        for k in range(0, len(rows), 1 << 15):
            own = rows[k : k + (1 << 15)]
            draw(own, weights(own, log_s[n : n + 1, 1 : n + 1], np.zeros(len(own), np.int64)))
    big, size = np.flatnonzero(c > EXACT), 32
    while len(big):
        big, more = big[np.argsort(c[big], kind="stable")], []
        each = max(1, (1 << 18) // size)
        for own in (big[k : k + each] for k in range(0, len(big), each)):
            distinct, which = np.unique(c[own], return_inverse=True)
            w = weights(own, log_ways(distinct, size, d), which)
            done = (c[own] <= size) | (w[:, -1] < w.max(1) * np.exp(-40))
            draw(own[done], w[done])
            more.append(own[~done])
        big, size = np.concatenate(more), size * 4
    return out


def bucket(x: np.ndarray) -> np.ndarray:
    """Numbers up to EXACT as they are, larger ones by steps of FINE."""
    out = np.array(x, np.int64, ndmin=1)
    large = out > EXACT
    out[large] = EXACT + np.rint(np.log(out[large] / EXACT) / np.log(FINE)).astype(np.int64)
    return out.reshape(np.shape(x))


def unbucket(b: np.ndarray) -> np.ndarray:
    return np.where(b <= EXACT, b, np.rint(EXACT * FINE ** (b - EXACT).astype(np.float64))).astype(np.int64)


def tallied(*values: np.ndarray) -> dict[tuple, int]:
    """How often each combination of buckets occurs."""
    code = np.zeros(len(values[0]), np.int64)
    for v in values:
        code = code << 12 | bucket(v)
    codes, n = np.unique(code, return_counts=True)
    return {tuple(c >> 12 * k & 4095 for k in reversed(range(len(values)))): m for c, m in zip(codes.tolist(), n.tolist())}


def added(parts) -> dict:
    """The sum of numbers, or of tallies, under each name of the dictionaries parts."""
    out: dict = {}
    for part in parts:
        for name, x in part.items():
            if isinstance(x, dict):
                own = out.setdefault(name, {})
                for k, n in x.items():
                    own[k] = own.get(k, 0) + n
            else:
                out[name] = out.get(name, 0) + x
    return out


def log_seating(dishes: dict[tuple, int], seats: dict[tuple, int], customers: dict[tuple, int]):
    """The log probability of a level's seating as a function of discount and strength.

    dishes: tally of (customers, tables) of a dish; seats and customers: of the tables and the customers of a restaurant.
    """

    def arrays(tally: dict[tuple, int], width: int) -> list[np.ndarray]:
        rows = np.array([(*k, n) for k, n in tally.items() if k[0] > 0], np.int64).reshape(-1, width + 1)
        return [*unbucket(rows[:, :-1]).T, rows[:, -1].astype(np.float64)]

    (c, t, dish_n), (seat, seat_n), (guest, guest_n) = arrays(dishes, 2), arrays(seats, 1), arrays(customers, 1)
    t = np.minimum(t, c)
    gamma = np.vectorize(lgamma, otypes=[float])
    fixed = gamma(c + 1.0) - gamma(t + 1.0)

    def ways(d: float) -> float:
        out, small = np.zeros(len(c)), c <= EXACT
        out[small] = recursion(d, EXACT, EXACT)[c[small], t[small]]
        one_less = ~small & (t == c - 1)
        out[one_less] = np.log((1 - d) * c[one_less] * (c[one_less] - 1.0) / 2)
        rest = np.flatnonzero(~small & (t < c - 1))
        for k in range(0, len(rest), 1 << 14):
            x, y = (v[rest[k : k + (1 << 14)]].astype(np.float64) for v in (c, t))
            out[rest[k : k + (1 << 14)]] = _integral(x, y, d) + fixed[rest[k : k + (1 << 14)]]
        return float(dish_n @ out)

    def opened(d: float, strength: float) -> float:
        tables = seat_n @ ((seat - 1) * np.log(d) + gamma(strength / d + seat) - lgamma(strength / d + 1)) if len(seat) else 0.0
        return float(tables - (guest_n @ (gamma(strength + guest) - lgamma(strength + 1)) if len(guest) else 0.0))

    return ways, opened


def slice_step(log_p, x: float, low: float, high: float, width: float, coins: Iterator[float]) -> float:
    """The number after x in a chain whose numbers, in the long run, are drawn from a density between low and high.

    A height under the density at x is drawn; then a number from where the density is above it: from an interval that has
    been widened until its ends are below, and that closes in on x with each number that is below.
    """
    level = log_p(x) + log(next(coins))
    left = x - width * next(coins)
    right = left + width
    while left > low and log_p(left) > level:
        left -= width
    while right < high and log_p(right) > level:
        right += width
    left, right = max(left, low), min(right, high)
    while True:
        new = left + (right - left) * next(coins)
        if new == x or log_p(new) > level:
            return new
        left, right = (new, right) if new < x else (left, new)


def hyperparameters(d: float, strength: float, dishes: dict, seats: dict, customers: dict, draw: int) -> tuple[float, float]:
    """Discount and strength of a level after d and strength in their chain, a step each given the other and the seating; as they were where there is no customer.

    The discount is between 0.02 and 0.98, each as likely; the strength between 0.01 and 100,000, its logarithm each as likely.
    """
    if not any(k[0] for k in customers):
        return d, strength
    ways, opened = log_seating(dishes, seats, customers)
    coins = (float(uniform(np.array([k], np.uint64), 1000 + draw)[0]) for k in count())
    d = slice_step(lambda x: ways(x) + opened(x, strength), min(max(d, 0.02), 0.98), 0.02, 0.98, 0.1, coins)
    return d, exp(slice_step(lambda x: opened(d, exp(x)), log(strength), log(0.01), log(1e5), 1.0, coins))


class Tokens:
    """The documents of a pack as numbers: distinct keys in order, and the distinct pairs of a context and a token, in the order of their words."""

    def __init__(self, body: bytes):
        keys, ids, sizes, train = pickle.loads(body)
        self.keys, self.ids, self.sizes = expand_sorted(keys), expand(ids).astype(np.int64), expand(sizes).astype(np.int64)
        self.train = np.unpackbits(np.frombuffer(train, np.uint8), count=len(self.sizes)).astype(bool)
        self.in_train = np.repeat(self.train, self.sizes)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        before = np.r_[0, self.ids[:-1]][: len(self.ids)]
        before[self.firsts] = np.searchsorted(self.keys, START)
        code, self.which = np.unique(before * len(self.keys) + self.ids, return_inverse=True)
        self.u, self.w = np.divmod(code, len(self.keys))
        hashes = mixed(self.keys[self.u], self.keys[self.w])
        self.order = np.argsort(hashes)  # of the pairs, by hash
        self.hashes = hashes[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():  # equal ones in the order of their words, on any machine
            self.order = np.argsort(hashes, kind="stable")

    @staticmethod
    def body(texts: pa.StringArray, train: list[bool]) -> bytes:
        """Of texts without nulls. Words are cut and told apart by Arrow, and each distinct one is hashed."""
        trimmed = pc.ascii_trim_whitespace(texts)
        cut = pc.ascii_split_whitespace(pc.ascii_lower(trimmed))
        words, own = cut.flatten(), np.diff(cut.offsets.to_numpy()).astype(np.int64)
        blank = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
        words, own = words.filter(pc.greater(pc.binary_length(words), 0)), np.where(blank, 0, own)
        numbers = words.dictionary_encode()
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(numbers.dictionary))
        every, place = np.unique(np.r_[keys, END, START], return_inverse=True)
        ends = np.cumsum(own)
        ids = np.insert(numbers.indices.to_numpy().astype(np.int64), ends, len(keys))
        return pickle.dumps((squeeze_sorted(every), squeeze(place[ids]), squeeze(own + 1), np.packbits(np.array(train, bool)).tobytes()))


def _tokenised(rows: pa.Table) -> bytes:
    return Tokens.body(pc.fill_null(rows.column("text").combine_chunks(), ""), rows.column("train").to_pylist())


def _each(function):
    """Each row as a call of function(number, row as a dictionary, answers by shard)."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                (row,) = b.slice(k, 1).to_pylist()
                yield from function(row["pack"], row, {s: pickle.loads(a) for s, a in in_order(row.get("answers")).items()})
                trim()

    return run


def _ask_counts(shards: int):
    def ask_counts(number, row, answers):
        tokens = Tokens(row["body"])
        words = np.bincount(tokens.ids[tokens.in_train], minlength=len(tokens.keys))
        words[np.searchsorted(tokens.keys, START)] = int(tokens.train.sum())
        pairs = np.bincount(tokens.which[tokens.in_train], minlength=len(tokens.u))[tokens.order]
        out = []
        for first, keys, counts in ((0, tokens.keys, words), (shards, tokens.hashes, pairs)):
            full, bounds = by_shard(keys, shards)
            out += [(first + k, pickle.dumps((squeeze_sorted(keys[a:b]), squeeze(counts[a:b])))) for k, a, b in zip(full.tolist(), bounds[:-1], bounds[1:])]
        yield batch(ASKED, [k for k, _ in out], [number] * len(out), [d for _, d in out])

    return _each(ask_counts)


def _counts(shards: int):
    """Of words: counts and ranks in the shard, and all counts for later. Of pairs: counts, a bit for the pack that owns the pair, and ranks of those that occur twice among these."""

    def handle(shard: int, packs: list[int], asked: list[bytes]) -> list[tuple[int, bytes]]:
        parts = [pickle.loads(a) for a in asked]
        keys = [expand_sorted(k) for k, _ in parts]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        held = np.concatenate(keys)
        order = np.argsort(held, kind="stable")
        fresh = np.flatnonzero(np.r_[True, np.diff(held[order]) > 0])
        every, holders = held[order][fresh], np.diff(np.r_[fresh, len(held)])
        which = np.empty(len(held), np.int64)
        which[order] = np.repeat(np.arange(len(every)), holders)
        c = np.bincount(which, np.concatenate([expand(n) for _, n in parts]), len(every)).astype(np.int64)
        words = c[every != START] if shard < shards else c
        kind = "word" if shard < shards else "pair"
        facts = {f"{kind}_total": int(words.sum()), f"{kind}_distinct": int((words > 0).sum()), f"{kind}_once": int((words == 1).sum()), f"{kind}_twice": int((words == 2).sum())}
        if shard < shards:
            out = [pickle.dumps((squeeze(c[w]), squeeze_sorted(w))) for w in np.split(which, cuts)]
            return [*zip(packs, out), (FACTS, pickle.dumps(facts | {"guests": tallied(c[(c > 0) & (every != END)])})), (STATE, pickle.dumps([squeeze(c)]))]
        owned = np.zeros(len(which), bool)
        owned[order[fresh + (mixed(every, np.uint64(5)) >> np.uint64(32)).astype(np.int64) % holders]] = True  # any of those that hold it
        many = np.cumsum(c > 1) - 1
        out = [pickle.dumps((squeeze(c[w]), np.packbits(o).tobytes(), squeeze_sorted(many[w[c[w] > 1]]))) for w, o in zip(np.split(which, cuts), np.split(owned, cuts))]
        return [*zip(packs, out), (FACTS, pickle.dumps(facts))]

    return handle


LEARNT = "pack bigint, rows binary, known binary, part binary, base binary, asks binary"


def _learn(shards: int, model: dict):
    """From the counts: rows, all of a document but its score; known, what scores need; part, the pairs to seat; base and asks, for shards.

    asks has, by shard, all words of the pack and those of its pairs that training has twice; base has tables of the pairs that the pack owns when each has one, by context and by word, and the words in part.
    """

    def learn(number, row, answers):
        tokens = Tokens(row["body"])
        present = sorted(k for k in answers if k < shards)
        c_word = np.concatenate([expand(answers[k][0]) for k in present]).astype(np.int64)
        ranks = [expand_sorted(answers[k][1]) for k in present]
        pairs = [(k, [expand(answers[k][0]).astype(np.int64), answers[k][1], answers[k][2]]) for k in sorted(answers) if k >= shards]
        c_pair = np.concatenate([c for _, (c, _, _) in pairs])  # by hash, as are all of the pairs' numbers here
        owned = np.concatenate([np.unpackbits(np.frombuffer(o, np.uint8), count=len(c)) for _, (c, o, _) in pairs]).astype(bool)
        u, w = tokens.u[tokens.order], tokens.w[tokens.order]

        base = np.log10((c_word + 0.5) / (model["total"] + 0.5 * (model["distinct"] + 1)))
        add = lambda x: np.add.reduceat(x, tokens.firsts) if len(tokens.firsts) else np.empty(0)
        docs = pa.ipc.open_stream(row["rows"]).read_all()
        docs = pa.table({
            "doc_id": docs.column("doc_id"), "held_out": pa.array(~tokens.train), "n_tokens": pa.array(tokens.sizes), "n_known": pa.array(add((c_word > 0)[tokens.ids].astype(np.int64)).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(tokens.sizes), model["total"], np.int64)), "base_score": pa.array(add(base[tokens.ids]).astype(np.float64)),
        })
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(docs)
        known = pickle.dumps((squeeze(c_pair), squeeze(c_word)))
        asks = [*((k, pickle.dumps(answers[k][1])) for k in present), *((k, pickle.dumps(r)) for k, (_, _, r) in pairs)]

        many = np.flatnonzero(owned & (c_pair > 1))  # one customer has one table
        seated = np.split(owned[c_pair > 1], np.cumsum([(c > 1).sum() for _, (c, _, _) in pairs])[:-1])
        mine_of = [(k, squeeze_sorted(expand_sorted(r)[o])) for (k, (_, _, r)), o in zip(pairs, seated)]
        words, place = np.unique(np.r_[u[many], w[many]], return_inverse=True)
        bounds = np.cumsum([0, *map(len, ranks)])
        cuts = np.searchsorted(words, bounds)
        every = np.concatenate(ranks)
        mine = {k: squeeze_sorted(every[words[a:b]]) for k, a, b in zip(present, cuts[:-1], cuts[1:]) if b > a}
        part = pickle.dumps((squeeze(place[: len(many)]), squeeze(place[len(many) :]), squeeze(c_pair[many]), squeeze_sorted(tokens.keys[words]), mine, mine_of))
        own = owned & (c_pair > 0)
        sums = [np.bincount(x[own], minlength=len(tokens.keys)) for x in (u, w)]
        first = [(k, pickle.dumps((squeeze_sorted(r), [squeeze(x[a:b]) for x in sums], mine.get(k)))) for k, r, a, b in zip(present, ranks, bounds[:-1], bounds[1:])]
        kinds = [pa.int64(), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((number, sink.getvalue().to_pybytes(), known, part, pickle.dumps(first), pickle.dumps(asks)), kinds)], ["pack", "rows", "known", "part", "base", "asks"])

    return _each(learn)


def _stored(number, row, answers):
    """Asks what learning stored."""
    own = pickle.loads(row["asked"])
    yield batch(ASKED, [k for k, _ in own], [number] * len(own), [d for _, d in own])


class Part:
    """The pairs that a pack owns and that occur twice, by hash: words as numbers of the part's words, customers, keys of the draws, and ranks in the shards of words and of pairs."""

    def __init__(self, data: bytes):
        u, w, c, keys, self.ranks, self.pair_ranks = pickle.loads(data)
        self.u, self.w, self.c = (expand(x).astype(np.int64) for x in (u, w, c))
        self.keys = expand_sorted(keys)
        self.hashes = mixed(self.keys[self.u], self.keys[self.w])

    def facts(self, answers: dict) -> list[np.ndarray]:
        """Tables of each of the part's words as a context, and its customers and tables in the parent."""
        own = [[expand(x) for x in answers[k]] for k in sorted(self.ranks)]
        return [np.concatenate(x).astype(np.int64) for x in zip(*own)] if own else [np.empty(0, np.int64)] * 3


def _seated(shards: int, model: dict, totals: dict, sweep: int):
    """Adds up tables by context and by word, and seats the words in the parent; answers with these for the next sweep.

    Before the first sweep (-1) the tables are those of one table a pair and a word. Later ones come as what is beyond. The
    state of the shard is its words' customers as contexts, the first sums, and tables in the parent. What packs send to
    themselves goes back as it came, with what it tells of them added up.
    """

    def handle(shard: int, packs: list[int], asked: list[bytes]) -> list[tuple[int, bytes]]:
        if shard >= 2 * shards:
            parts = [pickle.loads(a) for a in asked]
            return [*zip(packs, [pickle.dumps(t) for t, _ in parts]), (FACTS, pickle.dumps(added({"pair_dishes": x} for _, x in parts)))]
        state = [expand(x).astype(np.int64) for x in pickle.loads(asked[packs.index(STATE)])]
        parts = [(n, pickle.loads(a)) for n, a in zip(packs, asked) if n != STATE]
        size = len(state[0])
        sums = [np.zeros(size, np.int64) for _ in range(2)]
        for _, (ranks, values, _) in parts:
            r = expand_sorted(ranks).astype(np.int64)
            for total, x in zip(sums, values):
                total[r] += expand(x).astype(np.int64)
        if sweep < 0:
            customers, first, k = state[0], sums, np.minimum(sums[1], 1)
            seats, n = sums
        else:
            customers, first, k = state[0], state[1:3], state[3]
            seats, n = first[0] + sums[0], first[1] + sums[1]
            keys = mixed(np.arange(size, dtype=np.uint64), np.uint64(shard + 7))
            (k,) = tables(n, np.maximum(0, totals["tables"] - k), np.full(size, 1 / (model["distinct"] + 1)), model["d_word"], model["s_word"], keys, [2 * sweep + 1])
        new = [customers, *first, k, seats, n]
        many = n > 1
        facts = {"customers": int(n.sum()), "tables": int(k.sum()), "seats": tallied(seats[seats > 0]), "word_dishes": tallied(n[many], k[many])}
        out = []
        for number, (ranks, _, mine) in parts:
            if (r := ranks if sweep >= 0 else mine) is not None:
                r = expand_sorted(r).astype(np.int64)
                out.append((number, pickle.dumps([squeeze(x[r]) for x in (seats, n, k)])))
        return [*out, (FACTS, pickle.dumps(facts)), (STATE, pickle.dumps([squeeze(x) for x in new]))]

    return handle


def _parent(n: np.ndarray, k: np.ndarray, model: dict, totals: dict) -> np.ndarray:
    """Probability in the parent restaurant of words with n customers and k tables."""
    d, strength = model["d_word"], model["s_word"]
    return (n - d * k + (strength + d * totals["tables"]) / (model["distinct"] + 1)) / (strength + totals["customers"])


def _sweep(shards: int, model: dict, totals: dict, sweep: int):
    """Draws the tables of the pairs of a part; asks for sums of those beyond one, and sends them to itself."""

    def report(number, row, answers):
        part = Part(row["part"])
        seats, n, k = part.facts(answers)
        t = 1 + expand(answers[2 * shards + number % shards]).astype(np.int64) if sweep else np.ones(len(part.c), np.int64)
        others = np.maximum(seats[part.u] - t, 0)
        (t,) = tables(part.c, others, _parent(n, k, model, totals)[part.w], model["d_pair"], model["s_pair"], part.hashes, [2 * sweep])
        sums = [np.bincount(x, t - 1, len(part.keys)).astype(np.int64) for x in (part.u, part.w)]
        own = sorted(part.ranks)
        bounds = np.cumsum([0, *[len(expand(part.ranks[s])) for s in own]])
        asked = [pickle.dumps((part.ranks[s], [squeeze(x[a:b]) for x in sums], None)) for s, a, b in zip(own, bounds[:-1], bounds[1:])]
        yield batch(ASKED, [*own, 2 * shards + number % shards], [number] * (len(own) + 1), [*asked, pickle.dumps((squeeze(t - 1), tallied(part.c, t)))])

    return _each(report)


def _tell(shards: int):
    """An owner's tables beyond one, of the kept states, for those of its pairs that have any."""

    def tell(number, row, answers):
        part = Part(row["part"])
        beyond = np.stack([expand(pickle.loads(a)).astype(np.int64) for a in row["states"]])
        out, at = [], 0
        for k, ranks in part.pair_ranks:
            ranks = expand_sorted(ranks)
            own = beyond[:, at : at + len(ranks)]
            at += len(ranks)
            if len(some := np.flatnonzero(own.any(0))):
                out.append((k, pickle.dumps((squeeze_sorted(ranks[some]), [squeeze(x[some]) for x in own]))))
        yield batch(ASKED, [k for k, _ in out], [FACTS] * len(out), [d for _, d in out])

    return _each(tell)


def _final(shards: int, kept: int):
    """Of words: the facts of each kept state. Of pairs: the tables beyond one in each."""

    def handle(shard: int, packs: list[int], asked: list[bytes]) -> list[tuple[int, bytes]]:
        if shard < shards:
            states = [[expand(x).astype(np.int64) for x in pickle.loads(a)] for n, a in sorted(zip(packs, asked)) if n <= STATE]
            wanted = [(n, expand_sorted(pickle.loads(a)).astype(np.int64)) for n, a in zip(packs, asked) if n > STATE]
            return [(n, pickle.dumps([squeeze_states([s[j][r] for s in states[::-1]]) for j in (4, 5, 3)])) for n, r in wanted]
        told_of = [(expand_sorted(r).astype(np.int64), v) for r, v in (pickle.loads(a) for n, a in zip(packs, asked) if n == FACTS)]
        wanted = [(n, expand_sorted(pickle.loads(a)).astype(np.int64)) for n, a in zip(packs, asked) if n != FACTS]
        values = np.zeros((kept, 1 + max((int(r[-1]) for r in [*(r for r, _ in told_of), *(r for _, r in wanted)] if len(r)), default=0)), np.int64)
        for r, v in told_of:
            for s in range(kept):
                values[s, r] = expand(v[s])
        return [(n, pickle.dumps([squeeze(v[r]) for v in values])) for n, r in wanted]

    return handle


def _scores(shards: int, states: list[tuple[dict, dict]]):
    def score(number, row, answers):
        tokens, (c, c_word) = Tokens(row["body"]), (expand(x).astype(np.int64) for x in pickle.loads(row["known"]))
        u, w = tokens.u[tokens.order], tokens.w[tokens.order]
        words = [[expand_states(x) for x in answers[k]] for k in sorted(answers) if k < shards]
        pairs = [answers[k] for k in sorted(answers) if k >= shards]
        many = np.flatnonzero(c > 1)
        p = np.zeros(len(c))
        for s, (model, totals) in enumerate(states):
            seats, n, k = (np.concatenate([x[j][s] for x in words]) for j in range(3))
            t = np.minimum(c, 1)
            if len(many):
                t[many] += np.concatenate([expand(x[s]) for x in pairs]).astype(np.int64)
            d, strength = model["d_pair"], model["s_pair"]
            p += (c - d * t + (strength + d * seats[u]) * _parent(n, k, model, totals)[w]) / (strength + c_word[u])
        docs = pa.ipc.open_stream(row["rows"]).read_all()
        p[tokens.order] = np.log10(p / len(states))
        own = np.add.reduceat(p[tokens.which], tokens.firsts) if len(tokens.firsts) else np.empty(0)
        yield from docs.append_column("score", pa.array(own.astype(np.float64))).combine_chunks().to_batches()

    return _each(score)


def _totals(answers: DataFrame) -> dict:
    """What the shards said of themselves, added up by the tasks that read it."""

    def run(batches):
        own = added(pickle.loads(d) for b in batches for d in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], ["data"])

    return added(pickle.loads(r.data) for r in answers.where(F.col("pack") == FACTS).select("data").mapInArrow(run, "data binary").collect())


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", parts: int = 5, held_out: int = 1, size: int | None = None, burn_in: int = BURN_IN, kept: int = KEPT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of docs.

    Tokens are the words of the text, A-Z lower-cased, and one end. All rows outside the held-out fold train the model.
    base_score is the smoothed unigram log10 probability of the text, score that of the model, perplexity is a token's.
    The model's probabilities are averaged over the states of the last kept of burn_in + kept sweeps; kept is at least 1.
    Words that training lacks are one word of the base. Null, empty and blank texts are an end alone. A null doc_id is in
    the fold of the empty text; repeated rows count and score each; without training rows every probability is 1, so
    scores are 0. An empty table gives no rows; other columns of docs are left aside. Words and pairs are told apart by
    64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), (fold(F.col(id_col), parts) != held_out).alias("train"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    to_packs = lambda answers: answers.where("pack >= 0")
    own_state = lambda answers, n=STATE: answers.where(F.col("pack") == STATE).select("shard", F.lit(n).cast("bigint").alias("pack"), "data")
    with dropped_after(spark, keep := []):
        packs, path = pack_rows(docs, _tokenised, ["doc_id"], size or PACK)
        keep.append(path)
        shards = shards_for(packs)
        counts, counted = store(ask_rows(packs.select("pack", "body").mapInArrow(_ask_counts(shards), ASKED), _counts(shards)), "counts")
        stats = _totals(counts)
        get = lambda name: stats.get(name, 0)
        discount = lambda kind: min(0.95, max(0.05, get(f"{kind}_once") / max(1, get(f"{kind}_once") + 2 * get(f"{kind}_twice"))))
        model = {"total": get("word_total"), "distinct": get("word_distinct"), "d_word": discount("word"), "d_pair": discount("pair"), "s_word": 1.0, "s_pair": 1.0}
        learnt, path = store(told(packs.select("pack", "body", "rows"), to_packs(counts)).mapInArrow(_learn(shards, model), LEARNT), "learnt")
        keep.append(path)
        asked = learnt.select("pack", F.col("base").alias("asked")).mapInArrow(_each(_stored), ASKED).unionByName(own_state(counts))
        seated, last = store(ask_rows(asked, _seated(shards, model, {}, -1)), "first-tables")
        drop(spark, counted)
        totals, states = _totals(seated), []
        part = learnt.select("pack", "part")
        for sweep in range(burn_in + kept):
            asked = told(part, to_packs(seated)).mapInArrow(_sweep(shards, model, totals, sweep), ASKED).unionByName(own_state(seated))
            seated, path = store(ask_rows(asked, _seated(shards, model, totals, sweep)), "tables")
            if sweep <= burn_in:
                drop(spark, last)
            last, totals = path, {"customers": 0, "tables": 0, **_totals(seated)}
            model = dict(model)
            for level, dishes, seats, guests in (("pair", "pair_dishes", totals.get("seats", {}), stats.get("guests", {})), ("word", "word_dishes", {(int(bucket(totals["tables"])),): 1}, {(int(bucket(totals["customers"])),): 1})):
                model[f"d_{level}"], model[f"s_{level}"] = hyperparameters(model[f"d_{level}"], model[f"s_{level}"], totals.get(dishes, {}), seats, guests, 2 * sweep + (level == "word"))
            if sweep >= burn_in:
                states.append((model, totals, seated))
        asked = learnt.select("pack", F.col("asks").alias("asked")).mapInArrow(_each(_stored), ASKED)
        beyond = part
        for s, (_, _, answers) in enumerate(states):
            asked = asked.unionByName(own_state(answers, STATE - s))
            beyond = beyond.join(answers.where(F.col("pack") >= 0).where(F.col("shard") >= 2 * shards).select("pack", F.col("data").alias(f"s{s}")).hint("merge"), "pack")
        beyond = beyond.select("pack", "part", F.array(*[f"s{s}" for s in range(kept)]).alias("states"))
        asked = asked.unionByName(beyond.mapInArrow(_tell(shards), ASKED))
        final, path = store(ask_rows(asked, _final(shards, kept)), "final-facts")
        keep.append(path)
    known = packs.select("pack", "body").join(learnt.select("pack", "known", "rows").hint("merge"), "pack")
    out = told(known, final).mapInArrow(_scores(shards, [s[:2] for s in states]), schema)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
