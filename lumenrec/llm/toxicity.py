"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of a fixed and of a learned lexicon, lexicon words near a second person, capitals,
punctuation, and obfuscated or stretched spellings. The learned lexicon holds words and word beginnings that labelled
toxic rows use far more than others. Lexicon, trees and calibration come from a bounded sample of labelled rows, dealt to
parts: the features that trees learn from, and the scores that calibration learns from, are each those of a row whose own
part taught nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, fold, store, table
from .training import labelled

SAMPLE = 20_000  # labelled rows that are learned from, at most
TERMS = 4_000  # entries of the learned lexicon, at most
NEAR = 4  # words between a lexicon word and a second person
PARTS = 3  # of the sample

#: Common insults of four languages, and words for the second person.
INSULTS = frozenset(
    "arschloch asshole bastard bitch clown connard crap cretin debil dick dumb dummkopf estupido fool fuck fucking garbage hate"
    " idiot idiota idiote imbecile imbécile imbecil jerk kill kys loser merde mierda moron ordure pathetic pig puta pute retard"
    " scheiße scheisse schlampe scum shit slut stupid stupide tonto trash trottel vermin whore worthless wichser".split()
)
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr sie tu te toi ton vous votre tú ti tus usted ustedes vosotros".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "*": None, "_": None, "-": None, ".": None})

_WORDS = re.compile(r"[^\W\d_]+").findall
_MASKED = re.compile(r"(?<![^\s\"'(])[^\W\d_]+(?:[0-9@$*!|_]+[^\W\d_]+)+").findall
_STRETCHED = re.compile(r"([^\W\d_])\1{3,}").findall
_CAPS, _DIGITS, _PUNCT, _LOUD = (bytes(map(ord, x)) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "\"'(),-./:;<=>[]_{}~", "!?*#$%&@"))
NAMES = ("fixed", "learned", "weight", "strongest", "hits", "near", "second", "masked", "masked_hits", "stretched", "capitals", "shouted", "punctuation", "loud", "digits", "word_length", "words")


def terms_of(text: str | None) -> set[str]:
    """Words of a text and, marked by a final -, their beginnings of 4 to 6 letters."""
    words = set(_WORDS((text or "").lower()))
    return words | {w[:k] + "-" for w in words for k in (4, 5, 6) if len(w) >= k}


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    text = text or ""
    words = _WORDS(text.lower())
    n, data = max(1, len(words)), text.encode("utf-8", "surrogatepass")
    size = max(1, len(data))
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / size
    known = lexicon.get
    starts = lexicon_starts(lexicon)
    hits, total, strongest, learned, fixed = [], 0.0, 0.0, 0, 0
    for k, w in enumerate(words):
        own = known(w, 0.0)
        if w[:4] in starts:
            own = max(own, known(w[:4] + "-", 0.0), known(w[:5] + "-", 0.0), known(w[:6] + "-", 0.0))
        if own:
            learned += 1
            total += own
            strongest = max(strongest, own)
        plain = w in INSULTS
        fixed += plain
        if own or plain:
            hits.append(k)
    near = sum(not SECOND.isdisjoint(words[max(0, k - NEAR) : k + NEAR + 1]) for k in hits)
    masked = _MASKED(text)
    unmasked = sum((p := m.lower().translate(LEET)) in INSULTS or p in lexicon for m in masked)
    return [
        fixed / n, learned / n, total / n, strongest, math.log1p(len(hits)), near / n, len([w for w in words if w in SECOND]) / n, len(masked) / n, unmasked / n,
        len(_STRETCHED(text)) / n, share(_CAPS), sum(map(str.isupper, _WORDS(text))) / n, share(_PUNCT), share(_LOUD), share(_DIGITS), sum(map(len, words)) / n, math.log1p(len(words)),
    ]


_starts: dict[int, tuple[dict, set]] = {}


def lexicon_starts(lexicon: dict[str, float]) -> set[str]:
    """First four letters of the beginnings in lexicon."""
    got = _starts.get(id(lexicon))
    if got is None or got[0] is not lexicon:
        got = _starts[id(lexicon)] = (lexicon, {t[:4] for t in lexicon if t[-1] == "-"})
    return got[1]


class Boosted:
    """Gradient-boosted trees for the logistic loss, over at most 64 quantile bins a feature."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, smooth: float = 1.0, least: float = 2.0):
        self.count, self.depth, self.rate, self.bins, self.smooth, self.least = trees, depth, rate, bins, smooth, least

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        at = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, f], at, method="lower")) for f in range(x.shape[1])]
        b, (n, m) = self._binned(x), x.shape
        self.base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
        raw, self.trees = np.full(n, self.base), []
        for _ in range(self.count):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node, size = np.zeros(n, np.int64), 1
            feature, cut = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, self.bins, np.int64)
            for level in range(self.depth):
                best = np.full(size, 1e-9)
                for f in range(m):
                    key = node * self.bins + b[:, f]
                    gs = np.bincount(key, g, size * self.bins).reshape(size, self.bins).cumsum(1)
                    hs = np.bincount(key, h, size * self.bins).reshape(size, self.bins).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.smooth) + (gt - gs) ** 2 / (ht - hs + self.smooth) - gt**2 / (ht + self.smooth)
                    gain[(hs < self.least * 0.25) | (ht - hs < self.least * 0.25)] = 0
                    k = gain.argmax(1)
                    top = gain[np.arange(size), k]
                    won = top > best
                    at_node = (1 << level) - 1 + np.flatnonzero(won)
                    feature[at_node], cut[at_node], best[won] = f, k[won], top[won]
                here = (1 << level) - 1 + node
                node = node * 2 + (b[np.arange(n), feature[here]] > cut[here])
                size *= 2
            leaf = self.rate * np.bincount(node, g, size) / (np.bincount(node, h, size) + self.smooth)
            raw += leaf[node]
            self.trees.append((feature, cut, leaf))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self._binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                here = (1 << level) - 1 + node
                node = node * 2 + (b[rows, feature[here]] > cut[here])
            out += leaf[node]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best rising fit of y to raw, by pooling adjacent violators; each pool is smoothed by one row a class."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # sum of raw, sum of y, rows
    for r, t in zip(raw[order].tolist(), y[order].tolist()):
        pools.append([r, t, 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    base = float(y.mean())
    return np.array([s / n for s, _, n in pools]), np.maximum.accumulate(np.array([(t + base) / (n + 1) for _, t, n in pools]))


class Model:
    """Lexicon, trees and calibration. Without both classes in the sample it gives the share of label 1, 0 if none.

    x: features of the sample's rows, each by the lexicon of the other parts; part: which part a row is of.
    """

    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, part: np.ndarray):
        self.lexicon, self.base, self.trees = lexicon, float(y.mean()) if len(y) else 0.0, None
        if 0 < self.base < 1 and min(y.sum(), len(y) - y.sum()) >= PARTS:
            raw = np.zeros(len(y))
            for k in np.unique(part).tolist():
                raw[part == k] = Boosted().fit(x[part != k], y[part != k]).raw(x[part == k])
            self.knots = isotonic(raw, y)
            self.trees = Boosted().fit(x, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.base)
        raw = self.trees.raw(x)
        spread = 1 / (1 + np.exp(-raw))  # keeps an order among rows of one pool
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 * spread, 0, 1)


def learn_lexicons(rows: DataFrame, limit: int = TERMS) -> list[dict[str, float]]:
    """Log odds of the terms that say most about rows (text, _label, _part): for each part by the other parts, and last by all.

    A term is in if its likelihood ratio is one that chance alone would not reach among so many terms.
    """

    def run(batches):
        found = [(Counter(), Counter()) for _ in range(PARTS)]
        for b in batches:
            for text, label, part in zip(*(b.column(k).to_pylist() for k in range(3))):
                found[part][label == 1].update(terms_of(text))
        for part, (good, bad) in enumerate(found):
            names = list(good.keys() | bad.keys())
            columns = [pa.array(names, pa.string()), *([pa.array([own[t] if k == part else 0 for t in names], pa.int64()) for k in range(PARTS) for own in (bad, good)])]
            yield pa.RecordBatch.from_arrays(columns, ["term", *each])

    each = [f"{c}{k}" for k in range(PARTS) for c in ("bad", "good")]
    sums = rows.agg(F.count("*"), *[F.count_if((F.col("_part") == k) & (F.col("_label") == label)) for k in range(PARTS) for label in (1, 0)]).first()[1:]
    counted = rows.select("text", "_label", "_part").mapInArrow(run, "term string, " + ", ".join(f"{c} bigint" for c in each)).groupBy("term").agg(*[F.sum(c).alias(c) for c in each])
    counted, path = store(counted.where(" + ".join(each[::2]) + " >= 3"), "terms")
    out = []
    for left_out in [*range(PARTS), None]:
        parts = [k for k in range(PARTS) if k != left_out]
        ones, n = sum(sums[2 * k] for k in parts), sum(sums[2 * k] + sums[2 * k + 1] for k in parts)
        if not ones or ones == n:
            out.append({})
            continue
        base = ones / n
        terms = counted.select("term", *[sum((F.col(f"{c}{k}") for k in parts), F.lit(0)).alias(c) for c in ("bad", "good")])
        terms = terms.where("bad >= 3").withColumn("p", (F.col("bad") + 0.5 * base) / (F.col("bad") + F.col("good") + 0.5))
        rest = F.greatest(1 - F.col("p"), F.lit(1e-9))
        ratio = F.col("bad") * F.log(F.col("p") / base) + F.when(F.col("good") > 0, F.col("good") * F.log(rest / (1 - base))).otherwise(0.0)
        top = terms.withColumn("r", ratio).where((F.col("p") > 2 * base) & (F.col("r") > math.log(50 * n))).orderBy(F.desc("r"), "term").limit(limit)
        out.append({t: math.log((bad + 0.5) / (good + 0.5) * (1 - base) / base) for t, bad, good in top.select("term", "bad", "good").collect()})
    drop(rows.sparkSession, path)
    return out


def fit(docs: DataFrame, labels: DataFrame, column: str, parts: int, held_out: int, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text. Learns from at most sample labelled ids outside the held-out fold; of several rows of an id, from the text of least hash."""
    chosen = labelled(labels, column, parts, held_out, sample)
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["_id"]).groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "_label")).alias("r"))
    rows, path = store(rows.select("doc_id", "r.text", "r._label", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("_part")), "labelled")
    *others, lexicon = learn_lexicons(rows)

    def run(batches):
        for b in batches:
            x = [features(t, others[p]) for t, p in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "_label", "_part", "x"])

    got = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, _label int, _part int, x array<double>").collect()
    drop(docs.sparkSession, path)
    got.sort(key=lambda r: str(r.doc_id))
    return Model(lexicon, np.array([r.x for r in got]).reshape(-1, len(NAMES)), np.array([r._label for r in got], float), np.array([r._part for r in got], int))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", column: str = "toxic", parts: int = 5, held_out: int = 0, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    score is the calibrated probability that labels.toxic is 1, from the text alone. Null, empty and blank texts are
    scored as texts without words. Without labels of both classes every row gets the share of label 1 (0 if there is no
    label). Repeated rows each get their own; an empty table gives none; other columns of docs are left aside.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    model = fit(docs, labels, column, parts, held_out, sample)

    def run(batches):
        for b in batches:
            x = np.array([features(t, model.lexicon) for t in b.column(1).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    scored = docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), parts) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
