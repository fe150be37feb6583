"""Quality: positive-unlabelled learning by the non-negative unbiased risk.

Trusted positives are labelled rows of label 1; the unlabelled rows are documents as they come, of which an estimated
share is good as well. With p that share, the risk of a scorer is p R+(positives) + max(0, R-(unlabelled) - p R-(positives));
where the second term falls below zero the step climbs instead, so a flexible scorer cannot profit from a negative risk.
"""

from __future__ import annotations

import math
import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fold, renamed, table, unnamed
from .packs import trim
from .training import labelled

POSITIVES, UNLABELLED = 10_000, 20_000  # rows that are learned from: at most, and about
_SETS = [bytes(map(ord, x)) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "\"'()-", "!", "?", "*#$%&@^~+=", "|<>[]{}\\/_")]
NAMES = ("capitals", "digits", "stops", "marks", "exclaimed", "asked", "symbols", "structure", "others", "shouted", "distinct", "pairs", "repeats", "lines", "line_words", "bare", "word_length", "long_words", "short_words", "words", "empty")


def features(text: str | None) -> list[float]:
    text = text or ""
    data, words = text.encode("utf-8", "surrogatepass"), text.split()
    size, n = max(1, len(data)), max(1, len(words))
    shares = [(len(data) - len(data.translate(None, chars))) / size for chars in _SETS]
    lines = [x for x in text.split("\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    follow = words[1:]
    return [
        *shares, (len(data) - len(text)) / size, sum(map(str.isupper, words)) / n, len(set(words)) / n ** 0.8, len(set(zip(words, follow))) / max(1, len(follow)),
        sum(map(eq, words, follow)) / n, len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))), sum(map(str.isalpha, words)) / n,
        float(sizes.mean()), float((sizes > 18).mean()), float((sizes <= 3).mean()), math.log1p(len(words)), float(not words),
    ]


def slopes(sp: np.ndarray, su: np.ndarray, prior: float) -> np.ndarray:
    """Slope of the risk at the outputs for positives and unlabelled rows whose scores are sp and su; of the rest's negative where that is below zero."""
    rest = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
    if rest >= 0:
        return np.concatenate([(prior * (sp - 1) - prior * sp) / len(sp), su / len(su)])
    return np.concatenate([prior * sp / len(sp), -su / len(su)])


class Network:
    """One hidden layer over standardised features, trained by Adam."""

    def __init__(self, x: np.ndarray, hidden: int = 24, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        m = x.shape[1]
        self.w = [rng.normal(0, (2 / m) ** 0.5, (m, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)]
        self.moments = [[np.zeros_like(w), np.zeros_like(w)] for w in self.w]
        self.steps, self.rng = 0, rng

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def raw(self, z: np.ndarray) -> np.ndarray:
        return np.maximum(z @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def step(self, z: np.ndarray, slope: np.ndarray, rate: float, decay: float) -> None:
        """One step down the risk whose slope at the outputs for z is given."""
        hidden = np.maximum(z @ self.w[0] + self.w[1], 0)
        back = np.outer(slope, self.w[2]) * (hidden > 0)
        self.steps += 1
        for w, g, (a, b) in zip(self.w, (z.T @ back + decay * self.w[0], back.sum(0), hidden.T @ slope + decay * self.w[2], slope.sum(keepdims=True)), self.moments):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w -= rate * (a / (1 - 0.9**self.steps)) / (np.sqrt(b / (1 - 0.999**self.steps)) + 1e-8)

    def train(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, epochs: int = 25, batch: int = 512, rate: float = 3e-3, decay: float = 1e-4) -> Network:
        """By the non-negative risk under prior; without one, to tell positives from unlabelled rows at even weight."""
        p, u = self.scaled(positive), self.scaled(unlabelled)
        for epoch in range(epochs):
            for _ in range(max(20, math.ceil(len(u) / batch))):
                zp, zu = p[self.rng.integers(0, len(p), batch)], u[self.rng.integers(0, len(u), batch)]
                z = np.concatenate([zp, zu])
                s = 1 / (1 + np.exp(-np.clip(self.raw(z), -30, 30)))
                sp, su = s[:batch], s[batch:]
                slope = np.concatenate([sp - 1, su]) / (2 * batch) if prior is None else slopes(sp, su, prior)
                self.step(z, slope, rate * (0.5 if epoch > epochs * 0.6 else 1) * (0.2 if epoch > epochs * 0.85 else 1), decay)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.scaled(x)), -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """Share of positives among the unlabelled, from scores of rows that the scorer was not trained on.

    In the best top bin of the scores the unlabelled rows are all but pure positives; the ratio of what the two samples
    have there, with a margin for chance, bounds the share, and its least value over the bins estimates it.
    """
    cuts = np.unique(np.r_[positive, unlabelled])
    qp = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    qu = 1 - np.searchsorted(np.sort(unlabelled), cuts, "left") / len(unlabelled)
    margin = math.sqrt(math.log(4 / doubt) / 2 / len(unlabelled)) + math.sqrt(math.log(4 / doubt) / 2 / len(positive))
    ok = qp > 0
    best = ((qu[ok] + margin) / qp[ok]).argmin()
    return float(np.clip(qu[ok][best] / qp[ok][best], 0.05, 0.99))


class Model:
    """Without positives every score is 0; without unlabelled rows, 1.

    The class prior is estimated twice, each time from the half of the documents that the scorer was not trained on. The
    halves are of documents: one that is both a trusted positive and an unlabelled row is on the same side in both.
    """

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, half_p: np.ndarray, half_u: np.ndarray):
        self.constant, self.network, self.prior = float(len(positive) > 0), None, None
        if min((half_p == k).sum() for k in (0, 1)) >= 4 and min((half_u == k).sum() for k in (0, 1)) >= 4:
            shares = []
            for k in (0, 1):
                first = Network(unlabelled).train(positive[half_p == k], unlabelled[half_u == k], None, epochs=12)
                shares.append(class_prior(first.score(positive[half_p != k]), first.score(unlabelled[half_u != k])))
            self.prior = float(np.mean(shares))
            self.network = Network(unlabelled).train(positive, unlabelled, self.prior)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.constant) if self.network is None else self.network.score(x)


def fit(docs: DataFrame, labels: DataFrame, column: str, parts: int, held_out: int, positives: int, unlabelled: int) -> Model:
    """docs: doc_id, text. Learns from at most so many ids with label 1 and about so many ids of all; of several rows of an id, from the text of least hash."""
    good = labelled(labels, column, parts, held_out, positives, only=1)
    share = min(1.0, unlabelled / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64(F.lit(31), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = docs.where(fold(F.col("doc_id"), parts) != held_out).join(F.broadcast(good), docs["doc_id"] == good["_id"], "left")
    rows = rows.select("doc_id", "text", F.col("_id").isNotNull().alias("p"), drawn.alias("u")).where("p OR u")

    def run(batches):
        for b in batches:
            x = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "p", "u", "h", "x"])

    made = rows.withColumn("h", F.xxhash64("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, p boolean, u boolean, h bigint, x array<double>")
    got = made.groupBy("doc_id").agg(F.min(F.struct("h", "x", "p", "u")).alias("r")).select("doc_id", "r.*").collect()
    got.sort(key=lambda r: zlib.crc32(str(r.doc_id).encode()))
    take = lambda rows: np.array([r.x for r in rows]).reshape(-1, len(NAMES))
    half = lambda rows: np.array([zlib.crc32(str(r.doc_id).encode()) >> 8 & 1 for r in rows], np.int64)
    p, u = [r for r in got if r.p], [r for r in got if r.u]
    return Model(take(p), take(u), half(p), half(u))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", column: str = "quality", parts: int = 4, held_out: int = 2, threshold: float = 0.7, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    score estimates the probability that labels.quality is 1, from the text alone. Null, empty and blank texts are
    scored as texts without words. Without labelled positives every score is 0. Repeated rows each get their own; an
    empty table gives none; other columns of docs are left aside.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    scored = with_scores(docs, fit(docs, labels, column, parts, held_out, positives, unlabelled))
    return scored.select("doc_id", (fold(F.col("doc_id"), parts) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def with_scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs, which has no column score, with one at the end."""
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(at).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x))], [*b.schema.names, "score"])
            trim()

    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, that score threshold or more."""
    plain = docs.select("doc_id", "text")
    model = fit(plain, labels, "quality", 4, 2, POSITIVES, UNLABELLED)
    return renamed(with_scores(unnamed(docs), model, f"c{docs.columns.index('text')}").where(F.col("score") >= threshold), docs)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
