import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenrec.llm.quality import class_prior, keep_quality, score_quality, slopes
from lumenrec.llm.toxicity import PARTS, Boosted, features, fit, isotonic, learn_lexicons, score_toxicity, terms_of


def rest(i, parts):
    return zlib.crc32(("" if i is None else str(i)).encode()) % parts


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows, toxic, quality = [], {}, {}
    for i in range(700):
        own = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        toxic[i], quality[i] = int(i % 5 == 0), int(i % 4 != 1)
        if toxic[i]:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(["idiot", "zarkoon", "zarkoons,", "You idiot"]))
        text = " ".join(w + (rng.choice(["***", "###", "%%%"]) if not quality[i] else "") for w in own)
        rows.append((i, text))
    return rows, toxic, quality


ODD = [(9001, None), (9002, ""), (9003, " \n"), (None, "no id"), (9004, "idiot " * 20_000), (3, "again")]


def labels_of(spark, toxic, quality, share=1.0):
    rows = [(i, quality[i], toxic[i], "x") for i in toxic if i < 600 * share] + [(None, 1, 1, "x"), (5, None, None, "x"), (5, quality[5], toxic[5], "x"), (77777, 1, 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def held_out_auc(scores, labels):
    ids = [i for i in labels if i in scores]
    pos, neg = [scores[i] for i in ids if labels[i]], [scores[i] for i in ids if not labels[i]]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


@pytest.mark.parametrize("which,parts,held,cut", [("toxic", 5, 0, 0.5), ("quality", 4, 2, 0.7)])
def test_held_out_accuracy(spark, make_docs, corpus, which, parts, held, cut):
    rows, toxic, quality = corpus
    run = score_toxicity if which == "toxic" else score_quality
    docs, labels = make_docs(rows + ODD), labels_of(spark, toxic, quality)
    got = run(docs, labels).collect()
    assert len(got) == len(rows) + len(ODD)
    assert all(r.held_out == (rest(r.doc_id, parts) == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in got)
    truth = toxic if which == "toxic" else quality
    out = {r.doc_id: r.score for r in got if r.held_out and r.doc_id is not None and r.doc_id < 700 and r.doc_id != 3}
    assert held_out_auc(out, truth) > 0.97
    right = [(s >= cut) == truth[i] for i, s in out.items()]
    assert sum(right) > 0.93 * len(right)
    flipped = labels.selectExpr("doc_id", *[f"IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % {parts} = {held}, 1 - {c}, {c}) AS {c}" for c in ("quality", "toxic")])
    assert sorted((str(r.doc_id), r.score) for r in run(docs, flipped).collect()) == sorted((str(r.doc_id), r.score) for r in got)  # held-out labels teach nothing


def test_without_labels(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for run in (score_toxicity, score_quality):
        assert {r.score for r in run(make_docs([(1, "a"), (2, None)]), none).collect()} == {0.0}
        assert run(make_docs([]), none).collect() == []


def test_keep_quality_keeps_columns(spark, make_docs, corpus):
    rows, toxic, quality = corpus
    docs = make_docs(rows)
    kept = keep_quality(docs, labels_of(spark, toxic, quality))
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {"x"}
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & {i for i in quality if quality[i]}) > 0.95 * sum(quality.values()) and len(ids - {i for i in quality if quality[i]}) < 20


def test_trees_learn_and_calibration_rises():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = Boosted().fit(x[:1500], y[:1500])
    assert ((model.raw(x[1500:]) > 0) == y[1500:]).mean() > 0.95
    knots, values = isotonic(np.array([0.1, 0.4, 0.3, 0.9, 0.8]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all()


def test_class_prior():
    rng = np.random.default_rng(1)
    positive = rng.normal(2, 1, 4000)
    for share in (0.3, 0.7, 0.9):
        n = int(4000 * share)
        mixed = np.r_[rng.normal(2, 1, n), rng.normal(-2, 1, 4000 - n)]
        assert abs(class_prior(positive, mixed) - share) < 0.06


def plain_tree(x, g, h, depth, model, rows=None):
    """Leaf value of each row: the best cut of each node among all features and cuts, by trying them all."""
    rows = np.arange(len(x)) if rows is None else rows
    out = {}
    if depth:
        best, chosen = 1e-9, None
        gain = lambda r: g[r].sum() ** 2 / (h[r].sum() + model.smooth)
        for f in range(x.shape[1]):
            for cut in model.cuts[f]:
                left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(h[left].sum(), h[right].sum()) >= model.least * 0.25 and gain(left) + gain(right) - gain(rows) > best + 1e-12:
                    best, chosen = gain(left) + gain(right) - gain(rows), (left, right)
        if chosen:
            for side in chosen:
                out |= plain_tree(x, g, h, depth - 1, model, side)
            return out
    return {r: model.rate * g[rows].sum() / (h[rows].sum() + model.smooth) for r in rows.tolist()}


def test_trees_against_brute_force():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (120, 3)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 7) ^ (rng.random(120) < 0.1)).astype(float)
    for trees in (1, 3):
        model = Boosted(trees=trees, depth=3, bins=16).fit(x, y)
        raw = np.full(120, math.log((y.sum() + 0.5) / (120 - y.sum() + 0.5)))
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            leaf = plain_tree(x, y - p, p * (1 - p), 3, model)
            raw = raw + np.array([leaf[k] for k in range(120)])
        assert np.allclose(model.raw(x), raw)


def test_isotonic_against_its_definition():
    """The best rising fit at a place is the largest, over all starts up to it, of the least mean up to any end from it on."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        raw, y = rng.permutation(25).astype(float), (rng.random(25) < 0.4).astype(float)
        if not 0 < y.sum() < 25:
            continue
        knots, values = isotonic(raw, y)
        own = y[np.argsort(raw)]
        fit_of = [max(min(own[a : b + 1].mean() for b in range(i, 25)) for a in range(i + 1)) for i in range(25)]
        pools = [[0]]
        for i in range(1, 25):
            if abs(fit_of[i] - fit_of[i - 1]) < 1e-12:
                pools[-1].append(i)
            else:
                pools.append([i])
        assert np.allclose(knots, [np.mean(p) for p in pools])
        assert np.allclose(values, np.maximum.accumulate([(own[p].sum() + y.mean()) / (len(p) + 1) for p in pools]))


def test_lexicons_leave_their_own_part_out(spark, corpus):
    rows, toxic, _ = corpus
    own = [(i, t, toxic[i], i % PARTS) for i, t in rows]
    got = learn_lexicons(spark.createDataFrame(own, "doc_id long, text string, _label int, _part int"))
    assert len(got) == PARTS + 1 and all(got)
    for left_out, lexicon in zip([*range(PARTS), None], got):
        used = [(set(terms_of(t)), y) for _, t, y, p in own if p != left_out]
        n, ones = len(used), sum(y for _, y in used)
        base, counts = ones / n, Counter()
        for terms, y in used:
            counts.update((t, y) for t in terms)
        want = {}
        for t in {t for t, _ in counts}:
            bad, good = counts[t, 1], counts[t, 0]
            p = (bad + 0.5 * base) / (bad + good + 0.5)
            ratio = bad * math.log(p / base) + (good * math.log(max(1 - p, 1e-9) / (1 - base)) if good else 0)
            if bad >= 3 and p > 2 * base and ratio > math.log(50 * n):
                want[t] = math.log((bad + 0.5) / (good + 0.5) * (1 - base) / base)
        assert lexicon.keys() == want.keys() and all(abs(lexicon[t] - want[t]) < 1e-9 for t in want)
    long = "z" * 60
    assert long in terms_of(f"a {long}") and features(long, {long: 2.0})[3] == 2.0


def test_calibration_holds_on_rows_that_taught_nothing(spark, make_docs, corpus):
    rows, toxic, _ = corpus
    docs = make_docs(rows + [(3, "a second text of an id")] * 3, extra=False).select("doc_id", "text")
    model = fit(docs, spark.createDataFrame([(i, toxic[i]) for i in toxic], "doc_id long, toxic int"), "toxic", 5, 0)
    out = [(model.score(np.array([features(t, model.lexicon)]))[0], toxic[i]) for i, t in rows if rest(i, 5) == 0]
    assert np.mean([(s - y) ** 2 for s, y in out]) < 0.03 and abs(np.mean([s for s, _ in out]) - np.mean([y for _, y in out])) < 0.06


def risk(zp, zu, prior):
    loss = lambda z: np.log1p(np.exp(-z)).mean()
    return prior * loss(zp), loss(-zu) - prior * loss(-zp)


@pytest.mark.parametrize("shift", [-1.0, 3.0])
def test_slopes_of_the_risk_against_differences(shift):
    rng = np.random.default_rng(5)
    zp, zu, prior = rng.normal(shift, 1, 30), rng.normal(0.2 - shift, 1, 40), 0.6
    zu = zu - 4 if shift > 0 else zu
    first, rest_of = risk(zp, zu, prior)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    got = slopes(sigmoid(zp), sigmoid(zu), prior)
    value = lambda p, u: sum(risk(p, u, prior)) if rest_of >= 0 else -risk(p, u, prior)[1]
    assert (rest_of < 0) == (shift > 0)
    for k in range(70):
        up, down = [(zp.copy(), zu.copy()) for _ in range(2)]
        for z, e in ((up, 1e-5), (down, -1e-5)):
            (z[0] if k < 30 else z[1])[k if k < 30 else k - 30] += e
        assert abs((value(*up) - value(*down)) / 2e-5 - got[k]) < 1e-6


def test_class_prior_against_its_definition():
    rng = np.random.default_rng(7)
    p, u = rng.random(60).round(2), rng.random(80).round(2)
    margin = math.sqrt(math.log(40) / 2 / 80) + math.sqrt(math.log(40) / 2 / 60)
    bins = [((u >= c).mean(), (p >= c).mean()) for c in sorted({*p, *u})]
    bound, share = min(((qu + margin) / qp, qu / qp) for qu, qp in bins if qp > 0)
    assert abs(class_prior(p, u) - min(0.99, max(0.05, share))) < 1e-12
