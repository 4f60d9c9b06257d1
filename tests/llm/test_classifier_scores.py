"""Scores of the two classifiers against plain Python, row by row, and the
descent against numeric gradients."""

import math
import random
import re

import numpy as np
import pytest

from sendero.llm import pu_learning, quality, toxicity

DOCS = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(5, 30)))
        docs.append((i, text + (" " + rng.choice(["Nasty", "rotten", "vile-"]) + "." if bad else " " + "kind!" * (i % 3))))
        labels.append((i, int(not bad), int(bad)))
    docs += [(1000, None), (1001, ""), (1002, "ROTTEN\nrotten é " + "x" * 50_000)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), docs


def test_toxicity_scores_row_by_row(tables):
    docs, labels, rows = tables
    index, weights, bias, prior = toxicity.train(docs, labels)
    assert index and 0.2 < prior < 0.3
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    for doc, text in rows:
        found = set()
        for word in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower()):
            found.add(b"<" + word + b">")
            for n in (4, 5, 6):
                if len(word) > n:
                    found |= {b"<" + word[:n], word[-n:] + b">"}
        z = bias
        for gram in sorted(found & index.keys()):
            z += weights[index[gram]]
        assert abs(got[doc] - 1 / (1 + math.exp(-min(max(z, -30), 30)))) < 1e-9
    assert got[1002] > 0.5 > got[1000] == got[1001]


def test_rare_but_clear_words_are_learnt(spark):
    """A word in 6 of some 240 positives."""
    rng = random.Random(1)
    plain = [" ".join(f"p{rng.randrange(50)}" for _ in range(12)) for _ in range(1500)]
    docs = [(i, t + (" horrid" if i % 5 == 0 else "")) for i, t in enumerate(plain)]
    learnt = [i for i in range(5, 1500, 5) if not _held(i)][:6]
    docs = [(i, t.replace("horrid", "rareslur") if i in learnt else t) for i, t in docs] + [(5000, "p1 p2 rareslur"), (5001, "p1 p2 p3")]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(1500)]
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert scores[5000] > 0.5 > scores[5001]


def _held(doc):
    import zlib

    return zlib.crc32(str(doc).encode()) % 5 == 0


@pytest.mark.parametrize("prior", [0.2, 0.9])  # 0.9: the negative part is below zero
def test_toxicity_slope_is_numeric_gradient(prior):
    rng = np.random.default_rng(2)
    hits = [np.sort(rng.choice(6, 3, replace=False)).astype(np.int32) for _ in range(30)]
    rows, n = toxicity.Rows(hits, 6), 10
    theta = rng.normal(size=7)
    if prior == 0.9:
        theta[-1] = -6  # unlabelled rows look negative, positives are missed
        hits = [np.array([0], np.int32)] * 10 + [np.array([1], np.int32)] * 20
        rows, theta[:2] = toxicity.Rows(hits, 6), (9, -3)

    def value(t):
        positive, negative = toxicity.risk(rows.logits(t[:-1], t[-1]), n, prior)
        return positive + negative if negative >= 0 else -negative

    w, b = rows.gradient(toxicity.risk_slope(rows.logits(theta[:-1], theta[-1]), n, prior))
    for i in range(7):
        e = np.zeros(7)
        e[i] = 1e-6
        assert abs((value(theta + e) - value(theta - e)) / 2e-6 - np.append(w, b)[i]) < 1e-6


def _plain_features(text):
    kinds = [quality._CLASS_OF[b] for b in text]
    tokens = text.split()
    out = [0.0] * quality.WIDTH
    if not tokens:
        return out
    n = quality._N
    for a, b in zip(kinds, kinds[1:]):
        out[int(a) * n + int(b)] += 1
    out[:n * n] = [math.sqrt(x / max(1, len(text) - 1)) for x in out[:n * n]]
    distinct = set(tokens)
    letters = re.compile(rb"[0-9A-Za-z\x80-\xff]")
    out[n * n:] = [sum(a == b for a, b in zip(tokens, tokens[1:])) / len(tokens), len(distinct) / len(tokens),
                   math.log(len(distinct)) / (1 + math.log(len(tokens))), sum(not letters.search(t) for t in tokens) / len(tokens),
                   sum(t.isupper() for t in tokens) / len(tokens), math.log1p(len(tokens)) / 10, sum(map(len, tokens)) / len(tokens) / 10]
    return out


def test_quality_scores_row_by_row(tables):
    docs, labels, rows = tables
    model, _ = quality.train(docs, labels)
    w1, b1, w2, b2 = (w.astype(float).tolist() for w in model.weights)
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    for doc, text in rows[::7] + rows[-3:]:
        x = [min(max((f - m) / s, -8), 8) for f, m, s in zip(_plain_features((text or "").encode()), model.mean.tolist(), model.scale.tolist())]
        hidden = [max(sum(xi * w1[i][j] for i, xi in enumerate(x)) + b1[j], 0) for j in range(len(b1))]
        z = sum(h * w for h, w in zip(hidden, w2)) + b2[0]
        assert abs(got[doc] - 1 / (1 + math.exp(-min(max(z, -30), 30)))) < 1e-3


def test_quality_backward_is_numeric_gradient():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 4))
    weights = [rng.normal(size=(4, 3)), rng.normal(size=3), rng.normal(size=3), rng.normal(size=1)]
    dz = rng.normal(size=12)
    _, hidden = pu_learning._forward(weights, x)
    for w, g in zip(weights, pu_learning._backward(weights, x, hidden, dz)):
        flat = w.reshape(-1)
        for i in range(flat.size):
            kept = flat[i]
            flat[i] = kept + 1e-6
            up = pu_learning._forward(weights, x)[0] @ dz
            flat[i] = kept - 1e-6
            down = pu_learning._forward(weights, x)[0] @ dz
            flat[i] = kept
            assert abs((up - down) / 2e-6 - np.asarray(g).reshape(-1)[i]) < 1e-5
