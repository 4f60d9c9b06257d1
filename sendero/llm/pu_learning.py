"""Non-negative positive-unlabelled learning with numpy.

A classifier is trained from trusted positives and unlabelled text: with the
class prior p, the risk is p E_P[l(g, +1)] + max(0, E_U[l(g, -1)] - p E_P[l(g, -1)]),
l the logistic loss.  Where the second part falls below zero (the network has
begun to fit the sample), the step goes back up that part instead.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sendero.llm.common import materialise, text_bytes

# Bounds of the training sample, in rows; scoring has none.
MAX_POSITIVE = 8_000
MAX_UNLABELLED = 16_000


def held_out() -> Column:
    """True for the fifth of the rows whose labels are never read; rows
    without an identifier belong to it."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, label: str,
                    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """doc_id, text, positive, unlabelled: at most ``max_positive`` rows whose labels
    all say 1 and ``max_unlabelled`` rows of whatever label, in the order of a
    hash of doc_id, none of them held out.  Written to the shared folder."""
    ids = docs.where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("low")).where("low = 1")
    positive = ids.join(marked.select("doc_id"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive)
    unlabelled = ids.orderBy(F.xxhash64(F.lit("u"), "doc_id"), "doc_id").limit(max_unlabelled)
    chosen = positive.select(F.col("doc_id").alias("_doc"), F.lit(True).alias("p"), F.lit(False).alias("u")).unionByName(
        unlabelled.select(F.col("doc_id").alias("_doc"), F.lit(False).alias("p"), F.lit(True).alias("u")))
    chosen = chosen.groupBy("_doc").agg(F.max("p").alias("positive"), F.max("u").alias("unlabelled"))
    # At most max_positive + max_unlabelled short rows.
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.coalesce("text", F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "_doc").groupBy("_doc", "positive", "unlabelled").agg(F.min("text").alias("text"))
    return materialise(sample.select(F.col("_doc").alias("doc_id"), "text", "positive", "unlabelled"), f"sample-{label}")


def labelled_share(labels: DataFrame, label: str) -> float | None:
    """The class prior as labels outside the held-out rows tell it: the share
    of 1 among them.  None if they hold no 0 (positives only) or no 1."""
    one, rows = labels.where(~held_out()).agg(F.sum(label), F.count(label)).first()
    return one / rows if rows and 0 < one < rows else None


def gather(sample: DataFrame, featurise) -> tuple[list, np.ndarray, np.ndarray]:
    """Features (as ``featurise`` gives them for a text: bytes), and which rows
    are positive and unlabelled, in the order of doc_id.  The sample is
    bounded, and so is what comes to the driver."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([featurise(t) for t in text_bytes(batch)], pa.binary()),
                 batch.column("positive"), batch.column("unlabelled")], names=["doc_id", "x", "p", "u"])

    rows = sample.mapInArrow(run, "doc_id long, x binary, p boolean, u boolean").toArrow().sort_by("doc_id")
    return rows.column("x").to_pylist(), *(np.array(rows.column(c).to_pylist(), dtype=bool) for c in "pu")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Network:
    """Logits of a linear model (no hidden units) or of one ReLU layer over
    standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return _forward(self.weights, self.standard(x))[0]


def _forward(weights, x):
    if len(weights) == 2:
        w, b = weights
        return x @ w + b[0], None
    w1, b1, w2, b2 = weights
    hidden = np.maximum(x @ w1 + b1, 0)
    return hidden @ w2 + b2[0], hidden


def _backward(weights, x, hidden, dz):
    if hidden is None:
        return [x.T @ dz, np.array([dz.sum()])]
    w1, b1, w2, b2 = weights
    dh = np.outer(dz, w2) * (hidden > 0)
    return [x.T @ dh, dh.sum(0), hidden.T @ dz, np.array([dz.sum()])]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 0, steps: int = 300,
        rate: float = 0.03, decay: float = 1e-4, standardise: bool = True, seed: int = 7) -> Network:
    """Full-batch Adam on the non-negative risk; the same on each run."""
    width = unlabelled.shape[1]
    mean = unlabelled.mean(0) if standardise else np.zeros(width, np.float32)
    scale = unlabelled.std(0) + 1e-3 if standardise else np.ones(width, np.float32)
    rng = np.random.default_rng(seed)
    if hidden:
        weights = [rng.normal(0, (2 / width) ** 0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
    else:
        weights = [np.zeros(width), np.zeros(1)]
    weights = [w.astype(np.float32) for w in weights]
    model = Network(mean, scale, weights)
    n = len(positive)
    x = model.standard(np.concatenate([positive, unlabelled]))
    m = [np.zeros_like(w) for w in weights]
    v = [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        z, layer = _forward(weights, x)
        p = sigmoid(z)
        negative = np.logaddexp(0, z[n:]).mean() - prior * np.logaddexp(0, z[:n]).mean()
        dz = np.concatenate([-prior * p[:n] / n, p[n:] / len(unlabelled)])
        if negative >= 0:
            dz[:n] -= prior * (1 - p[:n]) / n
        else:
            dz = -dz
        gradient = _backward(weights, x, layer, dz.astype(np.float32))
        for i, g in enumerate(gradient):
            g = g + decay * weights[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            weights[i] -= (rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, **how) -> float:
    """The share of positives in the unlabelled rows where no label is 0:
    the smallest ratio of unlabelled to positive mass above a threshold, on
    the half of the rows that a plain positive-against-unlabelled fit has not
    seen."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    model = fit(positive[::2], unlabelled[::2], 0.5, **how)
    p, u = model.logits(positive[1::2] if len(positive) > 1 else positive), model.logits(unlabelled[1::2] if len(unlabelled) > 1 else unlabelled)
    ratios = []
    for share in np.arange(0.1, 1.0, 0.05):
        bar = np.quantile(p, 1 - share)
        ratios.append(((u >= bar).sum() + 1) / len(u) / (p >= bar).mean())
    return float(np.clip(min(ratios), 0.01, 0.99))
