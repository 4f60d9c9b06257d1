"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, any text of the training rows is
the unlabelled rest.  Features are words, and the character n-grams that words
begin or end with, that stand in clearly more positive than unlabelled documents of the
training sample, in MIN_DOCS at least; all that do are kept.  A linear numpy
classifier over their presence, trained on sparse rows, minimises the
class-prior-corrected risk, and so gives the probability that a document is
toxic whatever its length.

Defined results: a null text is the empty text, which has no feature and gets
the score of a document without any; without positives every score is 0;
repeated rows get the same score; conflicting labels of a document count as 0;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendero.llm.common import packed, text_bytes
from sendero.llm.pu_learning import MAX_POSITIVE, MAX_UNLABELLED, gather, held_out, labelled_share, sigmoid, training_sample

BAR = 0.5
GRAM_SIZES = (4, 5, 6)
MIN_PURITY = 0.6
MIN_Z = 3.0
MIN_DOCS = 4
STEPS, RATE, DECAY = 300, 0.1, 1e-4
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CACHED_WORDS = 500_000
_HELD_GRAMS = 1_000_000


def words(text: bytes) -> set[bytes]:
    return set(_WORD.findall(text.lower()))


def grams(word: bytes) -> set[bytes]:
    """The whole word, its beginnings and its ends (in bytes)."""
    out = {b"<" + word + b">"}
    for n in GRAM_SIZES:
        if len(word) > n:
            out.add(b"<" + word[:n])
            out.add(word[-n:] + b">")
    return out


def _gram_counts(batches):
    schema = pa.schema([("gram", pa.binary()), ("p", pa.int64()), ("u", pa.int64())])
    p, u = Counter(), Counter()

    def flush():
        keys = list(p.keys() | u.keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array([p[k] for k in keys], pa.int64()), pa.array([u[k] for k in keys], pa.int64())], schema=schema)

    for batch in batches:
        for text, positive, unlabelled in zip(text_bytes(batch), batch.column("positive").to_pylist(), batch.column("unlabelled").to_pylist()):
            found = set().union(*map(grams, words(text)))
            if positive:
                p.update(found)
            if unlabelled:
                u.update(found)
            if len(p) + len(u) > _HELD_GRAMS:
                yield flush()
                p.clear()
                u.clear()
    yield flush()


def choose_features(sample: DataFrame, prior: float) -> list[bytes]:
    """The n-grams in MIN_DOCS positives, of whose documents at least the share MIN_PURITY is
    positive (prior x share among positives / share among the unlabelled), and
    whose shares differ by MIN_Z standard errors."""
    totals = sample.agg(F.count_if("positive"), F.count_if("unlabelled")).first()
    n_p, n_u = totals[0], totals[1]
    if not n_p or not n_u:
        return []
    counts = sample.mapInArrow(_gram_counts, "gram binary, p long, u long").groupBy("gram").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    share_p, share_u = F.col("p") / n_p, (F.col("u") + 0.5) / (n_u + 1)
    z = (share_p - share_u) / F.sqrt(share_u * (1 - share_u) * (1 / n_p + 1 / n_u))
    found = counts.where((F.col("p") >= MIN_DOCS) & (share_u < 1) & (prior * share_p >= MIN_PURITY * share_u)).select("gram", z.alias("z")).where(F.col("z") >= MIN_Z)
    # N-grams of a bounded sample.
    return sorted(bytes(r.gram) for r in found.select("gram").collect())


def _present(index: dict[bytes, int]):
    """Text to the numbers of the features in it; words are looked up once."""
    cache: dict[bytes, tuple[int, ...]] = {}

    def of(text: bytes) -> set[int]:
        found: set[int] = set()
        for word in words(text):
            hits = cache.get(word)
            if hits is None:
                if len(cache) > _CACHED_WORDS:
                    cache.clear()
                hits = cache[word] = tuple(index[g] for g in grams(word) if g in index)
            if hits:
                found.update(hits)
        return found

    return of


class Rows:
    """Sparse rows of ones: the numbers of the features in each."""

    def __init__(self, hits: list[np.ndarray], width: int):
        self.feature = np.concatenate([np.zeros(0, np.int32), *hits])
        self.row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
        self.size, self.width = len(hits), width

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.row, weights=weights[self.feature], minlength=self.size)

    def gradient(self, dz: np.ndarray) -> tuple[np.ndarray, float]:
        return np.bincount(self.feature, weights=dz[self.row], minlength=self.width), float(dz.sum())


def risk(z: np.ndarray, n: int, prior: float) -> tuple[float, float]:
    """The positive part of the risk, and the negative part before it is kept
    from falling below zero; the first ``n`` logits are those of positives."""
    positive = prior * np.logaddexp(0, -z[:n]).mean()
    return positive, np.logaddexp(0, z[n:]).mean() - prior * np.logaddexp(0, z[:n]).mean()


def risk_slope(z: np.ndarray, n: int, prior: float) -> np.ndarray:
    """The step's direction by logit: of the whole risk, or, where the negative
    part is below zero, back up that part."""
    p = sigmoid(z)
    slope = np.concatenate([-prior * p[:n] / n, p[n:] / (len(z) - n)])
    if risk(z, n, prior)[1] < 0:
        return -slope
    slope[:n] -= prior * (1 - p[:n]) / n
    return slope


def fit_rows(positive: list[np.ndarray], unlabelled: list[np.ndarray], width: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the non-negative risk, from zero."""
    rows, n = Rows([*positive, *unlabelled], width), len(positive)
    theta, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        weights, bias = rows.gradient(risk_slope(rows.logits(theta[:-1], theta[-1]), n, prior))
        g = np.append(weights, bias) + DECAY * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _prior(positive: list[np.ndarray], unlabelled: list[np.ndarray], width: int) -> float:
    """The share of positives among the unlabelled where no label is 0: the
    smallest ratio of their mass above a threshold, on the half of the rows
    that a plain fit has not seen."""
    model = fit_rows(positive[::2], unlabelled[::2], width, 0.5)
    p, u = (Rows(x[1::2] or x, width).logits(*model) for x in (positive, unlabelled))
    bars = np.quantile(p, 1 - np.arange(0.1, 1.0, 0.05))
    return float(np.clip(min(((u >= b).sum() + 1) / len(u) / (p >= b).mean() for b in bars), 0.01, 0.99))


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED):
    """(feature -> number, weights, bias, prior)."""
    sample = training_sample(docs, labels, "toxic", max_positive, max_unlabelled)
    prior = labelled_share(labels, "toxic")
    chosen = choose_features(sample, prior or 0.1)
    index = {g: i for i, g in enumerate(chosen)}
    if not index:
        return {}, np.zeros(0), -30.0, 0.0

    of = _present(index)
    rows, p, u = gather(sample, lambda text: np.array(sorted(of(text)), dtype=np.int32).tobytes())
    hits = [np.frombuffer(x, dtype=np.int32) for x in rows]
    positive, unlabelled = ([hits[i] for i in np.flatnonzero(which)] for which in (p, u))
    if prior is None:
        prior = _prior(positive, unlabelled, len(index))
    weights, bias = fit_rows(positive, unlabelled, len(index), prior)
    return index, weights, bias, prior


def _scores(index, weights, bias):
    def run(batches):
        of = _present(index)
        for batch in batches:
            logits = np.array([bias + sum(weights[i] for i in sorted(of(t))) for t in text_bytes(batch, "_text")], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(sigmoid(logits), pa.float64())], names=["_row", "_score"])

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``_row`` (a struct of all columns of ``docs``) and ``_score``."""
    index, weights, bias, _ = train(docs, labels)
    rows = packed(docs)
    kind = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(_scores(index, weights, bias), f"_row {kind}, _score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, bar: float = BAR) -> DataFrame:
    """doc_id, held_out, score (probability of toxic), predicted."""
    rows = scored(docs.select("doc_id", "text"), labels).select(F.col("_row.doc_id").alias("doc_id"), F.col("_score").alias("score"))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= bar).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, bar: float = BAR) -> DataFrame:
    """The documents whose score stays below the bar, as they came."""
    return scored(docs, labels).where(F.col("_score") < bar).select("_row.*")
