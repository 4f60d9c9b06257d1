"""Quality classifier by non-negative positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; the rest of what it
learns from is unlabelled text, with an estimated class prior.  Features
describe the form of the whole text: shares of character-class pairs, and of
repeated, distinct, symbol-only and upper-case tokens.  A small numpy network
gives the probability of quality 1.

Defined results: a null text is the empty text, whose features are zero, and
gets a score too; without positives or without training rows every score is
the prior 0.5; repeated rows get the same score; conflicting labels of a
document count as 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendero.llm.common import packed, text_bytes
from sendero.llm.pu_learning import (MAX_POSITIVE, MAX_UNLABELLED, Network, estimate_prior, fit, gather, held_out,
                                     labelled_share, sigmoid, training_sample)

BAR = 0.3
HIDDEN = 16
# Classes of bytes: blank, line feed, lower, upper, digit, then ASCII symbols in
# small families, then the bytes of other letters.
_CLASSES = [b" \t\r\x0b\x0c", b"\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789",
            b".,;:", b"!?", b"'\"()[]{}", b"-_/\\", b"|", b"#$%&*+<=>@^`~", bytes(range(128, 256))]
_N = len(_CLASSES) + 1
_CLASS_OF = np.full(256, _N - 1, dtype=np.uint8)
for _i, _members in enumerate(_CLASSES):
    _CLASS_OF[list(_members)] = _i
WIDTH = _N * _N + 7
_PAIR_CHUNK = 1 << 20


def features(text: bytes) -> np.ndarray:
    out = np.zeros(WIDTH, dtype=np.float32)
    tokens = text.split()
    if not tokens:
        return out
    pairs = np.zeros(_N * _N, dtype=np.int64)
    for at in range(0, len(text), _PAIR_CHUNK):
        kinds = _CLASS_OF[np.frombuffer(text[at:at + _PAIR_CHUNK + 1], dtype=np.uint8)].astype(np.int16)
        pairs += np.bincount(kinds[:-1] * _N + kinds[1:], minlength=_N * _N)
    out[:_N * _N] = np.sqrt(pairs / max(1, len(text) - 1))
    n = len(tokens)
    distinct = set(tokens)
    out[_N * _N:] = (
        sum(map(eq, tokens, tokens[1:])) / n,
        len(distinct) / n,
        math.log(len(distinct)) / (1 + math.log(n)),
        sum(not t.isalnum() and t.isascii() and not any(map(_word_byte, t)) for t in tokens) / n,
        sum(map(bytes.isupper, tokens)) / n,
        math.log1p(n) / 10,
        sum(map(len, tokens)) / n / 10,
    )
    return out


def _word_byte(x: int) -> bool:
    return 48 <= x <= 57 or 65 <= x <= 90 or 97 <= x <= 122 or x >= 128


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> tuple[Network | None, float]:
    sample = training_sample(docs, labels, "quality", max_positive, max_unlabelled)

    rows, p, u = gather(sample, lambda text: features(text).tobytes())
    x = np.frombuffer(b"".join(rows), dtype=np.float32).reshape(-1, WIDTH)
    if not p.any() or not u.any():
        return None, 0.5
    prior = labelled_share(labels, "quality") or estimate_prior(x[p], x[u], hidden=HIDDEN)
    return fit(x[p], x[u], prior, hidden=HIDDEN), prior


def _scores(model: Network | None, prior: float):
    def run(batches):
        for batch in batches:
            texts = text_bytes(batch, "_text")
            if model is None:
                score = np.full(len(texts), prior)
            else:
                score = sigmoid(model.logits(np.array([features(t) for t in texts]).reshape(-1, WIDTH))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(score, pa.float64())], names=["_row", "_score"])

    return run


def scored(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """``_row`` (a struct of all columns of ``docs``) and ``_score``."""
    rows = packed(docs)
    kind = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(_scores(*train(docs, labels, max_positive, max_unlabelled)), f"_row {kind}, _score double")


def quality_scores(docs: DataFrame, labels: DataFrame, bar: float = BAR) -> DataFrame:
    """doc_id, held_out, score (probability of quality 1), predicted."""
    rows = scored(docs.select("doc_id", "text"), labels).select(F.col("_row.doc_id").alias("doc_id"), F.col("_score").alias("score"))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= bar).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, bar: float = BAR) -> DataFrame:
    """The documents whose score reaches the bar, as they came."""
    return scored(docs, labels).where(F.col("_score") >= bar).select("_row.*")
