"""Language-model scores by stupid backoff over corpus-wide n-gram counts.

The model counts the word n-grams (orders 1 to ``order``) of all documents; a
document is scored by the counts of all others (its own occurrences are
subtracted).  Going through its words, the longest n-gram that occurs
elsewhere gives count / count of its context, times ``ALPHA`` for each order
backed off; a word that occurs nowhere else counts ``UNSEEN``.  The score is
the sum of the logarithms.

Rows are column blocks rather than single n-grams: a block holds the words of
some documents (about ``BLOCK_WORDS``, whole documents) as numbers.  The
distinct n-grams of a block are dealt out by hash range, so an n-gram that a
third of all documents contain leaves each block once, with its count.  In
each hash range the blocks' counts are summed to the count table, which is
joined back to the n-grams of every block; a block then sums the scores per
document.  The number of hash ranges follows the number of words.

Defined results: a null text has no words, score 0 and no mean; repeated rows
are documents of their own; in a corpus of one document every word is unseen;
an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendero.llm.common import batches_of, materialise, text_bytes

ORDER = 2
ALPHA = 0.4
UNSEEN = 0.5
BLOCK_WORDS = 1_000_000
RANGE_WORDS = 1_000_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)

_BLOCK = pa.schema([("block", pa.int64()), ("n_words", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
                    ("vocabulary", pa.binary()), ("words", pa.binary())])
_ASK = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])


def pack(x: np.ndarray) -> bytes:
    """The bytes of an array by place value: high bytes, mostly zero, together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() if len(x) else b""


def unpack(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel() if b else np.zeros(0, kind)


def _blocks(block_words: int):
    def run(batches):
        def rows():
            context = TaskContext.get()
            number = (context.partitionId() if context else 0) << 32
            docs, sizes, ids, index, held = [], [], [], {}, 0

            def block():
                hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in index], dtype=np.uint64)
                order = np.argsort(hashes)
                rank = np.empty(len(order), dtype=np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                words = rank[np.concatenate(ids)] if index else np.zeros(0, np.uint32)
                return number, len(words), list(docs), list(sizes), pack(np.diff(hashes[order], prepend=np.uint64(0))), pack(words)

            for batch in batches:
                for doc, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch)):
                    found = _WORD.findall(text.lower())
                    ids.append(np.array([index.setdefault(w, len(index)) for w in found], dtype=np.int64))
                    docs.append(doc)
                    sizes.append(len(found))
                    held += len(found)
                    if held >= block_words:
                        yield block()
                        number += 1
                        docs, sizes, ids, index, held = [], [], [], {}, 0
            if docs:
                yield block()

        yield from batches_of(rows(), _BLOCK, every=4)

    return run


def _grams(vocabulary: bytes, words: bytes, sizes: list[int], order: int) -> list[np.ndarray]:
    """For each order k the hashes of the n-grams that end at each word; below
    the k-th word of a document there is none, which ``_valid`` tells."""
    vocab = np.cumsum(unpack(vocabulary, np.uint64), dtype=np.uint64)
    h = vocab[unpack(words, np.uint32)] if len(vocab) else np.zeros(0, np.uint64)
    out, last = [_scramble(h + np.uint64(1))], h
    for k in range(2, order + 1):
        before = np.concatenate([np.zeros(1, np.uint64), last[:-1]])[:len(h)]
        last = _scramble(before * _MIX + h + np.uint64(k))
        out.append(last)
    return out


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _valid(sizes: np.ndarray, k: int) -> np.ndarray:
    """Which words of a block are at least the k-th of their document."""
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return at >= k - 1


def _asks(order: int, bits: int):
    def run(batches):
        def rows():
            for batch in batches:
                for block, sizes, vocabulary, words in zip(*(batch.column(c).to_pylist() for c in ("block", "sizes", "vocabulary", "words"))):
                    n = np.array(sizes, dtype=np.int64)
                    grams = [g[_valid(n, k)] for k, g in enumerate(_grams(vocabulary, words, sizes, order), 1)]
                    unique, counts = np.unique(np.concatenate(grams), return_counts=True)
                    ranges = (unique >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(unique), np.int32)
                    edges = np.flatnonzero(np.diff(ranges, prepend=-1))
                    for a, b in zip(edges, [*edges[1:], len(unique)]):
                        yield int(ranges[a]), block, pack(np.diff(unique[a:b], prepend=np.uint64(0))), pack(counts[a:b].astype(np.uint32))

        yield from batches_of(rows(), _ASK)

    return run


def _count_range(rows: pd.DataFrame) -> pd.DataFrame:
    """The count table of one hash range, joined back to each block's n-grams."""
    grams = [np.cumsum(unpack(g, np.uint64), dtype=np.uint64) for g in rows["grams"]]
    counts = np.concatenate([unpack(c, np.uint32) for c in rows["counts"]])
    table, at = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.bincount(at, weights=counts, minlength=len(table)).astype(np.uint64)[at]
    ends = np.cumsum([len(g) for g in grams])
    return pd.DataFrame({"block": rows["block"], "range": rows["range"],
                         "totals": [pack(totals[e - len(g):e]) for g, e in zip(grams, ends)]})


def _score(order: int, alpha: float, total_words: int):
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in blocks.itertuples():
            sizes = np.asarray(row.sizes, dtype=np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            totals = np.concatenate([np.zeros(0, np.uint64), *(unpack(t, np.uint64) for t in answers.sort_values("range")["totals"])]).astype(np.float64)
            grams = _grams(row.vocabulary, row.words, row.sizes, order)
            valid = [_valid(sizes, k) for k in range(1, order + 1)]
            unique = np.unique(np.concatenate([g[v] for g, v in zip(grams, valid)]))
            rest = (total_words - sizes)[owner].clip(1).astype(np.float64)
            elsewhere = [np.zeros(len(owner)) for _ in grams]  # counts in other documents
            for g, v, e in zip(grams, valid, elsewhere):
                at = np.searchsorted(unique, g[v])
                _, which, own = np.unique(owner[v] * (len(unique) + 1) + at, return_inverse=True, return_counts=True)
                e[v] = totals[at] - own[which]
            value = np.log(np.maximum(elsewhere[0], UNSEEN) / rest)
            for k in range(2, order + 1):  # the longest n-gram seen elsewhere wins
                seen = valid[k - 1] & (elsewhere[k - 1] > 0)
                context = np.concatenate([np.ones(1), elsewhere[k - 2][:-1]])[:len(owner)]
                higher = np.log(np.where(seen, elsewhere[k - 1], 1) / np.where(seen, context, 1))
                value = np.where(seen, higher, value + np.where(valid[k - 1], np.log(alpha), 0))
            score = np.bincount(owner, weights=value, minlength=len(sizes))
            out.append(pd.DataFrame({"doc_id": pd.array([None if d is None or d != d else int(d) for d in row.docs], dtype="Int64"), "n_words": sizes, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": pd.array([], dtype="Int64"), "n_words": np.zeros(0, np.int64), "score": np.zeros(0)})

    return run


def lm_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, block_words: int = BLOCK_WORDS, range_words: int = RANGE_WORDS) -> DataFrame:
    """Per document: n_words, score (sum of natural logarithms) and its mean."""
    blocks = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _blocks(block_words), "block long, n_words long, docs array<long>, sizes array<long>, vocabulary binary, words binary")
    blocks = materialise(blocks, "lm-blocks")
    words = blocks.agg(F.sum("n_words")).first()[0] or 0
    bits = max(0, int(words // range_words).bit_length())
    asks = blocks.select("block", "sizes", "vocabulary", "words").mapInArrow(_asks(order, bits), "range int, block long, grams binary, counts binary")
    answers = asks.groupBy("range").applyInPandas(_count_range, "block long, range int, totals binary")
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        _score(order, alpha, int(words)), "doc_id long, n_words long, score double")
    return scored.select("doc_id", "n_words", F.round("score", 6).alias("score"),
                         F.when(F.col("n_words") > 0, F.round(F.col("score") / F.col("n_words"), 6)).alias("mean_score"))
