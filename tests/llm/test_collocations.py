"""Collocations and the FM-index against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from sendero.llm import collocations as C
from sendero.llm.word_index import WordIndex, transform

DOCS = "doc_id long, text string, lang string, rank int, phrase string"


def low(text):
    return re.sub("[A-Z]", lambda m: m.group(0).lower(), text or "")


def brute(docs, min_count, top):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= min_count}
    out = []
    for lang in n:
        rows = []
        mine = {p: a for (x, p), a in found.items() if x == lang}
        for p, a in mine.items():
            inside = any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in mine.items())
            if not inside:
                score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def got(spark, docs, **how):
    frame = spark.createDataFrame([(i, t, lang, 3, "x") for i, (t, lang) in enumerate(docs)], DOCS)
    return sorted(tuple(r) for r in C.collocations(frame, **how).collect())


@pytest.mark.parametrize("shard_words", [4_000_000, 150])
def test_against_plain_python(spark, shard_words):
    rng = random.Random(2)
    words = ["the", "The", "of", "año", "x-y", "ß", "\x00", "new york", "open source software licence", "é"]
    docs = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", "! "] + [" "] * 12) for _ in range(rng.randrange(60)))
        docs.append((text, rng.choice(["en", "en", "fr", None, "und", ""])))
    docs += [(None, "en"), ("", None), (" .,\t", "xx"), ("x " * 3000, "en"), ("again and again " * 20, "fr"), ("again and again " * 20, "fr")]
    assert got(spark, docs, min_count=8, top=25, shard_words=shard_words) == brute(docs, 8, 25)


def test_empty(spark):
    assert got(spark, []) == []


def test_long_texts_are_cut_at_separators_only(monkeypatch):
    monkeypatch.setattr(C, "_CHUNK", 10)
    text = b"one two three four, five six. seven" + b" eight" * 10
    chunks = list(C.chunks_of(text))
    assert b"".join(chunks) == text and len(chunks) > 1 and all(c[-1:] in b",." for c in chunks[:-1])


def test_intervals_hold_every_occurrence():
    """Counts and intervals after extensions on either side."""
    rng = random.Random(4)
    ids = np.array([0] + [rng.choice([0, 1, 2, 3, 3, 4]) for _ in range(500)] + [0], np.int32)
    hashes = np.array([xxhash.xxh64_intdigest(bytes([i])) for i in range(5)], np.uint64)
    index = WordIndex(np.bincount(ids, minlength=5), hashes, transform(ids), transform(ids[::-1]))
    grams = {k: Counter(tuple(ids[i:i + k].tolist()) for i in range(len(ids) - k + 1) if 0 not in ids[i:i + k]) for k in range(1, 6)}
    phrases = index.single()
    keys = {}
    # Kept phrases keep the intervals that they had among all.
    chosen = index.extended(phrases, True, lambda x: x.count > 40)
    assert 0 < len(chosen.count) < len(grams[2]) and dict(zip(map(tuple, index.extended(chosen, False).words.tolist()),
        index.extended(chosen, False).count.tolist())) == {g: c for g, c in grams[3].items() if grams[2][g[:2]] > 40}
    for level, left in ((2, True), (3, False), (4, True), (5, False)):
        phrases = index.extended(phrases, left)
        assert dict(zip(map(tuple, phrases.words.tolist()), phrases.count.tolist())) == grams[level]
        keys[level] = dict(zip(map(tuple, phrases.words.tolist()), phrases.keys.tolist()))
        if level > 2:
            for end, cut in ((True, slice(1, None)), (False, slice(None, -1))):
                for words, key in zip(phrases.words.tolist(), index.without_end(phrases, end).tolist()):
                    assert key == keys[level - 1][tuple(words[cut])]


def test_different_phrases_with_one_key_are_told_apart():
    """One shard each spells a frequent phrase, with the sum of all."""
    import pyarrow as pa

    schema = C._schema(C._BLOCK)

    def block(shard, keys, checks, counts):
        return (3, shard, 2, np.array(keys, np.int64).tobytes(), np.array(checks, np.uint64).tobytes(), np.array(counts, np.int32).tobytes())

    blocks = [block(0, [5, 7, 9], [1, 1, 4], [60, 30, 1]), block(1, [9, 7, 5], [4, 2, 1], [98, 80, 50]), block(2, [7], [2], [30])]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*blocks), schema)], schema=schema)
    out, = C._sum_buckets(100)([batch])
    rows = {r["shard"]: r for r in out.to_pylist()}
    bits = {s: np.unpackbits(np.frombuffer(r["bits"], np.uint8)).tolist() for s, r in rows.items()}
    assert bits[0][:3] == [1, 0, 0] and bits[1][:3] == [0, 1, 1] and bits[2][:1] == [1]
    sums = sorted(n for r in rows.values() for n in np.frombuffer(r["sums"], np.int64).tolist())
    assert sums == [110, 110]
    assert sum(int(np.unpackbits(np.frombuffer(r["spelt"], np.uint8)).sum()) for r in rows.values()) == 2
