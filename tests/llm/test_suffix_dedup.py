"""Suffix dedup and its sort against brute force, and edge cases."""

import hashlib
import random

import numpy as np
import pytest

from sendero.llm import suffix_dedup as S
from sendero.llm.rolling import BASES, Rolling
from sendero.llm.steps import Steps

DOCS = "doc_id long, text string, lang string, start int, doc string"


def brute(docs, length):
    """Places in order of (null doc_id last, doc_id, digest of the text, start)."""
    seen, removed = {}, {}
    for doc, _, text in sorted(set(docs), key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        raw = text.encode()
        gone = set()
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            if w in seen:
                gone.update(range(i, i + length))
            seen.setdefault(w, (doc, i))
        removed[doc, text] = gone
    return removed


def expected(docs, length):
    ties = len({d for d, _ in docs}) < len(docs)
    import xxhash

    def tie(text):  # Spark's xxhash64: seed 42, signed
        x = xxhash.xxh64_intdigest(text.encode(), 42)
        return (x - (1 << 64) if x >= 1 << 63 else x) if ties else 0

    gone = brute([(d, tie(t or ""), t or "") for d, t in docs], length)
    out = []
    for d, t in docs:
        raw, g = (t or "").encode(), gone[d, t or ""]
        kept = bytes(b for i, b in enumerate(raw) if i not in g)
        out.append((d, len(raw), len(g), sum(i - 1 not in g for i in g), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(spark, docs, length, gram, block):
    frame = spark.createDataFrame([(d, t, "en", 5, "x") for d, t in docs], DOCS)
    rows = S.cut_documents(frame, length, gram, block).collect()
    assert all(r._row.start == 5 and r._row.doc == "x" for r in rows)
    return sorted(((r._row.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows), key=repr)


def made(rng, passages, n):
    letters = "abcdé \n"
    text = "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    for _ in range(rng.randrange(4)):
        p = rng.choice(passages)
        a = rng.randrange(len(p))
        text += p[a:a + rng.randrange(120)] + "".join(rng.choice(letters) for _ in range(rng.randrange(8)))
    return text


@pytest.mark.parametrize("block", [20_000, 2])  # 2: every group is salted
def test_repeats_against_brute_force(spark, block):
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdé ") for _ in range(150)) for _ in range(5)]
    docs = [(i, made(rng, passages, 60)) for i in range(60)]
    docs += [(100 + i, passages[0] + str(i)) for i in range(8)] + [(200, "a" * 300), (201, "b" + "a" * 90), (202, "ab" * 100)]
    assert got(spark, docs, 20, 6, block) == expected(docs, 20)


def test_odd_rows(spark):
    text = "".join(random.Random(3).choice("abcdef") for _ in range(80))
    docs = [(1, text), (1, text), (1, text + "x"), (None, text), (None, "y" + text), (2, None), (3, ""), (4, "short"), (5, text[10:50]), (6, text)]
    assert got(spark, docs, 20, 6, 3) == expected(docs, 20)
    assert got(spark, [], 20, 6, 3) == []


def test_long_text_is_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "_BUFFER", 64)
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh") for _ in range(1500))
    texts = [(0, long.encode()), (1, (long[400:900] + "zz" + long[100:300]).encode())]
    covered = {0: [], 1: []}
    for anchor, h1, h2, number, start, n, at in S.pieces_of(texts, 20, 6):
        for i, s, k in zip(number.tolist(), start.tolist(), n.tolist()):
            covered[i] += range(s, s + k)
    assert {i: sorted(c) for i, c in covered.items()} == {i: list(range(len(t) - 19)) for i, t in texts}


def test_sort_is_the_suffix_order():
    rng = random.Random(1)
    raw = "".join(rng.choice("ab") for _ in range(400)).encode() + b"a" * 60
    data = np.frombuffer(raw, np.uint8)
    at = np.arange(len(raw) - 30)
    sizes = np.array([100, 1, len(at) - 101])
    starts = np.cumsum(sizes) - sizes
    suffixes = S.Suffixes(data, at, 30, BASES[0])
    order = suffixes.sort(starts, sizes)
    for a, k in zip(starts.tolist(), sizes.tolist()):
        assert order[a:a + k].tolist() == sorted(range(a, a + k), key=lambda i: raw[i:i + 30])
    follows = np.setdiff1d(np.arange(len(at)), starts)
    assert suffixes.verified(order, follows)
    assert not suffixes.verified(order[::-1].copy(), np.arange(1, len(at)))


def test_collisions_are_seen_and_sorted_again(monkeypatch):
    """A base under which everything collides is left for the next one."""
    raw = b"abcdefghij" * 4 + b"abcdefghiX" * 4
    data = np.frombuffer(raw, np.uint8)
    n = np.array([4, 4])
    args = (data, np.array([0, 0]), np.array([0, 40]), n, np.array([3, 3]), 20)
    right = S.repeated_windows(*args)

    class Blind(Rolling):
        def __init__(self, data, base):
            super().__init__(data, base)
            if base == BASES[0]:
                self.prefix[:] = 0

    monkeypatch.setattr(S, "Rolling", Blind)
    assert S.repeated_windows(*args).tolist() == right.tolist() == [False] * 8


def test_texts_come_back(spark):
    frame = spark.createDataFrame([(1, "é" * 80, "en", 5, "x"), (2, "-" + "é" * 60 + "+", "en", 5, "x"), (3, None, "en", 5, None)], DOCS)
    rows = {r.doc_id: (r.text, r.start, r.doc) for r in S.suffix_dedup(frame, 100).collect()}
    assert rows[2][0] == "-+" and rows[3] == (None, 5, None) and len(rows[1][0]) < 80


def test_steps_delete_what_is_done(spark):
    import os

    steps = Steps(spark)
    df = steps.write(spark.range(3), "trial")
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    steps.done(df)
    assert not os.path.exists(path)
