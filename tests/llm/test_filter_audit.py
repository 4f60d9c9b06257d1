"""The filter audit against plain Python, and its edge cases."""

import re
from collections import Counter
from itertools import permutations

from sendero.llm import filter_audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _mask int, part string"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    masks = []
    for doc, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)),
                 "E": any(doc is not None and d is not None and d < doc and (t or "") == text for d, t, _ in docs)}
        masks.append((source or "", {k for k, v in fails.items() if v}, doc in good, doc in toxic))
    out = {}
    for part in {m[0] for m in masks}:
        mine = [m for m in masks if m[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for i, f in enumerate(order):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                out[part, order, i + 1] = [len(left), len(gone), sum(f in m[1] for m in mine) - len(gone),
                                           sum(m[1] == {f} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone)]
    shapley = Counter()
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return {k: (*row, shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def audit(spark, docs, labels):
    frame = spark.createDataFrame([(d, t, "en", s, None, 7, "x") for d, t, s in docs], DOCS)
    rows = filter_audit.filter_audit(frame, spark.createDataFrame(labels, LABELS)).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in rows}


def test_audit_against_plain_python(spark):
    plain = " ".join(f"w{i}" for i in range(250))
    docs = [(1, plain, "a"), (2, plain, "a"), (2, plain, "a"), (2, "other", "a"), (3, None, "a"), (4, "", None), (5, " \t\n", "b"),
            (6, "LOUD " * 300, "b"), (7, plain + " $5", "b"), (None, plain, "b"), (None, plain, "a"), (8, "x y " * 400_000, "b"),
            (9, "x y " * 400_000, None), (10, plain + "ÉÉ", "a"), (-1, "LOUD " * 300, "a")]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (4, None, 1), (None, 1, 1), (6, 0, 1), (99, 1, 1)]
    assert audit(spark, docs, labels) == brute(docs, labels)


def test_hashes_that_collide_are_told_apart_by_text(spark, monkeypatch):
    from pyspark.sql import functions as F

    # Every text under one hash: only the texts decide.
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    docs = [(1, "a", "s"), (2, "b", "s"), (3, "a", "s"), (4, "c", "s"), (5, "b", "s")]
    assert audit(spark, docs, []) == brute(docs, [])


def test_empty_tables(spark):
    assert audit(spark, [], []) == {}
    only = audit(spark, [(1, None, None)], [])
    assert len(only) == 600 and only["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)
