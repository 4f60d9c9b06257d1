"""The pruned search against the full comparison."""

import numpy as np
import pytest

from sendero.operators.pruned_search import Blocks, _angles, pruned_topk
from sendero.operators.similarity import similarity_topk


def _frames(spark, queries, items, excluded):
    q = spark.createDataFrame([(f"q{i}", [float(v) for v in x]) for i, x in enumerate(queries)], "qid string, embedding array<double>")
    i = spark.createDataFrame([(f"i{j:04d}", [float(v) for v in x]) for j, x in enumerate(items)], "iid string, embedding array<double>")
    return q, i, spark.createDataFrame(excluded, "qid string, iid string")


def _clustered(rng, n, centres):
    return centres[rng.integers(len(centres), size=n)] + rng.normal(0, 0.03, (n, centres.shape[1]))


def test_clustered_vectors_are_pruned_and_complete(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(25, 12))
    items, queries = _clustered(rng, 900, centres), _clustered(rng, 40, centres)
    items[5] = 0  # no direction
    items[20:40] = items[19]  # ties
    queries = np.concatenate([queries, items[19:20]])
    excluded = [("q40", f"i{j:04d}") for j in range(19, 30)] + [("q1", f"i{j:04d}") for j in range(300)] + [("q2", "unknown"), (None, "i0001")]
    q, i, e = _frames(spark, queries, items, excluded)
    hits, compared, pairs = pruned_topk(q, i, 7, exclude=e, block_size=32)
    got = {(r.qid, r.iid, r["rank"]) for r in hits.collect()}
    assert got == {(r.qid, r.iid, r["rank"]) for r in similarity_topk(q, i, 7, exclude=e).collect()}
    assert pairs == 41 * 899 and compared < 0.4 * pairs


def test_small_and_odd_tables(spark):
    q, i, e = _frames(spark, [[1, 0], [0, 0], [-1, 0.5]], [[1, 1], [2, 2], [0, 0], [-1, 0]], [("q0", "i0000")])
    hits, compared, pairs = pruned_topk(q, i, 10, exclude=e)
    assert sorted((r.qid, r.iid, r["rank"]) for r in hits.collect()) == [
        ("q0", "i0001", 1), ("q0", "i0003", 2), ("q2", "i0000", 2), ("q2", "i0001", 3), ("q2", "i0003", 1)]
    assert pairs == 6 and compared <= 6
    none = pruned_topk(q, i.where("iid = 'x'"), 3)
    assert none[0].count() == 0 and none[1] == 0
    with pytest.raises(ValueError):
        pruned_topk(q, i, 0)


def test_bounds_hold_for_every_member():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = rng.normal(size=(20, 6))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    angle = _angles(x, x[:5])
    parts = np.arange(60) % 4
    blocks = Blocks(np.arange(4), np.bincount(parts), np.array([angle[parts == b].min(0) for b in range(4)]),
                    np.array([angle[parts == b].max(0) for b in range(4)]), x[:5])
    bound = blocks.bounds(q)
    for b in range(4):
        assert ((q @ x[parts == b].T).max(axis=1) <= bound[:, b] + 1e-9).all()


def test_vectors_without_clusters_go_to_the_blocked_join(spark, monkeypatch):
    from sendero.operators import pruned_search as S

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 24))
    # Half of the queries lie by a tight cluster, half anywhere.
    items = np.concatenate([_clustered(rng, 600, centres), rng.normal(size=(900, 24))])
    queries = np.concatenate([_clustered(rng, 30, centres), rng.normal(size=(30, 24))])
    excluded = [(f"q{i}", f"i{j:04d}") for i in range(0, 60, 7) for j in range(0, 1500, 3)]
    q, i, e = _frames(spark, queries, items, excluded)
    visited, write = [], S.write_once

    def watched(df, name):
        out = write(df, name)
        if name == "visits":
            visited.append(out.count())
        return out

    monkeypatch.setattr(S, "write_once", watched)
    hits, compared, pairs = pruned_topk(q, i, 5, exclude=e, block_size=16)
    got = sorted((r.qid, r.iid, r["rank"]) for r in hits.collect())
    assert got == sorted((r.qid, r.iid, r["rank"]) for r in similarity_topk(q, i, 5, exclude=e).collect())
    # Not a copy of a query for each of the small blocks.
    assert pairs == 60 * 1500 and compared <= pairs and sum(visited) < 60 * 40
