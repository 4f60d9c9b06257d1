"""The blocked similarity top-k against a brute-force reference."""

import numpy as np
import pandas as pd

from sendero.operators.similarity import _kernel, _select_topk, similarity_topk


def brute(qv, iv, k, exclude):
    out = []
    for qi, q in qv.items():
        scores = []
        for ii, v in iv.items():
            if (qi, ii) in exclude:
                continue
            d = np.linalg.norm(q) * np.linalg.norm(v)
            if d == 0:
                continue
            scores.append((-(q @ v) / d, ii))
        scores.sort()
        out += [(qi, ii, -s, r + 1) for r, (s, ii) in enumerate(scores[:k])]
    return out


def _data(seed, nq, ni, dim=8, ties=True):
    rng = np.random.default_rng(seed)
    qv = {f"q{i:03d}": rng.integers(0, 3, dim).astype(float) for i in range(nq)}
    iv = {f"i{i:03d}": rng.integers(0, 3, dim).astype(float) for i in range(ni)}
    if ties:
        iv["i900"] = iv["i001"].copy()  # exact duplicate vector: a tie
    iv["i999"] = np.zeros(dim)  # zero vector: never a candidate
    ex = {(q, i) for q in qv for i in iv if rng.random() < 0.2}
    ex.add(("q000", "not-in-catalogue"))
    return qv, iv, ex


def _run(spark, qv, iv, ex, k, **kw):
    q = spark.createDataFrame([(a, v.tolist()) for a, v in qv.items()], "qid string, embedding array<double>")
    i = spark.createDataFrame([(a, v.tolist()) for a, v in iv.items()], "iid string, embedding array<double>")
    e = spark.createDataFrame(sorted(ex), "qid string, iid string")
    rows = similarity_topk(q, i, k, exclude=e, **kw).collect()
    return sorted((r.qid, r.iid, round(r.sim, 12), r.rank) for r in rows)


def _round(rows):
    return sorted((a, b, round(c, 12), d) for a, b, c, d in rows)


def test_matches_brute_force_single_block(spark):
    qv, iv, ex = _data(1, 40, 30)
    assert _run(spark, qv, iv, ex, 5) == _round(brute(qv, iv, 5, ex))


def test_matches_brute_force_many_blocks(spark):
    qv, iv, ex = _data(2, 25, 50)
    got = _run(spark, qv, iv, ex, 7, item_block_rows=8, query_groups=3)
    assert got == _round(brute(qv, iv, 7, ex))


def test_k_larger_than_catalogue_and_full_exclusion(spark):
    qv, iv, _ = _data(3, 5, 6, ties=False)
    ex = {("q000", i) for i in iv}  # q000 consumed everything
    got = _run(spark, qv, iv, ex, 50)
    assert not [r for r in got if r[0] == "q000"]
    assert got == _round(brute(qv, iv, 50, ex))


def test_properties(spark):
    qv, iv, ex = _data(4, 30, 40)
    got = _run(spark, qv, iv, ex, 6, query_groups=7)
    by_q = {}
    for q, i, s, r in got:
        assert (q, i) not in ex
        by_q.setdefault(q, []).append((r, s))
    for lst in by_q.values():
        lst.sort()
        assert [r for r, _ in lst] == list(range(1, len(lst) + 1))
        assert all(a[1] >= b[1] for a, b in zip(lst, lst[1:]))
        assert len(lst) <= 6


def test_select_topk_ties_smallest_column_wins():
    S = np.array([[0.5, 0.9, 0.5, 0.5, 0.1]])
    idx, vals = _select_topk(S, 2)
    assert idx.tolist() == [[1, 0]] and vals.tolist() == [[0.9, 0.5]]


def test_group_without_queries_returns_typed_empty():
    left = pd.DataFrame({"qid": ["a"], "embedding": [None], "ex": ["x"], "blk": [0], "grp": [0]})
    right = pd.DataFrame({"iid": ["x"], "embedding": [np.ones(3)], "blk": [0], "grp": [0]})
    out = _kernel(3)((0, 0), left, right)
    assert out.empty and out["qid"].dtype == object and out["rank"].dtype == np.int32


def test_dot_metric(spark):
    qv = {"q": np.array([1.0, 0.0])}
    iv = {"a": np.array([10.0, 0.0]), "b": np.array([1.0, 0.0])}
    q = spark.createDataFrame([(a, v.tolist()) for a, v in qv.items()], "qid string, embedding array<double>")
    i = spark.createDataFrame([(a, v.tolist()) for a, v in iv.items()], "iid string, embedding array<double>")
    rows = similarity_topk(q, i, 2, metric="dot").orderBy("rank").collect()
    assert [r.iid for r in rows] == ["a", "b"] and rows[0].sim == 10.0


def _frames(spark, qv, iv, ex=()):
    q = spark.createDataFrame([(a, v.tolist()) for a, v in qv.items()], "qid string, embedding array<double>")
    i = spark.createDataFrame([(a, v.tolist()) for a, v in iv.items()], "iid string, embedding array<double>")
    e = spark.createDataFrame(sorted(ex), "qid string, iid string") if ex else None
    return q, i, e


def test_role_symmetry(spark):
    qv, iv, _ = _data(6, 8, 9, ties=False)
    q, i, _ = _frames(spark, qv, iv)
    fwd = {(r.qid, r.iid): r.sim for r in similarity_topk(q, i, 50).collect()}
    bwd = {(r.iid, r.qid): r.sim for r in similarity_topk(
        i.withColumnRenamed("iid", "qid"), q.withColumnRenamed("qid", "iid"), 50).collect()}
    assert fwd.keys() == bwd.keys()
    assert all(abs(fwd[k] - bwd[k]) < 1e-12 for k in fwd)


def test_exclusion_equals_over_fetch_then_skip(spark):
    qv, iv, ex = _data(7, 10, 25)
    q, i, e = _frames(spark, qv, iv, ex)
    k = 4
    anti = sorted((r.qid, r.iid) for r in similarity_topk(q, i, k, exclude=e).collect())
    over = similarity_topk(q, i, k + len(iv)).collect()
    skipped = {}
    for r in sorted(over, key=lambda r: (r.qid, r.rank)):
        lst = skipped.setdefault(r.qid, [])
        if (r.qid, r.iid) not in ex and len(lst) < k:
            lst.append(r.iid)
    assert anti == sorted((a, b) for a, lst in skipped.items() for b in lst)


def test_multi_block_merge_uses_window_group_limit(spark):
    qv, iv, _ = _data(8, 5, 30)
    q, i, _ = _frames(spark, qv, iv)
    plan = similarity_topk(q, i, 3, item_block_rows=10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "FlatMapCoGroupsInPandas" in plan


def test_null_ids_and_vectors_are_ignored(spark):
    import pytest

    q = spark.createDataFrame([("a", [1.0, 0.0]), (None, [1.0, 0.0]), ("b", None)], "qid string, embedding array<double>")
    i = spark.createDataFrame([("x", [1.0, 0.0]), ("y", None), (None, [0.0, 1.0])], "iid string, embedding array<double>")
    e = spark.createDataFrame([("a", None), (None, "x")], "qid string, iid string")
    rows = [(r.qid, r.iid, r.rank) for r in similarity_topk(q, i, 3, exclude=e).collect()]
    assert rows == [("a", "x", 1)]
    with pytest.raises(ValueError):
        similarity_topk(q, i, 0)


def test_a_full_group_stays_small_in_a_worker():
    import tracemalloc

    from sendero.operators.similarity import BLOCK_BYTES, block_rows, plan_blocks

    rng = np.random.default_rng(9)
    k, n_items = 20, 400
    # Many more queries than slots: groups are bounded by bytes, hits included.
    blocks, groups = plan_blocks(5_400_000, n_items, 12, block_rows(64, hits=k), block_rows(64, hits=1), k=k)
    n = -(-5_400_000 // groups)
    assert blocks == 1 and n * (8 * 64 + 200 * k) <= BLOCK_BYTES
    left = pd.DataFrame({"qid": [f"q{i}" for i in range(n)], "embedding": list(rng.random((n, 64), dtype=np.float32)), "ex": None})
    right = pd.DataFrame({"iid": [f"i{i:04d}" for i in range(n_items)], "embedding": list(rng.random((n_items, 64), dtype=np.float32))})
    tracemalloc.start()
    out = _kernel(k)((0, 0), left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == n * k and peak < 120 << 20


def test_select_topk_wide_rows_with_ties():
    rng = np.random.default_rng(4)
    for S in (rng.integers(0, 40, (5, 6001)) / 40.0, rng.random((5, 6001)), np.where(rng.random((5, 6001)) < 0.9995, -np.inf, 0.5)):
        idx, vals = _select_topk(S.copy(), 9)
        want = [sorted(range(6001), key=lambda j: (-row[j], j))[:9] for row in S]
        finite = np.isfinite(vals)
        assert (vals == np.take_along_axis(S, np.array(want), 1)).all() and (idx[finite] == np.array(want)[finite]).all()
