"""Property test: the top-k kernel equals brute force on random inputs
(ties, zero vectors, exclusions, k above and below the item count)."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from sendero.operators.similarity import _kernel


def _brute(Q, P, qids, iids, k, excluded):
    out = []
    for a, q in zip(qids, Q):
        cand = []
        for b, v in zip(iids, P):
            d = np.sqrt(q @ q) * np.sqrt(v @ v)
            if (a, b) in excluded or d == 0:
                continue
            cand.append((-(q @ v) / d, b))
        cand.sort()
        out += [(a, b, -s, r + 1) for r, (s, b) in enumerate(cand[:k])]
    return sorted(out)


@settings(max_examples=60, deadline=None)
@given(
    nq=st.integers(1, 6), ni=st.integers(1, 9), dim=st.integers(1, 4), k=st.integers(1, 12),
    seed=st.integers(0, 10_000), ex_rate=st.floats(0, 1),
)
def test_kernel_matches_brute_force(nq, ni, dim, k, seed, ex_rate):
    rng = np.random.default_rng(seed)
    Q = rng.integers(0, 3, (nq, dim)).astype(float)
    P = rng.integers(0, 3, (ni, dim)).astype(float)
    qids = [f"q{i}" for i in range(nq)]
    iids = [f"i{i}" for i in rng.permutation(ni)]
    excluded = {(a, b) for a in qids for b in iids if rng.random() < ex_rate}
    left = pd.DataFrame({
        "qid": qids + [a for a, _ in excluded],
        "embedding": list(Q) + [None] * len(excluded),
        "ex": [None] * nq + [b for _, b in excluded],
    })
    right = pd.DataFrame({"iid": iids, "embedding": list(P)})
    out = _kernel(k)((0, 0), left, right)
    got = sorted(zip(out["qid"], out["iid"], out["sim"], out["rank"]))
    want = _brute(Q, P, qids, iids, k, excluded)
    assert [(a, b, r) for a, b, _, r in got] == [(a, b, r) for a, b, _, r in want]
    assert np.allclose([s for *_, s, _ in got], [s for *_, s, _ in want])
