"""The kernel that filters in float32, and what the searches built on it send."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sendero.operators.embed import HashedTokenEmbedder, token_bucket, tokens
from sendero.operators.pruned_search import pruned_topk
from sendero.operators.similarity import similarity_topk
from sendero.operators.topk_kernel import TILE_COLUMNS, Side, nearest


def _brute(Q, P, order, k, excluded):
    q, p = Q.astype(float), P.astype(float)
    qn, pn = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (q, p))
    out = []
    for r in range(len(q)):
        s = np.full(len(p), -np.inf)
        free = (pn > 0) & (qn[r] > 0)
        free[[i for a, i in excluded if a == r]] = False
        s[free] = np.einsum("ij,ij->i", np.repeat(q[r:r + 1], free.sum(), 0), p[free]) / (qn[r] * pn[free])
        near = [c for c in np.lexsort((order, -s))[:k] if s[c] > -np.inf]
        out += [(r, c, s[c], i + 1) for i, c in enumerate(near)]
    return out


def _vectors(kind, rng, n, dim):
    if kind == "counts":
        return rng.integers(0, 3, (n, dim)).astype(np.float32)
    if kind == "nearly equal":
        # Differences that float32 similarities do not show.
        return (1 + rng.normal(0, 1e-4, (n, dim))).astype(np.float32)
    if kind == "one common":
        return np.where(rng.random((n, 1)) < 0.4, np.ones((1, dim)), rng.normal(size=(n, dim))).astype(np.float32)
    return (rng.normal(size=(5, dim))[rng.integers(0, 5, n)] + rng.normal(0, 0.02, (n, dim))).astype(np.float32)


@pytest.mark.parametrize("kind", ["counts", "nearly equal", "one common", "clusters"])
@pytest.mark.parametrize("n,k", [(3, 5), (90, 7), (TILE_COLUMNS + 700, 3), (2 * TILE_COLUMNS + 50, 40)])
def test_ranked_as_by_all_pairs(kind, n, k):
    rng = np.random.default_rng(n)
    Q, P = np.split(_vectors(kind, rng, n + 40, 6), [40])
    Q[3], P[n // 2] = 0, 0
    order = rng.permutation(n)
    excluded = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 40, 200), rng.integers(0, n, 200))} | {(1, i) for i in range(n - 2)})
    ex_q, ex_i = np.array(excluded).T
    want = _brute(Q, P, order, k, excluded)
    alone = [row for q, i, s, r, _ in nearest(Side(Q), Side(P), order, k, ex_q, ex_i) for row in zip(q, i, s, r)]
    assert alone == want
    # Blocks, one of them longer than a tile, with the bounds as they are.
    sizes = np.diff(np.unique([0, *np.minimum(n, [1, 60, 61, 90, 90 + 2 * TILE_COLUMNS]), n]))
    starts = np.cumsum(sizes) - sizes
    with np.errstate(invalid="ignore"):
        true = np.nan_to_num((Q / np.linalg.norm(Q, axis=1, keepdims=True)) @ (P / np.linalg.norm(P, axis=1, keepdims=True)).T, nan=-1)
    bound = np.maximum.reduceat(true, starts, axis=1)
    by_blocks, met = [], 0
    for q, i, s, r, pairs in nearest(Side(Q), Side(P), order, k, ex_q, ex_i, sizes=sizes, bounds=lambda lo, hi: bound[lo:hi], rounds=(1, 2), wide=0.5):
        by_blocks += zip(q, i, s, r)
        met += pairs
    assert by_blocks == want and met <= 40 * n


def test_several_shards_give_the_same_and_leave_out_far_ones(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 10))
    items = centres[rng.integers(0, 12, 1200)] + rng.normal(0, 0.02, (1200, 10))
    queries = centres[rng.integers(0, 12, 50)] + rng.normal(0, 0.02, (50, 10))
    items[100:130] = items[99]
    q = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(queries)], "qid string, embedding array<double>")
    i = spark.createDataFrame([(f"i{j:04d}", x.tolist()) for j, x in enumerate(items)], "iid string, embedding array<double>")
    e = spark.createDataFrame([(f"q{a}", f"i{b:04d}") for a in range(0, 50, 3) for b in range(0, 1200, 2)] + [("q1", "no such"), ("q1", None)], "qid string, iid string")
    want = sorted((r.qid, r.iid, r["rank"], round(r.sim, 12)) for r in similarity_topk(q, i, 9, exclude=e).collect())
    for shards in (1, 5):
        hits, compared, pairs = pruned_topk(q, i, 9, exclude=e, block_size=32, shards=shards)
        assert sorted((r.qid, r.iid, r["rank"], round(r.sim, 12)) for r in hits.collect()) == want
        assert pairs == 50 * 1200 and 0 < compared < 0.4 * pairs


def test_texts_hash_as_in_sql(spark):
    texts = ["", " ", "  ", " a", "a ", "a  b", "ÀÉ İstanbul ΣΑΣ", "x\ty\nz", "😀 B 😀", "w " * 300, None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, t string")
    buckets = F.transform(tokens(F.col("t")), lambda t: token_bucket(t, 7))
    count = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda j: F.size(F.filter(buckets, lambda b: b == j)).cast("double"))
    want = {r.id: r.v for r in df.where("t IS NOT NULL").select("id", count.alias("v")).collect()}
    assert {r.id: r.embedding for r in HashedTokenEmbedder(7)(df, "id", "t").collect()} == want


def test_recall_embeds_each_text_once(spark):
    from conftest import SF_SMALL

    from sendero.operators.embed import HashedTokenEmbedder
    from sendero.plans.pipeline import Pipeline
    from sendero.plans.registered.retrieval import _ann_topk_recall

    seen = spark.sparkContext.accumulator(0)

    class Counting(HashedTokenEmbedder):
        def __call__(self, df, id_col, text_col):
            def count(batches):
                for batch in batches:
                    seen.add(batch.num_rows)
                    yield batch

            rows = df.select(id_col, text_col)
            return super().__call__(rows.mapInArrow(count, rows.schema), id_col, text_col)

    p = Pipeline(spark, SF_SMALL, embedder=Counting())
    rows = _ann_topk_recall(p).collect()
    assert [r.recall for r in rows] == [1.0, 1.0, 1.0]
    texts = sum(df.count() for df in (p.user_texts, p.place_texts, p.user_texts.where("trim(documento) != ''"), p.site_contexts))
    assert seen.value == texts
