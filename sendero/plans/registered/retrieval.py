"""Registered queries: retrieval, the vector-only baseline, stored-vector neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendero.operators.pruned_search import pruned_topk
from sendero.operators.similarity import similarity_topk
from sendero.plans import oracle as O
from sendero.plans.pipeline import Pipeline
from sendero.plans.registry import register
from sendero.session import write_all
from sendero.sources.tables import table


# --- retrieval and the vector-only baseline ------------------------------------------
@register("topk_places", O.sql(f"SELECT * FROM {O.topk_places_fragment(6)}", O.topk_places_fragment(6)))
def _topk_places(p: Pipeline) -> DataFrame:
    """Top-6 unconsumed sites per user."""
    return p.topk_places(6)


@register("topk_users", O.sql(f"SELECT * FROM {O.topk_users_fragment(10)}", O.topk_users_fragment(10)))
def _topk_users(p: Pipeline) -> DataFrame:
    """Top-10 users per site among those who never visited it."""
    return p.topk_users(10)


@register("baseline_direct", O.baseline_direct_sql(6, 3))
def _baseline_direct(p: Pipeline) -> DataFrame:
    """M6 direct: first 3 of 6 retrieved sites with affinity and reason."""
    return p.recommend_direct(6, 3)


@register("baseline_inverse", O.baseline_inverse_sql(10, 3))
def _baseline_inverse(p: Pipeline) -> DataFrame:
    """M6 inverse: first 3 of 10 retrieved users with a reason."""
    return p.recommend_inverse(10, 3)


@register("recommend_direct", O.baseline_direct_sql(20, 10))
def _recommend_direct(p: Pipeline) -> DataFrame:
    """M7 for every user at the demo configuration (K=20, N=10)."""
    return p.recommend_direct(20, 10)


@register("recommend_inverse", O.baseline_inverse_sql(20, 10))
def _recommend_inverse(p: Pipeline) -> DataFrame:
    """M8 for every site at K=20, N=10."""
    return p.recommend_inverse(20, 10)


# --- precomputed vector table --------------------------------------------------------------------


_NEIGHBOURS = O.sql("""
SELECT qid AS vec_id, rank, iid AS vecino, round(sim, 4) AS similitud_vectorial FROM (
  SELECT qid, iid, sim, CAST(row_number() OVER (PARTITION BY qid ORDER BY sim DESC, iid) AS INTEGER) AS rank FROM (
    SELECT CAST(a.vec_id AS VARCHAR) AS qid, CAST(b.vec_id AS VARCHAR) AS iid,
      list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
        / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])))
           * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) AS sim
    FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id
  )
) WHERE rank <= 10""")


@register("vector_neighbours", _NEIGHBOURS)
def _vector_neighbours(p: Pipeline) -> DataFrame:
    """V1(a)/V4/K1 on the stored vector table: the 10 nearest other vectors
    of every vector (self pairs passed as exclusions)."""
    emb = table(p.spark, p.sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    hits = similarity_topk(
        emb.select(F.col("id").alias("qid"), "embedding"),
        emb.select(F.col("id").alias("iid"), "embedding"),
        10,
        exclude=emb.select(F.col("id").alias("qid"), F.col("id").alias("iid")),
    )
    return hits.select(F.col("qid").alias("vec_id"), "rank", F.col("iid").alias("vecino"),
                       F.round("sim", 4).alias("similitud_vectorial"))


# --- the same lists by a pruned search (V7) ---------------------------------------------------------


def _vectors(p: Pipeline) -> DataFrame:
    return table(p.spark, p.sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")


CASES = ("topk_places", "topk_users", "vector_neighbours")


def _case(p: Pipeline, case: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Queries, items, excluded pairs and k of one of the three retrievals."""
    if case == "vector_neighbours":
        emb = _vectors(p)
        return (emb.select(F.col("id").alias("qid"), "embedding"), emb.select(F.col("id").alias("iid"), "embedding"),
                emb.select(F.col("id").alias("qid"), F.col("id").alias("iid")), 10)
    p.prepare()
    if case == "topk_places":
        return (p.user_context_vectors.select(F.col("id_usuario").alias("qid"), "embedding"),
                p.place_vectors.select(F.col("url_sitio").alias("iid"), "embedding"),
                p.consumed.select(F.col("id_usuario").alias("qid"), F.col("url_sitio").alias("iid")), 6)
    return (p.site_context_vectors.select(F.col("url_sitio").alias("qid"), "embedding"),
            p.user_document_vectors.select(F.col("id_usuario").alias("iid"), "embedding"),
            p.visitors.select(F.col("url_sitio").alias("qid"), F.col("id_usuario").alias("iid")), 10)


def _pruned(p: Pipeline, case: str) -> DataFrame:
    queries, items, exclude, k = _case(p, case)
    return pruned_topk(queries, items, k, exclude=exclude)[0]


@register("ann_topk_places", O.sql(f"SELECT id_usuario, url_sitio, rank, similitud_vectorial FROM {O.topk_places_fragment(6)}", O.topk_places_fragment(6)))
def _ann_topk_places(p: Pipeline) -> DataFrame:
    """V7: the lists of ``topk_places`` by the pruned search."""
    return _pruned(p, "topk_places").select(F.col("qid").alias("id_usuario"), F.col("iid").alias("url_sitio"), "rank",
                                            F.round("sim", 4).alias("similitud_vectorial"))


@register("ann_topk_users", O.sql(f"SELECT url_sitio, id_usuario, rank, similitud_vectorial FROM {O.topk_users_fragment(10)}", O.topk_users_fragment(10)))
def _ann_topk_users(p: Pipeline) -> DataFrame:
    """V7: the lists of ``topk_users`` by the pruned search."""
    return _pruned(p, "topk_users").select(F.col("qid").alias("url_sitio"), F.col("iid").alias("id_usuario"), "rank",
                                           F.round("sim", 4).alias("similitud_vectorial"))


@register("ann_vector_neighbours", _NEIGHBOURS)
def _ann_vector_neighbours(p: Pipeline) -> DataFrame:
    """V7: the lists of ``vector_neighbours`` by the pruned search."""
    return _pruned(p, "vector_neighbours").select(F.col("qid").alias("vec_id"), "rank", F.col("iid").alias("vecino"),
                                                  F.round("sim", 4).alias("similitud_vectorial"))


@register("ann_topk_recall")
def _ann_topk_recall(p: Pipeline) -> DataFrame:
    """V7: for each retrieval the share of the full comparison's hits that the
    pruned search finds, and the share of all pairs that it compares."""
    out = None
    for case in CASES:
        queries, items, exclude, k = _case(p, case)
        # Texts are embedded once for both searches.
        written = write_all({"queries": queries, "items": items, "exclude": exclude})
        queries, items, exclude = written["queries"], written["items"], written["exclude"]
        hits, compared, pairs = pruned_topk(queries, items, k, exclude=exclude)
        full = similarity_topk(queries, items, k, exclude=exclude)
        both = full.select("qid", "iid", F.col("rank").alias("r")).join(hits.select("qid", "iid", "rank"), ["qid", "iid"], "left")
        row = both.agg(F.count(F.lit(1)).alias("vecinos"), F.round(F.count_if(F.col("rank") == F.col("r")) / F.count(F.lit(1)), 6).alias("recall")).select(
            F.lit(case).alias("caso"), F.lit(k).alias("k"), "vecinos", "recall", F.lit(compared).cast("long").alias("pares_comparados"),
            F.lit(pairs).cast("long").alias("pares"), F.round(F.lit(compared / max(pairs, 1)), 6).alias("parte_comparada"))
        out = row if out is None else out.unionByName(row)
    return out
