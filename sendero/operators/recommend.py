"""Direct (user -> sites) and inverse (site -> users) retrieval and the
vector-only top-N baseline (J2-J7, K1, M6, M9, M10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sendero.functions import fixed
from sendero.functions.text import render
from sendero.operators.similarity import similarity_topk

U = "id_usuario"
URL = "url_sitio"

# Our justification texts for the vector-only baseline (not reference values).
DIRECT_REASON = "Afinidad vectorial con el perfil: categoría {categoria_sitio} en {ubicacion}."
INVERSE_REASON = "Perfil {tipo_viajero} con presupuesto {presupuesto_viaje} afín al sitio {nombre_sitio}."


def retrieve_places(user_vectors: DataFrame, place_vectors: DataFrame, consumed: DataFrame,
                    catalog: DataFrame, k: int = fixed.DIRECT_TOP_K, **blocking) -> DataFrame:
    """V5 for every user: top-k sites not yet consumed, with site metadata.

    user_vectors (id_usuario, embedding); place_vectors (url_sitio, embedding);
    consumed (id_usuario, url_sitio); catalog (url_sitio, nombre_sitio, ...).
    """
    # Site metadata (three short texts) rides with the site vectors through
    # the kernel (J6), so the k-per-user output needs no join by site - a
    # join that would be skewed towards the most recommended sites.
    fields = ("nombre_sitio", "categoria_sitio", "ubicacion")
    items = place_vectors.join(catalog.select(URL, *fields), URL).select(F.col(URL).alias("iid"), "embedding", *fields)
    hits = similarity_topk(
        user_vectors.select(F.col(U).alias("qid"), "embedding"),
        items,
        k,
        exclude=consumed.select(F.col(U).alias("qid"), F.col(URL).alias("iid")),
        item_payload=fields,
        **blocking,
    )
    return hits.select(
        F.col("qid").alias(U),
        "rank",
        F.col("iid").alias(URL),
        *fields,
        F.round("sim", 4).alias("similitud_vectorial"),
    )


def retrieve_users(place_vectors: DataFrame, user_vectors: DataFrame, visitors: DataFrame,
                   user_index_rows: DataFrame, k: int = fixed.INVERSE_TOP_K, **blocking) -> DataFrame:
    """V6 for every site: top-k users who never interacted with it.

    user_index_rows (id_usuario, nombre, nacionalidad, tipo_viajero,
    presupuesto_viaje, resumen_perfil) carries the attached fields.
    """
    hits = similarity_topk(
        place_vectors.select(F.col(URL).alias("qid"), "embedding"),
        user_vectors.select(F.col(U).alias("iid"), "embedding"),
        k,
        exclude=visitors.select(F.col(URL).alias("qid"), F.col(U).alias("iid")),
        **blocking,
    )
    return hits.join(user_index_rows, hits.iid == user_index_rows[U]).select(
        F.col("qid").alias(URL),
        "rank",
        U,
        "nombre",
        "nacionalidad",
        "tipo_viajero",
        "presupuesto_viaje",
        F.round("sim", 4).alias("similitud_vectorial"),
        "resumen_perfil",
    )


def affinity_level(subject: str) -> F.Column:
    """Baseline affinity: the first, second and last third of a list."""
    tile = F.ntile(3).over(Window.partitionBy(subject).orderBy("rank"))
    levels = fixed.AFFINITY_LEVELS
    return F.when(tile == 1, levels[0]).when(tile == 2, levels[1]).otherwise(levels[2])


def baseline_direct(candidates: DataFrame, n: int = fixed.TOP_N) -> DataFrame:
    """M6: first n of the retrieved sites, with an affinity level and reason."""
    top = candidates.where(F.col("rank") <= n)
    return top.select(
        U, "rank", URL, "nombre_sitio", "categoria_sitio", "ubicacion",
        affinity_level(U).alias("nivel_afinidad"),
        render(DIRECT_REASON, categoria_sitio=F.col("categoria_sitio"), ubicacion=F.col("ubicacion")).alias("justificacion"),
        "similitud_vectorial",
    )


def baseline_inverse(candidates: DataFrame, sites: DataFrame, n: int = fixed.TOP_N) -> DataFrame:
    """M6 for the inverse pipeline: first n retrieved users with a reason."""
    top = candidates.where(F.col("rank") <= n).join(sites.select(URL, "nombre_sitio"), URL)
    return top.select(
        URL, "rank", U, "nombre", "tipo_viajero",
        render(INVERSE_REASON, tipo_viajero=F.col("tipo_viajero"),
               presupuesto_viaje=F.col("presupuesto_viaje"),
               nombre_sitio=F.col("nombre_sitio")).alias("justificacion_target"),
        "similitud_vectorial",
    )


def no_candidates(subjects: DataFrame, key: str, candidates: DataFrame, message: str) -> DataFrame:
    """M9: subjects for which retrieval returned nothing, with the message."""
    return subjects.select(key).join(candidates.select(key), key, "left_anti").select(
        key, F.lit(message).alias("mensaje")
    )


def config_sweep(candidates: DataFrame, grid: list[tuple[int, int]], models: list[str],
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """Baseline lists for every model and (K, N) of ``grid`` from one
    retrieval at the largest K (exact: the first K of a longer ranking are the
    top K).  The baseline is the same for each model; a caller generates
    from the rows of a model.  ``carry`` names further columns to keep.
    Each candidate row is expanded only into the configurations it belongs
    to (a generator over a literal array, no join)."""
    cfgs = F.array(*[F.struct(F.lit(m).alias("modelo"), F.lit(k).alias("top_k"), F.lit(n).alias("top_n")) for m in models for k, n in grid])
    rows = candidates.select(
        U, "rank", URL, *carry,
        F.explode(F.filter(cfgs, lambda c: F.col("rank") <= F.least(c["top_k"], c["top_n"]))).alias("cfg"),
    ).select(F.col("cfg.modelo").alias("modelo"), F.col("cfg.top_k").alias("top_k"), F.col("cfg.top_n").alias("top_n"), U, "rank", URL, *carry)
    tile = F.ntile(3).over(Window.partitionBy("modelo", "top_k", "top_n", U).orderBy("rank"))
    levels = fixed.AFFINITY_LEVELS
    return rows.withColumn(
        "nivel_afinidad", F.when(tile == 1, levels[0]).when(tile == 2, levels[1]).otherwise(levels[2])
    )
