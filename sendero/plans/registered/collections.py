"""Registered queries: vector collections (batch and streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendero.functions import fixed
from sendero.plans import oracle as O
from sendero.plans.pipeline import Pipeline
from sendero.plans.registry import register
from sendero.session import scratch_path
from sendero.sources import index as IX
from sendero.streaming.incremental_index import start_place_index_stream


# --- vector collections ---------------------------------------------------------------------

_PLACE_INDEX_SQL = O.sql(f"""
SELECT t.url_sitio AS id, t.documento AS document,
  coalesce(t.nombre_sitio, '{fixed.DEFAULT_NAME}') AS nombre_sitio,
  coalesce(t.categoria_sitio, '{fixed.DEFAULT_FIELD}') AS categoria_sitio,
  coalesce(t.ubicacion, '{fixed.DEFAULT_FIELD}') AS ubicacion,
  t.url_sitio, {O.DIM} AS dims, round(sqrt(n.nn), 6) AS norma
FROM place_texts t JOIN place_vec_norm n ON n.id = t.url_sitio""", "place_texts", "place_vec_norm")


def _place_rows(p: Pipeline) -> DataFrame:
    return IX.place_index_rows(p.place_texts, p.place_vectors)


def _user_rows(p: Pipeline) -> DataFrame:
    return IX.user_index_rows(p.user_index_rows, p.user_document_vectors)


@register("place_index", _PLACE_INDEX_SQL)
def _place_index(p: Pipeline) -> DataFrame:
    """Place collection rows (vector shown as dims and norm)."""
    return IX.index_summary(_place_rows(p))


@register("user_index", O.sql(f"""
SELECT u.id_usuario AS id, u.resumen_perfil AS document, u.id_usuario, u.nombre, u.nacionalidad,
  u.tipo_viajero, u.presupuesto_viaje, {O.DIM} AS dims, round(sqrt(n.nn), 6) AS norma
FROM user_index_rows u JOIN udoc_vec_norm n ON n.id = u.id_usuario""", "user_index_rows", "udoc_vec_norm"))
def _user_index(p: Pipeline) -> DataFrame:
    """User collection rows, written with overwrite (drop and
    recreate) and read back."""
    idx = IX.VectorIndex(p.spark, scratch_path(p.spark, IX.USERS), IX.USER_METADATA)
    idx.overwrite(_user_rows(p))
    return IX.index_summary(idx.read())


@register("index_upsert", _PLACE_INDEX_SQL)
def _index_upsert(p: Pipeline) -> DataFrame:
    """The same batch upserted twice leaves the collection unchanged."""
    idx = IX.VectorIndex(p.spark, scratch_path(p.spark, IX.PLACES), IX.PLACE_METADATA).get_or_create()
    rows = _place_rows(p)
    idx.upsert(rows)
    idx.upsert(rows)
    return IX.index_summary(idx.read())


@register("index_new_only", O.sql("""
SELECT id_usuario AS id, narrativa_explicita AS document FROM user_texts WHERE trim(documento) <> ''""",
    "user_texts"))
def _index_new_only(p: Pipeline) -> DataFrame:
    """A stale collection (explicit-only documents of users with
    history) receives only the ids it lacks; existing rows are kept."""
    idx = IX.VectorIndex(p.spark, scratch_path(p.spark, IX.USERS), IX.USER_METADATA)
    stale_rows = p.user_index_rows.join(p.interactions.select("id_usuario"), "id_usuario", "left_semi").join(
        p.user_texts.select("id_usuario", "narrativa_explicita"), "id_usuario"
    ).withColumn("resumen_perfil", F.col("narrativa_explicita")).drop("narrativa_explicita")
    stale = IX.user_index_rows(stale_rows, p.embedder(stale_rows, "id_usuario", "resumen_perfil"))
    idx.overwrite(stale)
    idx.ingest(_user_rows(p), force=False)
    return idx.read().select("id", "document")


@register("index_listing", O.sql(f"""
SELECT coalesce(nombre_sitio, '{fixed.DEFAULT_NAME}') AS nombre_sitio,
  coalesce(categoria_sitio, '{fixed.DEFAULT_FIELD}') AS categoria_sitio,
  coalesce(ubicacion, '{fixed.DEFAULT_FIELD}') AS ubicacion, url_sitio, documento AS documento_indexado
FROM place_texts""", "place_texts"))
def _index_listing(p: Pipeline) -> DataFrame:
    """Full scan of the written place collection: metadata + document."""
    idx = IX.VectorIndex(p.spark, scratch_path(p.spark, IX.PLACES), IX.PLACE_METADATA)
    idx.ingest(_place_rows(p))
    return idx.listing()


@register("place_index_stream", _PLACE_INDEX_SQL)
def _place_index_stream(p: Pipeline) -> DataFrame:
    """S7 over a stream: the events file is consumed by a file stream source
    and every micro-batch inserts the sites the collection lacks."""
    path = scratch_path(p.spark, IX.PLACES + "-stream")
    q = start_place_index_stream(p.spark, p.sf_dir, p.sf_dir, path, state_path=path + "-state",
                                 file_pattern="events.parquet")
    q.awaitTermination()
    return IX.index_summary(IX.VectorIndex(p.spark, path, IX.PLACE_METADATA).read())
