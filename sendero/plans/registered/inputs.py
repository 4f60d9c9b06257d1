"""Registered queries: inputs, cleaning, aggregates, narratives, vectors, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendero.functions import fixed
from sendero.functions.text import render_sql
from sendero.operators import aggregates as A
from sendero.operators import lookups as L
from sendero.operators import recommend as R
from sendero.operators.clean import ORDER
from sendero.operators.embed import cosine
from sendero.plans import oracle as O
from sendero.plans.pipeline import Pipeline
from sendero.plans.registry import register


# --- inputs, cleaning, aggregates ------------------------------------------------------
@register("profiles_clean", O.sql("SELECT * FROM prof", "prof"))
def _profiles_clean(p: Pipeline) -> DataFrame:
    """Typed profiles with trimmed ids."""
    return p.profiles


@register("interactions_clean", O.sql("SELECT * FROM inter", "inter"))
def _interactions_clean(p: Pipeline) -> DataFrame:
    """Typed interactions, trimmed ids and urls, no blank users."""
    return p.commented.drop(ORDER)


@register("place_catalog", O.sql("SELECT * FROM catalog", "catalog"))
def _place_catalog(p: Pipeline) -> DataFrame:
    """A1: first row per url, then null url/name dropped."""
    return p.catalog


@register("place_selector", O.sql("SELECT * FROM first_rows", "first_rows"))
def _place_selector(p: Pipeline) -> DataFrame:
    """A2: first row per url without the null filter."""
    return p.selector


def _freq_sql(column: str, k: int) -> str:
    return O.sql(f"""
SELECT id_usuario, rank, {column}, n FROM (
  SELECT id_usuario, {column}, count(*) AS n,
         CAST(row_number() OVER (PARTITION BY id_usuario ORDER BY count(*) DESC, {column}) AS INTEGER) AS rank
  FROM inter WHERE {column} IS NOT NULL GROUP BY id_usuario, {column}
) WHERE rank <= {k}""", "inter")


@register("user_top_categories", _freq_sql("categoria_sitio", 3))
def _user_top_categories(p: Pipeline) -> DataFrame:
    """A3/K3: three most frequent categories per user."""
    return A.top_frequent(p.interactions, "categoria_sitio", 3)


@register("user_top_locations", _freq_sql("ubicacion", 2))
def _user_top_locations(p: Pipeline) -> DataFrame:
    """A4: two most frequent locations per user."""
    return A.top_frequent(p.interactions, "ubicacion", 2)


def _first_sql(kind: str) -> str:
    return O.sql(f"""
SELECT id_usuario, rank, nombre_sitio FROM (
  SELECT id_usuario, nombre_sitio, CAST(row_number() OVER (PARTITION BY id_usuario ORDER BY id_interaccion) AS INTEGER) AS rank
  FROM first_kinds WHERE kind = '{kind}'
) WHERE rank <= 3""", "first_kinds")


@register("user_bookings", _first_sql("booked"))
def _user_bookings(p: Pipeline) -> DataFrame:
    """First three booked sites per user (duplicates kept)."""
    return A.first_items(p.interactions, "booked")


@register("user_favorites", _first_sql("favourite"))
def _user_favorites(p: Pipeline) -> DataFrame:
    """First three favourites per user."""
    return A.first_items(p.interactions, "favourite")


@register("user_top_rated", _first_sql("rated"))
def _user_top_rated(p: Pipeline) -> DataFrame:
    """First three sites rated 4 or more per user."""
    return A.first_items(p.interactions, "rated")


@register("consumed_sites", O.sql("SELECT * FROM consumed", "consumed"))
def _consumed_sites(p: Pipeline) -> DataFrame:
    """Distinct consumed (user, url) pairs."""
    return p.consumed


@register("site_visitors", O.sql(
    "SELECT DISTINCT url_sitio, id_usuario FROM inter WHERE url_sitio IS NOT NULL", "inter"))
def _site_visitors(p: Pipeline) -> DataFrame:
    """Distinct (url, user) visitor pairs."""
    return p.visitors


# --- narratives -------------------------------------------------------------------------
@register("explicit_narrative", O.sql("SELECT id_usuario, narrativa_explicita FROM user_texts", "user_texts"))
def _explicit_narrative(p: Pipeline) -> DataFrame:
    """Declared-profile narrative of every user."""
    return p.user_texts.select("id_usuario", "narrativa_explicita")


@register("implicit_narrative", O.sql("SELECT id_usuario, narrativa_implicita FROM implicit", "implicit"))
def _implicit_narrative(p: Pipeline) -> DataFrame:
    """History narrative of every user with interactions."""
    return p.implicit.select("id_usuario", "narrativa_implicita")


@register("user_documents", O.sql("SELECT id_usuario, documento FROM user_texts", "user_texts"))
def _user_documents(p: Pipeline) -> DataFrame:
    """Profile left-joined with its history text, indexed form."""
    return p.user_texts.select("id_usuario", "documento")


@register("user_context", O.sql("SELECT id_usuario, contexto FROM user_texts", "user_texts"))
def _user_context(p: Pipeline) -> DataFrame:
    """Query context (recent-behaviour or cold-start form)."""
    return p.user_texts.select("id_usuario", "contexto")


@register("place_narratives", O.sql("""
SELECT t.url_sitio, t.narrativa_catalogo, t.documento, s.contexto
FROM place_texts t JOIN site_contexts s ON s.url_sitio = t.url_sitio""", "place_texts", "site_contexts"))
def _place_narratives(p: Pipeline) -> DataFrame:
    """The three site text forms of every catalogued site."""
    return p.place_texts.select("url_sitio", "narrativa_catalogo", "documento").join(
        p.site_contexts.select("url_sitio", "contexto"), "url_sitio"
    )


# --- vectors ------------------------------------------------------------------------------
@register("hashed_embeddings", O.sql("SELECT id AS id_usuario, b AS bucket, n FROM udoc_vec", "udoc_vec"))
def _hashed_embeddings(p: Pipeline) -> DataFrame:
    """V1(b): sparse hashed token counts of every indexed user document."""
    docs = p.user_texts.where(F.trim(F.col("documento")) != "")
    return p.embedder.sparse(docs, "id_usuario", "documento")


@register("cosine_pairs", O.sql("""
SELECT c.id_usuario, c.url_sitio,
  round(coalesce(d.dot, 0) / (sqrt(un.nn) * sqrt(pn.nn)), 4) AS similitud_vectorial
FROM consumed c
JOIN uctx_vec_norm un ON un.id = c.id_usuario
JOIN place_vec_norm pn ON pn.id = c.url_sitio
LEFT JOIN (
  SELECT u.id AS uid, v.id AS pid, sum(u.n * v.n) AS dot
  FROM uctx_vec u JOIN place_vec v ON u.b = v.b
  WHERE EXISTS (SELECT 1 FROM consumed x WHERE x.id_usuario = u.id AND x.url_sitio = v.id)
  GROUP BY u.id, v.id
) d ON d.uid = c.id_usuario AND d.pid = c.url_sitio""", "consumed", "uctx_vec_norm", "place_vec_norm"))
def _cosine_pairs(p: Pipeline) -> DataFrame:
    """V4: cosine of each user's context to each site the user consumed
    (a keyed join on existing pairs, JVM-side vector arithmetic)."""
    u = p.user_context_vectors.select("id_usuario", F.col("embedding").alias("u"))
    s = p.place_vectors.select("url_sitio", F.col("embedding").alias("s"))
    return p.consumed.join(u, "id_usuario").join(s, "url_sitio").select(
        "id_usuario", "url_sitio", F.round(cosine(F.col("u"), F.col("s")), 4).alias("similitud_vectorial")
    )


# --- lookups, labels, previews, counts ------------------------------------------------------
@register("unknown_users", O.sql("""
SELECT DISTINCT trim(id_usuario) AS id_usuario FROM inter
WHERE trim(id_usuario) NOT IN (SELECT id_usuario FROM prof)""", "inter", "prof"))
def _unknown_users(p: Pipeline) -> DataFrame:
    """User ids referenced by interactions that have no profile."""
    return L.unknown_users(p.interactions, p.profiles)


@register("unknown_places", O.sql("""
SELECT DISTINCT url_sitio FROM inter
WHERE url_sitio IS NOT NULL AND url_sitio NOT IN (SELECT url_sitio FROM catalog)""", "inter", "catalog"))
def _unknown_places(p: Pipeline) -> DataFrame:
    """Referenced urls that did not make it into the catalogue."""
    return L.unknown_places(p.interactions, p.catalog)


@register("selector_labels", O.sql(f"""
SELECT 'usuario' AS tipo, etiqueta, trim(split_part(etiqueta, '{fixed.USER_LABEL_SEPARATOR}', 1)) AS id_parseado
FROM (SELECT {render_sql('{id}' + fixed.USER_LABEL_SEPARATOR + '{nombre}', id='id_usuario', nombre='nombre')} AS etiqueta FROM prof)
UNION ALL
SELECT 'sitio' AS tipo, etiqueta, trim(string_split(etiqueta, '{fixed.PLACE_LABEL_SEPARATOR}')[-1]) AS id_parseado
FROM (SELECT {render_sql('{n} ({c} - {u})' + fixed.PLACE_LABEL_SEPARATOR + '{url}', n='nombre_sitio', c='categoria_sitio', u='ubicacion', url='url_sitio')} AS etiqueta FROM first_rows)
""", "prof", "first_rows"))
def _selector_labels(p: Pipeline) -> DataFrame:
    """Selector labels for users and sites and the ids parsed back."""
    return L.user_labels(p.profiles).unionByName(L.place_labels(p.selector))


@register("users_preview", O.sql("""
SELECT id_usuario, nombre, edad, nacionalidad, tipo_viajero,
  CAST(row_number() OVER (ORDER BY id_usuario) AS INTEGER) AS posicion,
  (SELECT count(*) FROM prof) AS total, 'string' AS tipo_id
FROM (SELECT * FROM prof ORDER BY id_usuario LIMIT 10)""", "prof"))
def _users_preview(p: Pipeline) -> DataFrame:
    """Preview of the first 10 profiles with their positions."""
    return L.users_preview(p.profiles, 10)


@register("cold_start_users", O.sql("""
SELECT id_usuario FROM prof WHERE id_usuario NOT IN (SELECT id_usuario FROM inter)""", "prof", "inter"))
def _cold_start_users(p: Pipeline) -> DataFrame:
    """Profiles without history (cold start)."""
    return L.cold_start_users(p.profiles, p.implicit)


@register("dataset_counts", O.sql("""
SELECT 'perfiles' AS tabla, count(*) AS filas FROM prof
UNION ALL SELECT 'interacciones', count(*) FROM inter
UNION ALL SELECT 'lugares_turisticos', count(*) FROM catalog
UNION ALL SELECT 'perfiles_usuarios', count(*) FROM user_index_rows""", "prof", "inter", "catalog", "user_index_rows"))
def _dataset_counts(p: Pipeline) -> DataFrame:
    """Row counts of profiles, interactions and the two collections."""
    return L.dataset_counts(
        perfiles=p.profiles, interacciones=p.interactions,
        lugares_turisticos=p.catalog, perfiles_usuarios=p.user_index_rows,
    )


@register("recommend_subset", O.sql(f"""
SELECT * FROM {O.topk_places_fragment(6)} WHERE id_usuario IN (SELECT id_usuario FROM inter)""",
    O.topk_places_fragment(6), "inter"))
def _recommend_subset(p: Pipeline) -> DataFrame:
    """Retrieval for requested users (here: users with history): a
    left-semi join before embedding and scoring."""
    return p.topk_places_of(p.interactions, 6)


@register("no_candidates", O.sql(f"""
SELECT 'directa' AS direccion, id_usuario AS sujeto, '{fixed.NO_PLACE_CANDIDATES}' AS mensaje
FROM prof WHERE id_usuario NOT IN (SELECT id_usuario FROM {O.topk_places_fragment(6)})
UNION ALL
SELECT 'inversa', url_sitio, '{fixed.NO_USER_CANDIDATES}'
FROM site_contexts WHERE url_sitio NOT IN (SELECT url_sitio FROM {O.topk_users_fragment(10)})""",
    "prof", O.topk_places_fragment(6), "site_contexts", O.topk_users_fragment(10)))
def _no_candidates(p: Pipeline) -> DataFrame:
    """M9: subjects whose retrieval is empty, with the outcome message."""
    d = R.no_candidates(p.profiles, "id_usuario", p.topk_places(6), fixed.NO_PLACE_CANDIDATES)
    i = R.no_candidates(p.site_contexts, "url_sitio", p.topk_users(10), fixed.NO_USER_CANDIDATES)
    return d.select(F.lit("directa").alias("direccion"), F.col("id_usuario").alias("sujeto"), "mensaje").unionByName(
        i.select(F.lit("inversa").alias("direccion"), F.col("url_sitio").alias("sujeto"), "mensaje"))
