"""Derived tables of one scale-factor folder, built lazily and shared.

``Pipeline(spark, sf_dir)`` exposes every intermediate table of the engine as
a lazy DataFrame; each property is built once per instance, so plans that
reuse a table share its definition (Spark still plans each action on its own).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sendero.functions import fixed
from sendero.functions import narratives as N
from sendero.operators import aggregates as A
from sendero.operators import recommend as R
from sendero.operators.clean import clean_interactions, clean_profiles
from sendero.operators.embed import HashedTokenEmbedder
from sendero.operators.prompts import check_k_n
from sendero.session import ship_package, spread, write_all, write_once
from sendero.sources import bindings
from sendero.sources.csv import read_interactions_csv, read_profiles_csv

U = "id_usuario"
URL = "url_sitio"


class Pipeline:
    """``embedder`` (U2) maps (df, id_col, text_col) to (id, embedding);
    ``user_document`` (U1) builds the indexed user text from the explicit
    and implicit narrative columns (default N6)."""

    def __init__(self, spark: SparkSession, sf_dir: str | None, embedder=None, user_document=None, **blocking):
        self.spark = spark
        ship_package(spark)
        self.sf_dir = sf_dir
        self.embedder = embedder or HashedTokenEmbedder()
        self.user_document = user_document or N.full_narrative
        self.blocking = blocking
        self._retrieved: dict[str, dict[int, DataFrame]] = {}

    @classmethod
    def from_frames(cls, spark: SparkSession, profiles: DataFrame, interactions: DataFrame, **kw) -> "Pipeline":
        """A pipeline over caller-supplied raw profile and interaction frames
        (any column types; they are cleaned and typed here)."""
        p = cls(spark, None, **kw)
        p.__dict__["profiles"] = clean_profiles(profiles)
        p.__dict__["interactions"] = p.__dict__["commented"] = clean_interactions(interactions)
        return p

    @classmethod
    def from_csv(cls, spark: SparkSession, profiles_path: str, interactions_path: str, **kw) -> "Pipeline":
        """A pipeline over the two CSV inputs (header row, Latin-1)."""
        return cls.from_frames(spark, read_profiles_csv(spark, profiles_path),
                               read_interactions_csv(spark, interactions_path), **kw)

    def for_training(self, train: DataFrame) -> "Pipeline":
        """A pipeline whose histories, narratives and consumed sets come from
        ``train`` while profiles and the catalogue stay those of the full
        data (items first seen in the test period remain recommendable)."""
        q = Pipeline(self.spark, self.sf_dir, self.embedder, self.user_document, **self.blocking)
        q.__dict__["profiles"] = self.profiles
        q.__dict__["interactions"] = train
        q.__dict__["selector"] = self.selector
        q.__dict__["catalog"] = self.catalog
        return q

    # -- inputs ---------------------------------------------------------------
    @cached_property
    def profiles(self) -> DataFrame:
        return clean_profiles(bindings.perfiles(self.spark, self.sf_dir))

    @cached_property
    def interactions(self) -> DataFrame:
        """All interactions; ``comentario`` only in ``commented``."""
        return clean_interactions(bindings.interacciones(self.spark, self.sf_dir, comments=False))

    @cached_property
    def commented(self) -> DataFrame:
        return clean_interactions(bindings.interacciones(self.spark, self.sf_dir))

    def keep_interactions(self) -> None:
        """Write the cleaned interactions (without comments), for plans that
        read them many times: parsing, joins and dates are done once."""
        if not hasattr(self.interactions, "_written"):
            self.__dict__["interactions"] = write_once(self.interactions, "interactions")

    def prepare(self) -> None:
        """Write what a retrieval reads, side by side."""
        made = {"selector": lambda: A.place_selector(self.interactions), "consumed": lambda: A.consumed_sites(self.interactions),
                "user_texts": lambda: self.user_text_rows}
        self.__dict__.update(write_all({name: df() for name, df in made.items() if name not in self.__dict__}))

    # -- aggregates -------------------------------------------------------------
    @cached_property
    def selector(self) -> DataFrame:
        return write_once(A.place_selector(self.interactions), "selector")

    @cached_property
    def catalog(self) -> DataFrame:
        return self.selector.na.drop(subset=[URL, "nombre_sitio"])

    @cached_property
    def consumed(self) -> DataFrame:
        return write_once(A.consumed_sites(self.interactions), "consumed")

    @cached_property
    def visitors(self) -> DataFrame:
        return self.consumed.select(URL, U)

    @cached_property
    def implicit(self) -> DataFrame:
        return A.implicit_profile(self.interactions)

    # -- narratives -------------------------------------------------------------
    @cached_property
    def user_texts(self) -> DataFrame:
        """``user_text_rows``, written once: vectors, prompts and envelopes
        each read their columns of it."""
        return write_once(self.user_text_rows, "user-texts")

    @cached_property
    def user_text_rows(self) -> DataFrame:
        """One row per profile: explicit, implicit ('' without history),
        indexed document (N6) and query context (N7)."""
        p = self.profiles.select(
            U, "nombre", "nacionalidad", "tipo_viajero", "presupuesto_viaje",
            N.explicit_narrative().alias("narrativa_explicita"),
        )
        imp = self.implicit.select(U, "narrativa_implicita")
        j = p.join(imp, U, "left").withColumn(
            "narrativa_implicita", F.coalesce(F.col("narrativa_implicita"), F.lit(""))
        )
        exp_, imp_ = F.col("narrativa_explicita"), F.col("narrativa_implicita")
        return j.select(
            "*",
            self.user_document(exp_, imp_).alias("documento"),
            N.user_context(exp_, imp_).alias("contexto"),
        )

    @cached_property
    def place_texts(self) -> DataFrame:
        return self.catalog.select(
            URL, "nombre_sitio", "categoria_sitio", "ubicacion",
            N.place_catalogue_text().alias("narrativa_catalogo"),
            N.place_document().alias("documento"),
        )

    @cached_property
    def site_contexts(self) -> DataFrame:
        """Inverse subjects: first row of every url (no name filter), N4 text."""
        return self.selector.where(F.col(URL).isNotNull()).select(
            URL, "nombre_sitio", "categoria_sitio", "ubicacion",
            N.place_query_context().alias("contexto"),
        )

    # -- vectors ------------------------------------------------------------------
    @cached_property
    def place_vectors(self) -> DataFrame:
        return self.embedder(self.place_texts, URL, "documento")

    @cached_property
    def user_context_vectors(self) -> DataFrame:
        return self.embedder(spread(self.user_texts.select(U, "contexto")), U, "contexto")

    @cached_property
    def user_document_vectors(self) -> DataFrame:
        docs = spread(self.user_texts.select(U, "documento")).where(F.trim(F.col("documento")) != "")
        return self.embedder(docs, U, "documento")

    @cached_property
    def site_context_vectors(self) -> DataFrame:
        return self.embedder(self.site_contexts, URL, "contexto")

    @cached_property
    def user_index_rows(self) -> DataFrame:
        t = self.user_texts.where(F.trim(F.col("documento")) != "")
        return t.select(
            U,
            F.coalesce("nombre", F.lit(fixed.DEFAULT_NAME)).alias("nombre"),
            F.coalesce("nacionalidad", F.lit(fixed.DEFAULT_FIELD)).alias("nacionalidad"),
            F.coalesce("tipo_viajero", F.lit(fixed.DEFAULT_FIELD)).alias("tipo_viajero"),
            F.coalesce("presupuesto_viaje", F.lit(fixed.DEFAULT_FIELD)).alias("presupuesto_viaje"),
            F.col("documento").alias("resumen_perfil"),
        )

    # -- retrieval -------------------------------------------------------------------
    def _hits(self, kind: str, k: int, retrieve) -> DataFrame:
        """The first k of each list, from the shortest list retrieved so far
        that is long enough; else retrieved now, and written once."""
        held = self._retrieved.setdefault(kind, {})
        longer = min((x for x in held if x >= k), default=None)
        if longer is None:
            self.prepare()
            held[k] = write_once(retrieve(k), f"hits-{kind}")
            return held[k]
        return held[longer] if longer == k else held[longer].where(F.col("rank") <= k)

    def topk_places(self, k: int = fixed.DIRECT_TOP_K) -> DataFrame:
        return self._hits("places", k, lambda n: self.places_for(self.user_context_vectors, n))

    def places_for(self, user_vectors: DataFrame, k: int) -> DataFrame:
        return R.retrieve_places(user_vectors, self.place_vectors, self.consumed, self.catalog, k, **self.blocking)

    def topk_users(self, k: int = fixed.INVERSE_TOP_K) -> DataFrame:
        return self._hits("users", k, lambda n: self.users_for(self.site_context_vectors, n))

    def users_for(self, site_vectors: DataFrame, k: int) -> DataFrame:
        return R.retrieve_users(site_vectors, self.user_document_vectors, self.visitors, self.user_index_rows, k, **self.blocking)

    def topk_places_of(self, users: DataFrame, k: int = fixed.DIRECT_TOP_K) -> DataFrame:
        """Retrieval for the users in ``users`` (id_usuario) alone: only their
        texts are embedded and scored."""
        wanted = self.user_texts.join(users.select(U).distinct(), U, "left_semi")
        return self.places_for(self.embedder(wanted, U, "contexto"), k)

    def recommend_direct(self, k: int = fixed.DIRECT_TOP_K, n: int = fixed.TOP_N) -> DataFrame:
        return R.baseline_direct(self.topk_places(k), check_k_n(k, n))

    def recommend_inverse(self, k: int = fixed.INVERSE_TOP_K, n: int = fixed.TOP_N) -> DataFrame:
        return R.baseline_inverse(self.topk_users(k), self.site_contexts, check_k_n(k, n))

    def lookup_user(self, user_id: str, k: int = fixed.DIRECT_TOP_K, n: int = fixed.TOP_N) -> DataFrame:
        """The single-user call of the reference: that user's text alone is
        embedded and scored; an unknown id raises (P2)."""
        uid = str(user_id).strip()
        one = self.user_texts.where(F.col(U) == uid)
        if one.limit(1).count() == 0:
            raise ValueError(f"user {uid!r} not found")
        return R.baseline_direct(self.places_for(self.embedder(one, U, "contexto"), k), check_k_n(k, n))

    def lookup_site(self, url: str, k: int = fixed.INVERSE_TOP_K, n: int = fixed.TOP_N) -> DataFrame:
        """The single-site call (P3): trimmed url, unknown urls raise."""
        key = str(url).strip()
        one = self.site_contexts.where(F.col(URL) == key)
        if one.limit(1).count() == 0:
            raise ValueError(f"site {key!r} not found")
        return R.baseline_inverse(self.users_for(self.embedder(one, URL, "contexto"), k), self.site_contexts, check_k_n(k, n))
