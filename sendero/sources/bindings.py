"""Bindings of the two recommender inputs onto the driver's base tables.

``perfiles`` is derived from customer/nation/region and ``interacciones`` from
events/part/nation/documents.  The derivation rules are fixed by FIXTURES.md
(the same rules appear as SQL in ``sendero.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sendero.sources.tables import table


def perfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    # nation (25 rows) and region (5 rows) are fixed-size dimensions.
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    k = F.col("c_custkey")
    parity = k % 2 == 0
    joined = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(
        F.broadcast(r), n.n_regionkey == r.r_regionkey
    )
    # Some ids come twice; the second row stands later in the file.
    again = F.explode(F.when(k % 25 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("bis")
    joined = joined.select("*", again)
    return joined.select(
        (k * 2 + F.col("bis")).cast("bigint").alias("_fila"),
        k.cast("string").alias("id_usuario"),
        F.when(F.col("bis") == 1, F.concat(F.col("c_name"), F.lit(" (bis)"))).otherwise(F.col("c_name")).alias("nombre"),
        (18 + k % 60).cast("int").alias("edad"),
        F.when(k % 3 == 0, "Femenino").when(k % 3 == 1, "Masculino").otherwise("Otro").alias("genero"),
        F.col("n_name").alias("nacionalidad"),
        F.when(F.col("r_name") == "EUROPE", "Español")
        .when(F.col("r_name") == "AMERICA", "Inglés")
        .otherwise("Francés").alias("idioma_principal"),
        F.when(parity, "Universitario").otherwise("Secundario").alias("nivel_estudios"),
        F.col("c_mktsegment").alias("ocupacion"),
        F.when(parity, "Soltero").otherwise("Casado").alias("estado_civil"),
        F.when(k % 5 == 0, "Sí").otherwise("No").alias("tiene_hijos"),
        F.when(F.col("c_acctbal") < 0, "Bajo")
        .when(F.col("c_acctbal") < 5000, "Medio")
        .otherwise("Alto").alias("presupuesto_viaje"),
        F.when(k % 4 == 0, "Cultural").when(k % 4 == 1, "Aventura")
        .when(k % 4 == 2, "Relax").alias("tipo_viajero"),
        (1 + k % 21).cast("int").alias("duracion_estadia_promedio"),
        F.when(parity, "Verano").otherwise("Invierno").alias("epoca_preferida"),
        F.when(k % 3 == 0, "Pareja").when(k % 3 == 1, "Familia").otherwise("Solo").alias("compania_viaje"),
        F.col("r_name").alias("destino_frecuente"),
        F.lit("Hotel").alias("alojamiento_preferido"),
        F.when(k % 3 == 0, "Alta").when(k % 3 == 1, "Media").otherwise("Baja").alias("nivel_actividad"),
        F.lit("Móvil").alias("dispositivo_principal"),
        F.concat_ws("|", F.col("c_mktsegment"), F.col("n_name")).alias("intereses_principales"),
        F.concat_ws("|", F.lit("Museos"), F.when(parity, F.lit("Playa"))).alias("actividades_preferidas"),
    )


# Added clicks, at the first visit of a site: of the user who has been
# everywhere on each visited site, and of users without a profile, one for each
# tenth site.
_EVERYWHERE, _EVERYWHERE_IDS = 5, 1_000_000_000_000
_UNKNOWN, _UNKNOWN_IDS, _UNKNOWN_EVERY = 9_000_000_000, 2_000_000_000_000, 10


def interacciones(spark: SparkSession, sf_dir: str, events: DataFrame | None = None, comments: bool = True) -> DataFrame:
    """``events`` may be given (e.g. one micro-batch of a stream); then the
    added clicks, which need all events, are left out.  The comment of an error
    event is the text of the document numbered event_id modulo the number of
    documents, if there is one; without ``comments`` the column is null and
    the documents are not read."""
    e = events if events is not None else table(spark, sf_dir, "events")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part_key = F.expr("try_cast(regexp_extract(props, '([0-9]+)', 1) as bigint)")
    ev = e.select("event_id", "ts", "user_id", "event_type", "value", part_key.alias("pk"))
    if events is None:
        pk = F.col("pk")
        everywhere = F.struct((F.lit(_EVERYWHERE_IDS) + pk).alias("event_id"), F.lit(_EVERYWHERE).cast("bigint").alias("user_id"))
        unknown = F.struct((F.lit(_UNKNOWN_IDS) + pk).alias("event_id"), (F.lit(_UNKNOWN) + pk).alias("user_id"))
        by = F.when(pk % _UNKNOWN_EVERY == 1, F.array(everywhere, unknown)).otherwise(F.array(everywhere))
        ev = ev.unionByName(ev.where(pk.isNotNull()).groupBy("pk").agg(F.min("ts").alias("ts")).select("ts", "pk", F.explode(by).alias("by")).select(
            "by.event_id", "ts", "by.user_id", F.lit("click").alias("event_type"), F.lit(0.0).alias("value"), "pk"))
    # part and documents grow with the data: the join strategy is left to the
    # planner and to adaptive execution.
    joined = (
        ev.join(p, ev.pk == p.p_partkey)
        .join(F.broadcast(n), (F.col("p_partkey") % 25) == n.n_nationkey)
    )
    if comments:
        d = table(spark, sf_dir, "documents").select("doc_id", "text")
        n_docs = max(d.count(), 1)
        joined = joined.join(d, (F.col("event_type") == "error") & ((F.col("event_id") % n_docs) == d.doc_id), "left")
    else:
        joined = joined.withColumn("text", F.lit(None).cast("string"))
    hour = F.hour("ts")
    et = F.col("event_type")
    return joined.select(
        F.col("event_id").alias("id_interaccion"),
        F.col("user_id").cast("string").alias("id_usuario"),
        F.col("ts").cast("date").alias("fecha_interaccion"),
        F.when(hour < 12, "Mañana").when(hour < 20, "Tarde").otherwise("Noche").alias("hora_dia"),
        F.when(F.col("event_id") % 2 == 0, "Móvil").otherwise("PC").alias("dispositivo_usado"),
        F.concat(F.lit("site/"), F.col("p_partkey").cast("string")).alias("url_sitio"),
        F.when(F.col("p_partkey") % 50 != 7, F.col("p_name")).alias("nombre_sitio"),
        F.col("p_type").alias("categoria_sitio"),
        F.col("n_name").alias("ubicacion"),
        F.when(et == "purchase", "Reserva").when(et == "signup", "Favorito")
        .when(et == "click", "Click").when(et == "view", "Calificación")
        .otherwise("Comentario").alias("tipo_interaccion"),
        F.when(et == "view", (1 + F.floor("value").cast("int") % 5).cast("double")).alias("calificacion"),
        F.when(et == "error", F.col("text")).alias("comentario"),
        F.floor(F.col("value") * 10).cast("bigint").alias("tiempo_visita_segundos"),
    )
