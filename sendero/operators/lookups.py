"""Lookups, labels, previews and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sendero.functions import fixed
from sendero.functions.text import render

U = "id_usuario"
URL = "url_sitio"


def unknown_users(requested: DataFrame, profiles: DataFrame) -> DataFrame:
    """P2 in batch: requested ids without a profile (the API raises on any)."""
    return requested.select(F.trim(F.col(U).cast("string")).alias(U)).distinct().join(
        profiles.select(U), U, "left_anti"
    )


def unknown_places(requested: DataFrame, catalog: DataFrame) -> DataFrame:
    """P3 in batch: requested (trimmed) urls that are not in the catalogue."""
    return requested.select(F.trim(F.col(URL)).alias(URL)).where(F.col(URL).isNotNull()).distinct().join(
        catalog.select(URL), URL, "left_anti"
    )


def user_labels(profiles: DataFrame) -> DataFrame:
    """``id - nombre`` labels and the id parsed back from them."""
    label = render("{id}" + fixed.USER_LABEL_SEPARATOR + "{nombre}", id=F.col(U), nombre=F.col("nombre"))
    return profiles.select(
        F.lit("usuario").alias("tipo"),
        label.alias("etiqueta"),
        F.trim(F.substring_index(label, fixed.USER_LABEL_SEPARATOR, 1)).alias("id_parseado"),
    )


def place_labels(selector: DataFrame) -> DataFrame:
    """``nombre (categoría - ubicación) | ID: url`` and the url parsed back."""
    label = render(
        "{nombre_sitio} ({categoria_sitio} - {ubicacion})" + fixed.PLACE_LABEL_SEPARATOR + "{url_sitio}",
        nombre_sitio=F.col("nombre_sitio"), categoria_sitio=F.col("categoria_sitio"),
        ubicacion=F.col("ubicacion"), url_sitio=F.col(URL),
    )
    return selector.select(
        F.lit("sitio").alias("tipo"),
        label.alias("etiqueta"),
        F.trim(F.substring_index(label, fixed.PLACE_LABEL_SEPARATOR, -1)).alias("id_parseado"),
    )


PREVIEW_COLUMNS = [U, "nombre", "edad", "nacionalidad", "tipo_viajero"]


def users_preview(profiles: DataFrame, n: int = 10) -> DataFrame:
    """The first n profiles by id with their position, the total
    number of profiles and the id column's type; the limit is the feature (a
    preview), Spark plans it as a TakeOrdered top-n."""
    cols = [c for c in PREVIEW_COLUMNS if c in profiles.columns]
    total = profiles.count()  # a scalar
    top = profiles.select(*cols).orderBy(U).limit(n)
    return top.withColumn("posicion", F.row_number().over(Window.orderBy(U))).withColumn(
        "total", F.lit(total).cast("bigint")
    ).withColumn("tipo_id", F.lit(profiles.schema[U].dataType.simpleString()))


def cold_start_users(profiles: DataFrame, implicit: DataFrame) -> DataFrame:
    """Profiles without any interaction history."""
    return profiles.select(U).join(implicit.select(U), U, "left_anti")


def dataset_counts(**tables: DataFrame) -> DataFrame:
    """Row count per named table, one aggregate per table unioned."""
    parts = [df.agg(F.count(F.lit(1)).alias("filas")).select(F.lit(name).alias("tabla"), "filas")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
