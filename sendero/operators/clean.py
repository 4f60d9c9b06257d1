"""Cleaning projections (P1, P5-P8): ids as trimmed text, typed columns,
optional columns with defaults.  One narrow projection per table; no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sendero.functions.text import blank_to_null
from sendero.sources.schemas import (
    INTERACTION_COLUMNS,
    INTERACTION_TYPES,
    PROFILE_COLUMNS,
    PROFILE_TYPES,
)

# Where a reader knows the place of a row in its file, and the order of rows
# that cleaned interactions carry.
ROW_ORDER = "_fila"
ORDER = "orden"


def _typed(df: DataFrame, columns: list[str], types: dict) -> list:
    out = []
    present = set(df.columns)
    for name in columns:
        target = types[name]
        if name not in present:
            # Optional column absent from the input: declared default (null).
            out.append(F.lit(None).cast(target).alias(name))
            continue
        field = df.schema[name].dataType
        c = F.col(name)
        if field != target:
            # try_cast: malformed text becomes null instead of failing (ANSI).
            c = F.expr(f"try_cast(`{name}` as {target.simpleString()})")
            if target.simpleString() in ("int", "bigint"):
                # "25.0" is 25.
                c = F.coalesce(c, F.expr(f"try_cast(try_cast(`{name}` as double) as {target.simpleString()})"))
        out.append(c.alias(name))
    return out


def clean_profiles(df: DataFrame) -> DataFrame:
    """One row per user id: of repeated ids the first row by the column
    ``ROW_ORDER`` (the CSV reader fills it with the place in the file), without
    that column the one whose cells hash lowest."""
    cols = _typed(df, PROFILE_COLUMNS, PROFILE_TYPES)
    place = F.col(ROW_ORDER).cast("long") if ROW_ORDER in df.columns else F.lit(0).cast("long")
    typed = df.select(*cols, place.alias(ROW_ORDER)).withColumn("id_usuario", blank_to_null(F.col("id_usuario")))
    first = Window.partitionBy("id_usuario").orderBy(ROW_ORDER, F.xxhash64(*PROFILE_COLUMNS))
    return (
        typed.where(F.col("id_usuario").isNotNull())
        .withColumn("_rn", F.row_number().over(first))
        .where(F.col("_rn") == 1)
        .select(*PROFILE_COLUMNS)
    )


def clean_interactions(df: DataFrame) -> DataFrame:
    """Typed rows and their order ``ORDER``, which exists for every row: the
    place in the file (``ROW_ORDER``) if the reader knows it, else the numeric
    id, else the date and then a hash of the id and of the other cells."""
    cols = _typed(df, INTERACTION_COLUMNS, INTERACTION_TYPES)
    raw_id = F.col("id_interaccion").cast("string") if "id_interaccion" in df.columns else F.lit(None).cast("string")
    day = F.coalesce(F.unix_date("fecha_interaccion"), F.lit(0)).cast("long")
    spread = F.xxhash64(F.lit("orden"), "_raw_id", *[c for c in INTERACTION_COLUMNS if c != "id_interaccion"])
    derived = F.shiftleft(day, 40) + F.shiftrightunsigned(spread, 24)
    place = F.col(ROW_ORDER).cast("long") if ROW_ORDER in df.columns else F.lit(None).cast("long")
    typed = df.select(*cols, raw_id.alias("_raw_id"), place.alias(ROW_ORDER)).withColumn(
        ORDER, F.coalesce(ROW_ORDER, "id_interaccion", derived)).drop("_raw_id", ROW_ORDER)
    return (
        typed.withColumn("id_usuario", blank_to_null(F.col("id_usuario")))
        .withColumn("url_sitio", blank_to_null(F.col("url_sitio")))
        .where(F.col("id_usuario").isNotNull())
    )
