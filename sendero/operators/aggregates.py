"""Per-user and per-site aggregates (A1-A9) and the implicit narrative.

All groupings use aggregates with a map-side partial step, and per-group
"first k" picks use ``row_number() <= k`` which the optimizer turns into a
partial WindowGroupLimit before the shuffle, so a user or site holding a large
share of all rows never arrives whole at one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sendero.functions import fixed
from sendero.functions.narratives import implicit_from_parts
from sendero.operators.clean import ORDER

U = "id_usuario"
URL = "url_sitio"
SITE_FIELDS = ["nombre_sitio", "categoria_sitio", "ubicacion"]


def frequencies(inter: DataFrame) -> DataFrame:
    """(id_usuario, kind, val, n): counts of categories (cat) and locations
    (loc) per user, and one row per user with history (any).  One scan, one
    hash aggregation with a map-side partial step."""
    keys = F.array(
        F.struct(F.lit("cat").alias("kind"), F.col("categoria_sitio").alias("val")),
        F.struct(F.lit("loc").alias("kind"), F.col("ubicacion").alias("val")),
        F.struct(F.lit("any").alias("kind"), F.lit("").alias("val")),
    )
    rows = inter.select(U, F.explode(keys).alias("key")).select(U, "key.kind", "key.val").where(F.col("val").isNotNull())
    return rows.groupBy(U, "kind", "val").agg(F.count(F.lit(1)).alias("n"))


def first_row_per_site(inter: DataFrame) -> DataFrame:
    """First interaction row (by ``orden``) of every url, as (url_sitio,
    fields...).  ``row_number() = 1`` keeps one row per url and task before
    the shuffle (partial WindowGroupLimit)."""
    first = Window.partitionBy(URL).orderBy(ORDER, *SITE_FIELDS)
    rows = inter.select(URL, ORDER, *SITE_FIELDS).withColumn("_rn", F.row_number().over(first))
    return rows.where(F.col("_rn") == 1).select(URL, *SITE_FIELDS)


def place_catalog(inter: DataFrame) -> DataFrame:
    """A1: first row per url, then rows without url or name dropped."""
    return first_row_per_site(inter).na.drop(subset=[URL, "nombre_sitio"])


def place_selector(inter: DataFrame) -> DataFrame:
    """A2: first row per url without the null filter."""
    return first_row_per_site(inter)


def top_frequent(inter: DataFrame, column: str, k: int) -> DataFrame:
    """A3/A4: the k most frequent non-null values per user (count desc, value asc)."""
    counts = inter.where(F.col(column).isNotNull()).groupBy(U, column).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(U).orderBy(F.desc("n"), F.asc(column))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(U, "rank", column, "n")


def _kinds(inter: DataFrame):
    kind = F.lower(F.col("tipo_interaccion"))
    rating = F.col("calificacion").cast("double")
    return F.filter(
        F.array(
            F.when(kind == fixed.BOOKING_KIND, F.lit("booked")),
            F.when(kind == fixed.FAVOURITE_KIND, F.lit("favourite")),
            F.when(rating >= fixed.TOP_RATED_MIN, F.lit("rated")),
        ),
        lambda x: x.isNotNull(),
    )


def first_items(inter: DataFrame, kind: str, k: int = fixed.FIRST_ITEMS) -> DataFrame:
    """First k named sites per user of one kind, in row order."""
    rows = inter.where(F.col("nombre_sitio").isNotNull()).select(
        U, ORDER, "nombre_sitio", F.explode(_kinds(inter)).alias("kind")
    ).where(F.col("kind") == kind)
    w = Window.partitionBy(U).orderBy(ORDER)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(U, "rank", "nombre_sitio")


def implicit_profile(inter: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Per user with history: the five picks and the implicit narrative.

    One plan for all components: frequency counts and "first items" rows are
    unioned into (user, kind, order keys, value), ranked by one window per
    (user, kind) with a limit of 3, then folded per user into at most 15
    small entries.  A marker row per user keeps users whose picks are all
    empty (their text uses the defaults).
    """
    base = inter.select(U, ORDER, "nombre_sitio", "categoria_sitio", "ubicacion",
                        "tipo_interaccion", "calificacion")
    # Frequency counts (category, location and a per-user marker) come from
    # ``counts`` when given, else from one pass over the rows; the "first
    # items" kinds take a second pass.
    freq = (frequencies(inter) if counts is None else counts).select(U, "kind", "val", (-F.col("n")).alias("o1"), F.col("val").alias("o2"))
    firsts = base.where(F.col("nombre_sitio").isNotNull()).select(
        U,
        F.explode(_kinds(base)).alias("kind"),
        F.col("nombre_sitio").alias("val"),
        F.col(ORDER).alias("o1"),
        F.lit("").alias("o2"),
    )
    w = Window.partitionBy(U, "kind").orderBy("o1", "o2")
    picks = (
        freq.unionByName(firsts)
        .withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= fixed.TOP_CATEGORIES)
        .where((F.col("kind") != "loc") | (F.col("rn") <= fixed.TOP_LOCATIONS))
    )
    folded = picks.groupBy(U).agg(F.collect_list(F.struct("kind", "rn", "val")).alias("p"))

    def pick(kind: str):
        chosen = F.array_sort(F.filter(F.col("p"), lambda x: x["kind"] == kind))
        return F.transform(chosen, lambda x: x["val"])

    out = folded.select(
        U,
        pick("cat").alias("top_categorias"),
        pick("loc").alias("top_ubicaciones"),
        pick("booked").alias("reservas"),
        pick("favourite").alias("favoritos"),
        pick("rated").alias("mejor_valorados"),
    )
    return out.withColumn(
        "narrativa_implicita",
        implicit_from_parts(
            F.col("top_categorias"), F.col("top_ubicaciones"), F.col("reservas"),
            F.col("favoritos"), F.col("mejor_valorados"),
        ),
    )


def consumed_sites(inter: DataFrame) -> DataFrame:
    """Distinct (user, url) pairs with a url."""
    return inter.where(F.col(URL).isNotNull()).select(U, URL).distinct()


def site_visitors(inter: DataFrame) -> DataFrame:
    """Distinct (url, user) pairs."""
    return inter.where(F.col(URL).isNotNull()).select(URL, U).distinct()
