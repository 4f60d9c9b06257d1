"""Knowledge graph over the interaction data.

Nodes and edges are unions of distinct projections.  Paths connect a user's
history to each retrieved candidate through a shared category or city: they
are found with equi-joins on (user, category) and (user, city) between the
user's distinct history attributes and the candidates' attributes, and each
path is reported once with its support (number of visited sites behind it),
so no site-to-site pair list is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendero.functions.text import render

U = "id_usuario"
URL = "url_sitio"

NODE_KINDS = ["Usuario", "Sitio", "Ciudad", "Region", "Categoria", "TipoViajero", "Aspecto"]
PATH_TEMPLATE = "{nombre_sitio} comparte {via} {nodo} con {soporte} sitio(s) de su historial"


def _node(df: DataFrame, col: str, kind: str) -> DataFrame:
    return df.select(F.col(col).cast("string").alias("nodo"), F.lit(kind).alias("tipo")).where(
        F.col("nodo").isNotNull()
    )


def nodes(profiles: DataFrame, catalog: DataFrame, city_regions: DataFrame, aspects: DataFrame) -> DataFrame:
    """(nodo, tipo) for every entity kind, distinct."""
    parts = [
        _node(profiles, U, "Usuario"),
        _node(catalog, URL, "Sitio"),
        _node(catalog, "ubicacion", "Ciudad"),
        _node(city_regions, "region", "Region"),
        _node(catalog, "categoria_sitio", "Categoria"),
        _node(profiles, "tipo_viajero", "TipoViajero"),
        _node(aspects, "aspecto", "Aspecto"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def city_regions(nation: DataFrame, region: DataFrame) -> DataFrame:
    """City (nation name of a site) -> region, from the nation/region tables."""
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("ubicacion"), F.col("r_name").alias("region")
    )


def edges(inter: DataFrame, catalog: DataFrame, cities: DataFrame, site_aspects: DataFrame) -> DataFrame:
    """(origen, destino, relacion, calificacion, fecha, polaridad).

    VISITO user->site (one edge per interaction, with rating and date),
    UBICADO_EN site->city and city->region, PERTENECE_A site->category,
    OFRECE_ASPECTO site->aspect with the summed comment polarity."""
    none_d, none_s, none_i = F.lit(None).cast("double"), F.lit(None).cast("date"), F.lit(None).cast("int")
    visito = inter.where(F.col(URL).isNotNull()).select(
        F.col(U).alias("origen"), F.col(URL).alias("destino"), F.lit("VISITO").alias("relacion"),
        F.col("calificacion").alias("calificacion"), F.col("fecha_interaccion").alias("fecha"),
        none_i.alias("polaridad"),
    )

    def simple(df: DataFrame, src: str, dst: str, rel: str) -> DataFrame:
        return df.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(
            F.col(src).alias("origen"), F.col(dst).alias("destino"), F.lit(rel).alias("relacion"),
            none_d.alias("calificacion"), none_s.alias("fecha"), none_i.alias("polaridad"),
        ).distinct()

    ubicado = simple(catalog, URL, "ubicacion", "UBICADO_EN")
    region = simple(cities.join(catalog.select("ubicacion").distinct(), "ubicacion", "left_semi"),
                    "ubicacion", "region", "UBICADO_EN")
    pertenece = simple(catalog, URL, "categoria_sitio", "PERTENECE_A")
    ofrece = site_aspects.select(
        F.col(URL).alias("origen"), F.col("aspecto").alias("destino"), F.lit("OFRECE_ASPECTO").alias("relacion"),
        none_d.alias("calificacion"), none_s.alias("fecha"), F.col("polaridad").cast("int").alias("polaridad"),
    )
    return visito.unionByName(ubicado).unionByName(region).unionByName(pertenece).unionByName(ofrece)


def history_paths(inter: DataFrame, candidates: DataFrame) -> DataFrame:
    """(user, candidate, via, node, support) for 2-hop paths
    user -VISITO-> site -{PERTENECE_A|UBICADO_EN}-> node <- candidate."""
    hist = inter.where(F.col(URL).isNotNull())
    attrs = (
        hist.select(U, URL, F.lit("categoría").alias("via"), F.col("categoria_sitio").alias("nodo"))
        .unionByName(hist.select(U, URL, F.lit("ubicación").alias("via"), F.col("ubicacion").alias("nodo")))
        .where(F.col("nodo").isNotNull())
        .groupBy(U, "via", "nodo")
        .agg(F.count_distinct(URL).alias("soporte"))
    )
    cand = (
        candidates.select(U, URL, "rank", "nombre_sitio", F.lit("categoría").alias("via"), F.col("categoria_sitio").alias("nodo"))
        .unionByName(candidates.select(U, URL, "rank", "nombre_sitio", F.lit("ubicación").alias("via"),
                                       F.col("ubicacion").alias("nodo")))
        .where(F.col("nodo").isNotNull())
    )
    return cand.join(attrs, [U, "via", "nodo"]).select(U, URL, "rank", "nombre_sitio", "via", "nodo", "soporte")


def graph_context(paths: DataFrame) -> DataFrame:
    """Per user, the path sentences in (rank, via) order as one text."""
    sentence = render(PATH_TEMPLATE, nombre_sitio=F.col("nombre_sitio"), via=F.col("via"),
                      nodo=F.col("nodo"), soporte=F.col("soporte"))
    entry = F.struct("rank", "via", sentence.alias("t"))
    folded = paths.groupBy(U).agg(F.array_sort(F.collect_list(entry)).alias("l"))
    return folded.select(U, F.size("l").alias("caminos"),
                         F.concat(F.array_join(F.transform("l", lambda x: x["t"]), ". "), F.lit(".")).alias("contexto_grafo"))


def graph_rerank(candidates: DataFrame, paths: DataFrame, n: int) -> DataFrame:
    """Hybrid re-ranking (stand-in for the generative reranker): candidates
    ordered by total path support, then by their retrieval rank; first n."""
    from pyspark.sql import Window

    support = paths.groupBy(U, URL).agg(F.sum("soporte").alias("s"))
    j = candidates.join(support, [U, URL], "left").withColumn("s", F.coalesce("s", F.lit(0)))
    w = Window.partitionBy(U).orderBy(F.desc("s"), F.asc("rank"))
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("s")
