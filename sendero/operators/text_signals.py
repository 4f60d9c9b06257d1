"""Signals from free text.

Comment and enrichment texts are processed whole, inside their row where the
result is one of the comment, with a map-side partial step where it is one of
the user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sendero.operators.embed import token_bucket, tokens

U = "id_usuario"
URL = "url_sitio"

# Our aspect lexicon (multilingual, lower case) and polarity words.
ASPECT_LEXICON = {
    "servicio": ["servicio", "service", "personal", "staff", "atención", "attention", "accueil", "bedienung"],
    "precio": ["precio", "price", "prix", "preis", "caro", "barato", "cheap", "expensive", "cher", "teuer"],
    "ambiente": ["ambiente", "atmosphere", "ambiance", "atmosphäre", "ambience", "décor", "música", "music"],
}
POSITIVE = ["bueno", "buena", "excelente", "genial", "good", "great", "excellent", "nice", "bon", "bonne", "gut", "toll"]
NEGATIVE = ["malo", "mala", "terrible", "pésimo", "bad", "poor", "awful", "mauvais", "mauvaise", "schlecht"]


def clean_token(tok):
    """Lower-case word with everything but letters removed."""
    return F.regexp_replace(F.lower(tok), r"[^\p{L}]", "")


def implicit_vectors(inter: DataFrame, dim: int = 64) -> DataFrame:
    """Per user, the mean hashed token vector of the user's comments,
    as sparse rows (id_usuario, bucket, valor).  The mean of count vectors
    is the per-bucket total over the number of comments."""
    # One pass: a comment gives its buckets and one marker (-1) to be counted.
    buckets = F.transform(tokens(F.col("comentario")), lambda t: token_bucket(t, dim))
    counts = (
        inter.where(F.col("comentario").isNotNull())
        .select(U, F.explode(F.concat(F.array(F.lit(-1).cast("bigint")), buckets)).alias("bucket"))
        .groupBy(U, "bucket")
        .agg(F.count(F.lit(1)).alias("t"))
    )
    # At most dim + 1 rows per user meet in the window.
    n = F.max(F.when(F.col("bucket") == -1, F.col("t"))).over(Window.partitionBy(U))
    return counts.withColumn("c", n).where(F.col("bucket") >= 0).select(
        U, "bucket", F.round(F.col("t") / F.col("c"), 6).alias("valor"))


def item_enrichment(place_texts: DataFrame, texts: DataFrame) -> DataFrame:
    """Site documents extended with an external text about the site
    (texts: url_sitio, texto); sites without text keep their document."""
    j = place_texts.select(URL, "documento").join(texts.select(URL, "texto"), URL, "left")
    doc = F.when(F.col("texto").isNotNull(), F.concat_ws(" ", "documento", "texto")).otherwise(F.col("documento"))
    return j.select(
        URL,
        F.col("texto").isNotNull().cast("int").alias("enriquecido"),
        doc.alias("documento_enriquecido"),
        F.size(tokens(doc)).alias("tokens"),
    )


def aspect_mentions(inter: DataFrame) -> DataFrame:
    """(id_interaccion, url_sitio, aspecto, polaridad) for comments that
    name an aspect; polarity = sign(#positive - #negative words) of the
    comment.  All of a comment stands in its row, so nothing is shuffled and
    interactions without a url or a numeric id stay apart."""
    def strings(values: list[str]):
        return F.array(*[F.lit(v) for v in values])

    words = F.transform(tokens(F.col("comentario")), clean_token)
    rows = inter.where(F.col("comentario").isNotNull()).select("id_interaccion", URL, words.alias("_w"))

    def count(values: list[str]):
        return F.size(F.filter("_w", lambda w: w.isin(values)))

    named = F.array(*[F.when(F.arrays_overlap("_w", strings(ws)), F.lit(a)) for a, ws in ASPECT_LEXICON.items()])
    return rows.select(
        "id_interaccion", URL, F.signum(count(POSITIVE) - count(NEGATIVE)).cast("int").alias("polaridad"),
        F.explode(F.array_compact(named)).alias("aspecto"),
    ).select("id_interaccion", URL, "aspecto", "polaridad")


def site_aspects(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy(URL, "aspecto").agg(F.sum("polaridad").alias("polaridad"))


def aspect_nodes(spark) -> DataFrame:
    return spark.createDataFrame([(a,) for a in ASPECT_LEXICON], "aspecto string")


def geo_grounding(recs: DataFrame, user_texts: DataFrame) -> DataFrame:
    """A recommended site's location is grounded when the user's context
    names it; otherwise the justification introduces a new destination."""
    j = recs.select(U, "rank", URL, "ubicacion").join(user_texts.select(U, "contexto"), U)
    return j.select(U, "rank", URL, "ubicacion",
                    (F.instr(F.col("contexto"), F.col("ubicacion")) > 0).cast("int").alias("fundamentado"))


PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def narrative_percentiles(texts: DataFrame) -> DataFrame:
    """Exact percentiles (linear between neighbours) of the characters and
    tokens of each narrative form, one row a form and percentile.  Lengths are
    counted by value first, so a form is aggregated from few rows."""
    t = F.col("texto")
    lengths = texts.where(t.isNotNull() & (t != "")).select("forma", F.explode(F.array(
        F.struct(F.lit("caracteres").alias("medida"), F.length(t).alias("v")),
        F.struct(F.lit("tokens").alias("medida"), F.size(tokens(t)).alias("v")))).alias("m"))
    counts = lengths.groupBy("forma", "m.medida", "m.v").agg(F.count(F.lit(1)).alias("n"))
    at = F.array(*[F.lit(p) for p in PERCENTILES])
    found = counts.groupBy("forma", "medida").agg(F.percentile("v", at, F.col("n")).alias("p"))
    pairs = F.explode(F.arrays_zip(at.alias("percentil"), F.col("p").alias("valor")))
    return found.select("forma", "medida", pairs.alias("x")).select("forma", "medida", "x.percentil", F.round("x.valor", 4).alias("valor"))


def narrative_stats(texts: DataFrame) -> DataFrame:
    """Per narrative form (texts: forma, texto), count, mean/max
    characters and mean tokens."""
    t = F.col("texto")
    return texts.where(t.isNotNull() & (t != "")).groupBy("forma").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.length(t)), 4).alias("caracteres_medios"),
        F.max(F.length(t)).alias("caracteres_max"),
        F.round(F.avg(F.size(tokens(t))), 4).alias("tokens_medios"),
    )
