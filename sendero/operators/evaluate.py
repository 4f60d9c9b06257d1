"""Offline evaluation (E1-E13): splits, ranking and catalogue metrics.

Protocols hold out first-time visits only (D18): a site already consumed in
training is excluded from recommendations and could never be hit.

* temporal: cutoff date = first date + floor(0.8 x span in days); relevant
  items of a user are the sites first visited on/after the cutoff; training
  rows are those before it.
* leave-one-out: per user, the site whose first visit is the latest is held
  out; training rows are all rows except those of the held-out site.

All per-user statistics are keyed aggregations with a map-side partial step
(min/max/count/max_by), so a user holding a large share of rows is combined
before the shuffle.  Metric values are rounded to 6 decimals.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sendero.operators.clean import ORDER
from sendero.session import write_once

U = "id_usuario"
URL = "url_sitio"
TRAIN_FRACTION = 0.8


def temporal_cutoff(inter: DataFrame, fraction: float = TRAIN_FRACTION):
    """A scalar: one aggregate row brought to the driver."""
    row = inter.agg(F.min("fecha_interaccion").alias("lo"), F.max("fecha_interaccion").alias("hi")).first()
    if row is None or row["lo"] is None:
        return None
    from datetime import timedelta

    return row["lo"] + timedelta(days=math.floor((row["hi"] - row["lo"]).days * fraction))


def split_temporal(inter: DataFrame, cutoff) -> DataFrame:
    """Every interaction tagged train/test by the cutoff date."""
    part = F.when(F.col("fecha_interaccion") < F.lit(cutoff), "train").otherwise("test")
    return inter.select("id_interaccion", U, URL, "fecha_interaccion", part.alias("particion"))


def split_by_rank(inter: DataFrame, fraction: float = TRAIN_FRACTION) -> DataFrame:
    """E1 per user: every interaction with its percent rank by date among those
    of its user, tagged train below ``fraction``.  Rows of one date share a
    rank, missing dates come last, a user's only date has rank 0.

    Ranks follow from the counts by user and date, so no task sorts all rows of
    a user; they are written, so that the join deals rows by user and date."""
    day = "fecha_interaccion"
    by_date = Window.partitionBy(U).orderBy(F.col(day).asc_nulls_last())
    counts = inter.groupBy(U, day).agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(by_date.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    others = F.sum("c").over(Window.partitionBy(U)) - 1
    ranks = write_once(counts.select(U, F.col(day).alias("_d"), F.when(others > 0, before / others).otherwise(0.0).alias("rango")), "date-ranks")
    rows = inter.select("id_interaccion", U, URL, day).join(ranks.withColumnRenamed(U, "_u"), (F.col(U) == F.col("_u")) & F.col(day).eqNullSafe(F.col("_d")))
    return rows.select("id_interaccion", U, URL, day, "rango", F.when(F.col("rango") < fraction, "train").otherwise("test").alias("particion"))


def temporal_train(inter: DataFrame, cutoff) -> DataFrame:
    return inter.where(F.col("fecha_interaccion") < F.lit(cutoff))


def temporal_relevant(inter: DataFrame, cutoff) -> DataFrame:
    """Sites first visited on/after the cutoff, per user."""
    first = inter.where(F.col(URL).isNotNull()).groupBy(U, URL).agg(F.min("fecha_interaccion").alias("f"))
    return first.where(F.col("f") >= F.lit(cutoff)).select(U, URL)


def held_out(inter: DataFrame) -> DataFrame:
    """Per user, the (user, url) pair whose first visit is the latest."""
    first = inter.where(F.col(URL).isNotNull()).groupBy(U, URL).agg(F.min(ORDER).alias("f"))
    last = Window.partitionBy(U).orderBy(F.desc("f"), URL)
    return first.withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") == 1).select(U, URL)


def without(inter: DataFrame, held: DataFrame) -> DataFrame:
    """The rows of all but the held-out pairs."""
    return inter.join(held, [U, URL], "left_anti")


def leave_one_out(inter: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(held-out (user, url) pairs, training rows)."""
    held = held_out(inter)
    return held, without(inter, held)


def user_ranking_stats(recs: DataFrame, relevant: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per evaluated user (has relevant items and a profile): number of
    relevant items, hits, first hit rank and DCG of the list."""
    rel = relevant.join(profiles.select(U), U, "left_semi")
    users = rel.groupBy(U).agg(F.count(F.lit(1)).alias("n_rel"))
    hits = recs.select(U, URL, "rank").join(rel, [U, URL])
    per = hits.groupBy(U).agg(
        F.count(F.lit(1)).alias("h"),
        F.min("rank").alias("min_rank"),
        F.sum(1.0 / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    return users.join(per, U, "left").select(
        U, "n_rel",
        F.coalesce("h", F.lit(0)).alias("h"),
        "min_rank",
        F.coalesce("dcg", F.lit(0.0)).alias("dcg"),
    )


def _ideal_dcg(n_rel, n: int):
    return F.aggregate(F.sequence(F.lit(1), F.least(n_rel, F.lit(n))), F.lit(0.0),
                       lambda acc, i: acc + 1.0 / F.log2(i + 1))


METRICS = ("hit_rate", "ndcg", "mrr", "precision", "recall")


def ranking_metrics(stats: DataFrame, n: int, protocol: str) -> DataFrame:
    """E3-E7 as rows (protocolo, metrica, k, valor, usuarios)."""
    per = stats.select(
        F.when(F.col("h") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        (F.col("dcg") / _ideal_dcg(F.col("n_rel"), n)).alias("ndcg"),
        F.coalesce(1.0 / F.col("min_rank"), F.lit(0.0)).alias("mrr"),
        (F.col("h") / F.lit(float(n))).alias("precision"),
        (F.col("h") / F.col("n_rel")).alias("recall"),
    )
    agg = per.agg(*[F.avg(m).alias(m) for m in METRICS], F.count(F.lit(1)).alias("usuarios"))
    stack = F.expr("stack({}, {})".format(len(METRICS), ", ".join(f"'{m}', {m}" for m in METRICS)))
    return agg.select(stack.alias("metrica", "v"), "usuarios").select(
        F.lit(protocol).alias("protocolo"), "metrica", F.lit(n).alias("k"),
        F.round("v", 6).alias("valor"), "usuarios",
    )


def coverage(recs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Share of the catalogue that appears in some recommendation list."""
    # Both sides are one-row aggregates; they are combined as a union and a
    # second one-row aggregate (no join).
    rec = recs.select(F.col(URL).alias("r"), F.lit(None).cast("string").alias("c"))
    cat = catalog.select(F.lit(None).cast("string").alias("r"), F.col(URL).alias("c"))
    agg = rec.unionByName(cat).agg(
        F.count_distinct("r").alias("recomendados"), F.count("c").alias("catalogo")
    )
    return agg.select("recomendados", "catalogo",
                      F.round(F.try_divide(F.col("recomendados"), F.col("catalogo")), 6).alias("cobertura"))


def intra_list_diversity(recs: DataFrame, vectors: DataFrame) -> DataFrame:
    """E9 without enumerating pairs: for unit vectors v_1..v_n of one list,
    sum_{i<j} cos(v_i, v_j) = (|sum v_i|^2 - n) / 2, so the mean pairwise
    distance is 1 - (|s|^2 - n) / (n (n - 1)).  Lists of one item are skipped."""
    normed = vectors.select(URL, "embedding",
                            F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, y: a + y * y)).alias("nrm"))
    unit = normed.select(URL, F.transform("embedding", lambda x: x / F.col("nrm")).alias("v"))
    unit = write_once(unit, "unit-vectors")
    dim = unit.agg(F.max(F.size("v"))).first()[0] or 1
    # One row per listed site and one sum per element: a user is one row of the
    # partial aggregate, not one per element.
    sums = recs.select(U, URL).join(unit, URL, "left").groupBy(U).agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("known"), *[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dim)])
    s2 = F.aggregate(F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) for i in range(dim)]), F.lit(0.0), lambda a, x: a + x * x)
    per = sums.where((F.col("n") > 1) & (F.col("known") > 0)).select(
        U, (1.0 - (s2 - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("ild")
    )
    return per.agg(F.round(F.avg("ild"), 6).alias("diversidad"), F.count(F.lit(1)).alias("usuarios"))


def novelty(recs: DataFrame, consumed: DataFrame) -> DataFrame:
    """Mean -log2(popularity) of recommended items, popularity = share of
    users with history who consumed the item."""
    users = consumed.agg(F.count_distinct(U).alias("nu")).first()["nu"] or 1
    pop = consumed.groupBy(URL).agg(F.count(F.lit(1)).alias("c"))
    # Counted by site first: a site that everybody is shown is one row.
    shown = recs.groupBy(URL).agg(F.count(F.lit(1)).alias("n"))
    nov = -F.log2(F.col("c") / F.lit(float(users)))
    j = shown.join(pop, URL, "left")
    known = F.col("c").isNotNull()
    # Items nobody consumed have infinite self-information; they are counted
    # apart and left out of the mean.
    return j.agg(
        F.round(F.try_divide(F.sum(F.when(known, F.col("n") * nov)), F.sum(F.when(known, F.col("n")))), 6).alias("novedad"),
        F.coalesce(F.sum(F.when(known, 0).otherwise(F.col("n"))), F.lit(0)).cast("bigint").alias("sin_historial"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("recomendaciones"),
    )
