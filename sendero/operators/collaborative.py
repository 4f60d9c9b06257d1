"""Collaborative-filtering baseline (E23), learned variant.

Implicit-feedback ALS on (user, site, interaction count), then exact top-k
by inner product of the factor vectors with the consumed sites excluded,
through the same blocked kernel as the content retrieval.  (An item-item
co-occurrence self-join would list every pair of sites inside each user's
history, which grows quadratically with the largest history; the factor
model avoids it.)

ALS needs integer ids: users and sites get a dense index computed JVM-side
(``dense_index``).
"""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sendero.operators.similarity import similarity_topk
from sendero.session import write_once

U = "id_usuario"
URL = "url_sitio"


def dense_index(df: DataFrame, col: str, name: str) -> DataFrame:
    """(col, name) with ``name`` = 0..n-1 over the distinct values of ``col``.

    Distinct keys are checkpointed (fixing their partitions), numbered inside
    each partition, and shifted by the running count of earlier partitions;
    only one count per partition reaches the driver.  ALS takes 32-bit ids,
    so more than 2^31 - 1 distinct values are refused.
    """
    keys = df.select(F.col(col)).distinct().checkpoint(eager=True)
    with_pid = keys.select(col, F.spark_partition_id().alias("pid"))
    w = Window.partitionBy("pid").orderBy(col)
    numbered = with_pid.withColumn("rn", F.row_number().over(w) - 1)
    counts = sorted((r["pid"], r["c"]) for r in with_pid.groupBy("pid").agg(F.count(F.lit(1)).alias("c")).collect())
    offsets, total = [], 0
    for pid, c in counts:
        offsets.append((pid, total))
        total += c
    if total > 2**31 - 1:
        raise ValueError(f"{total} distinct values of {col}; ALS takes at most 2^31 - 1")
    spark = df.sparkSession
    off = spark.createDataFrame(offsets or [(0, 0)], "pid int, off long")
    return numbered.join(F.broadcast(off), "pid").select(col, (F.col("off") + F.col("rn")).cast("int").alias(name))


def als_factors(inter: DataFrame, rank: int = 16, max_iter: int = 10, reg: float = 0.1,
                alpha: float = 1.0, seed: int = 42):
    """(user factors (id_usuario, embedding), item factors (url_sitio, embedding))."""
    counts = inter.where(F.col(URL).isNotNull()).groupBy(U, URL).agg(F.count(F.lit(1)).cast("float").alias("r"))
    # Written: read three times, and a join whose side is a plain scan can be
    # split at a site that everybody visits.
    counts = write_once(counts, "als-counts")
    users = dense_index(counts, U, "u")
    items = dense_index(counts, URL, "i")
    data = counts.join(users, U).join(items, URL).select("u", "i", "r")
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, alpha=alpha, implicitPrefs=True, userCol="u",
              itemCol="i", ratingCol="r", seed=seed, checkpointInterval=5, coldStartStrategy="drop")
    model = als.fit(data)
    uf = model.userFactors.join(users, model.userFactors.id == users.u).select(
        U, F.col("features").cast("array<double>").alias("embedding"))
    itf = model.itemFactors.join(items, model.itemFactors.id == items.i).select(
        URL, F.col("features").cast("array<double>").alias("embedding"))
    return uf, itf


def cf_recommendations(inter: DataFrame, consumed: DataFrame, k: int, factors: tuple[DataFrame, DataFrame] | None = None,
                       **als_params) -> DataFrame:
    uf, itf = factors or als_factors(inter, **als_params)
    hits = similarity_topk(
        uf.select(F.col(U).alias("qid"), "embedding"),
        itf.select(F.col(URL).alias("iid"), "embedding"),
        k,
        exclude=consumed.select(F.col(U).alias("qid"), F.col(URL).alias("iid")),
        metric="dot",
    )
    return hits.select(F.col("qid").alias(U), "rank", F.col("iid").alias(URL), F.round("sim", 6).alias("puntuacion"))
