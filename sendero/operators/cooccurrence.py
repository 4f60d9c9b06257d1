"""Item-item co-occurrence baseline.

Sites that the same users visited are similar: the cosine of two sites is the
number of users they share over the root of the product of their numbers of
users.  A user's score of a site is the sum of its similarities to the sites
the user has visited, over each visited site's ``neighbours`` nearest ones.

The counts are the product of the user-site matrix with itself.  A user's
sites are dealt to segments of about ``segment`` sites, and the pairs of
segments are the rows that tasks get: a user who has been everywhere makes
many such rows, none of which holds the whole list or all its pairs.  A task
counts the pairs of its rows in bounded tables before they are shuffled, so a
pair that many users share leaves a task once per table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sendero.operators.collaborative import dense_index
from sendero.session import drop_written, write_once

U = "id_usuario"
URL = "url_sitio"
SEGMENT = 256
NEIGHBOURS = 20
# Pairs that a task holds before it adds them up (adding up takes them several
# times over).
_HELD = 1_000_000


def _pairs(batches):
    """Counts of site pairs (a < b) of rows (first, second: lists of site
    numbers; same: both are one segment)."""
    keys, counts, held = [], [], 0

    def summed():
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)

    def out(key, count):
        for lo in range(0, len(key), 100_000):
            part = key[lo:lo + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part >> 32), pa.array(part & 0xFFFFFFFF), pa.array(count[lo:lo + 100_000])], names=["a", "b", "n"])

    for batch in batches:
        for first, second, same in zip(batch.column("first"), batch.column("second"), batch.column("same").to_pylist()):
            x, y = (s.values.to_numpy().astype(np.int64) for s in (first, second))
            low, high = np.minimum(x[:, None], y[None, :]), np.maximum(x[:, None], y[None, :])
            pairs = low << 32 | high
            pairs = pairs[np.triu_indices(len(x), 1)] if same else pairs.ravel()
            keys.append(pairs)
            counts.append(np.ones(len(pairs)))
            held += len(pairs)
            if held >= _HELD:
                key, count = summed()
                keys, counts, held = [key], [count.astype(float)], len(key)
                if held >= _HELD // 2:
                    yield from out(key, count)
                    keys, counts, held = [], [], 0
    if keys:
        yield from out(*summed())


def site_pairs(visits: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """a, b, n: how many users visited both of two sites (a < b); ``visits``:
    distinct (u, i) with numbered sites."""
    size = visits.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / segment).cast("int").alias("segments"))
    part = F.pmod(F.xxhash64("i"), F.col("segments")).cast("int")
    # Lists of about ``segment`` sites.
    parts = visits.join(size, "u").select("u", "segments", part.alias("part"), "i").groupBy("u", "segments", "part").agg(
        F.collect_list("i").alias("sites"))
    parts = write_once(parts, "segments")
    first = parts.select("u", F.col("part").alias("p"), F.col("sites").alias("first"),
                         F.explode(F.sequence("part", F.col("segments") - 1)).alias("part"))
    both = first.join(parts.select("u", "part", F.col("sites").alias("second")), ["u", "part"]).select(
        "first", "second", (F.col("p") == F.col("part")).alias("same"))
    counted = both.repartition(F.xxhash64("first", "second")).mapInArrow(_pairs, "a long, b long, n long")
    out = write_once(counted.groupBy("a", "b").agg(F.sum("n").alias("n")), "site-pairs")
    drop_written(parts)
    return out


def similar_sites(visits: DataFrame, neighbours: int = NEIGHBOURS, segment: int = SEGMENT) -> DataFrame:
    """i, j, sim: each site's ``neighbours`` most similar ones (ties: the
    smaller name first; ``visits``: u, i, url)."""
    users = visits.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("url"))
    users = write_once(users, "site-users")
    pairs = site_pairs(visits.select("u", "i"), segment)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    x, y = users.select(F.col("i").alias("a"), F.col("n").alias("na")), users.select(F.col("i").alias("b"), F.col("n").alias("nb"), "url")
    sim = F.col("n") / F.sqrt((F.col("na") * F.col("nb")).cast("double"))
    nearest = Window.partitionBy("a").orderBy(F.desc("sim"), F.asc("url"))
    ranked = both.join(x, "a").join(y, "b").select("a", "b", "url", sim.alias("sim")).withColumn("rank", F.row_number().over(nearest))
    out = write_once(ranked.where(F.col("rank") <= neighbours).select(F.col("a").alias("i"), F.col("url").alias(URL), "rank", "sim"), "similar-sites")
    drop_written(pairs)
    drop_written(users)
    return out


def cooccurrence_recommendations(consumed: DataFrame, catalog: DataFrame, k: int, neighbours: int = NEIGHBOURS,
                                 segment: int = SEGMENT) -> DataFrame:
    """id_usuario, rank, url_sitio, puntuacion: each user's ``k`` best sites of
    the catalogue that the user has not visited.  Users whose neighbours are
    all visited have none."""
    numbers = dense_index(consumed, URL, "i")
    visits = write_once(consumed.join(numbers, URL).select(F.col(U).alias("u"), "i", F.col(URL).alias("url")), "visits")
    near = similar_sites(visits, neighbours, segment)
    scored = visits.select("u", "i").join(near.select("i", URL, "sim"), "i").groupBy("u", URL).agg(F.sum("sim").alias("s"))
    scored = scored.join(catalog.select(URL), URL, "left_semi").select(F.col("u").alias(U), URL, F.round("s", 6).alias("puntuacion"))
    fresh = scored.join(consumed.select(U, URL), [U, URL], "left_anti")
    best = Window.partitionBy(U).orderBy(F.desc("puntuacion"), F.asc(URL))
    return fresh.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(U, "rank", URL, "puntuacion")
