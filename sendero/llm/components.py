"""Connected components of a link table whose nodes are longs, by alternating
large-star and small-star rounds: each round is two grouped minima and two
joins, written to the shared folder, until nothing changes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendero.llm.common import materialise


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links a-b of one task as stars: (node, smallest node of its
    component), for the nodes that aren't the smallest themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        x, y = label[i], label[j]
        open_ = x != y
        if not open_.any():
            break
        i, j, x, y = i[open_], j[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _stars(links: DataFrame) -> DataFrame:
    """One round: u > v in, each linked to something no larger out."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    return small.select("u", F.col("m").alias("v")).unionByName(
        small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def component_roots(links: DataFrame) -> DataFrame:
    """``links``: u, v.  One row (node, root) for each node that isn't the
    smallest of its component."""
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    links = materialise(links, "links")
    state = _state(links)
    while True:
        links = materialise(_stars(links), "links")
        after = _state(links)
        if after == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = after
