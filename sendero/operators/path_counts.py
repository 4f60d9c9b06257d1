"""Paths of several hops through the knowledge graph.

A frontier of (start, kinds of the edges so far, node, number of paths) is
carried one hop further by a join with the edge table and one grouped sum, so
paths are counted and never listed.  Edges are walked in both directions;
against the direction their kind is written ``~KIND``.  Only the sequences of
kinds that were asked for are followed, by their common beginnings.

A sequence walks on by the kinds that may follow it alone: the join is on node
and kind, so the visitors of a visited site are not met on the way to its city.
The last hop to given targets is walked from them: what one step leads to a
target is few, what the frontier leads to may be every site of a city.

Every round is written and the one before it deleted.  Hubs (a city of many
sites, a site that everybody visits) are walked like other nodes: both sides
of the join are written tables, which adaptive execution splits at such a
node, and the sums begin before the shuffle.  What reaches a node is one row
per start and sequence, however many paths there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendero.session import drop_written, write_once


def both_ways(edges: DataFrame) -> DataFrame:
    """desde, hasta, paso: the distinct edges in both directions."""
    plain = edges.where(F.col("origen").isNotNull() & F.col("destino").isNotNull()).select("origen", "destino", "relacion").distinct()
    return plain.select(F.col("origen").alias("desde"), F.col("destino").alias("hasta"), F.col("relacion").alias("paso")).unionByName(
        plain.select(F.col("destino").alias("desde"), F.col("origen").alias("hasta"), F.concat(F.lit("~"), "relacion").alias("paso")))


def _follow(frontier: DataFrame, beginnings: set[tuple[str, ...]]) -> DataFrame | None:
    """The frontier with each kind that may follow (sigue), one row per kind."""
    if not beginnings:
        return None
    kinds = F.array(*[F.struct(F.lit(">".join(p[:-1])).alias("tipo"), F.lit(p[-1]).alias("paso")) for p in sorted(beginnings)])
    sigue = F.transform(F.filter(kinds, lambda x: x["tipo"] == F.col("tipo")), lambda x: x["paso"])
    return frontier.select("inicio", "tipo", "nodo", "caminos", F.explode(sigue).alias("sigue"))


def _walked(joined: DataFrame, hop: int) -> DataFrame:
    sequence = F.col("sigue") if hop == 1 else F.concat_ws(">", "tipo", "sigue")
    return joined.select("inicio", sequence.alias("tipo"), F.col("hasta").alias("nodo"), "caminos")


def path_counts(edges: DataFrame, starts: DataFrame, patterns: list[tuple[str, ...]],
                targets: DataFrame | None = None, to_targets: tuple[tuple[str, ...], ...] = ()) -> DataFrame:
    """inicio, tipo, saltos, nodo, caminos: for every start (``starts``: one
    column inicio) and pattern how many paths lead to each node.  Paths of the
    patterns in ``to_targets`` end in ``targets`` (inicio, nodo) only; those
    patterns must not begin another one."""
    for p in to_targets:
        if any(len(q) > len(p) and q[:len(p)] == p for q in patterns):
            raise ValueError(f"another pattern goes on from {'>'.join(p)}")
    kinds = sorted({r for p in patterns for r in p})
    steps = write_once(both_ways(edges).where(F.col("paso").isin(kinds)), "graph-steps")
    longest = max(map(len, patterns))
    frontier = write_once(starts.select("inicio", F.lit("").alias("tipo"), F.col("inicio").alias("nodo"), F.lit(1).cast("long").alias("caminos")).distinct(), "frontier")
    found = None
    for hop in range(1, longest + 1):
        # Beginnings of this length, and what may follow each shorter one.
        ending = {p for p in to_targets if len(p) == hop}
        onward = _follow(frontier, {p[:hop] for p in patterns if len(p) >= hop} - ending)
        rows = None
        if onward is not None:
            rows = _walked(onward.join(steps, (onward.nodo == steps.desde) & (onward.sigue == steps.paso)), hop)
        if ending:
            last = steps.where(F.col("paso").isin(sorted({p[-1] for p in ending})))
            before = targets.select("inicio", "nodo").distinct().join(last, F.col("nodo") == last.hasta).select(F.col("inicio").alias("para"), "desde", "hasta", "paso")
            near = _follow(frontier, ending)
            ended = _walked(near.join(before, (near.inicio == before.para) & (near.nodo == before.desde) & (near.sigue == before.paso)), hop)
            rows = ended if rows is None else rows.unionByName(ended)
        reached = write_once(rows.groupBy("inicio", "tipo", "nodo").agg(F.sum("caminos").alias("caminos")), "frontier")
        whole = [">".join(p) for p in patterns if len(p) == hop]
        if whole:
            part = reached.where(F.col("tipo").isin(whole)).select("inicio", "tipo", F.lit(hop).alias("saltos"), "nodo", "caminos")
            part = write_once(part, "paths")
            found = part if found is None else found.unionByName(part)
        drop_written(frontier)
        frontier = reached
    drop_written(frontier)
    drop_written(steps)
    return found
