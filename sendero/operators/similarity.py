"""Exact cosine top-k similarity join with exclusion.

Plan
----
Items are hashed into ``C`` blocks of bounded bytes and queries into ``G``
groups.  Each query row is replicated once per item block and each item row
once per query group; a single cogroup shuffle on (block, group) then brings
one query group and one item block together, where a numpy kernel computes the
cosine matrix in bounded chunks, masks the excluded pairs and keeps the best
``k`` per query.  Only (query, item, sim) rows of the per-block top-k leave the
kernel - never the pair matrix.  With more than one item block a final
``row_number() <= k`` per query (a partial WindowGroupLimit before its shuffle)
merges the blocks.

Exclusion pairs travel in the same shuffle as the queries (they carry the
item's block), so excluding needs no extra join.  A query's exclusions inside
one group are bounded by the item block size, however many rows the query
has in the source.

Ties rank by item id ascending; a zero vector has no similarity and is never
a candidate.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sendero.operators.topk_kernel import Side, _select_topk, nearest
from sendero.session import checkpoint_dir, write_all

RESULT_SCHEMA = "qid string, iid string, sim double, rank int"
# Cells of one similarity chunk held at a time inside the kernel (8 MB, several
# times over).
_CHUNK_CELLS = 1_000_000
# From this many items on, cosines are filtered in float32 (``topk_kernel``).
_FILTERED = 512
# Bytes that one side of a group takes in a Python worker, hits included.
BLOCK_BYTES = 64 << 20
# About what a row takes besides its float64 vector (ids, Arrow and pandas
# objects), an excluded pair, and a hit, or an item's payload, as it leaves.
_ROW_BYTES, _EXCLUDED_BYTES, _HIT_BYTES = 512, 384, 256
GROUPS_PER_SLOT = 2


# Partitions for each group, so that few share one, and how many at most.
_SPREAD, _MOST_PARTITIONS = 4, 4000


def dealt(df: DataFrame, block: str, groups: int) -> DataFrame:
    """Dealt out by group to so many partitions.  Groups are small in bytes and
    long in time, so adaptive execution, which goes by bytes, would put many
    of them into one task and leave slots without one."""
    return df.repartition(min(groups * _SPREAD, _MOST_PARTITIONS), block, "grp")


def no_vector() -> Column:
    """What an excluded pair carries as a vector.  Not null: Spark's Arrow
    writer takes the size of a batch after each row, and for a list column
    goes through the nulls at its end again each time."""
    return F.array().cast("array<float>").alias("embedding")


def _empty_result(payload: tuple[str, ...] = ()) -> pd.DataFrame:
    cols = {
        "qid": pd.Series([], dtype=object),
        "iid": pd.Series([], dtype=object),
        "sim": pd.Series([], dtype=np.float64),
        "rank": pd.Series([], dtype=np.int32),
    }
    cols.update({c: pd.Series([], dtype=object) for c in payload})
    return pd.DataFrame(cols)


def excluded_cells(pairs: pd.DataFrame, q_ids: np.ndarray, item_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the excluded pairs (qid, ex) that are in the group."""
    if pairs.empty:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    # Merge-based mapping tolerates repeated ids on either side.
    m = pairs.merge(pd.DataFrame({"qid": q_ids, "r": np.arange(len(q_ids))}), on="qid")
    m = m.merge(pd.DataFrame({"ex": item_ids, "c": np.arange(len(item_ids))}), on="ex")
    return m["r"].to_numpy(), m["c"].to_numpy()


def _kernel(k: int, metric: str = "cosine", payload: tuple[str, ...] = ()):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        asks = left["ex"].isna().to_numpy()
        if not asks.any() or right.empty:
            # Typed empty columns: a group may hold exclusions but no query.
            return _empty_result(payload)
        right = right.sort_values("iid", kind="stable")
        item_ids = right["iid"].to_numpy()
        item_payload = {c: right[c].to_numpy(dtype=object) for c in payload}
        q_ids, vectors = left["qid"].to_numpy()[asks], left["embedding"].to_numpy()[asks]

        ex_q, ex_i = excluded_cells(left.loc[~asks, ["qid", "ex"]], q_ids, item_ids)

        out_q, out_i, out_s, out_r = [], [], [], []
        out_p = {c: [] for c in payload}

        def hits() -> pd.DataFrame:
            result = {
                "qid": np.concatenate(out_q),
                "iid": np.concatenate(out_i),
                "sim": np.concatenate(out_s),
                "rank": np.concatenate(out_r).astype(np.int32),
            }
            result.update({c: np.concatenate(v) for c, v in out_p.items()})
            return pd.DataFrame(result)

        if metric != "dot" and len(item_ids) >= _FILTERED:
            found = nearest(Side(np.stack(vectors)), Side(np.stack(right["embedding"].to_numpy())), np.arange(len(item_ids)), k, ex_q, ex_i)
            for query, item, sim, rank, _ in found:
                out_q.append(q_ids[query])
                out_i.append(item_ids[item])
                out_s.append(sim)
                out_r.append(rank)
                for c in payload:
                    out_p[c].append(item_payload[c][item])
            return hits()

        P = np.stack(right["embedding"].to_numpy(), dtype=np.float64, casting="unsafe")
        p_norm = np.sqrt(np.einsum("ij,ij->i", P, P))
        step = max(1, _CHUNK_CELLS // max(1, len(item_ids)))
        for lo in range(0, len(q_ids), step):
            hi = min(lo + step, len(q_ids))
            Q = np.stack(vectors[lo:hi], dtype=np.float64, casting="unsafe")
            S = Q @ P.T
            if metric != "dot":
                q_norm = np.sqrt(np.einsum("ij,ij->i", Q, Q))
                with np.errstate(divide="ignore", invalid="ignore"):
                    np.divide(S, q_norm[:, None] * p_norm[None, :], out=S)
                S[q_norm == 0] = -np.inf
                S[:, p_norm == 0] = -np.inf
            sel = (ex_q >= lo) & (ex_q < hi)
            S[ex_q[sel] - lo, ex_i[sel]] = -np.inf
            idx, vals = _select_topk(S, k)
            rank = np.broadcast_to(np.arange(1, idx.shape[1] + 1), idx.shape)
            valid = np.isfinite(vals)
            rows = np.broadcast_to(np.arange(lo, hi)[:, None], idx.shape)
            out_q.append(q_ids[rows[valid]])
            out_i.append(item_ids[idx[valid]])
            out_s.append(vals[valid])
            out_r.append(rank[valid])
            for c in payload:
                out_p[c].append(item_payload[c][idx[valid]])
        return hits()

    return run


def block_rows(dim: int, block_bytes: int = BLOCK_BYTES, hits: int = 0) -> int:
    """Rows of one side of a group: ``block_bytes`` of vectors, ids and hits
    (``hits`` for each row)."""
    return max(1, block_bytes // _row_bytes(dim, hits))


def _row_bytes(dim: int, hits: int) -> int:
    return 8 * max(dim, 1) + _ROW_BYTES + _HIT_BYTES * hits


def excluded_rows(n_excluded: int, dim: int, hits: int) -> int:
    """A query counts with its hits; several excluded pairs take as much."""
    return math.ceil(n_excluded * _EXCLUDED_BYTES / _row_bytes(dim, hits))


def plan_blocks(n_queries: int, n_items: int, parallelism: int,
                query_block_rows: int, item_block_rows: int, n_excluded: int = 0, k: int = 10) -> tuple[int, int]:
    """(item blocks C, query groups G).

    Item blocks are bounded by ``item_block_rows``; the left side of a group
    (its queries plus their exclusion pairs falling in the block, about
    (Q + E / C) / G rows) by ``query_block_rows``.  The G x C groups number
    about ``GROUPS_PER_SLOT`` for each task slot, so that none waits for a
    slot that got several.  Every item row is shuffled once per query group
    and every query row once per item block, and several blocks give k rows
    per query and block to merge: of the ways to make that many groups the
    one that moves the fewest rows is taken.
    """
    slots = parallelism * GROUPS_PER_SLOT
    least = max(1, math.ceil(n_items / item_block_rows))

    def groups_for(blocks: int) -> int:
        by_memory = math.ceil((n_queries + n_excluded / blocks) / query_block_rows)
        return max(1, min(max(by_memory, math.ceil(slots / blocks)), max(n_queries, 1)))

    def moved(blocks: int) -> int:
        return n_queries * blocks * (1 + (k if blocks > 1 else 0)) + n_items * groups_for(blocks)

    blocks = min(range(least, max(least, min(slots, n_items)) + 1), key=moved)
    return blocks, groups_for(blocks)


def similarity_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    *,
    exclude: DataFrame | None = None,
    query_block_rows: int | None = None,
    item_block_rows: int | None = None,
    query_groups: int | None = None,
    metric: str = "cosine",
    item_payload: tuple[str, ...] = (),
) -> DataFrame:
    """Top-k items per query by cosine similarity, excluded pairs removed.

    ``queries``: (qid, embedding); ``items``: (iid, embedding);
    ``exclude``: (qid, iid) pairs that may not be returned.  Ids are strings
    and unique within their side.  Result: (qid, iid, sim, rank) with ranks
    1..min(k, available) per query.  ``metric="dot"`` ranks by the plain
    inner product (factor models) instead of the cosine.  ``item_payload``
    names small text columns of ``items`` carried through the kernel into the
    result, which saves a join of the k-per-query output with the items.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = queries.sparkSession
    checkpoint_dir(spark)
    # Both sides are written once to the shared folder, side by side: their
    # sizes fix the blocking, and the join then reads the files instead of
    # recomputing the text and vector pipelines (and restarts from them if
    # an executor is lost during the quadratic stage).  Vectors travel as
    # float32; the kernel computes in float64.
    # Rows without an id or a vector can never be ranked (D17) and are left out.
    payload = tuple(item_payload)
    wanted = {
        "queries": queries.select(F.col("qid").cast("string"), F.col("embedding").cast("array<float>")).where(
            F.col("qid").isNotNull() & F.col("embedding").isNotNull()),
        "items": items.select(F.col("iid").cast("string"), F.col("embedding").cast("array<float>"),
                              *[F.col(c).cast("string") for c in payload]).where(F.col("iid").isNotNull() & F.col("embedding").isNotNull()),
    }
    # What the caller has written is not written again.
    given = {"queries": queries, "items": items}
    written = wanted | write_all({name: df for name, df in wanted.items() if not hasattr(given[name], "_written")})
    q, it = written["queries"], written["items"]
    # Total task slots of the cluster (executor cores); the shuffle-partition
    # setting is often much larger and would only inflate item replication.
    parallelism = spark.sparkContext.defaultParallelism
    n_excluded = exclude.where(F.col("iid").isNotNull()).count() if exclude is not None else 0
    n_queries, dim = q.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    n_items = it.count()
    blocks, groups = plan_blocks(n_queries, n_items, parallelism, query_block_rows or block_rows(dim or 0, hits=k),
                                 item_block_rows or block_rows(dim or 0, hits=1 if payload else 0), n_excluded=excluded_rows(n_excluded, dim or 0, k), k=k)
    if query_groups is not None:
        groups = query_groups

    def spread(n: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n > 1 else F.lit(0)

    def bucket(c: str, n: int) -> F.Column:
        return F.pmod(F.xxhash64(F.col(c)), F.lit(n)).cast("int") if n > 1 else F.lit(0)

    left = q.select("qid", "embedding", F.lit(None).cast("string").alias("ex"), spread(blocks).alias("blk"))
    if exclude is not None:
        ex = exclude.select(F.col("qid").cast("string"), F.col("iid").cast("string").alias("ex")).where(
            F.col("qid").isNotNull() & F.col("ex").isNotNull())
        left = left.unionByName(
            ex.select("qid", no_vector(), "ex", bucket("ex", blocks).alias("blk"))
        )
    left = left.withColumn("grp", bucket("qid", groups))
    right = it.select("iid", "embedding", *payload, bucket("iid", blocks).alias("blk"), spread(groups).alias("grp"))

    hits = (
        dealt(left, "blk", blocks * groups).groupBy("blk", "grp")
        .cogroup(dealt(right, "blk", blocks * groups).groupBy("blk", "grp"))
        .applyInPandas(_kernel(k, metric, payload), RESULT_SCHEMA + "".join(f", `{c}` string" for c in payload))
    )
    if blocks == 1:
        return hits
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), F.asc("iid"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
