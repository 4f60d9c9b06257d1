"""Exact cosine top-k that leaves out what cannot be near (V7).

Angles between vectors are a metric, so whoever lies far from a pivot lies far
from what surrounds it.  Items are dealt to cells around pivots, cells to
blocks of bounded rows, and each block keeps, for every reference pivot, the
least and the largest angle of its members.  For a query the differences of
its own angles to those ranges bound its similarity to all of a block.

Blocks that lie near one another make up a shard, which a task holds.  A query
goes first to the shard with the block of the highest bound, then, with its
k-th similarity, to those shards that still have a block that is not beaten.
In a shard it visits blocks in the order of their bounds, in rounds of growing
size, and then all that its k-th similarity doesn't beat: the result is that
of the full comparison, by certificate, and the number of pairs that were
compared is returned with it.  Excluded pairs are masked before counting to k.

Where the bounds leave a query more than a share WIDE of a shard after the
first round, it skips the other rounds: what is left is compared with whole
tiles of items at once.

Pivots are a sample of at most MAX_PIVOTS items and blocks number at most
MAX_BLOCKS and one per pivot, whatever the table's size (a block then grows),
so what every task gets of them is bounded; items and queries move by shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sendero.operators.similarity import RESULT_SCHEMA, block_rows, dealt, excluded_rows, no_vector, plan_blocks
from sendero.operators.topk_kernel import Side, nearest
from sendero.session import drop_written, write_all, write_once

MAX_PIVOTS = 1024
MAX_BLOCKS = 65_536
REFERENCES = 32
BLOCK_ROWS = 256
# Blocks that a query has visited in its shard after each round; then all that
# are still possible.
ROUNDS = (2, 6, 24)
# Queries with more than this share of a shard still possible skip rounds.
WIDE = 0.25
# More than rounding adds to a bound or takes from it (an angle near 0 is
# known to 2e-8, bounds are taken in float32).
SLACK = 1e-6
# Bounds taken at a time, so that they stay in a core's cache.
_BOUND_CELLS = 131_072


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a list column."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


@dataclass
class Blocks:
    """Numbers, sizes and angle ranges of all blocks, in the order of their
    numbers; the reference pivots."""

    number: np.ndarray
    size: np.ndarray
    least: np.ndarray
    most: np.ndarray
    references: np.ndarray
    shard: np.ndarray | None = None

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest similarity that a member of each block can have."""
        angle = _angles(queries, self.references).astype(np.float32)
        least, most = (np.ascontiguousarray(x.T, dtype=np.float32) for x in (self.least, self.most))
        out = np.zeros((len(queries), len(self.number)), np.float32)
        below, above = np.empty_like(out), np.empty_like(out)
        for j in range(angle.shape[1]):
            a = angle[:, j, None]
            np.maximum(np.subtract(least[None, j], a, out=below), np.subtract(a, most[None, j], out=above), out=below)
            np.maximum(out, below, out=out)
        return np.cos(np.minimum(out, np.float32(np.pi))) + np.float32(SLACK)

    def some(self, numbers: np.ndarray) -> "Blocks":
        at = np.searchsorted(self.number, numbers)
        return Blocks(numbers, self.size[at], self.least[at], self.most[at], self.references)


def _neighbours_adjoin(x: np.ndarray) -> np.ndarray:
    """An order of the rows in which near ones mostly adjoin: halves along the
    line to the row that is farthest from the middle, and halves of these."""

    def halves(rows: np.ndarray) -> list[np.ndarray]:
        if len(rows) < 3:
            return [rows]
        y = x[rows] - x[rows].mean(axis=0)
        by = rows[np.argsort(y @ y[np.einsum("ij,ij->i", y, y).argmax()], kind="stable")]
        return halves(by[:len(by) // 2]) + halves(by[len(by) // 2:])

    return np.concatenate(halves(np.arange(len(x))))


def _deal(pivots: np.ndarray):
    """Nearest pivot of each item."""
    narrow = pivots.astype(np.float32)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("embedding")).astype(np.float32)
                near = np.concatenate([(x[lo:lo + 512] @ narrow.T).argmax(axis=1) for lo in range(0, len(x), 512)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=[*batch.schema.names, "cell"])

    return run


def _ranges(references: np.ndarray, n_blocks: int):
    """Of a task's items: rows, least and largest angles by block."""

    def run(batches):
        size = np.zeros(n_blocks, np.int64)
        least, most = np.full((n_blocks, len(references)), np.inf), np.full((n_blocks, len(references)), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("blk").to_numpy()
            by = np.argsort(block, kind="stable")
            here, start, count = np.unique(block[by], return_index=True, return_counts=True)
            angle = _angles(_matrix(batch.column("embedding")), references)[by]
            size[here] += count
            least[here] = np.minimum(least[here], np.minimum.reduceat(angle, start))
            most[here] = np.maximum(most[here], np.maximum.reduceat(angle, start))
        full = np.flatnonzero(size)
        for lo in range(0, len(full), 4096):
            at = full[lo:lo + 4096]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(size[at]), *(pa.array(list(x[at]), pa.list_(pa.float64())) for x in (least, most))],
                names=["blk", "n", "least", "most"])

    return run


def _routes(blocks: Blocks, first: bool):
    """The shards that each query goes to, and its best block there: the one
    with the best block of all, or all others that have a block which its k-th
    similarity doesn't beat."""
    schema = pa.schema([("qid", pa.string()), ("embedding", pa.list_(pa.float32())), ("kth", pa.float64()), ("shard", pa.int32()), ("near", pa.int64())])
    shards, starts = np.unique(blocks.shard, return_index=True)

    def run(batches):
        step = max(1, _BOUND_CELLS // len(blocks.number))
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column("embedding"))
            kth = batch.column("kth").fill_null(-2.0).to_numpy(zero_copy_only=False)
            row, shard, near = [], [], []
            for lo in range(0, len(unit), step):
                bound = blocks.bounds(unit[lo:lo + step])
                best = bound.argmax(axis=1)
                if first:
                    at, to = np.arange(len(bound)), np.searchsorted(shards, blocks.shard[best])
                else:
                    open_ = np.maximum.reduceat(bound, starts, axis=1) + SLACK >= kth[lo:lo + step, None]
                    open_[np.arange(len(bound)), np.searchsorted(shards, blocks.shard[best])] = False
                    at, to = np.nonzero(open_)
                row.append(at + lo)
                shard.append(shards[to])
                near.append(blocks.number[best[at]])
            row, shard, near = (np.concatenate(x) for x in (row, shard, near))
            for lo in range(0, len(row), 10_000):
                part = slice(lo, lo + 10_000)
                here = pa.array(row[part])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(here) for c in ("qid", "embedding", "kth")),
                                                  pa.array(shard[part].astype(np.int32)), pa.array(near[part])], schema=schema)

    return run


_FOUND = pa.schema([("qid", pa.string()), ("iid", pa.string()), ("sim", pa.float64()), ("rank", pa.int32())])


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _search(blocks: Blocks, k: int, rounds: tuple[int, ...]):
    """The hits of a group's queries in one shard, and a row without ids whose
    ``sim`` is the number of pairs compared."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asking = left.filter(pc.is_null(left["ex"]))
        if not len(asking) or not len(right):
            return _FOUND.empty_table()
        # Queries with the same best block side by side.
        asking = asking.sort_by("near")
        right = right.sort_by([("blk", "ascending"), ("iid", "ascending")])
        q_ids, i_ids = asking["qid"].combine_chunks(), right["iid"].combine_chunks()
        order = np.empty(len(right), np.int64)
        order[pc.sort_indices(i_ids).to_numpy()] = np.arange(len(right))
        out_of = left.filter(pc.is_valid(left["ex"]))
        ex_q = pc.index_in(out_of["qid"], value_set=q_ids)
        ex_i = pc.index_in(out_of["ex"], value_set=right["num"].combine_chunks())
        both = pc.and_(pc.is_valid(ex_q), pc.is_valid(ex_i))
        ex_q, ex_i = (x.filter(both).to_numpy().astype(np.int64) for x in (ex_q, ex_i))
        numbers, sizes = np.unique(right["blk"].to_numpy(), return_counts=True)
        here = blocks.some(numbers)
        queries, items = Side(_rows(asking["embedding"])), Side(_rows(right["embedding"]))
        kth = asking["kth"].to_numpy()
        kth = np.where(np.isnan(kth), -np.inf, kth)

        def bounds(lo: int, hi: int) -> np.ndarray:
            step = max(1, _BOUND_CELLS // len(numbers))
            unit = queries.rows[lo:hi].astype(np.float64) / queries.norm[lo:hi, None]
            return np.concatenate([here.bounds(unit[a:a + step]) for a in range(0, hi - lo, step)])

        found, met = [], 0
        for query, item, sim, rank, n in nearest(queries, items, order, k, ex_q, ex_i, sizes=sizes, bounds=bounds, kth=kth, rounds=rounds, wide=WIDE):
            met += n
            found.append(pa.Table.from_arrays([q_ids.take(pa.array(query)), i_ids.take(pa.array(item)), pa.array(sim), pa.array(rank)], schema=_FOUND))
        found.append(pa.Table.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([float(met)]), pa.array([0], pa.int32())], schema=_FOUND))
        return pa.concat_tables(found)

    return run


def _build(items: DataFrame, n_items: int, block_size: int, n_shards: int) -> tuple[DataFrame, DataFrame, Blocks]:
    """(items with block and shard, the table they are read from, blocks)."""
    spark = items.sparkSession
    n_pivots = int(min(MAX_PIVOTS, max(1, round(n_items ** 0.5))))
    chosen = items.orderBy(F.xxhash64("iid"), "iid").limit(n_pivots).select("embedding").toArrow()
    pivots = _matrix(chosen.column("embedding").combine_chunks())
    references = pivots[:REFERENCES]
    near = write_once(items.mapInArrow(_deal(pivots[_neighbours_adjoin(pivots)]), "iid string, embedding array<float>, cell int").withColumn(
        "num", F.monotonically_increasing_id()), "cells")
    rows = max(block_size, -(-n_items // MAX_BLOCKS))
    # At most MAX_PIVOTS rows.
    cells = sorted((cell, -(-n // rows)) for cell, n in near.groupBy("cell").count().collect())
    starts = np.cumsum([0] + [parts for _, parts in cells])
    parts = spark.createDataFrame(pa.table({"cell": pa.array([c for c, _ in cells], pa.int32()), "parts": pa.array([n for _, n in cells], pa.int32()), "start": pa.array(starts[:-1])}))
    block = F.col("start") + F.pmod(F.xxhash64("iid"), F.col("parts"))
    placed = near.join(F.broadcast(parts), "cell").select("iid", "embedding", "num", block.alias("blk"))
    ranges = [f(F.col(name)[j]).alias(f"{name}{j}") for name, f in (("least", F.min), ("most", F.max)) for j in range(len(references))]
    found = placed.select("embedding", "blk").mapInArrow(_ranges(references, int(starts[-1])), "blk long, n long, least array<double>, most array<double>")
    table = found.groupBy("blk").agg(F.sum("n").alias("n"), *ranges).orderBy("blk").toArrow()
    side = {name: np.column_stack([table.column(f"{name}{j}").to_numpy() for j in range(len(references))]) for name in ("least", "most")}
    number, size = table.column("blk").to_numpy(), table.column("n").to_numpy()
    shard = (np.cumsum(size) - size) // -(-n_items // n_shards)
    blocks = Blocks(number, size, side["least"], side["most"], references, shard)
    # At most MAX_BLOCKS and one per pivot.
    where = spark.createDataFrame(pa.table({"blk": pa.array(number), "shard": pa.array(shard.astype(np.int32))}))
    return placed.join(F.broadcast(where), "blk"), near, blocks


def pruned_topk(queries: DataFrame, items: DataFrame, k: int, *, exclude: DataFrame | None = None, block_size: int = BLOCK_ROWS,
                rounds: tuple[int, ...] = ROUNDS, shards: int | None = None) -> tuple[DataFrame, int, int]:
    """(hits, pairs compared, all pairs).  Hits are (qid, iid, sim, rank), as
    ``similarity_topk`` gives them: ids are strings, unique within their side;
    zero vectors have no similarity; ties rank by item id."""
    if k < 1:
        raise ValueError("k must be at least 1")
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    wanted = {"queries": (queries, "qid"), "items": (items, "iid")}
    written = write_all({name: df.select(F.col(c).cast("string"), F.col("embedding").cast("array<float>")).where(
        F.col(c).isNotNull() & F.col("embedding").isNotNull()).where(norm > 0) for name, (df, c) in wanted.items()})
    q, it = written["queries"], written["items"]
    spark = q.sparkSession
    (n_queries, dim), n_items = q.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first(), it.count()
    if not n_queries or not n_items:
        return spark.createDataFrame([], RESULT_SCHEMA), 0, n_queries * n_items
    pairs, n_excluded = None, 0
    if exclude is not None:
        pairs = exclude.select(F.col("qid").cast("string"), F.col("iid").cast("string")).where("qid IS NOT NULL AND iid IS NOT NULL")
        n_excluded = pairs.count()
    planned, groups = plan_blocks(n_queries, n_items, spark.sparkContext.defaultParallelism, block_rows(dim, hits=k), block_rows(dim),
                                  n_excluded=excluded_rows(n_excluded, dim, k), k=k)
    placed, cells, blocks = _build(it, n_items, block_size, shards or planned)
    several = int(blocks.shard.max()) > 0
    n_groups = (int(blocks.shard.max()) + 1) * groups
    group = F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int").alias("grp")
    masked = None
    if pairs is not None:
        # The item by its number: those whom queries exclude may lie together
        # in one shard, and their ids would take ten times the memory.
        masked = write_once(pairs.join(placed.select("iid", "shard", "num"), "iid").select("qid", "num", "shard"), "masked")
    right = placed.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def search(asking: DataFrame, first: bool) -> DataFrame:
        """Hits, written, and a row for each task's pairs."""
        routed = asking.mapInArrow(_routes(blocks, first), "qid string, embedding array<float>, kth double, shard int, near long")
        left = routed.select("qid", "embedding", "kth", "near", F.lit(None).cast("long").alias("ex"), "shard", group)
        if masked is not None:
            none = (F.lit(None).cast(t).alias(c) for c, t in (("kth", "double"), ("near", "long")))
            left = left.unionByName(masked.select("qid", no_vector(), *none, F.col("num").alias("ex"), "shard", group))
        left, items = (dealt(side, "shard", n_groups) for side in (left, right))
        found = left.groupBy("shard", "grp").cogroup(items.groupBy("shard", "grp")).applyInArrow(_search(blocks, k, rounds), RESULT_SCHEMA)
        return write_once(found, "hits")

    found = search(q.withColumn("kth", F.lit(None).cast("double")), True)
    if several:
        full = found.where(F.col("rank") == k).select("qid", F.col("sim").alias("kth"))
        found = found.unionByName(search(q.join(full, "qid", "left"), False))
    compared = int(found.where("qid IS NULL").agg(F.sum("sim")).first()[0])
    hits = found.where("qid IS NOT NULL")
    if several:
        best = Window.partitionBy("qid").orderBy(F.desc("sim"), F.asc("iid"))
        hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    for done in (masked, cells, q, it):
        if done is not None:
            drop_written(done)
    return hits, compared, n_queries * n_items
