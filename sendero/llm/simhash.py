"""SimHash near-duplicates through vantage-point trees.

Fingerprints: 64 majority bits over the XXH64 (seed 42) of a document's word
shingles.  Two fingerprints are linked at ``radius`` or fewer differing bits;
all such pairs are found, exactly.

The search is a vantage-point tree over the distinct fingerprints.  A level
has a vantage point and a block of bits, and its distance is the Hamming
distance inside that block; blocks of different levels don't overlap, so by
the triangle inequality the sum over levels of |d(a) - d(b)| is at most the
Hamming distance of a and b.  The top levels partition the fingerprints into
shards (one ring of distances per level); a fingerprint is sent as a query to
its own shard and to the shards across a boundary that the summed bound
leaves within the radius (half of them: each pair meets once).  In a shard
further levels on narrower blocks prune branches in the same way until a
small block of pairs is left for XOR and popcount.

The number of top levels follows the number of distinct fingerprints; a shard
whose own rows exceed ``shard_rows`` is split by hash and its queries go to
each part.  Vantage points come from a sample of 64 fingerprints.  Exact
copies share a fingerprint and are one node; a shard returns a spanning
forest of its links, never all pairs of a dense group.

Defined results: a null or blank text has fingerprint zero and is linked like
any other; ``component_id`` is null only if no row of the component has an
identifier; repeated rows are separate documents of one component; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendero.llm.common import materialise, packed, text_bytes
from sendero.llm.components import component_roots, local_forest

SHINGLE = 3
RADIUS = 3
BITS = 64
SHARD_ROWS = 50_000
_VANTAGE_SAMPLE = 64
_BRUTE_PAIRS = 1 << 18
_FOLD_LINKS = 1 << 19
# Largest share of uniform fingerprints in one shard, by number of top levels
# (the most likely distance of a 64-, 32-, 21- and 16-bit block).
_PEAK = {1: 0.10, 2: 0.02, 3: 0.005, 4: 0.0015}
_BASE = 128  # digits of a shard number; distances are at most 64 and shifted


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes: A-Z only, and \x20 \x09-\x0D
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[s:e - 1], 42) for s, e in zip(starts, ends[shingle - 1:])]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _prints(shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch)
            fps = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()),
                 pa.array(fps)], schema=schema)

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, digest (MD5 of the text), fp (the fingerprint as a long)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _prints(shingle), "doc_id long, digest binary, fp long")


def _blocks(count: int) -> list[int]:
    """``count`` masks that part the 64 bits."""
    edges = [BITS * i // count for i in range(count + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _vantages(sample: list[int], masks: list[int]) -> list[int]:
    """For each block the sampled point with the widest spread of distances."""
    points = np.array(sample or [0], dtype=np.int64).view(np.uint64)
    out = []
    for mask in masks:
        d = np.bitwise_count((points[:, None] ^ points[None, :]) & np.uint64(mask))
        out.append(int(points[int(d.var(axis=1).argmax())]))
    return out


def _offsets(levels: int, radius: int) -> list[int]:
    """Shard numbers to add: no step, and one of each pair of opposite steps."""
    steps = [o for o in itertools.product(range(-radius, radius + 1), repeat=levels) if sum(map(abs, o)) <= radius]
    return [sum(x * _BASE ** i for i, x in enumerate(reversed(o))) for o in steps if o >= (0,) * levels]


def _search(home, query, budget, level, masks, radius):
    """Pairs (home, query) within the radius, block by block."""
    if not len(home) or not len(query):
        return
    if len(home) * len(query) <= _BRUTE_PAIRS or level == len(masks):
        rows = max(1, _BRUTE_PAIRS // len(query))
        for at in range(0, len(home), rows):
            part = home[at:at + rows]
            i, j = np.nonzero(np.bitwise_count(part[:, None] ^ query[None, :]) <= radius)
            if len(i):
                yield part[i], query[j]
        return
    vantage = home[len(home) // 2]
    mask = np.uint64(masks[level])
    dh = np.bitwise_count((home ^ vantage) & mask).astype(np.int16)
    dq = np.bitwise_count((query ^ vantage) & mask).astype(np.int16)
    for ring in np.unique(dh):
        gap = np.abs(dq - ring)
        near = gap <= budget
        yield from _search(home[dh == ring], query[near], budget[near] - gap[near], level + 1, masks, radius)


def _shard_links(radius: int):
    masks = _blocks(8)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        own = rows["own"].to_numpy(dtype=bool)
        home, query = fp[own], fp[~own]
        a, b, held = [], [], 0
        for x, y in _search(home, query, np.full(len(query), radius, dtype=np.int16), 0, masks, radius):
            a.append(x)
            b.append(y)
            held += len(x)
            if held > _FOLD_LINKS:
                x, y = local_forest(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], 0
        if a:
            x, y = local_forest(np.concatenate(a), np.concatenate(b))
        else:
            x = y = np.zeros(0, dtype=np.uint64)
        return pd.DataFrame({"u": x.view(np.int64), "v": y.view(np.int64)})

    return run


def fingerprint_links(points: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``points``: fp, distinct.  Links u, v that connect exactly the
    fingerprints that pairs within the radius connect."""
    total = points.count()
    levels = next((k for k, peak in _PEAK.items() if total * peak <= shard_rows), max(_PEAK))
    masks = _blocks(levels)
    sample = [r[0] for r in points.orderBy(F.xxhash64("fp"), "fp").limit(_VANTAGE_SAMPLE).collect()]
    shard = F.lit(0).cast("long")
    for mask, vantage in zip(masks, _vantages(sample, masks)):
        ring = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(vantage))).bitwiseAND(F.lit(_signed(mask))))
        shard = shard * _BASE + ring + radius
    placed = points.select("fp", shard.alias("shard"))
    parts = placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("parts"))
    # At most (64 / levels + 1) ** levels shards, whatever the data.
    parts = F.broadcast(parts)
    home = placed.join(parts, "shard").select(
        "shard", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"), "fp", F.lit(True).alias("own"))
    steps = F.array(*[F.lit(o).cast("long") for o in _offsets(levels, radius)])
    near = F.transform(steps, lambda step: step + F.col("shard"))
    query = placed.select("fp", F.explode(near).alias("shard")).join(parts, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "fp", F.lit(False).alias("own"))
    return home.unionByName(query).groupBy("shard", "part").applyInPandas(_shard_links(radius), "u long, v long")


def near_duplicate_classes(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """fp, root: the smallest fingerprint (as a long) reachable from each."""
    points = materialise(prints.select("fp").distinct(), "simhash-points")
    roots = component_roots(fingerprint_links(points, radius, shard_rows))
    return points.join(roots, points["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per document: its fingerprint in hex and its component's smallest id."""
    prints = materialise(fingerprints(docs, shingle), "simhash-prints")
    classes = near_duplicate_classes(prints, radius, shard_rows)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    placed = materialise(classes.join(least, "fp"), "simhash-classes")
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One document of each component, as it came: the one with the smallest
    identifier (null last), then the smallest MD5 of its text; of rows that
    repeat even that, one."""
    prints = materialise(fingerprints(docs, shingle), "simhash-prints")
    classes = near_duplicate_classes(prints, radius, shard_rows)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    least = prints.groupBy("fp").agg(F.min(key).alias("key"))
    kept = classes.join(least, "fp").groupBy("root").agg(F.min("key").alias("key"))
    rows = prints.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("_rows"))
    kept = kept.select(F.col("key.doc_id").alias("_doc"), F.col("key.digest").alias("_kept"))
    kept = materialise(kept.join(rows, kept["_doc"].eqNullSafe(rows["doc_id"]) & (kept["_kept"] == rows["digest"])).select(
        "_doc", F.lower(F.hex("_kept")).alias("_kept"), "_rows"), "simhash-kept")

    rows = packed(docs)
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.md5(F.coalesce("_text", F.lit(""))) == F.col("_kept"))
    # The kept rows grow with the corpus: joined by shuffle at every size.
    once = rows.join(kept.where("_rows = 1").hint("merge"), same)
    repeated = rows.join(kept.where("_rows > 1"), same).dropDuplicates(["_doc", "_kept"])
    return once.select("_row.*").unionByName(repeated.select("_row.*"))
