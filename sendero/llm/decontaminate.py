"""Benchmark decontamination: a broadcast hash set of normalised benchmark
n-grams against every token window of the training documents.

Each benchmark item gives its windows of ``n`` words (an item of fewer words
is one window).  Documents are scanned in one pass without Python: words are
hashed, every window's hash is looked up in the set, and a hit counts only if
its words equal the item's.  One more row per document, looked up as hash
``_BASE``, carries the documents without hits through the same join.  The set
is broadcast only while it has at most ``broadcast_windows`` windows;
beyond, the planner joins by shuffle, with the same result.

Defined results: a null text or item has no words; a document shorter than a
window can only be hit by a shorter item; repeated items count once; items
without an identifier hit words but appear in no list; documents are told
apart by row, so repeated identifiers stay apart; empty tables give no hits
or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sendero.llm.common import RAW_WORD, ascii_lower, materialise, packed, text_or_empty, words_of

N = 10
BROADCAST_WINDOWS = 200_000
_BASE = 0


def _hash(hashes: Column, start: Column, length: int) -> Column:
    return F.xxhash64(F.slice(hashes, start, length))


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """Distinct windows: key, length, words, and the items that have them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(ascii_lower(text_or_empty())).alias("w"))
    size = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
    windows = items.where(size > 0).withColumn("window", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))))
    return windows.groupBy("window").agg(F.collect_set("item").alias("items")).select(
        F.xxhash64(_word_hashes(F.col("window"))).alias("key"), F.size("window").alias("length"), "window", "items")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, broadcast_windows: int = BROADCAST_WINDOWS,
         carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: the carried columns, n_words, ``hits`` (structs of first
    word, from 0, and length) and ``items`` (identifiers as strings)."""
    windows = materialise(benchmark_windows(benchmark, n), "bench-windows")
    found = windows.agg(F.count(F.lit(1)), F.collect_set("length")).first()
    lengths = sorted(found[1])  # at most n different ones
    base = docs.sparkSession.range(1).select(
        F.lit(_BASE).cast("long").alias("key"), F.lit(0).alias("length"),
        F.lit(None).cast("array<string>").alias("window"), F.lit(None).cast("array<string>").alias("items"))
    table = windows.unionByName(base)
    if found[0] <= broadcast_windows:
        table = F.broadcast(table)

    rows = docs.select(*carry, F.monotonically_increasing_id().alias("_row"),
                       words_of(ascii_lower(text_or_empty())).alias("_words"))
    rows = rows.withColumn("_hashes", _word_hashes(F.col("_words"))).withColumn("_n", F.size("_words"))
    def keys_of(length: int) -> Column:
        starts = F.sequence(F.lit(1), F.col("_n") - (length - 1))
        return F.when(F.col("_n") >= length, F.transform(starts, lambda i: _hash(F.col("_hashes"), i, length))).otherwise(
            F.array().cast("array<bigint>"))

    keys = F.concat(F.array(F.lit(_BASE).cast("long")), *map(keys_of, lengths))
    offset, first = F.lit(1), F.lit(0)
    for k in lengths:  # where the windows of that length begin among the keys
        first = F.when(F.col("length") == k, offset).otherwise(first)
        offset = offset + F.greatest(F.col("_n") - (k - 1), F.lit(0))
    hit = rows.select(*carry, "_row", "_n", "_words", F.posexplode(keys).alias("_at", "key")).join(table, "key")
    hit = hit.withColumn("_start", F.col("_at") - first)
    real = F.col("length") > 0
    hit = hit.where((~real & (F.col("_at") == 0)) | (
        real & (F.col("_at") > 0) & (F.slice("_words", F.col("_start") + 1, F.greatest(F.col("length"), F.lit(1))) == F.col("window"))))
    per_row = hit.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in carry], F.first("_n").cast("long").alias("n_words"),
        F.collect_set(F.when(real, F.struct(F.col("_start").alias("start"), F.col("length")))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list(F.when(real, F.col("items"))))).alias("items"))
    return per_row.drop("_row")


def hit_words(hits: Column) -> Column:
    """The distinct numbers of the words inside hits."""
    return F.array_distinct(F.flatten(F.transform(
        hits, lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per document: n_words, n_hit, n_items, the item list and its digest."""
    scanned = scan(docs, benchmark, n, broadcast_windows)
    listed = F.array_join(F.array_sort("items"), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(hit_words(F.col("hits"))).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"), listed.alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = N,
                  broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The documents without contamination, with the columns they came with:
    ``mode`` "documents" drops those with a hit, "spans" cuts the words inside
    hits and keeps what stands between words."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode must be documents or spans: {mode}")
    digest = F.md5(F.coalesce("_text", F.lit("")))
    keyed = packed(docs).select("_id", digest.alias("_digest"), F.col("_text").alias("text"))
    hit = scan(keyed, benchmark, n, broadcast_windows, carry=("_id", "_digest")).where(F.size("hits") > 0)
    hit = hit.select(F.col("_id").alias("_doc"), "_digest", hit_words(F.col("hits")).alias("_cut"))
    hit = materialise(hit.dropDuplicates(["_doc", "_digest"]), "bench-hits")
    rows = packed(docs)
    same = (digest == F.col("_digest")) & F.col("_id").eqNullSafe(F.col("_doc"))
    hit = hit.hint("merge")  # grows with the corpus: joined by shuffle at every size
    if mode == "documents":
        return rows.join(hit, same, "left_anti").select("_row.*")
    words, between = F.regexp_extract_all("_text", F.lit(RAW_WORD), F.lit(0)), F.split("_text", RAW_WORD)
    # Word i stands after the piece i of what is between words.
    kept = F.transform(F.arrays_zip(between.alias("b"), words.alias("w")), lambda x, i: F.concat(
        x["b"], F.when(F.array_contains("_cut", i), "").otherwise(F.coalesce(x["w"], F.lit("")))))
    text = F.when(F.col("_cut").isNotNull(), F.array_join(kept, "")).otherwise(F.col("_text"))
    return rows.join(hit, same, "left").select(
        *[text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
