"""Phrase collocation mining over FM-indexes.

Every task indexes the words of its documents in shards of bounded size: one
bidirectional FM-index over word ids each, written once, in buckets by shard.
Phrases grow by one word a level, to the left and to the right in turn: each
shard enumerates the extensions of its phrases that are frequent in the whole
corpus, their counts are summed across shards, and only those that reach the
minimum grow on (from three words on, an extension's other end
must be frequent, too).  So a level costs the occurrences of frequent phrases,
not all n-grams.
Levels are summed in blocks by bucket of keys, where a phrase is its language
and words in two independent 64-bit hashes (among 10^12 different phrases the
odds of one pair alike in both are below 10^-14; a pair alike in one is told
apart).  A shard gets one bit back for each phrase it has counted.  Of the
shards that hold a frequent phrase one, by bucket in turn, also gets the sum and
spells the phrase, so each phrase is written once and no words are shuffled.

Scores are relational: each cut of a phrase looks up its two parts, and a
phrase is dropped where an extension by one word has its count (a longer one
with that count contains such an extension).

Defined results: a null text is the empty text; a null language is ``und``;
pieces end at the separators and at the end of a document; a very long text
is indexed whole, cut at separators only; repeated rows count as often as they
stand; doc_id and further columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sendero.llm.common import text_or_empty
from sendero.llm.rolling import BASES, mixed, powers
from sendero.llm.steps import Steps
from sendero.llm.word_index import Phrases, WordIndex, transform

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
# Words and separators of one shard, about.
SHARD_WORDS = 1_500_000
_CHUNK = 4 << 20  # bytes of a text that are split at a time
_SEPARATOR = re.compile(rb"[.,;:!?\n-\r]+")
_END = b"."  # stands for any separator: no word holds one

_INDEX = "shard long, langs array<string>, words binary, lang_of binary, counts binary, forward binary, reverse binary"
_BLOCK = "bucket int, shard long, level int, keys binary, checks binary, counts binary"
_FREQUENT = "shard long, level int, bucket int, bits binary, spelt binary, sums binary"
_PHRASE = "lang string, phrase string, words int, n long"
# Levels that are summed together, and from which side the words come.
_LEVELS = ((1, 2), (3,), (4, 5))
# Buckets of keys for each shuffle partition.
_BUCKETS = 4


def _from_left(level: int) -> bool:
    return level % 2 == 0


# --- shards --------------------------------------------------------------------------

def chunks_of(text: bytes) -> Iterator[bytes]:
    """The text in chunks that end at separators."""
    at = 0
    while len(text) - at > _CHUNK:
        found = _SEPARATOR.search(text, at + _CHUNK)
        if not found:
            break
        yield text[at:found.end()]
        at = found.end()
    yield text[at:]


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


class _Shard:
    def __init__(self):
        self.next_id = count(1)
        self.ids: dict[str, dict[bytes, int]] = {}
        self.parts: list[np.ndarray] = [np.zeros(1, np.int32)]
        self.size = 1

    def add(self, lang: str, chunk: bytes) -> None:
        known = self.ids.get(lang)
        if known is None:
            known = self.ids[lang] = defaultdict(self.next_id.__next__)
            known[_END] = 0
        tokens = _SEPARATOR.sub(b" . ", chunk.lower()).split()  # bytes.lower(): A-Z only
        part = np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))
        self.parts += (part, np.zeros(1, np.int32))
        self.size += len(part) + 1

    def row(self, number: int) -> pa.RecordBatch:
        ids = np.concatenate(self.parts)
        n = next(self.next_id)
        words, lang_of = [b""] * n, np.zeros(n, np.int32)
        for i, known in enumerate(self.ids.values()):
            for word, at in known.items():
                if at:
                    words[at], lang_of[at] = word, i
        counts = np.bincount(ids, minlength=n).astype(np.int64)
        row = (number, list(self.ids), b"\n".join(words), lang_of.tobytes(), counts.tobytes(),
               transform(ids).tobytes(), transform(ids[::-1]).tobytes())
        schema = _schema(_INDEX)
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)


def _index(shard_words: int):
    def run(batches):
        number = TaskContext.get().partitionId() << 24
        shard = _Shard()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                for chunk in chunks_of(text):
                    shard.add(lang, chunk)
                    if shard.size >= shard_words:
                        yield shard.row(number)
                        number, shard = number + 1, _Shard()
        if shard.ids:
            yield shard.row(number)

    return run


# --- levels --------------------------------------------------------------------------

def _hashes(row: dict, seed: int = 0) -> np.ndarray:
    """Hashes of language and word by id."""
    lang_of = np.frombuffer(row["lang_of"], np.int32).tolist()
    prefix = [x.encode() + b"\n" for x in row["langs"]]
    return np.array([xxhash.xxh64_intdigest(prefix[i] + w, seed) for i, w in zip(lang_of, row["words"].split(b"\n"))], np.uint64)


def _checks(phrases: Phrases, hashes: np.ndarray) -> np.ndarray:
    """A second hash of each phrase, from other hashes of its words."""
    n = phrases.words.shape[1]
    up, _ = powers(BASES[1], n + 1)
    out = np.full(len(phrases.words), n, np.uint64)
    for i in range(n):
        out += hashes[phrases.words[:, i]] * up[i]
    return mixed(out)


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(wanted):
        return np.zeros(len(keys), bool)
    return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in the order of their buckets; where each bucket
    ends.  The same for the same keys, so a bit says which key is meant."""
    bucket = ((keys.view(np.uint64) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    return np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=buckets))


def _frequent(phrases: Phrases, bits: dict[int, bytes], buckets: int) -> np.ndarray:
    order, ends = _by_bucket(phrases.keys, buckets)
    out = np.zeros(len(order), bool)
    for bucket, packed in bits.items():
        part = order[ends[bucket - 1] if bucket else 0:ends[bucket]]
        out[part] = np.unpackbits(np.frombuffer(packed, np.uint8), count=len(part))
    return out


def _spelt(phrases: Phrases, found: dict[int, dict], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the phrases that this shard spells, and their sums."""
    order, ends = _by_bucket(phrases.keys, buckets)
    places, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for bucket, x in found.items():
        part = order[ends[bucket - 1] if bucket else 0:ends[bucket]]
        places.append(part[np.unpackbits(np.frombuffer(x["spelt"], np.uint8), count=len(part)).astype(bool)])
        sums.append(np.frombuffer(x["sums"], np.int64))
    return np.concatenate(places), np.concatenate(sums)


def _grow(row: dict, counted: int | None, buckets: int) -> Iterator[tuple[int, Phrases]]:
    """The phrases of the shard by level: of the groups of levels before
    ``counted`` (None: of all) those the corpus has found frequent, of that
    group all that could be."""
    counts, hashes = np.frombuffer(row["counts"], np.int64), _hashes(row)
    forward, reverse = (np.frombuffer(row[c], np.int32) if row.get(c) is not None else None for c in ("forward", "reverse"))
    index = WordIndex(counts, hashes, forward, reverse)
    bits: dict[int, dict[int, bytes]] = {level: {} for group in _LEVELS for level in group}
    for x in row.get("found") or ():
        bits[x["level"]][x["bucket"]] = x["bits"]
    groups = _LEVELS if counted is None else _LEVELS[:counted + 1]
    phrases, known = None, None
    for number, group in enumerate(groups):
        for level in group:
            last, left = level == group[-1], _from_left(level)
            other_end = known if level == group[0] else None

            def keep(found: Phrases) -> np.ndarray:
                out = np.ones(len(found.count), bool)
                if other_end is not None:  # the end that was there before is frequent; the other must be
                    out &= _among(index.without_end(found, not left), other_end)
                if last and number != counted:
                    at = np.flatnonzero(out)
                    out[at] = _frequent(found.take(at), bits[level], buckets)
                return out

            phrases = index.single() if level == 1 else index.extended(phrases, left, keep, intervals=level < groups[-1][-1])
            # Levels of one group are counted together, so none waits for the
            # one before it to be known.
            yield level, phrases if number == counted or last else phrases.take(np.flatnonzero(_frequent(phrases, bits[level], buckets)))
        known = np.sort(phrases.keys)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def _count_level(counted: int, buckets: int):
    """The counts of a shard, in one block for each bucket of keys."""
    schema = _schema(_BLOCK)

    def blocks(shard: int, level: int, phrases: Phrases, hashes: np.ndarray) -> pa.RecordBatch:
        order, ends = _by_bucket(phrases.keys, buckets)
        keys, checks = phrases.keys[order], _checks(phrases, hashes)[order]
        counts = phrases.count[order].astype(np.int32)  # a shard's words are numbered in 32 bits
        filled = np.flatnonzero(np.diff(ends, prepend=0))
        parts = [(ends[i - 1] if i else 0, ends[i]) for i in filled.tolist()]
        return pa.RecordBatch.from_arrays(
            [pa.array(filled.astype(np.int32)), pa.array(np.full(len(parts), shard)), pa.array(np.full(len(parts), level, np.int32)),
             pa.array([keys[a:b].tobytes() for a, b in parts], pa.binary()),
             pa.array([checks[a:b].tobytes() for a, b in parts], pa.binary()),
             pa.array([counts[a:b].tobytes() for a, b in parts], pa.binary())], schema=schema)

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                second = _hashes(row, 1)
                for level, phrases in _grow(row, counted, buckets):
                    if level in _LEVELS[counted]:
                        yield blocks(row["shard"], level, phrases, second)

    return run


def _sum_buckets(min_count: int):
    """For each block, one bit a key: does its sum over all shards reach the
    minimum?  Of these, one bit a key: is this the block that spells it, and
    then its sum.  Blocks come in the order of their buckets."""
    schema = _schema(_FREQUENT)

    def summed(bucket: int, held: list[tuple]) -> pa.RecordBatch:
        # The first block with a key spells it: another shard is first in each bucket.
        held.sort(key=lambda x: x[:2])
        turn = xxhash.xxh64_intdigest(bucket.to_bytes(4, "little")) % len(held)
        held = held[turn:] + held[:turn]
        keys = np.concatenate([np.frombuffer(h[2], np.int64) for h in held])
        checks = np.concatenate([np.frombuffer(h[3], np.uint64) for h in held])
        counts = np.concatenate([np.frombuffer(h[4], np.int32) for h in held])
        order = np.argsort(keys, kind="stable")
        new, other = np.ones(len(keys), bool), np.zeros(len(keys), bool)
        new[1:] = keys[order[1:]] != keys[order[:-1]]
        other[1:] = checks[order[1:]] != checks[order[:-1]]
        if (other & ~new).any():  # different phrases with one key
            order = np.lexsort((checks, keys))
            new[1:] = (keys[order[1:]] != keys[order[:-1]]) | (checks[order[1:]] != checks[order[:-1]])
        first = np.flatnonzero(new)
        sums = np.add.reduceat(counts[order].astype(np.int64), first)
        frequent = sums >= min_count
        enough, total = np.empty(len(keys), bool), np.zeros(len(keys), np.int64)
        enough[order] = np.repeat(frequent, np.diff(np.append(first, len(keys))))
        total[order[first[frequent]]] = sums[frequent]
        ends = np.cumsum([len(h[2]) // 8 for h in held])[:-1]
        parts = [(e, t[e]) for e, t in zip(np.split(enough, ends), np.split(total, ends))]
        return pa.RecordBatch.from_arrays(
            [pa.array([h[0] for h in held]), pa.array([h[1] for h in held], pa.int32()), pa.array([bucket] * len(held), pa.int32()),
             pa.array([np.packbits(e).tobytes() for e, _ in parts], pa.binary()),
             pa.array([np.packbits(t > 0).tobytes() for _, t in parts], pa.binary()),
             pa.array([t[t > 0].tobytes() for _, t in parts], pa.binary())], schema=schema)

    def run(batches):
        held, bucket = [], None
        for batch in batches:
            for b, *block in zip(*(c.to_pylist() for c in batch.columns)):
                if held and b != bucket:
                    yield summed(bucket, held)
                    held = []
                bucket = b
                held.append(block)
        if held:
            yield summed(bucket, held)

    return run


def _spell(buckets: int):
    """The frequent phrases that fall to the shard, in words, and each
    language's words in it as a phrase of none."""

    def run(batches):
        schema = _schema(_PHRASE)
        for batch in batches:
            for row in _rows(batch):
                words = [w.decode("utf-8", "replace") for w in row["words"].split(b"\n")]
                lang_of, counts = np.frombuffer(row["lang_of"], np.int32), np.frombuffer(row["counts"], np.int64)
                totals = np.bincount(lang_of[1:], weights=counts[1:], minlength=len(row["langs"])).astype(np.int64)
                out = [(lang, "", 0, int(n)) for lang, n in zip(row["langs"], totals)]
                found: dict[int, dict[int, dict]] = defaultdict(dict)
                for x in row["found"] or ():
                    found[x["level"]][x["bucket"]] = x
                for level, phrases in _grow(row, None, buckets):
                    places, sums = _spelt(phrases, found[level], buckets)
                    for ids, n in zip(phrases.words[places].tolist(), sums.tolist()):
                        out.append((row["langs"][lang_of[ids[0]]], " ".join([words[i] for i in ids]), level, n))
                for lo in range(0, len(out), 10_000):
                    columns = zip(*out[lo:lo + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def phrase_counts(docs: DataFrame, steps: Steps, min_count: int = MIN_COUNT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, phrase, words, n: all phrases of up to MAX_WORDS words that occur
    ``min_count`` times, and the number of words of each language (phrase '',
    words 0).  Written."""
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    index = steps.write_bucketed(source.mapInArrow(_index(shard_words), _INDEX), "phrase-index", "shard")
    buckets = _BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known: list[DataFrame] = []

    def shards(*columns: str, about: tuple[str, ...] = ("bits",)) -> DataFrame:
        """The shards, with what is known of their phrases."""
        held = index.select("shard", "langs", "words", "lang_of", "counts", *columns)
        if not known:
            return held
        found = known[0]
        for more in known[1:]:
            found = found.unionByName(more)
        # One bit for each phrase that the shard has counted.
        found = found.groupBy("shard").agg(F.collect_list(F.struct("level", "bucket", *about)).alias("found"))
        return held.join(found.hint("shuffle_hash"), "shard")

    for counted, levels in enumerate(_LEVELS):
        sides = ("forward",) if max(levels) == 2 else ("forward", "reverse")
        blocks = shards(*sides).mapInArrow(_count_level(counted, buckets), _BLOCK)
        dealt = blocks.repartition("bucket").sortWithinPartitions("bucket")
        known.append(steps.write(dealt.mapInArrow(_sum_buckets(min_count), _FREQUENT), "phrase-level", wide_rows=True))
    spelt = steps.write(shards("forward", "reverse", about=("bits", "spelt", "sums")).mapInArrow(_spell(buckets), _PHRASE),
                        "phrase-counts", wide_rows=True)
    steps.done(index, *known)
    totals = spelt.where("words = 0").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return spelt.where("words > 0").unionByName(totals)


# --- scores --------------------------------------------------------------------------

def _part(words: Column, start: Column | int, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    steps = Steps(docs.sparkSession)
    counts = phrase_counts(docs, steps, min_count, shard_words)
    found = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    totals = counts.where("words = 0").select("lang", F.col("n").alias("n"))
    k, size = F.col("k"), F.col("words")
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _part(F.col("w"), 1, k).alias("left"), _part(F.col("w"), k + 1, size - k).alias("right"))
    parts = counts.where("words > 0")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    cuts = cuts.join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(38, 0)) * a * n) div (cast(l as decimal(38, 0)) * r)")
    scored = cuts.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    longer = found.where("words > 2")
    covered = longer.select("lang", "a", F.explode(F.array(
        _part(F.col("w"), 1, size - 1), _part(F.col("w"), 2, size - 1))).alias("phrase")).distinct()
    best = scored.join(covered, ["lang", "phrase", "a"], "left_anti").select(
        "lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
