"""Suffix-array dedup: repeated byte strings of a fixed length go.

Every byte that a string of ``length`` bytes covers is removed if that string
also starts earlier (in a document before it by doc_id, or earlier in the same
one).  Strings are judged on the input, and overlap.

Suffixes that could share ``length`` bytes are brought together first.  In
each window of ``length`` bytes the substring of GRAM bytes with the smallest
hash is its anchor, so equal windows have equal anchors at equal offsets; the
windows in a row that share an anchor are one piece.  Pieces whose anchor
stands nowhere else are dropped.  Of pieces that are equal as a whole (128-bit
digests of their bytes) all but the first go at once.  What remains are the
different pieces around an anchor: their suffixes, cut after ``length`` bytes,
are sorted by a mergesort whose comparison finds the common extension of two
suffixes by binary search over prefix polynomial hashes.  The sorted order and
each equality are then verified on the bytes; after a collision the block is
sorted again under another base.  Neighbours that agree in ``length`` bytes
are repeats, and the first place of each stays.

An anchor with more than ``block`` different pieces is sorted in blocks of
about that many; the windows that stay in a block meet once more by digest.
Counts and first places are partial aggregates, and joins have written tables
on both sides, so that adaptive execution can split a passage that a third of
all documents share.

Defined results: a null text is the empty text; texts shorter than ``length``
keep all; a very long text is hashed in pieces of bounded size, all of it;
rows without doc_id come last; rows of one doc_id with different texts follow
a hash of the text; rows equal in doc_id and text are one document and share
its decision; further columns pass by; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sendero.llm.common import text_bytes
from sendero.llm.rolling import BASES, Rolling, mixed
from sendero.llm.steps import Steps

LENGTH = 100
GRAM = 24
# Different pieces around one anchor that are sorted together.
BLOCK = 4_000
_BUFFER = 1 << 19  # bytes hashed at a time
_POSITION = np.uint64((1 << 24) - 1)  # low bits of a window minimum: where it stands

_PIECE = pa.schema([("anchor", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()),
                    ("start", pa.int32()), ("n", pa.int32()), ("at", pa.int32())])
_FOUND = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


# --- pieces ------------------------------------------------------------------------

def window_anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``length`` bytes the position of its anchor (the
    first of equal ones); the hashes of all substrings of ``gram`` bytes."""
    hashes = mixed(Rolling(data).every(gram))
    w = length - gram + 1
    marked = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
    windows = len(data) - length + 1
    # Minima of w neighbours: within rows of w, from the left and from the right.
    table = np.full(-(-(len(marked) + w) // w) * w, ~np.uint64(0))
    table[:len(marked)] = marked
    table = table.reshape(-1, w)
    left = np.minimum.accumulate(table, axis=1).ravel()
    right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[:windows], left[w - 1:w - 1 + windows])
    return (least & _POSITION).astype(np.int64), hashes


def pieces_of(texts: list[tuple[int, bytes]], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pieces of (number, text) as arrays: anchor hash, digest (two halves),
    number, start of the first window, windows, offset of the anchor."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for number, text in texts:
        for at in range(0, max(len(text) - length + 1, 0), _BUFFER):
            part = text[at:at + _BUFFER + length - 1]
            held.append((number, at, part))
            size += len(part)
            if size >= _BUFFER:
                yield _pieces(held, length, gram)
                held, size = [], 0
    if held:
        yield _pieces(held, length, gram)


def _pieces(parts: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    raw = b"".join(p for _, _, p in parts)
    data = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(p) for _, _, p in parts])
    ends = np.cumsum(sizes)
    anchors, hashes = window_anchors(data, length, gram)
    outside = np.zeros(len(data) + 1, np.int32)  # windows that would run over the end of a part
    outside[ends - length + 1] += 1
    np.subtract.at(outside, ends, 1)
    inside = np.flatnonzero(np.cumsum(outside)[:len(anchors)] == 0)
    own = anchors[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (own[1:] != own[:-1]) | (inside[1:] != inside[:-1] + 1)
    first = np.flatnonzero(new)
    start, anchor = inside[first], own[first]
    n = np.diff(np.append(first, len(inside)))
    view = memoryview(raw)
    digests = b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(start.tolist(), (start + n + length - 1).tolist())])
    halves = np.frombuffer(digests, ">i8").reshape(-1, 2)
    part = np.searchsorted(ends, start, side="right")
    number = np.array([p[0] for p in parts])[part]
    begin = np.array([p[1] for p in parts])[part] - (ends - sizes)[part]
    return hashes[anchor].view(np.int64), halves[:, 0], halves[:, 1], number, start + begin, n, anchor - start


def _emit_pieces(length: int, gram: int):
    def run(batches):
        for batch in batches:
            docs, ties = batch.column("doc"), batch.column("tie")
            for anchor, h1, h2, number, start, n, at in pieces_of(list(enumerate(text_bytes(batch))), length, gram):
                rows = pa.array(number)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(h1.astype(np.int64)), pa.array(h2.astype(np.int64)), docs.take(rows), ties.take(rows),
                     pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))], schema=_PIECE)

    return run


# --- the suffix sort ----------------------------------------------------------------

class Suffixes:
    """Suffixes of one buffer, cut after ``length`` bytes, compared by hashes."""

    def __init__(self, data: np.ndarray, at: np.ndarray, length: int, base: int):
        self.data, self.at, self.length = data, at, length
        self.rolling = Rolling(data, base)
        self.whole = self.rolling.of(at, length)
        # The eight bytes at each position as one number.
        self.wide = np.ndarray(max(len(data) - 7, 0), "<u8", data, strides=(1,)) if length >= 8 else None

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension of suffixes that differ: the longest length at
        which their hashes agree, by binary search."""
        a, b = self.at[i], self.at[j]
        prefix, down = self.rolling.prefix, self.rolling.down
        from_a, from_b, down_a, down_b = prefix[a], prefix[b], down[a], down[b]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length - 1, np.int64)
        for _ in range((self.length - 1).bit_length()):
            mid = (low + high + 1) >> 1
            same = (prefix[a + mid] - from_a) * down_a == (prefix[b + mid] - from_b) * down_b
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low

    def before(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Is suffix i before suffix j, or equal where ``or_equal``?"""
        out = (self.whole[i] == self.whole[j])
        apart = np.flatnonzero(~out)
        out &= or_equal
        if self.wide is not None:  # most differ in their first bytes
            a, b = (self.wide[self.at[x[apart]]] for x in (i, j))
            early = a != b
            out[apart[early]] = a[early].byteswap() < b[early].byteswap()
            apart = apart[~early]
        i, j = i[apart], j[apart]
        at = self.common(i, j)
        out[apart] = self.data[self.at[i] + at] < self.data[self.at[j] + at]
        return out

    def sort(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of the suffixes, sorted within segments that stand in a row
        (stable): a mergesort from below, all merges of a level at once."""
        order = np.arange(sizes.sum())
        start, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        width = 1
        while width < sizes.max(initial=0):
            p = np.flatnonzero(size > width)
            base, end = start[p], start[p] + size[p]
            pair = base + (p - base) // (2 * width) * (2 * width)
            middle = np.minimum(pair + width, end)
            right = p >= middle
            low = np.where(right, pair, middle)
            high = np.where(right, middle, np.minimum(pair + 2 * width, end))
            own, other = p - np.where(right, middle, pair), low.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                passed = self.before(order[mid], order[p[open_]], right[open_])
                low[open_[passed]] = mid[passed] + 1
                high[open_[~passed]] = mid[~passed]
            merged = order.copy()
            merged[pair + own + low - other] = order[p]
            order, width = merged, 2 * width
        return order

    def verified(self, order: np.ndarray, follows: np.ndarray) -> bool:
        """Do the bytes of neighbours (``follows``: positions after another of
        their segment) stand in this order, and agree where the hashes do?"""
        width = 8 if self.wide is not None else 1
        values = self.data if self.wide is None else self.wide
        i, j = order[follows - 1], order[follows]
        agree = self.whole[i] == self.whole[j]
        a, b = self.at[i], self.at[j]
        # The last step may look at some bytes twice.
        for step in (*range(0, self.length - width, width), self.length - width):
            x, y = values[a + step], values[b + step]
            differ = x != y
            if differ.any():
                if (x[differ].byteswap() > y[differ].byteswap()).any() or agree[differ].any():
                    return False
                a, b, agree = a[~differ], b[~differ], agree[~differ]
        return bool(agree.all())


def repeated_windows(data: np.ndarray, group: np.ndarray, base: np.ndarray, n: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Of pieces in the order of their places (``group``: their anchor,
    ``base``: where they begin in ``data``, ``n`` windows each, the anchor at
    offset ``at``): which windows repeat one of an earlier piece, as booleans
    window by window."""
    piece = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    # Windows around an anchor can only be equal with the anchor at one offset.
    key = group[piece] * length + at[piece] - step
    found = np.zeros(len(piece), bool)
    by_key = np.argsort(key, kind="stable")
    _, first, count = np.unique(key[by_key], return_index=True, return_counts=True)
    many = count > 1
    chosen = by_key[np.repeat(many, count)]
    sizes = count[many]
    if not len(sizes):
        return found
    starts = np.cumsum(sizes) - sizes
    follows = np.ones(len(chosen), bool)
    follows[starts] = False
    follows = np.flatnonzero(follows)
    for multiplier in BASES:
        suffixes = Suffixes(data, base[piece[chosen]] + step[chosen], length, multiplier)
        order = suffixes.sort(starts, sizes)
        if suffixes.verified(order, follows):
            break
    else:
        raise ValueError("suffixes collide under every base")
    again = follows[suffixes.whole[order[follows]] == suffixes.whole[order[follows - 1]]]
    found[chosen[order[again]]] = True
    return found


def _runs(found: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, first window and number of windows of each run of True."""
    piece = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(found)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (piece[at[1:]] != piece[at[:-1]])
    first = np.flatnonzero(new)
    begin = at[first]
    return piece[begin], begin - (np.cumsum(n) - n)[piece[begin]], np.diff(np.append(first, len(at)))


def _sort_block(rows: pa.Table, length: int) -> pa.RecordBatch:
    """Repeated windows of the pieces of whole (anchor, salt) groups; of
    salted groups also the digests of the windows that stay."""
    number = {c: rows.column(c).to_numpy() for c in ("anchor", "salt", "tie", "start", "n", "at", "salts")}
    doc, unknown = rows.column("doc").fill_null(0).to_numpy(), rows.column("doc").is_null().to_numpy()
    by_place = np.lexsort((number["start"], number["tie"], doc, unknown, number["salt"], number["anchor"]))

    def changes(*columns: np.ndarray) -> np.ndarray:
        new = np.ones(len(by_place), bool)
        new[1:] = np.any([x[by_place[1:]] != x[by_place[:-1]] for x in columns], axis=0)
        return new

    # Repeated rows of one document bring their pieces twice.
    by_place = by_place[changes(number["anchor"], number["salt"], unknown, doc, number["tie"], number["start"])]
    group = np.cumsum(changes(number["anchor"], number["salt"])) - 1
    texts = rows.column("bytes").to_pylist()
    raw = b"".join([texts[i] for i in by_place.tolist()])
    data = np.frombuffer(raw, np.uint8)
    n, at = number["n"][by_place].astype(np.int64), number["at"][by_place].astype(np.int64)
    base = np.cumsum(n + length - 1) - (n + length - 1)
    found = repeated_windows(data, group, base, n, at, length)
    piece, first, count = _runs(found, n)
    digests: list[bytes | None] = [None] * len(piece)
    salted = np.repeat(number["salts"][by_place] > 1, n) & ~found
    if salted.any():
        window = np.flatnonzero(salted)
        more = np.repeat(np.arange(len(n)), n)[window]
        step = window - (np.cumsum(n) - n)[more]
        digests += [hashlib.sha256(raw[i:i + length]).digest() for i in (base[more] + step).tolist()]
        piece, first, count = np.append(piece, more), np.append(first, step), np.append(count, np.ones(len(more), np.int64))
    row = by_place[piece]
    rows_ = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [rows.column("doc").combine_chunks().take(rows_), rows.column("tie").combine_chunks().take(rows_),
         pa.array((number["start"][row] + first).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(digests, pa.binary())],
        schema=_FOUND)


def _sort_blocks(length: int, block: int):
    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            a, s = batch.column("anchor").to_numpy(), batch.column("salt").to_numpy()
            cuts = np.flatnonzero((a[1:] != a[:-1]) | (s[1:] != s[:-1])) + 1
            if held and batch.num_rows:
                last = held[-1].slice(held[-1].num_rows - 1)
                if (last.column("anchor")[0].as_py(), last.column("salt")[0].as_py()) != (a[0], s[0]):
                    cuts = np.insert(cuts, 0, 0)
            # The last group of the batch may go on in the next one.
            at = 0
            for cut in cuts.tolist():
                if size + cut - at >= block:
                    yield _sort_block(pa.Table.from_batches([*held, batch.slice(at, cut - at)]), length)
                    held, size, at = [], 0, cut
            if batch.num_rows > at:
                held.append(batch.slice(at))
                size += batch.num_rows - at
        if held:
            yield _sort_block(pa.Table.from_batches(held), length)

    return run


# --- the job --------------------------------------------------------------------------

def _place() -> Column:
    return F.struct(F.col("doc").isNull().alias("unknown"), "doc", "tie", "start")


def _tie(docs: DataFrame) -> Column:
    """What tells apart different texts under one doc_id: nothing where no
    doc_id is repeated."""
    again = docs.groupBy(F.col("doc_id").cast("long").alias("doc")).count().where("count > 1").limit(1).count()
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) if again else F.lit(0).cast("long")


def _cut_pieces(length: int):
    """The bytes of the wanted pieces of each text."""
    schema = pa.schema([("anchor", pa.int64()), ("salt", pa.int64()), ("salts", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()),
                        ("start", pa.int32()), ("n", pa.int32()), ("at", pa.int32()), ("bytes", pa.binary())])

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch, "text")
            wanted = batch.column("wanted")
            rows = pc.list_parent_indices(wanted)
            flat = wanted.flatten()
            start, n = flat.field("start").to_pylist(), flat.field("n").to_pylist()
            cut = [texts[r][s:s + k + length - 1] for r, s, k in zip(rows.to_pylist(), start, n)]
            for lo in range(0, len(cut), 10_000):
                part, hi = flat.slice(lo, 10_000), lo + 10_000
                at = rows.slice(lo, 10_000)
                yield pa.RecordBatch.from_arrays(
                    [part.field("anchor"), part.field("salt"), part.field("salts"), batch.column("doc").take(at), batch.column("tie").take(at),
                     part.field("start"), part.field("n"), part.field("at"), pa.array(cut[lo:hi], pa.binary())], schema=schema)

    return run, ("anchor long, salt long, salts long, doc long, tie long, start int, n int, at int, bytes binary")


def repeats(docs: DataFrame, tie: Column, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc, tie, start, n: ``n`` windows in a row, from ``start``, that stand
    earlier in the corpus.  Written."""
    steps = Steps(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc"), tie.alias("tie"), F.col("text").cast("string").alias("text"))
    pieces = steps.write(source.mapInArrow(_emit_pieces(length, gram), _ddl(_PIECE)), "suffix-pieces")
    shared = steps.write(pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "suffix-anchors")
    together = steps.write(pieces.join(shared, "anchor"), "suffix-together")
    steps.done(pieces, shared)
    whole = ("anchor", "h1", "h2")
    firsts = steps.write(together.groupBy(*whole).agg(F.min(_place()).alias("first"), F.first("n").alias("n"), F.first("at").alias("at"),
                                                      F.count(F.lit(1)).alias("c")), "suffix-firsts")
    # Pieces equal to an earlier one.
    copied = firsts.where("c > 1").select(*whole, "first")
    later = together.join(copied, list(whole)).where(_place() != F.col("first")).select("doc", "tie", "start", "n")
    # Anchors with different pieces.
    several = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    several = steps.write(several.select("anchor", F.ceil(F.col("kinds") / block).alias("salts")), "suffix-several")
    salt = F.pmod(F.xxhash64("first"), F.col("salts"))
    wanted = firsts.join(several, "anchor").select("first.doc", "first.tie", F.struct(
        "anchor", salt.alias("salt"), "salts", F.col("first.start").alias("start"), "n", "at").alias("piece"))
    # No longer than a document has pieces.
    wanted = steps.write(wanted.groupBy("doc", "tie").agg(F.collect_list("piece").alias("wanted")), "suffix-wanted")
    same = F.col("s.doc").eqNullSafe(F.col("w.doc")) & (F.col("s.tie") == F.col("w.tie"))
    asked = source.alias("s").join(wanted.alias("w").hint("merge"), same).select("s.doc", "s.tie", "s.text", "w.wanted")
    cut, kind = _cut_pieces(length)
    dealt = asked.mapInArrow(cut, kind).repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    found = steps.write(dealt.mapInArrow(_sort_blocks(length, block), _ddl(_FOUND)), "suffix-found")
    steps.done(several, wanted)
    stayed = found.where("digest IS NOT NULL")
    earliest = steps.write(stayed.groupBy("digest").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"))
                           .where("first <> last").select("digest", "first"), "suffix-earliest")
    crossing = stayed.join(earliest, "digest").where(_place() != F.col("first")).select("doc", "tie", "start", "n")
    out = steps.write(later.unionByName(found.where("digest IS NULL").select("doc", "tie", "start", "n")).unionByName(crossing), "suffix-repeats")
    steps.done(together, firsts, found, earliest)
    return out


def spans_of(windows: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs (start, end) that windows (first, number) cover."""
    out: list[list[int]] = []
    for start, n in sorted(windows):
        end = start + n + length - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _removed(length: int):
    def run(batches):
        for batch in batches:
            kept, spans = [], []
            for text, windows in zip(text_bytes(batch, "_text"), batch.column("_windows").to_pylist()):
                gone = spans_of([(w["start"], w["n"]) for w in windows or ()], length)
                at, left = 0, []
                for a, b in gone:
                    left.append(text[at:a])
                    at = b
                kept.append(b"".join(left) + text[at:] if gone else text)
                spans.append([{"start": a, "end": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array([len(x) for x in text_bytes(batch, "_text")], pa.int64()), pa.array(kept, pa.binary()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["_row", "n_bytes", "kept", "spans"])

    return run


def cut_documents(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """``_row`` (a struct of all columns of ``docs``), n_bytes, kept (the
    remaining bytes) and spans (the removed byte runs, end exclusive)."""
    if gram > length:
        raise ValueError(f"an anchor of {gram} bytes does not fit into {length}")
    tie = _tie(docs)
    found = repeats(docs, tie, length, gram, block)
    steps = Steps(docs.sparkSession)
    # No longer than the document.
    listed = steps.write(found.groupBy(F.col("doc").alias("_doc"), F.col("tie").alias("_tie")).agg(
        F.collect_set(F.struct("start", "n")).alias("_windows")), "suffix-cuts")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), tie.alias("_own"),
        F.col("text").cast("string").alias("_text"))
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_tie"))
    kind = rows.schema["_row"].dataType.simpleString()
    return rows.join(listed.hint("merge"), same, "left").select("_row", "_text", "_windows").mapInArrow(
        _removed(length), f"_row {kind}, n_bytes long, kept binary, spans array<struct<start: long, end: long>>")


def removal_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    cut = cut_documents(docs.select("doc_id", "text"), length)
    return cut.select(
        F.col("_row.doc_id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, with the columns they came with, without the repeated
    strings.  A character that loses some of its bytes goes whole."""
    cut = cut_documents(docs, length)
    text = F.when(F.col("_row.text").isNotNull(), F.col("_text"))

    def decoded(batches):
        for batch in batches:
            texts = [x.decode("utf-8", "ignore") for x in batch.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], names=["_row", "_text"])

    kind = cut.schema["_row"].dataType.simpleString()
    return cut.select("_row", "kept").mapInArrow(decoded, f"_row {kind}, _text string").select(
        *[text.alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
