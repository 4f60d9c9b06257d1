"""Line deduplication by winnowing over line hashes.

A line is what stands between line feeds; lines are compared after trimming
blanks and lower-casing A-Z, and blank lines are no lines.  A document's
grams of ``gram`` line hashes are winnowed: of each ``window`` grams in a row
the smallest (the last of equals) is selected.  Any run of
``gram + window - 1`` lines that stands in two places has the same selected
fingerprint in both, so joining the positions of equal fingerprints misses no
such run.  Each position in a fingerprint that occurs more than once is
extended to both sides: the runs of the guaranteed length around it are
compared whole (128-bit hashes of their lines).  The first place of a run, by
doc_id and position, stays; the lines of each later place are deleted.
Longer matches are the union of the runs that overlap in them.

With ``long_words``, a line of more than so many blank-separated words is a
run of its own: it is fingerprinted and matched alone, whatever stands beside
it, also in a document of one line.

Positions meet only in grouped minima, never in pairs, so a boilerplate line
that a third of all documents share costs one row per place.

Defined results: a null text stays null; a document of fewer lines than the
guaranteed length keeps all but its long ones; rows without an identifier come last; rows
equal in doc_id and text share one decision; deleting all lines leaves the
empty text (or the blank lines); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendero.llm.common import batches_of, materialise, packed, text_bytes

GRAM = 1
WINDOW = 2
# Lines of more words than this match alone.
LONG_WORDS = 20
_HASH = 16
_BLANK = b" \t\n\r\x0b\x0c"

_PRINT = pa.schema([("fp", pa.binary()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("start", pa.int64()),
                    ("back", pa.int32()), ("around", pa.binary())])
_RUN = pa.schema([("run", pa.binary()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("start", pa.int64()),
                  ("lines", pa.int32())])


def full_lines(text: bytes) -> list[bytes]:
    lines = (line.strip(_BLANK) for line in text.split(b"\n"))
    return [line.lower() for line in lines if line]


def line_hashes(text: bytes) -> list[bytes]:
    return [xxhash.xxh3_128_digest(line) for line in full_lines(text)]


def winnow(hashes: list[bytes], gram: int, window: int) -> list[int]:
    """Positions of the selected grams."""
    grams = [b"".join(hashes[i:i + gram]) for i in range(len(hashes) - gram + 1)]
    chosen, last = [], -1
    for i in range(len(grams) - window + 1):
        if last < i:  # the former minimum left the window
            last = min(range(i + window - 1, i - 1, -1), key=grams.__getitem__)
            chosen.append(last)
        elif grams[i + window - 1] <= grams[last]:
            last = i + window - 1
            chosen.append(last)
    return chosen


def _prints(gram: int, window: int, long_words: int | None):
    alone = long_words is not None and gram + window > 2  # else every line matches alone

    def run(batches):
        def rows():
            for batch in batches:
                for doc, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch)):
                    lines = full_lines(text)
                    hashes = [xxhash.xxh3_128_digest(line) for line in lines]
                    digest = hashlib.md5(text).digest()
                    for at in winnow(hashes, gram, window):
                        first = max(0, at - window + 1)
                        around = b"".join(hashes[first:at + gram + window - 1])
                        yield xxhash.xxh3_128_digest(b"".join(hashes[at:at + gram])), doc, digest, at, at - first, around
                    for at, line in enumerate(lines if alone else ()):
                        if len(line.split(None, long_words)) > long_words:
                            # Not the fingerprint of a gram, so a place meets itself nowhere.
                            yield xxhash.xxh3_128_digest(b"alone" + hashes[at]), doc, digest, at, 0, hashes[at]

        yield from batches_of(rows(), _PRINT)

    return run


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, long_words: int | None = LONG_WORDS) -> DataFrame:
    """Selected fingerprints with their places and the line hashes around; long
    lines by themselves."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _prints(gram, window, long_words), "fp binary, doc_id long, digest binary, start long, back int, around binary")


def _extend(length: int):
    def run(batches):
        def rows():
            for batch in batches:
                for doc, digest, start, back, around in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "start", "back", "around"))):
                    lines = min(length, len(around) // _HASH)  # 1: a long line alone
                    for at in range(len(around) // _HASH - lines + 1):
                        run_ = around[at * _HASH:(at + lines) * _HASH]
                        yield xxhash.xxh3_128_digest(run_), doc, digest, start - back + at, lines

        yield from batches_of(rows(), _RUN)

    return run


def repeated_runs(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, long_words: int | None = LONG_WORDS) -> DataFrame:
    """doc_id, digest, start, lines: the later places of repeated runs, each
    ``gram + window - 1`` lines, or one long line, from ``start`` (counted
    without blank lines)."""
    prints = materialise(fingerprints(docs, gram, window, long_words), "line-prints")
    shared = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("places")).where("places > 1").select("fp")
    # Written, so that adaptive execution can split the join at a hot line: it
    # can't where a side comes straight from an aggregation.
    shared = materialise(shared, "line-shared")
    runs = prints.join(shared, "fp").mapInArrow(
        _extend(gram + window - 1), "run binary, doc_id long, digest binary, start long, lines int")
    runs = materialise(runs, "line-runs")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "start")
    firsts = runs.groupBy("run").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    firsts = materialise(firsts.select("run", "first"), "line-firsts")
    return runs.join(firsts, "run").where(place != F.col("first")).select("doc_id", "digest", "start", "lines")


def cut_lines(text: str | None, starts: list[int], length: int, alone: list[int] = ()) -> tuple[str | None, int, int]:
    """The text without the runs of ``length`` lines that begin at ``starts``
    and the lines at ``alone``; its number of lines; the number deleted."""
    gone = {s + k for s in starts for k in range(length)}.union(alone)
    kept, at = [], 0
    for line in (text or "").split("\n"):
        blank = not line.strip(_BLANK.decode())
        if blank or at not in gone:
            kept.append(line)
        at += not blank
    return "\n".join(kept) if gone else text, at, len(gone)


def _cut(length: int):
    def run(batches):
        for batch in batches:
            starts = [x or [] for x in batch.column("_starts").to_pylist()]
            alone = [x or [] for x in batch.column("_alone").to_pylist()]
            rows = [cut_lines(t, s, length, a) for t, s, a in zip(batch.column("_text").to_pylist(), starts, alone)]
            text, lines, removed = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(text, pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(starts, pa.list_(pa.int64()))], names=["_row", "text", "n_lines", "n_removed", "starts"])

    return run


def cut_documents(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, long_words: int | None = LONG_WORDS) -> DataFrame:
    """``_row`` (a struct of all columns of ``docs``), text without the deleted
    lines, n_lines, n_removed, and the starts of the deleted runs (without the
    long lines that match alone)."""
    length = gram + window - 1
    # Lists per document, no longer than the document has lines.
    listed = [F.sort_array(F.collect_set(F.when(kind, F.col("start")))).alias(name)
              for name, kind in (("_starts", F.col("lines") == length), ("_alone", F.col("lines") < length))]
    cuts = repeated_runs(docs, gram, window, long_words).groupBy("doc_id", "digest").agg(*listed)
    cuts = materialise(cuts.select(F.col("doc_id").alias("_doc"), F.lower(F.hex("digest")).alias("_digest"), "_starts", "_alone"), "line-cuts")
    rows = packed(docs)
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.md5(F.coalesce("_text", F.lit(""))) == F.col("_digest"))
    kind = rows.schema["_row"].dataType.simpleString()
    # The list of cuts grows with the corpus: joined by shuffle at every size.
    return rows.join(cuts.hint("merge"), same, "left").select("_row", "_text", "_starts", "_alone").mapInArrow(
        _cut(length), f"_row {kind}, text string, n_lines long, n_removed long, starts array<long>")


def line_dedup(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, long_words: int | None = LONG_WORDS) -> DataFrame:
    """The documents, with the columns they came with, without the later
    places of repeated runs of lines and of long lines."""
    cut = cut_documents(docs, gram, window, long_words)
    return cut.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
