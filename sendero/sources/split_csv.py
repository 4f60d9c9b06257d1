"""CSV records of files that are read in many splits.

Cells in quotes may hold line breaks, so a split can begin inside a cell.  A
first pass reads every split under both assumptions, outside and inside a
quoted cell, and keeps only where each one ends: one row a split.  From these
the state at the start of every split follows.  A second pass cuts records; of
a record that crosses splits each split gives its part, and the parts are put
together afterwards.  Lines are read as bytes, so the encoding is ours.

Defined results: a quote counts only as the first character of a cell, and
inside a quoted one (doubled: itself), as for the ``csv`` module; a carriage
return before the line break that ends a record is dropped, one inside quotes
stays; blank records are dropped; a quoted cell still open at the end of a file
ends there; an empty file has no records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sendero.session import drop_written, ship_package, write_once

# Beyond so many splits their states are joined by a shuffle.
BROADCAST_SPLITS = 100_000
# Lines of one split that the order of rows leaves room for.
_SPLIT_LINES = 1 << 36

_QUOTED = rb'[^"]*+(?:""[^"]*+)*+'
_OPENS = re.compile(rb'(?:(?:"' + _QUOTED + rb'"[^,]*+|[^",][^,]*+|),)*+"' + _QUOTED + rb"\Z")
_CLOSES = re.compile(_QUOTED + rb'"[^,]*+,?')

_WHOLE, _OPENING, _MIDDLE, _CLOSING = range(4)
_ENDS = "file string, start long, outside boolean, inside boolean"
_PARTS = "split long, line long, kind int, bytes binary"


def after(line: bytes, inside: bool) -> bool:
    """Is the end of the line inside a quoted cell, if its start is (is not)?"""
    if inside:
        closed = _CLOSES.match(line)
        if not closed:
            return True
        return closed.group().endswith(b",") and bool(_OPENS.match(line, closed.end()))
    return bool(_OPENS.match(line))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                      F.col("value").cast("binary").alias("line"))


def _with_quotes(lines: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))


def _runs(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of a batch with equal values in the columns."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    for c in columns:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    bounds = [0, *np.flatnonzero(new).tolist(), n]
    yield from zip(bounds, bounds[1:])


def _split_ends(batches):
    """Where each split ends if it begins outside, and inside, a quoted cell."""
    current, ends = None, (False, True)

    def row():
        return pa.RecordBatch.from_pylist([{"file": current[0], "start": current[1], "outside": ends[0], "inside": ends[1]}])

    for batch in batches:
        if not batch.num_rows:
            continue
        file, start, lines = (batch.column(c) for c in ("file", "start", "line"))
        for lo, hi in _runs(file, start):
            if (here := (file[lo].as_py(), start[lo].as_py())) != current:
                if current is not None:
                    yield row()
                current, ends = here, (False, True)
            part = lines.slice(lo, hi - lo)
            for i in _with_quotes(part).tolist():
                line = part[i].as_py()
                ends = (after(line, ends[0]), after(line, ends[1]))
    if current is not None:
        yield row()


def split_states(lines: DataFrame) -> DataFrame:
    """file, start, split, inside: every split's number, in the order of files
    and places, and its state at the start.  One row a split."""
    ends = lines.mapInArrow(_split_ends, _ENDS)
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("outside") & ~F.col("inside")).cast("int")
    # A split ends where it began, or the other way round, or always in the same state.
    ends = ends.withColumn("swaps", F.sum(swap).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").cast("int").alias("state"), "swaps"))
    ends = ends.select("file", "start", F.coalesce(F.sum(swap).over(before), F.lit(0)).alias("n"),
                       F.last(fixed, ignorenulls=True).over(before).alias("since"))
    state = (F.col("n") - F.coalesce(F.col("since.swaps"), F.lit(0)) + F.coalesce(F.col("since.state"), F.lit(0))) % 2
    return ends.select("file", "start", F.row_number().over(Window.orderBy("file", "start")).cast("long").alias("split"),
                       (state == 1).alias("inside"))


class _Split:
    """Cuts the lines of one split into records."""

    def __init__(self, number: int, inside: bool):
        self.number, self.inside, self.cut = number, inside, inside
        self.held: list[bytes] = []
        self.at = self.line = 0

    def take(self, lines: pa.Array) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
        """(lines, kinds, texts) of the records that end among the lines."""
        inside = np.zeros(len(lines) + 1, bool)  # at the start of each line
        last = 0
        state = self.inside
        for i in _with_quotes(lines).tolist():
            inside[last:i + 1] = state
            state, last = after(lines[i].as_py(), state), i + 1
        inside[last:] = state
        values = lines.to_pylist()
        out = ([], [], [])
        begin = 0
        for end in (np.flatnonzero(~inside[1:]) + 1).tolist():
            if self.held or self.cut or end - begin > 1:
                text = b"\n".join([*self.held, *values[begin:end]])
            else:
                text = values[begin]
            out[0].append(self.at if self.held else self.line + begin)
            out[1].append(_CLOSING if self.cut else _WHOLE)
            out[2].append(text)
            self.held, self.cut, begin = [], False, end
        if begin < len(values):
            if not self.held:
                self.at = self.line + begin
            self.held += values[begin:]
        self.inside, self.line = state, self.line + len(values)
        return out

    def rest(self) -> tuple[list[int], list[int], list[bytes]]:
        """The record that goes on in the next split."""
        if not self.held:
            return [], [], []
        return [self.at], [_MIDDLE if self.cut else _OPENING], [b"\n".join(self.held)]


def _cut(batches):
    split: _Split | None = None

    def rows(columns):
        at, kinds, texts = columns
        return pa.RecordBatch.from_arrays([pa.array([split.number] * len(at), pa.int64()), pa.array(at, pa.int64()),
                                           pa.array(kinds, pa.int32()), pa.array(texts, pa.binary())], ["split", "line", "kind", "bytes"])

    for batch in batches:
        if not batch.num_rows:
            continue
        number, inside, lines = (batch.column(c) for c in ("split", "inside", "line"))
        for lo, hi in _runs(number):
            if split is None or number[lo].as_py() != split.number:
                if split is not None:
                    yield rows(split.rest())
                split = _Split(number[lo].as_py(), inside[lo].as_py())
            yield rows(split.take(lines.slice(lo, hi - lo)))
    if split is not None:
        yield rows(split.rest())


def csv_records(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", broadcast_splits: int = BROADCAST_SPLITS) -> DataFrame:
    """row_order, first (is it the first record of its file), record.  Written,
    so that both passes are done and consumers read the records."""
    ship_package(spark)
    # Both passes must split the files alike, also if executors come or go.
    fixed = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(fixed, None)
    spark.conf.set(fixed, before or str(spark.sparkContext.defaultParallelism))
    try:
        lines = _lines(spark, path)
        states = write_once(split_states(lines), "csv-splits")
        if states.count() <= broadcast_splits:
            held = lines.join(F.broadcast(states), ["file", "start"], "left")
        else:
            held = lines.withColumn("n", F.monotonically_increasing_id()).join(states.hint("shuffle_hash"), ["file", "start"], "left")
            held = held.repartition("file", "start").sortWithinPartitions("file", "start", "n")
        known = F.coalesce("split", F.raise_error(F.lit("a split that the first pass has not seen")).cast("long"))
        parts = write_once(held.select(known.alias("split"), "inside", "line").mapInArrow(_cut, _PARTS), "csv-parts")
    finally:
        spark.conf.unset(fixed) if before is None else spark.conf.set(fixed, before)
    whole = parts.where(F.col("kind") == _WHOLE).select("split", "line", "bytes")
    # Parts of records across splits: at most two a split.
    crossing = parts.where(F.col("kind") != _WHOLE).join(states.select("split", "file"), "split")
    number = F.sum((F.col("kind") == _OPENING).cast("int")).over(Window.partitionBy("file").orderBy("split", "line"))
    joined = crossing.withColumn("record", number).groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("split", "line", "bytes"))).alias("p"))
    joined = joined.select(F.col("p")[0]["split"].alias("split"), F.col("p")[0]["line"].alias("line"), F.expr(
        "aggregate(slice(p, 2, size(p)), p[0].bytes, (acc, x) -> concat(acc, X'0A', x.bytes))").alias("bytes"))
    text = F.regexp_replace(F.decode("bytes", encoding), r"\r\z", "")
    firsts = states.groupBy("file").agg(F.min("split").alias("split")).select("split", F.lit(True).alias("top"))
    out = whole.unionByName(joined).join(firsts, "split", "left").select(
        (F.col("split") * _SPLIT_LINES + F.col("line")).alias("row_order"),
        (F.col("top").isNotNull() & (F.col("line") == 0)).alias("first"), text.alias("record"))
    done = write_once(out.where(F.trim("record") != ""), "csv-records")
    drop_written(parts)
    drop_written(states)
    return done
