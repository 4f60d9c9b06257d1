"""Helpers shared by the operators of this subpackage.

Rows: an operator reads the columns it names and nothing else, so further
columns of any name pass by.  A null text counts as the empty text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sendero.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# What stands between words: the ASCII characters that are neither digits nor
# letters (lower-case ones: the text is lower-cased first).
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same words in text whose letters still have either case.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Blank-separated words.
TOKEN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def words_of(col: Column) -> Column:
    """The words of a text whose A-Z are lower-case already."""
    return F.array_remove(F.split(col, NOT_WORD), "")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared folder (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends
    there, lost executors cost nothing, and the planner knows its size."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame) -> DataFrame:
    """``_row`` (a struct of all columns, whatever their names), ``_id`` and
    ``_text``; ``_row.*`` gives the documents back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column, nulls as the empty text."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def batches_of(rows: Iterator[tuple], schema: pa.Schema, every: int = 10_000, bound: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of at most ``every`` rows and about ``bound`` bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str, list)))
        if len(held) >= every or size >= bound:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
