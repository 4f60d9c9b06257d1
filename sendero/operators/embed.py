"""Text -> vector steps (V1).  An embedder maps a DataFrame with an id and a
text column to (id, embedding array<double>).

* ``HashedTokenEmbedder`` - bag of hashed tokens: tokens are ``split(lower(text), ' ')``, each token goes to bucket
  ``md5[0:8] mod dim`` and the vector holds token counts.  Integer counts make
  every later dot product exact, so results are reproducible anywhere.
* ``TableEmbedder`` - join to a precomputed vector table.
* ``PandasEmbedder`` - a caller-supplied batch function run with
  ``mapInPandas`` (e.g. a local model).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sendero.session import ship_package


def token_bucket(token: Column, dim: int) -> Column:
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % dim


def tokens(text: Column) -> Column:
    return F.split(F.lower(text), " ")


def _bucket_counts(dim: int):
    """Counts by ``token_bucket`` of the tokens of each row's lower-case text,
    as rows of ``dim`` doubles; a batch's distinct tokens are hashed once."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.columns
            words = pc.split_pattern(texts, " ")
            sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
            coded = words.flatten().dictionary_encode()
            buckets = np.array([int(md5(t).hexdigest()[:8], 16) % dim for t in coded.dictionary.cast(pa.binary()).to_pylist()], dtype=np.int64)
            cells = np.repeat(np.arange(len(words)), sizes) * dim + buckets[coded.indices.to_numpy()]
            counts = np.bincount(cells, minlength=len(words) * dim).astype(np.float64)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * dim), pa.array(counts))
            yield pa.RecordBatch.from_arrays([ids, vectors], names=[batch.schema.names[0], "embedding"])

    return run


@dataclass(frozen=True)
class HashedTokenEmbedder:
    dim: int = 64

    def __call__(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, vector), inside the row: no shuffle.  A batch's ``tokens`` are
        hashed and counted by one ``bincount``."""
        rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.lower(F.col(text_col)).alias("_text"))
        kind = rows.schema[id_col].dataType.simpleString()
        return rows.mapInArrow(_bucket_counts(self.dim), f"`{id_col}` {kind}, embedding array<double>")

    def sparse(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, bucket, count) rows of the non-empty buckets."""
        rows = self(df, id_col, text_col).select(id_col, F.posexplode("embedding").alias("bucket", "n"))
        return rows.where("n > 0").select(id_col, F.col("bucket").cast("long").alias("bucket"), F.col("n").cast("long").alias("n"))


@dataclass(frozen=True)
class TableEmbedder:
    """Vectors looked up in ``vectors`` (key_col, embedding) by a key column
    of the input; rows without a vector are dropped (inner join)."""

    vectors: DataFrame
    key_col: str

    def __call__(self, df: DataFrame, id_col: str, text_col: str | None = None) -> DataFrame:
        v = self.vectors.select(F.col(self.key_col), F.col("embedding").cast("array<double>").alias("embedding"))
        return df.select(id_col, self.key_col).join(v, self.key_col).select(id_col, "embedding")


@dataclass(frozen=True)
class PandasEmbedder:
    """``fn(list[str]) -> list[list[float]]`` applied per Arrow batch."""

    fn: Callable[[list[str]], list[list[float]]]

    def __call__(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        ship_package(df.sparkSession)
        fn = self.fn

        def run(batches):
            for pdf in batches:
                vecs = fn(pdf[text_col].fillna("").tolist())
                yield pd.DataFrame({id_col: pdf[id_col], "embedding": list(vecs)})

        return df.select(id_col, text_col).mapInPandas(run, f"`{id_col}` string, embedding array<double>")


def l2_norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equal-length vectors; null when either is a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    denom = l2_norm(a) * l2_norm(b)
    return F.when(denom > 0, dot / denom)
