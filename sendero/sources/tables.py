"""Readers for the parquet tables of a scale-factor folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one base table.  Projection and filters written on the result are
    pushed into the parquet scan by the optimizer."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
