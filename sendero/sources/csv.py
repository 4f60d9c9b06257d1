"""CSV scans of the two inputs (header row, Latin-1 text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sendero.operators.clean import ROW_ORDER
from sendero.sources.schemas import INTERACTION_COLUMNS, PROFILE_COLUMNS
from sendero.sources.split_csv import csv_records

# --- fixed values: cells read as missing (the default missing-value words of
# pandas' CSV reader, which the reference uses); matched exactly. ---
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def null_tokens(df: DataFrame) -> DataFrame:
    """Missing-value words in text columns become nulls (one projection)."""
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if field.dataType.simpleString() == "string":
            c = F.when(c.isin(NULL_TOKENS), F.lit(None)).otherwise(c)
        out.append(c.alias(field.name))
    return df.select(*out)


_OPTIONS = {"header": "true", "encoding": "ISO-8859-1", "mode": "PERMISSIVE", "multiLine": "true", "escape": '"'}


def _read(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Quoted cells may hold line breaks and doubled quotes.  Files are read in
    splits (``split_csv``); only their header goes through Spark's reader."""
    header = spark.read.options(**_OPTIONS).csv(path).columns
    records = csv_records(spark, path).where(~F.col("first"))
    cells = ", ".join(f"c{i} string" for i in range(len(header)))
    cells = F.from_csv("record", cells, {k: v for k, v in _OPTIONS.items() if k != "header"})
    raw = records.select("row_order", cells.alias("r")).select("row_order", *[F.col(f"r.c{i}") for i in range(len(header))])
    raw = raw.toDF("row_order", *[c.strip() for c in header])
    # Declared columns absent from the file are added as nulls; every column is
    # read as text and typed by the cleaning step.
    rows = raw.select(*[(F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in columns],
                      F.col("row_order").alias(ROW_ORDER))
    return null_tokens(rows)


def read_profiles_csv(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, PROFILE_COLUMNS)


def read_interactions_csv(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, INTERACTION_COLUMNS)
