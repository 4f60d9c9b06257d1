"""Intermediate tables that a run writes, reads and deletes again.

A table is written to the shared folder, so lineage ends there and a lost
executor costs nothing; the shuffle files of the job that wrote it go when it
has ended, and the table itself when its last reader has finished.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from sendero.llm.common import shared_path

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Settings of the session that hold for the jobs inside."""
    names = {"clean": _CLEAN, "rows": _ROWS}
    before = {names[k]: spark.conf.get(names[k]) for k in values}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Steps:
    """The written tables of one run."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, str] = {}
        self._tables: dict[int, str] = {}
        self._kept: list[DataFrame] = []

    def write(self, df: DataFrame, name: str, wide_rows: bool = False) -> DataFrame:
        """``wide_rows``: rows are large, so Python workers get few at a time."""
        path = shared_path(self.spark, name)
        with settings(self.spark, clean="true", **({"rows": "4"} if wide_rows else {})):
            df.write.option("compression", "zstd").parquet(path)
        return self._remember(self.spark.read.schema(df.schema).parquet(path), path)

    def write_bucketed(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """As ``write``, in buckets by ``column``: joins on it leave the table
        where it is."""
        path = shared_path(self.spark, name)
        table = path.rsplit("/", 1)[1].replace("-", "_")
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with settings(self.spark, clean="true"):
            df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(table)
        back = self._remember(self.spark.table(table), path)
        self._tables[id(back)] = table
        return back

    def _remember(self, back: DataFrame, path: str) -> DataFrame:
        self._paths[id(back)] = path
        self._kept.append(back)
        return back

    def done(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for df in tables:
            if id(df) in self._tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(id(df))}")
            path = jvm.org.apache.hadoop.fs.Path(self._paths.pop(id(df)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
