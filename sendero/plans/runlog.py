"""Per-stage run times (M11): each stage is one Spark action over the whole
input, timed on the driver and kept as a small run-log table."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_fully(df: DataFrame) -> None:
    """Execute a plan to the end without collecting (no-op sink)."""
    df.write.format("noop").mode("overwrite").save()


class RunLog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.rows: list[tuple[str, str, float]] = []

    def time(self, stage: str, model: str, action) -> float:
        t0 = time.perf_counter()
        action()
        dt = round(time.perf_counter() - t0, 3)
        self.rows.append((stage, model, dt))
        return dt

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, "etapa string, modelo_usado string, segundos double")

    def summary(self) -> DataFrame:
        t = self.table()
        total = t.groupBy("modelo_usado").agg(F.sum("segundos").alias("segundos")).withColumn("etapa", F.lit("total"))
        return t.unionByName(total).groupBy("modelo_usado", "etapa").agg(
            F.count(F.lit(1)).alias("ejecuciones"),
            F.round(F.avg("segundos"), 3).alias("media_s"),
            F.round(F.max("segundos"), 3).alias("max_s"),
        )
