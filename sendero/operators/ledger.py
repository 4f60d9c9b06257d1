"""A ledger of generated answers (M3, M11, E12, E25): each prompt is asked once.

An answer is stored under the hash of prompt, model and options.  Prompts
whose answer is there aren't sent again, equal prompts are sent once, and both
outputs of the parser read what is stored.
"""

from __future__ import annotations

import hashlib
import time

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sendero.operators.generate import Generator, answer_rows
from sendero.session import drop_written, ship_package, write_once

ASKED = ("prompt", "modelo_usado", "opciones")
SCHEMA = "clave string, modelo_usado string, opciones string, respuesta string, error string, segundos double, filas_llamada long"
# Prompts in a task, on average: what a lost task asks again at most.
TASK_PROMPTS = 256
# Tasks in a job, beyond which tasks get larger.
MAX_TASKS = 100_000


def answer_key() -> Column:
    """Hash of what is asked; a null counts as a value of its own."""
    return F.sha2(F.to_json(F.struct(*ASKED)), 256)


class AnswerLedger:
    """A folder of Parquet files, one of each task that has finished.

    A task's answers count from the moment it commits, also where its job
    fails later (the committer moves a task's file when the task is done, not
    when the job is).  So an executor or a driver lost midway costs at most the
    calls of the tasks it was running.  Rows without an answer (the call failed)
    are kept with their error and asked again by the next run.  Of two answers
    to one key (a task lost after its commit, two drivers at once) every reader
    takes the same one.  Run it without speculation: a copy of a task calls, too."""

    def __init__(self, spark: SparkSession, path: str, task_prompts: int = TASK_PROMPTS):
        self.spark = spark
        self.path = path.rstrip("/")
        self.task_prompts = task_prompts
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        root.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(root)

    def calls(self) -> DataFrame:
        """All stored rows, those of failed calls included."""
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)

    def _answered(self) -> DataFrame:
        return self.calls().where(F.col("respuesta").isNotNull())

    def missing(self, prompts: DataFrame) -> DataFrame:
        """The distinct prompts without an answer, with their ``clave``."""
        keyed = prompts.withColumn("clave", answer_key())
        return keyed.join(self._answered().select("clave"), "clave", "left_anti").dropDuplicates(["clave"])

    def ask(self, prompts: DataFrame, generator: Generator) -> int:
        """Send what has no answer yet; the number of prompts sent.  The
        generator gets pandas batches with the columns of ``prompts`` and may
        depend on prompt, model and options alone."""
        ship_package(self.spark)
        todo = write_once(self.missing(prompts), "prompts")
        try:
            n = todo.count()
            if n:
                tasks = min(-(-n // self.task_prompts), MAX_TASKS)
                (todo.repartition(tasks, "clave").mapInPandas(_caller(generator), SCHEMA).write.mode("append")
                 .option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(self.path))
            return n
        finally:
            drop_written(todo)

    def answers(self, prompts: DataFrame, key: str) -> DataFrame:
        """(key, modelo_usado, opciones, respuesta, error, segundos) for every
        prompt row, from what is stored; nulls where nothing is."""
        keyed = prompts.select(key, "modelo_usado", "opciones", answer_key().alias("clave"))
        wanted = self.calls().join(keyed.select("clave").distinct(), "clave", "left_semi")
        # An answer before an error, then the smallest: the same for everybody.
        picked = wanted.groupBy("clave").agg(
            F.min(F.struct(F.col("respuesta").isNull().alias("sin"), "respuesta", "error", "segundos")).alias("r"))
        return keyed.join(picked, "clave", "left").select(
            key, "modelo_usado", "opciones", "r.respuesta", "r.error", "r.segundos")

    def run(self, prompts: DataFrame, key: str, generator: Generator) -> DataFrame:
        """``ask``, then ``answers``."""
        self.ask(prompts, generator)
        return self.answers(prompts, key)

    def delete(self) -> None:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        root.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(root, True)

    def latency(self) -> DataFrame:
        """Measured time of the calls by model and options.
        ``segundos`` of a row is its share of the call that answered it."""
        return self.calls().groupBy("modelo_usado", "opciones").agg(
            F.count(F.lit(1)).alias("prompts"),
            F.count(F.when(F.col("respuesta").isNull(), 1)).alias("sin_respuesta"),
            F.round(F.avg("segundos"), 4).alias("media_s"),
            F.round(F.percentile("segundos", 0.95), 4).alias("p95_s"),
            F.round(F.max("segundos"), 4).alias("max_s"))


def literal_generator(responses: list[str]) -> Generator:
    """A deterministic stand-in that answers with one of sixteen given texts,
    by the first hex digit of the MD5 of prompt, line break and options."""

    def run(pdf: pd.DataFrame) -> list[str]:
        asked = (pdf["prompt"] + "\n" + pdf["opciones"]).map(lambda t: hashlib.md5(t.encode("utf-8")).hexdigest())
        return [responses[int(h[0], 16)] for h in asked]

    return run


def _caller(generator: Generator):
    def run(batches):
        for pdf in batches:
            begun = time.perf_counter()
            out, errors = answer_rows(generator, pdf)
            spent = (time.perf_counter() - begun) / max(len(pdf), 1)
            yield pd.DataFrame({"clave": pdf["clave"], "modelo_usado": pdf["modelo_usado"], "opciones": pdf["opciones"],
                                "respuesta": out, "error": errors, "segundos": spent, "filas_llamada": len(pdf)})

    return run


def sweep_options(prompts: DataFrame, options: list[str]) -> DataFrame:
    """Every prompt once for each sampling option (a JSON text), a
    fixed list, so a column to explode and no join."""
    return prompts.withColumn("opciones", F.explode(F.array(*[F.lit(o) for o in options])))


def validity_by_option(answers: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """Answers and well-formed ones by model and sampling option;
    ``answers`` and ``rejected`` are keyed by ``key``, one row an answer."""
    bad = rejected.where("estado <> 'excedente'").select(key, F.lit(1).alias("_bad"))
    surplus = rejected.where("estado = 'excedente'").select(key, F.lit(1).alias("_more"))
    return answers.join(bad, key, "left").join(surplus, key, "left").groupBy("modelo_usado", "opciones").agg(
        F.count(F.lit(1)).alias("respuestas"),
        F.count(F.when(F.col("_bad").isNull(), 1)).alias("validas"),
        F.count("_more").alias("con_excedente"),
        F.round(F.avg(F.col("_bad").isNull().cast("int")), 6).alias("tasa"))
