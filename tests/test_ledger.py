"""The ledger of answers: each prompt is asked once, whatever is lost."""

import os
import time
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sendero.operators import generate as G
from sendero.operators.ledger import AnswerLedger, sweep_options
from sendero.plans.registered.answers import LITERAL_ANSWERS

GOOD = LITERAL_ANSWERS[1]


def _prompts(spark, n, parts=4):
    return spark.range(n).repartition(parts).select(
        F.col("id").cast("string").alias("id_usuario"), F.lit("m").alias("modelo_usado"), F.lit("{}").alias("opciones"),
        F.concat(F.lit("p"), (F.col("id") % 30).cast("string")).alias("prompt"))


def _counting(log, fail=(), lose=None, seen=None):
    """Notes every prompt it is asked; raises for some, and ends its worker
    at ``lose`` unless the file ``seen`` is there."""

    def run(pdf: pd.DataFrame):
        if len(pdf) and (pdf["prompt"].isin(list(fail))).any():
            raise ValueError("refused")
        if lose is not None and not os.path.exists(seen) and (pdf["prompt"] == lose).any():
            time.sleep(4)  # the other tasks finish first
            open(seen, "w").close()
            os._exit(1)
        with open(log, "a") as f:
            f.write("".join(p + "\n" for p in pdf["prompt"]))
        return [GOOD] * len(pdf)

    return run


def _asked(log):
    return Counter(open(log).read().split()) if os.path.exists(log) else Counter()


def test_each_prompt_is_asked_once_over_runs_and_outputs(spark, tmp_path):
    ledger, log = AnswerLedger(spark, str(tmp_path / "l")), str(tmp_path / "log")
    assert ledger.ask(_prompts(spark, 50), _counting(log)) == 30  # equal prompts once
    assert ledger.ask(_prompts(spark, 100), _counting(log)) == 0
    answers = ledger.run(_prompts(spark, 100), "id_usuario", _counting(log))
    items, rejected = G.parse_responses(answers, "id_usuario", "direct", 2)
    assert items.count() == 200 and rejected.count() == 100  # the third item is beyond
    assert len(_asked(log)) == 30 and set(_asked(log).values()) == {1}
    row = ledger.latency().collect()[0]
    assert (row.prompts, row.sin_respuesta) == (30, 0) and row.max_s >= row.media_s >= 0


def test_failed_calls_keep_their_error_and_are_asked_again(spark, tmp_path):
    ledger, log = AnswerLedger(spark, str(tmp_path / "l")), str(tmp_path / "log")
    first = {r.id_usuario: r for r in ledger.run(_prompts(spark, 30), "id_usuario", _counting(log, fail={"p3"})).collect()}
    assert first["3"].respuesta is None and "refused" in first["3"].error
    assert sum(r.respuesta is not None for r in first.values()) == 29
    assert ledger.ask(_prompts(spark, 30), _counting(log)) == 1
    second = {r.id_usuario: r.respuesta for r in ledger.answers(_prompts(spark, 30), "id_usuario").collect()}
    assert set(second.values()) == {GOOD} and _asked(log)["p3"] == 1


def test_a_lost_task_costs_only_its_own_calls(spark, tmp_path):
    ledger, log, seen = AnswerLedger(spark, str(tmp_path / "l"), task_prompts=8), str(tmp_path / "log"), str(tmp_path / "seen")
    with pytest.raises(Exception):
        ledger.ask(_prompts(spark, 30), _counting(log, lose="p7", seen=seen))
    stored = {r.respuesta for r in ledger.calls().collect()}
    before, kept = _asked(log), ledger.calls().count()
    assert stored == {GOOD} and 0 < kept < 30 and kept == sum(before.values())
    assert ledger.ask(_prompts(spark, 30), _counting(log, lose="p7", seen=seen)) == 30 - kept
    assert set(_asked(log).values()) == {1} and len(_asked(log)) == 30


def test_two_answers_to_one_key_read_as_one(spark, tmp_path):
    one = AnswerLedger(spark, str(tmp_path / "l"))
    two = AnswerLedger(spark, str(tmp_path / "l"))
    stale = one.missing(_prompts(spark, 30)).toPandas()
    one.ask(_prompts(spark, 30), lambda pdf: ["b"] * len(pdf))
    two.missing = lambda prompts: spark.createDataFrame(stale)  # it looked before the first one's answers were there
    two.ask(_prompts(spark, 30), lambda pdf: ["a"] * len(pdf))
    assert one.calls().count() == 60
    rows = one.answers(_prompts(spark, 60), "id_usuario").collect()
    assert len(rows) == 60 and {r.respuesta for r in rows} == {"a"}


def test_nulls_options_and_empty_tables(spark, tmp_path):
    ledger = AnswerLedger(spark, str(tmp_path / "l"))
    assert ledger.ask(_prompts(spark, 0), lambda pdf: [GOOD] * len(pdf)) == 0
    assert ledger.answers(_prompts(spark, 3), "id_usuario").where("respuesta is null").count() == 3
    null = _prompts(spark, 2).withColumn("prompt", F.lit(None).cast("string"))
    assert ledger.ask(null, lambda pdf: [GOOD] * len(pdf)) == 1
    swept = sweep_options(_prompts(spark, 2), ["{}", '{"temperature":1}'])
    assert ledger.ask(swept, lambda pdf: [GOOD] * len(pdf)) == 4
    assert ledger.answers(swept, "id_usuario").where("respuesta is not null").count() == 4
