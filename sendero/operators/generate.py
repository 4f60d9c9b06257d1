"""Batch generation and response handling.

Generation runs the caller's callable over Arrow batches of the prompt table
with ``mapInPandas`` (the only Python step of the pipeline).  Responses are
parsed with ``from_json`` against the fixed answer contract; every response
gets a status, accepted lists are capped to N and exploded, the others go to
a rejected output with the reason.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendero.functions import fixed
from sendero.session import ship_package

Generator = Callable[[pd.DataFrame], list[str]]

CONTRACTS = {
    "direct": (fixed.DIRECT_RESPONSE_LIST, fixed.DIRECT_RESPONSE_FIELDS),
    "inverse": (fixed.INVERSE_RESPONSE_LIST, fixed.INVERSE_RESPONSE_FIELDS),
}


def response_schema(kind: str) -> str:
    name, fields = CONTRACTS[kind]
    return f"{name} array<struct<{', '.join(f'{f}: string' for f in fields)}>>"


def answer_rows(generator: Generator, pdf: pd.DataFrame) -> tuple[list, list]:
    """(answers, errors) of a batch: where the call fails, its rows are
    called one by one."""

    def one(row: pd.DataFrame):
        try:
            return list(generator(row))[0], None
        except Exception as failed:  # noqa: BLE001
            return None, f"{type(failed).__name__}: {failed}"

    try:
        return list(generator(pdf)), [None] * len(pdf)
    except Exception:  # noqa: BLE001  whatever the caller's client raises
        rows = [one(pdf.iloc[i:i + 1]) for i in range(len(pdf))]
        return [r for r, _ in rows], [e for _, e in rows]


def generate(prompts: DataFrame, key: str, generator: Generator) -> DataFrame:
    """M3: (key, modelo_usado, respuesta, error) for every prompt row.

    ``generator`` receives a pandas batch with the prompt table's columns
    (prompt, modelo_usado, opciones, candidates_json, ...) and returns one response
    text per row; it is supplied by the caller (a model client, a service
    call, or the deterministic stub below).  If the call for a batch fails,
    its rows are called one by one; a row that fails alone has no answer but
    the error's text, and the others are not lost with it."""

    ship_package(prompts.sparkSession)

    def run(batches):
        for pdf in batches:
            out, errors = answer_rows(generator, pdf)
            yield pd.DataFrame({key: pdf[key], "modelo_usado": pdf["modelo_usado"], "respuesta": out, "error": errors})

    return prompts.mapInPandas(run, f"`{key}` string, modelo_usado string, respuesta string, error string")


# Our texts for the deterministic stand-in generator.
STUB_DIRECT_REASON = "Candidato recuperado en la posición {pos}."
STUB_INVERSE_REASON = "Usuario recuperado en la posición {pos}."


def stub_generator(kind: str, top_n: int = fixed.TOP_N) -> Generator:
    """Deterministic stand-in for a model: answers with the first top_n
    candidates of the prompt, in the answer contract of ``kind``; the
    affinity of item i of n picked is level min(2, 3 i / n)."""
    name, fields = CONTRACTS[kind]
    levels = fixed.AFFINITY_LEVELS

    def answer(cands: list[dict]) -> str:
        picked = cands[:top_n]
        items = []
        for i, c in enumerate(picked):
            item = {f: c.get(f) for f in fields if f in c}
            if kind == "direct":
                item["nivel_afinidad"] = levels[min(2, i * 3 // max(1, len(picked)))]
                item["justificacion"] = STUB_DIRECT_REASON.format(pos=i + 1)
            else:
                item["justificacion_target"] = STUB_INVERSE_REASON.format(pos=i + 1)
            items.append(item)
        return json.dumps({name: items}, ensure_ascii=False)

    def run(pdf: pd.DataFrame) -> list[str]:
        return [answer(json.loads(s)) for s in pdf["candidates_json"]]

    return run


def parse_responses(responses: DataFrame, key: str, kind: str, top_n: int = fixed.TOP_N):
    """M4/M5: (accepted items, rejected responses).

    status: ``json_invalido`` (not JSON), ``sin_lista`` (list missing or of
    the wrong type), ``lista_vacia``, ``sin_respuesta`` (the call failed) or
    ``ok``.  Accepted lists are capped to ``top_n`` items (D10); the items
    beyond are in the rejected output as ``excedente``."""
    name, fields = CONTRACTS[kind]
    parsed = F.from_json(F.col("respuesta"), response_schema(kind))
    lst = parsed[name]
    status = (
        F.when(F.col("respuesta").isNull(), F.lit("sin_respuesta"))
        .when(F.get_json_object(F.col("respuesta"), "$").isNull(), F.lit("json_invalido"))
        .when(lst.isNull(), F.lit("sin_lista"))
        .when(F.size(lst) == 0, F.lit("lista_vacia"))
        .otherwise(F.lit("ok"))
    )
    tagged = responses.select(key, "modelo_usado", "respuesta", status.alias("estado"), lst.alias("lst"))
    accepted = tagged.where(F.col("estado") == "ok").select(
        key, "modelo_usado", F.posexplode(F.slice(F.col("lst"), 1, top_n)).alias("pos", "item")
    ).select(key, "modelo_usado", (F.col("pos") + 1).alias("posicion"), *[F.col(f"item.{f}").alias(f) for f in fields])
    rejected = tagged.where(F.col("estado") != "ok").select(key, "modelo_usado", "estado", "respuesta")
    surplus = tagged.where((F.col("estado") == "ok") & (F.size("lst") > top_n)).select(
        key, "modelo_usado", F.lit("excedente").alias("estado"),
        F.to_json(F.slice("lst", top_n + 1, F.size("lst"))).alias("respuesta"))
    return accepted, rejected.unionByName(surplus)


def grounded(items: DataFrame, candidates: DataFrame, key: str, item_col: str) -> DataFrame:
    """Flag each parsed item whose named item is among its candidates."""
    c = candidates.select(key, F.col(item_col).alias("_c")).distinct().withColumn("_hit", F.lit(1))
    j = items.join(c, (items[key] == c[key]) & (items[item_col] == c["_c"]), "left")
    return j.select(items["*"], F.coalesce(F.col("_hit"), F.lit(0)).alias("en_candidatos"))


def envelopes(direction: str, key: str, subjects: DataFrame, candidates: DataFrame, answers: DataFrame, message: str) -> DataFrame:
    """One row per subject (key, contexto): its candidates as JSON
    (n_candidatos, candidates_json) and its answer (modelo_usado, respuesta),
    or, where there are no candidates, nulls and the message."""
    rows = subjects.select(key, "contexto").join(candidates, key, "left").join(answers.select(key, "modelo_usado", "respuesta"), key, "left")
    return rows.select(
        F.lit(direction).alias("direccion"), F.col(key).alias("sujeto"),
        F.coalesce("modelo_usado", F.lit(fixed.DEFAULT_GENERATOR)).alias("modelo_usado"), F.col("contexto").alias("contexto_usado"),
        F.coalesce("n_candidatos", F.lit(0)).alias("n_candidatos"), F.col("candidates_json").alias("candidatos_json"),
        F.col("respuesta").alias("resultado_json"), F.when(F.col("n_candidatos").isNull(), F.lit(message)).alias("mensaje"))


def responses_from_baseline(baseline: DataFrame, key: str, kind: str) -> DataFrame:
    """A deterministic, JVM-side responder for offline evaluation: each
    subject's answer is its baseline list written in the answer contract."""
    name, fields = CONTRACTS[kind]
    entry = F.struct(F.col("rank"), F.struct(*[F.col(f) for f in fields]).alias("c"))
    folded = baseline.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("l"))
    body = F.struct(F.transform("l", lambda x: x["c"]).alias(name))
    return folded.select(key, F.lit(fixed.DEFAULT_GENERATOR).alias("modelo_usado"),
                         F.to_json(body, {"ignoreNullFields": "false"}).alias("respuesta"))
