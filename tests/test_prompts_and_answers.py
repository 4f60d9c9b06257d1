"""Prompt assembly, template validation and answer parsing."""

import json

import pytest
from pyspark.sql import functions as F

from sendero.functions.text import render, template_variables
from sendero.operators import generate as G
from sendero.operators import prompts as PR


def test_braces_in_user_data_are_kept(spark):
    df = spark.createDataFrame([("{top_n} y {{x}}",)], "c string")
    t = "N={top_n} C={user_context} J={{\"a\": 1}}"
    got = df.select(render(t, top_n=F.lit("3"), user_context=F.col("c"))).first()[0]
    assert got == 'N=3 C={top_n} y {{x}} J={"a": 1}'


def test_template_validation():
    assert template_variables("a {top_n} {{no}} {user_context}") == {"top_n", "user_context"}
    with pytest.raises(ValueError):
        PR.validate_template("only {top_n}")
    PR.validate_template("{top_n} {user_context} {candidates_json}")
    assert PR.check_k_n(2, 5) == 2


def test_prompt_lists_in_rank_order(spark):
    cands = spark.createDataFrame(
        [("u", 2, "B", "c", "l"), ("u", 1, "A", "c", "l")],
        "id_usuario string, rank int, nombre_sitio string, categoria_sitio string, ubicacion string")
    texts = spark.createDataFrame([("u", "ctx")], "id_usuario string, contexto string")
    row = PR.direct_prompts(texts, cands, 3).first()
    assert json.loads(row["candidates_json"])[0]["nombre_sitio"] == "A"
    assert "ctx" in row["prompt"] and "{top_n}" not in row["prompt"] and row["n_candidatos"] == 2


def test_malformed_answers_rejected(spark):
    ok = json.dumps({"recomendaciones": [{"nombre_sitio": f"S{i}"} for i in range(5)]})
    rows = [("a", "m", "not json"), ("b", "m", "{}"), ("c", "m", '{"recomendaciones": "x"}'),
            ("d", "m", '{"recomendaciones": []}'), ("e", "m", ok)]
    df = spark.createDataFrame(rows, "id_usuario string, modelo_usado string, respuesta string")
    items, rejected = G.parse_responses(df, "id_usuario", "direct", top_n=3)
    reasons = {r["id_usuario"]: r["estado"] for r in rejected.collect()}
    assert reasons == {"a": "json_invalido", "b": "sin_lista", "c": "sin_lista", "d": "lista_vacia", "e": "excedente"}
    got = [(r["id_usuario"], r["posicion"], r["nombre_sitio"]) for r in items.orderBy("posicion").collect()]
    assert got == [("e", 1, "S0"), ("e", 2, "S1"), ("e", 3, "S2")]


def test_ungrounded_flag(spark):
    items = spark.createDataFrame([("u", "A"), ("u", "Z")], "id_usuario string, nombre_sitio string")
    cands = spark.createDataFrame([("u", "A")], "id_usuario string, nombre_sitio string")
    got = {r["nombre_sitio"]: r["en_candidatos"] for r in G.grounded(items, cands, "id_usuario", "nombre_sitio").collect()}
    assert got == {"A": 1, "Z": 0}


def test_stub_generator_through_map_in_pandas(spark):
    cj = json.dumps([{"nombre_sitio": "A", "categoria_sitio": "c", "ubicacion": "l"}] * 4)
    prompts = spark.createDataFrame([("u", "m", cj, "p")], "id_usuario string, modelo_usado string, candidates_json string, prompt string")
    out = G.generate(prompts, "id_usuario", G.stub_generator("direct", 3)).first()
    assert len(json.loads(out["respuesta"])["recomendaciones"]) == 3
