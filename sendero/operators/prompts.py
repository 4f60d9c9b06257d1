"""Prompt assembly for a caller-supplied generator.

Candidates are pruned to the prompt fields, folded per subject into a JSON
list in rank order (at most k entries per subject, so the fold is bounded)
and written into the template.  Values are inserted last, so braces inside
user data stay as they are.
"""

from __future__ import annotations

import json
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sendero.functions import fixed
from sendero.functions.text import render, template_variables

JSON_OPTIONS = {"ignoreNullFields": "false"}
DIRECT_FIELDS = {"nombre_sitio": "nombre_sitio", "categoria_sitio": "categoria_sitio", "ubicacion": "ubicacion"}
INVERSE_FIELDS = {
    "id_usuario": "id_usuario",
    "nombre": "nombre",
    "tipo_viajero": "tipo_viajero",
    "presupuesto": "presupuesto_viaje",
    "perfil": "resumen_perfil",
}


def validate_template(template: str, required=tuple(fixed.TEMPLATE_VARIABLES)) -> str:
    """A template override must use every required variable."""
    missing = [v for v in required if v not in template_variables(template)]
    if missing:
        raise ValueError(f"prompt template lacks variables: {missing}")
    return template


def check_k_n(top_k: int, top_n: int) -> int:
    """N larger than K is allowed, with a warning, and capped by K."""
    if top_k < 1 or top_n < 1:
        raise ValueError("top_k and top_n must be positive")
    if top_n > top_k:
        warnings.warn(f"top_n={top_n} is larger than top_k={top_k}; {top_k} results are given", stacklevel=2)
    return min(top_n, top_k)


def candidate_json(candidates: DataFrame, subject: str, fields: dict[str, str]) -> DataFrame:
    """Per subject: (n_candidatos, candidates_json) with entries in rank order."""
    entry = F.struct(F.col("rank"), F.struct(*[F.col(src).alias(dst) for dst, src in fields.items()]).alias("c"))
    folded = candidates.groupBy(subject).agg(F.array_sort(F.collect_list(entry)).alias("l"))
    return folded.select(
        subject,
        F.size("l").alias("n_candidatos"),
        F.to_json(F.transform("l", lambda x: x["c"]), JSON_OPTIONS).alias("candidates_json"),
    )


def _model(model: str | None) -> Column:
    return F.lit(model or fixed.DEFAULT_GENERATOR)


def _options(options: dict | None) -> Column:
    """Generation options handed to the generator with each prompt."""
    return F.lit(json.dumps(options if options is not None else fixed.GENERATION_OPTIONS,
                            separators=(",", ":"), sort_keys=True))


def direct_prompts(user_texts: DataFrame, candidates: DataFrame, top_n: int = fixed.TOP_N,
                   template: str | None = None, model: str | None = None,
                   options: dict | None = None, context: DataFrame | None = None) -> DataFrame:
    """M1: one prompt per user with candidates.  ``context`` (id_usuario,
    contexto_grafo) adds a text to the user's context, e.g. the paths of the
    graph (E20); users without one keep theirs."""
    template = validate_template(template) if template else fixed.DIRECT_PROMPT_TEMPLATE
    lists = candidate_json(candidates, "id_usuario", DIRECT_FIELDS)
    j = lists.join(user_texts.select("id_usuario", "contexto"), "id_usuario")
    if context is not None:
        j = j.join(context.select("id_usuario", "contexto_grafo"), "id_usuario", "left").withColumn(
            "contexto", F.concat_ws("\n", "contexto", "contexto_grafo"))
    return j.select(
        "id_usuario",
        _model(model).alias("modelo_usado"),
        _options(options).alias("opciones"),
        "n_candidatos",
        "candidates_json",
        render(template, top_n=F.lit(str(top_n)), user_context=F.col("contexto"),
               candidates_json=F.col("candidates_json")).alias("prompt"),
    )


def inverse_prompts(site_contexts: DataFrame, candidates: DataFrame, top_n: int = fixed.TOP_N,
                    model: str | None = None, options: dict | None = None) -> DataFrame:
    """M2: one prompt per site with user candidates (fixed template)."""
    lists = candidate_json(candidates, "url_sitio", INVERSE_FIELDS)
    j = lists.join(site_contexts.select("url_sitio", "contexto"), "url_sitio")
    return j.select(
        "url_sitio",
        _model(model).alias("modelo_usado"),
        _options(options).alias("opciones"),
        "n_candidatos",
        "candidates_json",
        render(fixed.INVERSE_PROMPT_TEMPLATE, top_n=F.lit(str(top_n)), place_context=F.col("contexto"),
               candidates_json=F.col("candidates_json")).alias("prompt"),
    )
