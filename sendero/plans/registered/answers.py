"""Registered queries: prompts, generation, parsed answers, envelopes, sweep, and the end-to-end generation path."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendero.functions import fixed
from sendero.functions.text import render_sql
from sendero.operators import generate as G
from sendero.operators import ledger as L
from sendero.operators import prompts as PR
from sendero.operators import recommend as R
from sendero.plans import oracle as O
from sendero.plans.pipeline import Pipeline
from sendero.plans.registry import register
from sendero.session import drop_written, scratch_path, write_once


# --- prompts, generation, answers ------------------------------------------------------------

_OPTIONS_JSON = json.dumps(fixed.GENERATION_OPTIONS, separators=(",", ":"), sort_keys=True)
O.candidate_json_fragment("direct_lists", O.topk_places_fragment(6), "id_usuario", PR.DIRECT_FIELDS)
O.candidate_json_fragment("inverse_lists", O.topk_users_fragment(10), "url_sitio", PR.INVERSE_FIELDS)


O.fragment("direct_prompt_rows", f"""
SELECT l.id_usuario, '{fixed.DEFAULT_GENERATOR}' AS modelo_usado, '{_OPTIONS_JSON}' AS opciones, l.n_candidatos, l.candidates_json,
  {render_sql(fixed.DIRECT_PROMPT_TEMPLATE, top_n="'3'", user_context='u.contexto', candidates_json='l.candidates_json')} AS prompt
FROM direct_lists l JOIN user_texts u ON u.id_usuario = l.id_usuario""", "direct_lists", "user_texts")


@register("prompt_direct", O.sql("SELECT * FROM direct_prompt_rows", "direct_prompt_rows"))
def _prompt_direct(p: Pipeline) -> DataFrame:
    """Direct prompt of every user (K=6, N=3)."""
    return PR.direct_prompts(p.user_texts, p.topk_places(6), 3)


@register("prompt_inverse", O.sql(f"""
SELECT l.url_sitio, '{fixed.DEFAULT_GENERATOR}' AS modelo_usado, '{_OPTIONS_JSON}' AS opciones, l.n_candidatos, l.candidates_json,
  {render_sql(fixed.INVERSE_PROMPT_TEMPLATE, top_n="'3'", place_context='s.contexto', candidates_json='l.candidates_json')} AS prompt
FROM inverse_lists l JOIN site_contexts s ON s.url_sitio = l.url_sitio""", "inverse_lists", "site_contexts"))
def _prompt_inverse(p: Pipeline) -> DataFrame:
    """M2/P10: inverse prompt of every site (K=10, N=3)."""
    return PR.inverse_prompts(p.site_contexts, p.topk_users(10), 3)


def _stub_json_sql() -> str:
    """The stub's answer text as Python's json.dumps writes it."""
    a, b, c = fixed.AFFINITY_LEVELS

    def j(x: str) -> str:
        return f"coalesce(CAST(to_json({x}) AS VARCHAR), 'null')"

    level = (f"CASE least(2, CAST(floor((t.rank - 1) * 3 / least(3, n.c)) AS INTEGER)) "
             f"WHEN 0 THEN '{a}' WHEN 1 THEN '{b}' ELSE '{c}' END")
    reason = render_sql(G.STUB_DIRECT_REASON, pos="t.rank")
    item = (f"""'{{"nombre_sitio": ' || {j('t.nombre_sitio')} || ', "categoria_sitio": ' || {j('t.categoria_sitio')}"""
            f""" || ', "ubicacion": ' || {j('t.ubicacion')} || ', "nivel_afinidad": ' || {j(level)}"""
            f""" || ', "justificacion": ' || {j(reason)} || '}}'""")
    t = O.topk_places_fragment(6)
    return O.sql(f"""
SELECT t.id_usuario, '{fixed.DEFAULT_GENERATOR}' AS modelo_usado,
  '{{"{fixed.DIRECT_RESPONSE_LIST}": [' || string_agg({item}, ', ' ORDER BY t.rank) || ']}}' AS respuesta
FROM {t} t JOIN (SELECT id_usuario, count(*) AS c FROM {t} GROUP BY id_usuario) n ON n.id_usuario = t.id_usuario
WHERE t.rank <= 3
GROUP BY t.id_usuario""", t)


@register("generate_stub", _stub_json_sql())
def _generate_stub(p: Pipeline) -> DataFrame:
    """M3: batch generation over the prompt table with a caller-supplied
    callable (here the deterministic stub) through mapInPandas."""
    prompts = PR.direct_prompts(p.user_texts, p.topk_places(6), 3)
    return G.generate(prompts, "id_usuario", G.stub_generator("direct", 3)).drop("error")


# Sixteen answers as a model might give them, good and bad; which of them are
# well formed is for the parser here, and for DuckDB's JSON functions in the SQL.
_LIST = fixed.DIRECT_RESPONSE_LIST
LITERAL_ANSWERS = [
    f'{{"{_LIST}": [{{"nombre_sitio": "Uno", "categoria_sitio": "c", "ubicacion": "u", "nivel_afinidad": "a", "justificacion": "j"}}]}}',
    f'{{"{_LIST}": [{{"nombre_sitio": "Uno"}}, {{"nombre_sitio": "Dos"}}, {{"nombre_sitio": "Tres"}}]}}',
    f'{{"{_LIST}": [{{"nombre_sitio": "1"}}, {{"nombre_sitio": "2"}}, {{"nombre_sitio": "3"}}, {{"nombre_sitio": "4"}}, {{"nombre_sitio": "5"}}]}}',
    f'{{"{_LIST}": [{{"nombre_sitio": 5, "ubicacion": null}}]}}',
    f'{{"nota": "con texto", "{_LIST}": [{{"nombre_sitio": "Ávila", "justificacion": "cerca, \\"bien\\""}}]}}',
    f'{{"{_LIST}": []}}',
    f'{{"{_LIST}": null}}',
    f'{{"{_LIST}": "Uno, Dos"}}',
    f'{{"{_LIST}": {{"nombre_sitio": "Uno"}}}}',
    f'{{"{_LIST}": [1, 2, 3]}}',
    f'{{"{_LIST}": [{{"nombre_sitio": "Uno"}}, "Dos"]}}',
    f'{{"otra": [{{"nombre_sitio": "Uno"}}]}}',
    '[{"nombre_sitio": "Uno"}]',
    f'{{"{_LIST}": [{{"nombre_sitio": "Uno"}}',
    "Lo siento, no puedo ayudar con eso.",
    "",
]
SAMPLING = [json.dumps(fixed.GENERATION_OPTIONS | {"temperature": t}, separators=(",", ":"), sort_keys=True) for t in (0.1, 0.7, 1.0)]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@register("generation_ledger", O.sql(f"""
SELECT * FROM (
WITH asked AS (SELECT id_usuario, modelo_usado, o.opciones, md5(prompt || chr(10) || o.opciones) AS h FROM direct_prompt_rows
               CROSS JOIN (VALUES {', '.join(f'({_quoted(o)})' for o in SAMPLING)}) o(opciones)),
texts(d, respuesta) AS (VALUES {', '.join(f"('{n:x}', {_quoted(a)})" for n, a in enumerate(LITERAL_ANSWERS))}),
judged AS (SELECT d, CASE WHEN json_valid(respuesta) THEN json_extract(respuesta, '$.{_LIST}') END AS l FROM texts),
status AS (SELECT d, coalesce(json_type(l) = 'ARRAY' AND json_array_length(l) > 0 AND
             len(list_filter(json_extract(l, '$[*]'), lambda x: json_type(x) <> 'OBJECT')) = 0, false) AS ok, json_array_length(l) AS n FROM judged)
SELECT modelo_usado, opciones, count(*) AS respuestas, count(*) FILTER (WHERE ok) AS validas,
  count(*) FILTER (WHERE ok AND n > 3) AS con_excedente, round(avg(CASE WHEN ok THEN 1 ELSE 0 END), 6) AS tasa,
  (SELECT count(DISTINCT h) FROM asked) AS enviadas, CAST(0 AS BIGINT) AS enviadas_otra_vez
FROM asked a JOIN status s ON s.d = substr(a.h, 1, 1) GROUP BY modelo_usado, opciones)""", "direct_prompt_rows"))
def _generation_ledger(p: Pipeline) -> DataFrame:
    """Every user's prompt at three sampling options through the
    ledger, twice: what the second run sends again, and the share of
    well-formed answers by option, from what is stored."""
    prompts = write_once(L.sweep_options(PR.direct_prompts(p.user_texts, p.topk_places(6), 3), SAMPLING).withColumn(
        "pregunta", F.concat_ws("|", "id_usuario", "opciones")), "swept-prompts")
    ledger = L.AnswerLedger(p.spark, scratch_path(p.spark, "ledger"))
    generator = L.literal_generator(LITERAL_ANSWERS)
    sent, again = ledger.ask(prompts, generator), ledger.ask(prompts, generator)
    answers = write_once(ledger.answers(prompts, "pregunta"), "answers")
    drop_written(prompts)
    ledger.delete()
    _, rejected = G.parse_responses(answers, "pregunta", "direct", 3)
    return L.validity_by_option(answers, rejected, "pregunta").withColumns(
        {"enviadas": F.lit(sent).cast("bigint"), "enviadas_otra_vez": F.lit(again).cast("bigint")})


def _parsed_sql(key: str, baseline_sql: str, fields: list[str], cand: str, cand_col: str) -> str:
    cols = ", ".join(f"b.{f}" for f in fields)
    return f"""
WITH b AS ({baseline_sql})
SELECT b.{key}, '{fixed.DEFAULT_GENERATOR}' AS modelo_usado, cast(b.rank AS INTEGER) AS posicion, {cols},
  CASE WHEN EXISTS (SELECT 1 FROM ({cand}) c WHERE c.{key} = b.{key} AND c.{cand_col} = b.{cand_col}) THEN 1 ELSE 0 END AS en_candidatos
FROM b"""


@register("parse_direct", _parsed_sql(
    "id_usuario", O.baseline_direct_sql(6, 3), fixed.DIRECT_RESPONSE_FIELDS,
    O.sql(f"SELECT * FROM {O.topk_places_fragment(6)}", O.topk_places_fragment(6)), "nombre_sitio"))
def _parse_direct(p: Pipeline) -> DataFrame:
    """Answers (from the deterministic responder) parsed against
    the contract, capped to N, exploded, and flagged when grounded."""
    topk = p.topk_places(6)
    answers = G.responses_from_baseline(R.baseline_direct(topk, 3), "id_usuario", "direct")
    items, _ = G.parse_responses(answers, "id_usuario", "direct", 3)
    return G.grounded(items, topk, "id_usuario", "nombre_sitio")


@register("parse_inverse", _parsed_sql(
    "url_sitio", O.baseline_inverse_sql(10, 3), fixed.INVERSE_RESPONSE_FIELDS,
    O.sql(f"SELECT * FROM {O.topk_users_fragment(10)}", O.topk_users_fragment(10)), "id_usuario"))
def _parse_inverse(p: Pipeline) -> DataFrame:
    """M5: inverse answers parsed and flagged when grounded."""
    topk = p.topk_users(10)
    answers = G.responses_from_baseline(R.baseline_inverse(topk, p.site_contexts, 3), "url_sitio", "inverse")
    items, _ = G.parse_responses(answers, "url_sitio", "inverse", 3)
    return G.grounded(items, topk, "url_sitio", "id_usuario")


_ENVELOPE_PLACES = {c: c for c in ("nombre_sitio", "categoria_sitio", "ubicacion", "url_sitio", "similitud_vectorial")}
_ENVELOPE_USERS = {c: c for c in ("id_usuario", "nombre", "nacionalidad", "tipo_viajero", "presupuesto_viaje",
                                  "similitud_vectorial", "resumen_perfil")}


def _envelope_sql(direction: str, key: str, subjects: str, hits: str, fields: dict[str, str], baseline: str,
                  answer_list: str, answer_fields: list[str], message: str) -> str:
    return f"""
SELECT '{direction}' AS direccion, s.{key} AS sujeto, '{fixed.DEFAULT_GENERATOR}' AS modelo_usado, s.contexto AS contexto_usado,
  coalesce(c.n, 0) AS n_candidatos, c.j AS candidatos_json, r.j AS resultado_json,
  CASE WHEN c.n IS NULL THEN '{message}' END AS mensaje
FROM {subjects} s
LEFT JOIN (SELECT {key}, cast(count(*) AS INTEGER) AS n, CAST(to_json(list({O.struct_sql(fields)} ORDER BY rank)) AS VARCHAR) AS j
           FROM {hits} GROUP BY {key}) c ON c.{key} = s.{key}
LEFT JOIN (SELECT {key}, CAST(to_json(struct_pack({answer_list} := list({O.struct_sql({f: f for f in answer_fields})} ORDER BY rank))) AS VARCHAR) AS j
           FROM ({baseline}) GROUP BY {key}) r ON r.{key} = s.{key}"""


@register("result_envelope", O.sql(
    _envelope_sql("directa", "id_usuario", "user_texts", O.topk_places_fragment(6), _ENVELOPE_PLACES, O.baseline_direct_sql(6, 3),
                  fixed.DIRECT_RESPONSE_LIST, fixed.DIRECT_RESPONSE_FIELDS, fixed.NO_PLACE_CANDIDATES)
    + "\nUNION ALL\n"
    + _envelope_sql("inversa", "url_sitio", "site_contexts", O.topk_users_fragment(10), _ENVELOPE_USERS, O.baseline_inverse_sql(10, 3),
                    fixed.INVERSE_RESPONSE_LIST, fixed.INVERSE_RESPONSE_FIELDS, fixed.NO_USER_CANDIDATES),
    "user_texts", "site_contexts", O.topk_places_fragment(6), O.topk_users_fragment(10)))
def _result_envelope(p: Pipeline) -> DataFrame:
    """One envelope per user and per site, in one schema: model, context,
    candidates and result, or the message where there are no candidates."""
    places, users = p.topk_places(6), p.topk_users(10)
    direct = G.envelopes("directa", "id_usuario", p.user_texts, PR.candidate_json(places, "id_usuario", _ENVELOPE_PLACES),
                         G.responses_from_baseline(R.baseline_direct(places, 3), "id_usuario", "direct"), fixed.NO_PLACE_CANDIDATES)
    inverse = G.envelopes("inversa", "url_sitio", p.site_contexts, PR.candidate_json(users, "url_sitio", _ENVELOPE_USERS),
                          G.responses_from_baseline(R.baseline_inverse(users, p.site_contexts, 3), "url_sitio", "inverse"),
                          fixed.NO_USER_CANDIDATES)
    return direct.unionByName(inverse)


SWEEP = sorted({(k, n) for n in (3, 5, 10) for k in (n, -(-5 * n // 2), 20)})


@register("config_sweep", O.sql(f"""
SELECT m.modelo, cfg.k AS top_k, cfg.n AS top_n, t.id_usuario, t.rank, t.url_sitio,
  CASE ntile(3) OVER (PARTITION BY m.modelo, cfg.k, cfg.n, t.id_usuario ORDER BY t.rank)
    WHEN 1 THEN '{fixed.AFFINITY_LEVELS[0]}' WHEN 2 THEN '{fixed.AFFINITY_LEVELS[1]}' ELSE '{fixed.AFFINITY_LEVELS[2]}' END AS nivel_afinidad
FROM {O.topk_places_fragment(max(k for k, _ in SWEEP))} t
JOIN (VALUES {', '.join(f'({k}, {n})' for k, n in SWEEP)}) cfg(k, n) ON t.rank <= least(cfg.k, cfg.n)
CROSS JOIN (VALUES {', '.join(f"('{m}')" for m in fixed.GENERATOR_CHOICES)}) m(modelo)
""", O.topk_places_fragment(max(k for k, _ in SWEEP))))
def _config_sweep(p: Pipeline) -> DataFrame:
    """The baseline for every model at every (K, N) of a grid
    (K ~ 2.5 N among them), from one retrieval at the largest K; N is capped
    by K."""
    return R.config_sweep(p.topk_places(max(k for k, _ in SWEEP)), SWEEP, list(fixed.GENERATOR_CHOICES))


# --- end-to-end generation path (retrieval -> prompt -> generator -> parsed answer) --------------
def _rag_sql(key: str, topk: str, fields: dict[str, str], reason: str, reason_col: str,
             item_col: str, direct: bool) -> str:
    """Parsed answers of the deterministic stub: the first 3 candidates, with
    the stub's affinity rule and reason text, all grounded."""
    a, b, c = fixed.AFFINITY_LEVELS
    level = (f", CASE least(2, CAST(floor((t.rank - 1) * 3 / least(3, n.c)) AS INTEGER)) "
             f"WHEN 0 THEN '{a}' WHEN 1 THEN '{b}' ELSE '{c}' END AS nivel_afinidad") if direct else ""
    cols = ", ".join(f"t.{src} AS {dst}" for dst, src in fields.items())
    return O.sql(f"""
SELECT t.{key}, '{fixed.DEFAULT_GENERATOR}' AS modelo_usado, t.rank AS posicion, {cols}{level},
  {render_sql(reason, pos='t.rank')} AS {reason_col}, 1 AS en_candidatos
FROM {topk} t JOIN (SELECT {key}, count(*) AS c FROM {topk} GROUP BY {key}) n ON n.{key} = t.{key}
WHERE t.rank <= 3""", topk)


@register("rag_direct", _rag_sql(
    "id_usuario", O.topk_places_fragment(6),
    {"nombre_sitio": "nombre_sitio", "categoria_sitio": "categoria_sitio", "ubicacion": "ubicacion"},
    G.STUB_DIRECT_REASON, "justificacion", "nombre_sitio", True))
def _rag_direct(p: Pipeline) -> DataFrame:
    """M7 through the generator path: V5 -> M1 -> M3 (mapInPandas, stub
    generator) -> M4 -> E11, for every user."""
    topk = p.topk_places(6)
    answers = G.generate(PR.direct_prompts(p.user_texts, topk, 3), "id_usuario", G.stub_generator("direct", 3))
    items, _ = G.parse_responses(answers, "id_usuario", "direct", 3)
    return G.grounded(items, topk, "id_usuario", "nombre_sitio")


@register("rag_inverse", _rag_sql(
    "url_sitio", O.topk_users_fragment(10),
    {"id_usuario": "id_usuario", "nombre": "nombre", "tipo_viajero": "tipo_viajero"},
    G.STUB_INVERSE_REASON, "justificacion_target", "id_usuario", False))
def _rag_inverse(p: Pipeline) -> DataFrame:
    """M8 through the generator path for every site."""
    topk = p.topk_users(10)
    answers = G.generate(PR.inverse_prompts(p.site_contexts, topk, 3), "url_sitio", G.stub_generator("inverse", 3))
    items, _ = G.parse_responses(answers, "url_sitio", "inverse", 3)
    return G.grounded(items, topk, "url_sitio", "id_usuario")
