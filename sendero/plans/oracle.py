"""Oracle SQL for the registered queries, runnable by DuckDB over the base
tables.  Queries are assembled from named CTE fragments; each fragment lists
the fragments it reads, and ``sql()`` inlines the needed ones in order.

The SQL is an independent brute-force statement of each result (all pairs,
plain windows), used only to check the Spark plans.
"""

from __future__ import annotations

from sendero.functions import fixed
from sendero.functions.text import render_sql, sql_literal
from sendero.operators.recommend import DIRECT_REASON, INVERSE_REASON

DIM = 64
_FRAGMENTS: dict[str, tuple[str, tuple[str, ...]]] = {}


def fragment(name: str, body: str, *deps: str) -> None:
    _FRAGMENTS[name] = (body.strip(), deps)


def sql(final: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _FRAGMENTS[n][1]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return final.strip()
    ctes = ",\n".join(f"{n} AS (\n{_FRAGMENTS[n][0]}\n)" for n in order)
    return f"WITH {ctes}\n{final.strip()}"


# --- bindings (FIXTURES.md section 2) ------------------------------------------
fragment("perfiles", """
SELECT c.c_custkey * 2 + v.bis AS _fila,
  cast(c.c_custkey as string) AS id_usuario,
  CASE WHEN v.bis = 1 THEN concat(c.c_name, ' (bis)') ELSE c.c_name END AS nombre,
  cast(18 + c.c_custkey % 60 as int) AS edad,
  CASE c.c_custkey % 3 WHEN 0 THEN 'Femenino' WHEN 1 THEN 'Masculino' ELSE 'Otro' END AS genero,
  n.n_name AS nacionalidad,
  CASE r.r_name WHEN 'EUROPE' THEN 'Español' WHEN 'AMERICA' THEN 'Inglés' ELSE 'Francés' END AS idioma_principal,
  CASE c.c_custkey % 2 WHEN 0 THEN 'Universitario' ELSE 'Secundario' END AS nivel_estudios,
  c.c_mktsegment AS ocupacion,
  CASE c.c_custkey % 2 WHEN 0 THEN 'Soltero' ELSE 'Casado' END AS estado_civil,
  CASE c.c_custkey % 5 WHEN 0 THEN 'Sí' ELSE 'No' END AS tiene_hijos,
  CASE WHEN c.c_acctbal < 0 THEN 'Bajo' WHEN c.c_acctbal < 5000 THEN 'Medio' ELSE 'Alto' END AS presupuesto_viaje,
  CASE c.c_custkey % 4 WHEN 0 THEN 'Cultural' WHEN 1 THEN 'Aventura' WHEN 2 THEN 'Relax' ELSE NULL END AS tipo_viajero,
  cast(1 + c.c_custkey % 21 as int) AS duracion_estadia_promedio,
  CASE c.c_custkey % 2 WHEN 0 THEN 'Verano' ELSE 'Invierno' END AS epoca_preferida,
  CASE c.c_custkey % 3 WHEN 0 THEN 'Pareja' WHEN 1 THEN 'Familia' ELSE 'Solo' END AS compania_viaje,
  r.r_name AS destino_frecuente,
  'Hotel' AS alojamiento_preferido,
  CASE c.c_custkey % 3 WHEN 0 THEN 'Alta' WHEN 1 THEN 'Media' ELSE 'Baja' END AS nivel_actividad,
  'Móvil' AS dispositivo_principal,
  concat_ws('|', c.c_mktsegment, n.n_name) AS intereses_principales,
  concat_ws('|', 'Museos', CASE WHEN c.c_custkey % 2 = 0 THEN 'Playa' END) AS actividades_preferidas
FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN (SELECT 0 AS bis UNION ALL SELECT 1) v ON v.bis = 0 OR c.c_custkey % 25 = 3
""")

fragment("interacciones", """
SELECT e.event_id AS id_interaccion,
  cast(e.user_id as string) AS id_usuario,
  cast(e.ts as date) AS fecha_interaccion,
  CASE WHEN extract(hour from e.ts) < 12 THEN 'Mañana' WHEN extract(hour from e.ts) < 20 THEN 'Tarde' ELSE 'Noche' END AS hora_dia,
  CASE e.event_id % 2 WHEN 0 THEN 'Móvil' ELSE 'PC' END AS dispositivo_usado,
  concat('site/', cast(p.p_partkey as string)) AS url_sitio,
  CASE WHEN p.p_partkey % 50 <> 7 THEN p.p_name END AS nombre_sitio,
  p.p_type AS categoria_sitio,
  n.n_name AS ubicacion,
  CASE e.event_type WHEN 'purchase' THEN 'Reserva' WHEN 'signup' THEN 'Favorito' WHEN 'click' THEN 'Click' WHEN 'view' THEN 'Calificación' ELSE 'Comentario' END AS tipo_interaccion,
  CASE WHEN e.event_type = 'view' THEN cast(1 + cast(floor(e.value) as int) % 5 as double) END AS calificacion,
  CASE WHEN e.event_type = 'error' THEN d.text END AS comentario,
  cast(floor(e.value * 10) as bigint) AS tiempo_visita_segundos
FROM (
  SELECT event_id, ts, user_id, event_type, value, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) AS pk FROM events
  UNION ALL
  SELECT 1000000000000 + pk, min(ts), 5, 'click', cast(0 as double), pk
  FROM (SELECT ts, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) AS pk FROM events) v
  WHERE pk IS NOT NULL GROUP BY pk
  UNION ALL
  SELECT 2000000000000 + pk, min(ts), 9000000000 + pk, 'click', cast(0 as double), pk
  FROM (SELECT ts, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) AS pk FROM events) v
  WHERE pk % 10 = 1 GROUP BY pk
) e
JOIN part p ON p.p_partkey = e.pk
JOIN nation n ON n.n_nationkey = p.p_partkey % 25
LEFT JOIN documents d ON e.event_type = 'error' AND d.doc_id = e.event_id % (SELECT count(*) FROM documents)
""")

# --- cleaning ---------------------------------------------------------------------
fragment("prof", """
SELECT * EXCLUDE (_fila) REPLACE (trim(id_usuario) AS id_usuario) FROM perfiles
WHERE trim(id_usuario) <> ''
QUALIFY row_number() OVER (PARTITION BY trim(id_usuario) ORDER BY _fila) = 1
""", "perfiles")

fragment("inter", """
SELECT * REPLACE (trim(id_usuario) AS id_usuario, nullif(trim(url_sitio), '') AS url_sitio)
FROM interacciones WHERE trim(id_usuario) <> ''
""", "interacciones")

# --- aggregates ----------------------------------------------------------------------
fragment("first_rows", """
SELECT url_sitio, nombre_sitio, categoria_sitio, ubicacion FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY url_sitio ORDER BY id_interaccion) AS INTEGER) AS rn FROM inter
) WHERE rn = 1
""", "inter")

fragment("catalog", """
SELECT * FROM first_rows WHERE url_sitio IS NOT NULL AND nombre_sitio IS NOT NULL
""", "first_rows")

def _optional(template: str, column: str) -> str:
    return f"CASE WHEN {column} IS NOT NULL THEN {render_sql(template, items=column)} END"


_MULTI = "coalesce(trim(replace({c}, '|', ', '), ', '), '')"
_EXPLICIT_SQL = render_sql(
    fixed.EXPLICIT_TEMPLATE,
    **{c: c for c in [
        "genero", "edad", "nacionalidad", "idioma_principal", "ocupacion", "tipo_viajero",
        "presupuesto_viaje", "compania_viaje", "duracion_estadia_promedio", "epoca_preferida",
        "destino_frecuente", "alojamiento_preferido", "nivel_actividad"]},
    intereses=_MULTI.format(c="intereses_principales"),
    actividades=_MULTI.format(c="actividades_preferidas"),
)


def user_chain(s: str = "", src: str = "inter") -> None:
    """User-side fragments (history picks, narratives, consumed set) over the
    interaction fragment ``src``; names carry the suffix ``s``."""
    if f"user_texts{s}" in _FRAGMENTS:
        return
    fragment(f"consumed{s}", f"""
SELECT DISTINCT id_usuario, url_sitio FROM {src} WHERE url_sitio IS NOT NULL
""", src)
    fragment(f"freq_counts{s}", f"""
SELECT id_usuario, kind, val, count(*) AS n FROM (
  SELECT id_usuario, 'cat' AS kind, categoria_sitio AS val FROM {src}
  UNION ALL SELECT id_usuario, 'loc' AS kind, ubicacion AS val FROM {src}
) WHERE val IS NOT NULL GROUP BY id_usuario, kind, val
""", src)
    fragment(f"first_kinds{s}", f"""
SELECT id_usuario, id_interaccion, nombre_sitio, 'booked' AS kind FROM {src}
  WHERE lower(tipo_interaccion) = '{fixed.BOOKING_KIND}' AND nombre_sitio IS NOT NULL
UNION ALL
SELECT id_usuario, id_interaccion, nombre_sitio, 'favourite' AS kind FROM {src}
  WHERE lower(tipo_interaccion) = '{fixed.FAVOURITE_KIND}' AND nombre_sitio IS NOT NULL
UNION ALL
SELECT id_usuario, id_interaccion, nombre_sitio, 'rated' AS kind FROM {src}
  WHERE TRY_CAST(calificacion AS DOUBLE) >= {fixed.TOP_RATED_MIN} AND nombre_sitio IS NOT NULL
""", src)
    fragment(f"picks{s}", f"""
SELECT id_usuario, kind, val, rn FROM (
  SELECT id_usuario, kind, val, CAST(row_number() OVER (PARTITION BY id_usuario, kind ORDER BY n DESC, val) AS INTEGER) AS rn
  FROM freq_counts{s}
) WHERE rn <= CASE kind WHEN 'loc' THEN 2 ELSE 3 END
UNION ALL
SELECT id_usuario, kind, val, rn FROM (
  SELECT id_usuario, kind, nombre_sitio AS val,
         CAST(row_number() OVER (PARTITION BY id_usuario, kind ORDER BY id_interaccion) AS INTEGER) AS rn
  FROM first_kinds{s}
) WHERE rn <= 3
""", f"freq_counts{s}", f"first_kinds{s}")
    fragment(f"implicit{s}", f"""
SELECT h.id_usuario, p.cats, p.locs, p.booked, p.favs, p.rated,
  concat_ws(' ',
    {render_sql(fixed.HISTORY_TEMPLATE, cats=f"coalesce(p.cats, '{fixed.DEFAULT_CATEGORIES}')", lugares=f"coalesce(p.locs, '{fixed.DEFAULT_LOCATIONS}')")},
    {_optional(fixed.BOOKED_TEMPLATE, 'p.booked')},
    {_optional(fixed.FAVOURITE_TEMPLATE, 'p.favs')},
    {_optional(fixed.TOP_RATED_TEMPLATE, 'p.rated')}) AS narrativa_implicita
FROM (SELECT DISTINCT id_usuario FROM {src}) h
LEFT JOIN (
  SELECT id_usuario,
    string_agg(val, ', ' ORDER BY rn) FILTER (WHERE kind = 'cat') AS cats,
    string_agg(val, ', ' ORDER BY rn) FILTER (WHERE kind = 'loc') AS locs,
    string_agg(val, ', ' ORDER BY rn) FILTER (WHERE kind = 'booked') AS booked,
    string_agg(val, ', ' ORDER BY rn) FILTER (WHERE kind = 'favourite') AS favs,
    string_agg(val, ', ' ORDER BY rn) FILTER (WHERE kind = 'rated') AS rated
  FROM picks{s} GROUP BY id_usuario
) p ON p.id_usuario = h.id_usuario
""", src, f"picks{s}")
    fragment(f"user_texts{s}", f"""
SELECT id_usuario, nombre, nacionalidad, tipo_viajero, presupuesto_viaje,
  narrativa_explicita, narrativa_implicita,
  CASE WHEN narrativa_implicita <> '' THEN concat(narrativa_explicita, ' ', narrativa_implicita)
       ELSE narrativa_explicita END AS documento,
  CASE WHEN narrativa_implicita <> '' THEN concat(narrativa_explicita, {sql_literal(fixed.RECENT_BEHAVIOUR_MARKER)}, narrativa_implicita)
       ELSE concat({sql_literal(fixed.COLD_START_MARKER)}, narrativa_explicita) END AS contexto
FROM (
  SELECT pr.id_usuario, pr.nombre, pr.nacionalidad, pr.tipo_viajero, pr.presupuesto_viaje,
    {_EXPLICIT_SQL} AS narrativa_explicita,
    coalesce(im.narrativa_implicita, '') AS narrativa_implicita
  FROM prof pr LEFT JOIN implicit{s} im ON im.id_usuario = pr.id_usuario
)
""", "prof", f"implicit{s}")


user_chain()


def _place_sql(template: str) -> str:
    return render_sql(template, nombre_sitio="nombre_sitio", categoria_sitio="categoria_sitio", ubicacion="ubicacion")


fragment("place_texts", f"""
SELECT url_sitio, nombre_sitio, categoria_sitio, ubicacion,
  {_place_sql(fixed.PLACE_TEMPLATE_CATALOGUE)} AS narrativa_catalogo,
  {_place_sql(fixed.PLACE_TEMPLATE_INDEX)} AS documento
FROM catalog
""", "catalog")

fragment("site_contexts", f"""
SELECT url_sitio, nombre_sitio, categoria_sitio, ubicacion,
  {_place_sql(fixed.PLACE_TEMPLATE_QUERY)} AS contexto
FROM first_rows WHERE url_sitio IS NOT NULL
""", "first_rows")

fragment("user_index_rows", f"""
SELECT id_usuario,
  coalesce(nombre, '{fixed.DEFAULT_NAME}') AS nombre,
  coalesce(nacionalidad, '{fixed.DEFAULT_FIELD}') AS nacionalidad,
  coalesce(tipo_viajero, '{fixed.DEFAULT_FIELD}') AS tipo_viajero,
  coalesce(presupuesto_viaje, '{fixed.DEFAULT_FIELD}') AS presupuesto_viaje,
  documento AS resumen_perfil
FROM user_texts WHERE trim(documento) <> ''
""", "user_texts")


# --- hashed token vectors (sparse: id, bucket, count) ---------------------------------
def bucket_sql(token: str, dim: int = DIM) -> str:
    return f"cast('0x' || substr(md5({token}), 1, 8) AS BIGINT) % {dim}"


def vector_fragment(name: str, source: str, id_col: str, text_col: str, where: str = "TRUE") -> None:
    fragment(name, f"""
SELECT id, b, count(*) AS n FROM (
  SELECT {id_col} AS id, {bucket_sql('t')} AS b
  FROM (SELECT {id_col}, unnest(string_split(lower({text_col}), ' ')) AS t FROM {source} WHERE {where})
) GROUP BY id, b
""", source)
    fragment(name + "_norm", f"SELECT id, sum(n * n) AS nn FROM {name} GROUP BY id", name)


vector_fragment("uctx_vec", "user_texts", "id_usuario", "contexto")
vector_fragment("udoc_vec", "user_texts", "id_usuario", "documento", "trim(documento) <> ''")
vector_fragment("place_vec", "place_texts", "url_sitio", "documento")
vector_fragment("site_vec", "site_contexts", "url_sitio", "contexto")


def cosine_all_pairs(name: str, qvec: str, ivec: str) -> None:
    """Every (query, item) pair with its cosine (zero when no shared bucket)."""
    fragment(name, f"""
SELECT qn.id AS qid, pn.id AS iid,
  coalesce(d.dot, 0) / (sqrt(qn.nn) * sqrt(pn.nn)) AS sim
FROM {qvec}_norm qn CROSS JOIN {ivec}_norm pn
LEFT JOIN (
  SELECT q.id AS qid, i.id AS iid, sum(q.n * i.n) AS dot
  FROM {qvec} q JOIN {ivec} i ON q.b = i.b GROUP BY q.id, i.id
) d ON d.qid = qn.id AND d.iid = pn.id
WHERE qn.nn > 0 AND pn.nn > 0
""", f"{qvec}_norm", f"{ivec}_norm")


cosine_all_pairs("direct_pairs", "uctx_vec", "place_vec")
cosine_all_pairs("inverse_pairs", "site_vec", "udoc_vec")


def topk_places_fragment(k: int, s: str = "") -> str:
    """Direct top-k over the user chain with suffix ``s`` (see user_chain)."""
    name = f"topk_places_{k}{s}"
    if name not in _FRAGMENTS:
        if s:
            vector_fragment(f"uctx_vec{s}", f"user_texts{s}", "id_usuario", "contexto")
            cosine_all_pairs(f"direct_pairs{s}", f"uctx_vec{s}", "place_vec")
        fragment(name, f"""
SELECT s.qid AS id_usuario, s.rank, c.url_sitio, c.nombre_sitio, c.categoria_sitio, c.ubicacion,
  round(s.sim, 4) AS similitud_vectorial
FROM (
  SELECT qid, iid, sim, CAST(row_number() OVER (PARTITION BY qid ORDER BY sim DESC, iid) AS INTEGER) AS rank
  FROM direct_pairs{s} p
  WHERE NOT EXISTS (SELECT 1 FROM consumed{s} x WHERE x.id_usuario = p.qid AND x.url_sitio = p.iid)
) s JOIN catalog c ON c.url_sitio = s.iid
WHERE s.rank <= {k}
""", f"direct_pairs{s}", f"consumed{s}", "catalog")
    return name


def topk_users_fragment(k: int) -> str:
    name = f"topk_users_{k}"
    if name not in _FRAGMENTS:
        fragment(name, f"""
SELECT s.qid AS url_sitio, s.rank, u.id_usuario, u.nombre, u.nacionalidad, u.tipo_viajero,
  u.presupuesto_viaje, round(s.sim, 4) AS similitud_vectorial, u.resumen_perfil
FROM (
  SELECT qid, iid, sim, CAST(row_number() OVER (PARTITION BY qid ORDER BY sim DESC, iid) AS INTEGER) AS rank
  FROM inverse_pairs p
  WHERE NOT EXISTS (SELECT 1 FROM inter x WHERE x.url_sitio = p.qid AND x.id_usuario = p.iid)
) s JOIN user_index_rows u ON u.id_usuario = s.iid
WHERE s.rank <= {k}
""", "inverse_pairs", "inter", "user_index_rows")
    return name


def _levels(subject: str) -> str:
    a, b, c = fixed.AFFINITY_LEVELS
    return (f"CASE ntile(3) OVER (PARTITION BY {subject} ORDER BY rank) "
            f"WHEN 1 THEN '{a}' WHEN 2 THEN '{b}' ELSE '{c}' END")


def baseline_direct_sql(k: int, n: int) -> str:
    t = topk_places_fragment(k)
    return sql(f"""
SELECT id_usuario, rank, url_sitio, nombre_sitio, categoria_sitio, ubicacion,
  {_levels('id_usuario')} AS nivel_afinidad,
  {render_sql(DIRECT_REASON, categoria_sitio='categoria_sitio', ubicacion='ubicacion')} AS justificacion,
  similitud_vectorial
FROM {t} WHERE rank <= {n}
""", t)


def baseline_inverse_sql(k: int, n: int) -> str:
    t = topk_users_fragment(k)
    return sql(f"""
SELECT t.url_sitio, t.rank, t.id_usuario, t.nombre, t.tipo_viajero,
  {render_sql(INVERSE_REASON, tipo_viajero='t.tipo_viajero', presupuesto_viaje='t.presupuesto_viaje', nombre_sitio='s.nombre_sitio')} AS justificacion_target,
  t.similitud_vectorial
FROM {t} t JOIN site_contexts s ON s.url_sitio = t.url_sitio
WHERE t.rank <= {n}
""", t, "site_contexts")


# --- prompts and answers -------------------------------------------------------------------
def struct_sql(fields: dict[str, str]) -> str:
    return "struct_pack(" + ", ".join(f"{dst} := {src}" for dst, src in fields.items()) + ")"


def candidate_json_fragment(name: str, source: str, subject: str, fields: dict[str, str]) -> None:
    fragment(name, f"""
SELECT {subject}, cast(count(*) AS INTEGER) AS n_candidatos,
  CAST(to_json(list({struct_sql(fields)} ORDER BY rank)) AS VARCHAR) AS candidates_json
FROM {source} GROUP BY {subject}
""", source)


# --- evaluation ------------------------------------------------------------------------------
fragment("cutoff", """
SELECT min(fecha_interaccion)
  + CAST(floor(date_diff('day', min(fecha_interaccion), max(fecha_interaccion)) * 0.8) AS INTEGER) AS c
FROM inter""", "inter")
fragment("inter_tt", "SELECT * FROM inter WHERE fecha_interaccion < (SELECT c FROM cutoff)", "inter", "cutoff")
fragment("rel_tt", """
SELECT id_usuario, url_sitio FROM inter WHERE url_sitio IS NOT NULL
GROUP BY id_usuario, url_sitio HAVING min(fecha_interaccion) >= (SELECT c FROM cutoff)""", "inter", "cutoff")
fragment("rel_loo", """
SELECT id_usuario, arg_max(url_sitio, f) AS url_sitio FROM (
  SELECT id_usuario, url_sitio, min(id_interaccion) AS f FROM inter WHERE url_sitio IS NOT NULL
  GROUP BY id_usuario, url_sitio
) GROUP BY id_usuario""", "inter")
fragment("inter_loo", """
SELECT * FROM inter i WHERE NOT EXISTS (
  SELECT 1 FROM rel_loo h WHERE h.id_usuario = i.id_usuario AND h.url_sitio = i.url_sitio)""", "inter", "rel_loo")
user_chain("_tt", "inter_tt")
user_chain("_loo", "inter_loo")

PROTOCOLS = {"temporal": "_tt", "leave_one_out": "_loo"}
METRIC_NAMES = ("hit_rate", "ndcg", "mrr", "precision", "recall")


def ranking_metrics_sql(recs: str, rel: str, label_col: str, label: str, n: int) -> str:
    """Metric rows for a recommendation fragment against a relevant set."""
    per_user = f"""
SELECT u.id_usuario, u.n_rel, count(h.rank) AS h, min(h.rank) AS min_rank,
  coalesce(sum(1.0 / log2(h.rank + 1)), 0) AS dcg
FROM (SELECT id_usuario, count(*) AS n_rel FROM {rel}
      WHERE id_usuario IN (SELECT id_usuario FROM prof) GROUP BY id_usuario) u
LEFT JOIN (SELECT r.id_usuario, r.rank FROM {recs} r JOIN {rel} x
           ON x.id_usuario = r.id_usuario AND x.url_sitio = r.url_sitio) h
  ON h.id_usuario = u.id_usuario
GROUP BY u.id_usuario, u.n_rel"""
    exprs = {
        "hit_rate": "CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END",
        "ndcg": f"dcg / list_sum(list_transform(range(1, least(n_rel, {n}) + 1), lambda i: 1.0 / log2(i + 1)))",
        "mrr": "coalesce(1.0 / min_rank, 0.0)",
        "precision": f"h / {float(n)}",
        "recall": "h / n_rel",
    }
    parts = [
        f"SELECT '{label}' AS {label_col}, '{m}' AS metrica, {n} AS k, round(avg({e}), 6) AS valor, "
        f"count(*) AS usuarios FROM pu"
        for m, e in exprs.items()
    ]
    return f"WITH pu AS ({per_user})\n" + "\nUNION ALL\n".join(parts)
