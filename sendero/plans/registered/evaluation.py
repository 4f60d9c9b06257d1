"""Registered queries: offline evaluation, knowledge graph, text signals, ALS baseline and calibration."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sendero.functions import fixed
from sendero.functions.text import render, render_sql
from sendero.operators import collaborative as CF
from sendero.operators import cooccurrence as CO
from sendero.operators import evaluate as E
from sendero.operators import generate as G
from sendero.operators import graph as GR
from sendero.operators import grounding as GD
from sendero.operators import path_counts as PC
from sendero.operators import prompts as PR
from sendero.operators import recommend as R
from sendero.operators import text_signals as TS
from sendero.operators.recommend import DIRECT_REASON
from sendero.plans import oracle as O
from sendero.plans.pipeline import Pipeline
from sendero.plans.registry import register
from sendero.plans.registered.answers import SWEEP
from sendero.session import write_once
from sendero.sources.tables import table


# --- offline evaluation ------------------------------------------------------------------------

EVAL_N = 10
RERANK_K = -(-5 * EVAL_N // 2)  # K ~ 2.5 N (E21)


def _protocol_data(p: Pipeline, protocol: str):
    """(training pipeline, relevant pairs) of a protocol."""
    if protocol == "temporal":
        cutoff = E.temporal_cutoff(p.interactions)
        return p.for_training(E.temporal_train(p.interactions, cutoff)), E.temporal_relevant(p.interactions, cutoff)
    held = write_once(E.held_out(p.interactions), "held-out")
    # The training rows are read several times (histories, texts, consumed).
    return p.for_training(write_once(E.without(p.interactions, held), "training")), held


def _metrics(p: Pipeline, n: int = EVAL_N) -> DataFrame:
    # What both protocols read is written first; their retrievals then run
    # side by side.
    p.keep_interactions()
    p.selector

    def one(protocol: str) -> DataFrame:
        tp, rel = _protocol_data(p, protocol)
        return E.ranking_metrics(E.user_ranking_stats(tp.topk_places(n), rel, p.profiles), n, protocol)

    with ThreadPoolExecutor(len(O.PROTOCOLS)) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, O.PROTOCOLS))


def _metrics_sql(metric: str, n: int = EVAL_N) -> str:
    parts, needs = [], []
    for protocol, s in O.PROTOCOLS.items():
        recs = O.topk_places_fragment(n, s)
        rel = f"rel{s}"
        needs += [recs, rel, "prof"]
        parts.append(f"SELECT * FROM ({O.ranking_metrics_sql(recs, rel, 'protocolo', protocol, n)}) "
                     f"WHERE metrica = '{metric}'")
    return O.sql("\nUNION ALL\n".join(f"({x})" for x in parts), *needs)


@register("split_temporal", O.sql("""
SELECT id_interaccion, id_usuario, url_sitio, fecha_interaccion,
  CASE WHEN fecha_interaccion < (SELECT c FROM cutoff) THEN 'train' ELSE 'test' END AS particion
FROM inter""", "inter", "cutoff"))
def _split_temporal(p: Pipeline) -> DataFrame:
    """Every interaction tagged train/test by the temporal cutoff."""
    return E.split_temporal(p.interactions, E.temporal_cutoff(p.interactions))


@register("split_by_rank", O.sql(f"""
SELECT *, CASE WHEN rango < {E.TRAIN_FRACTION} THEN 'train' ELSE 'test' END AS particion FROM (
  SELECT id_interaccion, id_usuario, url_sitio, fecha_interaccion,
    percent_rank() OVER (PARTITION BY id_usuario ORDER BY fecha_interaccion NULLS LAST) AS rango FROM inter)""", "inter"))
def _split_by_rank(p: Pipeline) -> DataFrame:
    """Every interaction tagged train/test by its rank among its user's."""
    return E.split_by_rank(p.interactions)


@register("split_leave_one_out", O.sql("SELECT * FROM rel_loo", "rel_loo"))
def _split_leave_one_out(p: Pipeline) -> DataFrame:
    """Per user, the held-out site (latest first-time visit)."""
    held, _ = E.leave_one_out(p.interactions)
    return held


def _metric_query(metric: str, doc: str):
    def fn(p: Pipeline) -> DataFrame:
        return _metrics(p).where(F.col("metrica") == metric)

    fn.__doc__ = doc
    register(f"metric_{metric}", _metrics_sql(metric))(fn)


_metric_query("hit_rate", "E3: Hit Rate@10 under both protocols.")
_metric_query("ndcg", "E4: NDCG@10 under both protocols.")
_metric_query("mrr", "E5: MRR (within the top-10) under both protocols.")
_metric_query("precision", "E6: Precision@10 under both protocols.")
_metric_query("recall", "E7: Recall@10 under both protocols.")


@register("metric_coverage", O.sql(f"""
SELECT count(DISTINCT r.url_sitio) AS recomendados, (SELECT count(*) FROM catalog) AS catalogo,
  round(count(DISTINCT r.url_sitio) / (SELECT count(*) FROM catalog), 6) AS cobertura
FROM {O.topk_places_fragment(EVAL_N)} r""", O.topk_places_fragment(EVAL_N), "catalog"))
def _metric_coverage(p: Pipeline) -> DataFrame:
    """Catalogue coverage of everyone's top-10."""
    return E.coverage(p.topk_places(EVAL_N), p.catalog)


@register("metric_ild", O.sql(f"""
SELECT round(avg(ild), 6) AS diversidad, count(*) AS usuarios FROM (
  SELECT a.id_usuario, 1 - avg(
    coalesce(d.dot, 0) / (sqrt(na.nn) * sqrt(nb.nn))) AS ild
  FROM {O.topk_places_fragment(EVAL_N)} a
  JOIN {O.topk_places_fragment(EVAL_N)} b ON a.id_usuario = b.id_usuario AND a.url_sitio < b.url_sitio
  JOIN place_vec_norm na ON na.id = a.url_sitio
  JOIN place_vec_norm nb ON nb.id = b.url_sitio
  LEFT JOIN (SELECT x.id AS i, y.id AS j, sum(x.n * y.n) AS dot FROM place_vec x JOIN place_vec y ON x.b = y.b
             GROUP BY x.id, y.id) d ON d.i = a.url_sitio AND d.j = b.url_sitio
  GROUP BY a.id_usuario
)""", O.topk_places_fragment(EVAL_N), "place_vec_norm"))
def _metric_ild(p: Pipeline) -> DataFrame:
    """Mean intra-list diversity (1 - cosine) of the top-10 lists,
    computed from per-list vector sums (no pair enumeration)."""
    return E.intra_list_diversity(p.topk_places(EVAL_N), p.place_vectors)


@register("metric_novelty", O.sql(f"""
SELECT round(avg(CASE WHEN c IS NOT NULL THEN -log2(c / (SELECT count(DISTINCT id_usuario) FROM consumed)) END), 6) AS novedad,
  CAST(sum(CASE WHEN c IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS sin_historial, count(*) AS recomendaciones
FROM {O.topk_places_fragment(EVAL_N)} r
LEFT JOIN (SELECT url_sitio, count(*) AS c FROM consumed GROUP BY url_sitio) p ON p.url_sitio = r.url_sitio
""", O.topk_places_fragment(EVAL_N), "consumed"))
def _metric_novelty(p: Pipeline) -> DataFrame:
    """Mean self-information of recommended sites."""
    return E.novelty(p.topk_places(EVAL_N), p.consumed)


# A table of answers that are not all good, from the baseline lists: of the
# users whose id leaves this remainder by 7, the answers are no JSON, lack the
# list, or name a site that was never retrieved first.
_NO_JSON, _NO_LIST, _INVENTED = 0, 1, 2
_EXCUSE, _INVENTED_SITE = "Lo siento, no puedo ayudar con eso.", "Sitio inventado"


def _mixed_answers(baseline: DataFrame, key: str) -> DataFrame:
    """(key, modelo_usado, respuesta) of a baseline with ``id_usuario``."""
    kind = F.col("id_usuario").cast("bigint") % 7
    named = F.when((kind == _INVENTED) & (F.col("rank") == 1), F.lit(_INVENTED_SITE)).otherwise(F.col("nombre_sitio"))
    answers = G.responses_from_baseline(baseline.withColumn("nombre_sitio", named), key, "direct")
    kind = F.element_at(F.split(key, r"\|"), -1).cast("bigint") % 7
    bad = F.when(kind == _NO_JSON, F.lit(_EXCUSE)).when(
        kind == _NO_LIST, F.replace(F.col("respuesta"), F.lit(fixed.DIRECT_RESPONSE_LIST), F.lit("otra_lista"))).otherwise(F.col("respuesta"))
    return answers.withColumn("respuesta", bad)


@register("metric_faithfulness", O.sql(f"""
SELECT count(DISTINCT id_usuario) AS respuestas, count(*) AS items,
  round(avg(CASE WHEN CAST(id_usuario AS BIGINT) % 7 = {_INVENTED} AND rank = 1 THEN 0 ELSE 1 END), 6) AS fidelidad
FROM ({O.baseline_direct_sql(6, 3)}) WHERE CAST(id_usuario AS BIGINT) % 7 NOT IN ({_NO_JSON}, {_NO_LIST})"""))
def _metric_faithfulness(p: Pipeline) -> DataFrame:
    """Share of parsed answer items that name one of their candidates,
    over answers some of which are malformed or name another site."""
    topk = p.topk_places(6)
    items, _ = G.parse_responses(_mixed_answers(R.baseline_direct(topk, 3), "id_usuario"), "id_usuario", "direct", 3)
    return G.grounded(items, topk, "id_usuario", "nombre_sitio").agg(
        F.count_distinct("id_usuario").alias("respuestas"),
        F.count(F.lit(1)).alias("items"),
        F.round(F.avg("en_candidatos"), 6).alias("fidelidad"),
    )


def _rerank_sql(s: str) -> str:
    t = O.topk_places_fragment(RERANK_K, s)
    src = f"inter{s}"
    name = f"graph_rerank{s}"
    if name not in O._FRAGMENTS:
        O.fragment(name, f"""
SELECT t.id_usuario, t.url_sitio, CAST(row_number() OVER (PARTITION BY t.id_usuario
  ORDER BY coalesce(sp.s, 0) DESC, t.rank) AS INTEGER) AS rank
FROM {t} t LEFT JOIN (
  SELECT c.id_usuario, c.url_sitio, sum(a.soporte) AS s
  FROM (SELECT id_usuario, url_sitio, 'categoría' AS via, categoria_sitio AS nodo FROM {t}
        UNION ALL SELECT id_usuario, url_sitio, 'ubicación', ubicacion FROM {t}) c
  JOIN (SELECT id_usuario, via, nodo, count(DISTINCT url_sitio) AS soporte FROM (
          SELECT id_usuario, url_sitio, 'categoría' AS via, categoria_sitio AS nodo FROM {src} WHERE url_sitio IS NOT NULL
          UNION ALL SELECT id_usuario, url_sitio, 'ubicación', ubicacion FROM {src} WHERE url_sitio IS NOT NULL)
        WHERE nodo IS NOT NULL GROUP BY id_usuario, via, nodo) a
    ON a.id_usuario = c.id_usuario AND a.via = c.via AND a.nodo = c.nodo
  GROUP BY c.id_usuario, c.url_sitio
) sp ON sp.id_usuario = t.id_usuario AND sp.url_sitio = t.url_sitio""", t, src)
    return name


def _compare_sql() -> str:
    s = O.PROTOCOLS["temporal"]
    vec = O.topk_places_fragment(EVAL_N, s)
    rr = _rerank_sql(s)
    a = O.ranking_metrics_sql(vec, f"rel{s}", "sistema", "vectorial", EVAL_N)
    b = O.ranking_metrics_sql(f"(SELECT * FROM {rr} WHERE rank <= {EVAL_N})", f"rel{s}", "sistema", "grafo", EVAL_N)
    return O.sql(f"({a})\nUNION ALL\n({b})", vec, rr, f"rel{s}", "prof")


@register("compare_baselines", _compare_sql())
def _compare_baselines(p: Pipeline) -> DataFrame:
    """Temporal-protocol metrics of the vector baseline against the
    hybrid list (K = 2.5 N retrieved, re-ranked by history-path support)."""
    p.keep_interactions()
    tp, rel = _protocol_data(p, "temporal")
    cand = tp.topk_places(RERANK_K)  # the first N of it are the vector list
    vec = E.ranking_metrics(E.user_ranking_stats(tp.topk_places(EVAL_N), rel, p.profiles), EVAL_N, "vectorial")
    rr = GR.graph_rerank(cand, GR.history_paths(tp.interactions, cand), EVAL_N)
    hyb = E.ranking_metrics(E.user_ranking_stats(rr, rel, p.profiles), EVAL_N, "grafo")
    return vec.unionByName(hyb).withColumnRenamed("protocolo", "sistema")


# --- knowledge graph ---------------------------------------------------------------------------
def _lexicon_values(words: dict | list) -> str:
    if isinstance(words, dict):
        return ", ".join(f"('{w}', '{a}')" for a, ws in words.items() for w in ws)
    return ", ".join(f"('{w}')" for w in words)


O.fragment("comment_words", """
SELECT id_interaccion, url_sitio, regexp_replace(lower(tok), '[^\\p{L}]', '', 'g') AS w FROM (
  SELECT id_interaccion, url_sitio, unnest(string_split(lower(comentario), ' ')) AS tok
  FROM inter WHERE comentario IS NOT NULL)""", "inter")
O.fragment("aspect_mentions", f"""
SELECT m.id_interaccion, m.url_sitio, m.aspecto, CAST(sign(c.pos - c.neg) AS INTEGER) AS polaridad
FROM (SELECT DISTINCT w.id_interaccion, w.url_sitio, l.aspecto FROM comment_words w
      JOIN (VALUES {_lexicon_values(TS.ASPECT_LEXICON)}) l(palabra, aspecto) ON l.palabra = w.w) m
JOIN (SELECT id_interaccion, url_sitio,
        sum(CASE WHEN w IN (SELECT * FROM (VALUES {_lexicon_values(TS.POSITIVE)})) THEN 1 ELSE 0 END) AS pos,
        sum(CASE WHEN w IN (SELECT * FROM (VALUES {_lexicon_values(TS.NEGATIVE)})) THEN 1 ELSE 0 END) AS neg
      FROM comment_words GROUP BY id_interaccion, url_sitio) c
  ON c.id_interaccion = m.id_interaccion AND c.url_sitio IS NOT DISTINCT FROM m.url_sitio""", "comment_words")


def _site_aspects(p: Pipeline) -> DataFrame:
    return TS.site_aspects(TS.aspect_mentions(p.commented))


@register("graph_nodes", O.sql(f"""
SELECT DISTINCT nodo, tipo FROM (
  SELECT id_usuario AS nodo, 'Usuario' AS tipo FROM prof
  UNION ALL SELECT url_sitio, 'Sitio' FROM catalog
  UNION ALL SELECT ubicacion, 'Ciudad' FROM catalog
  UNION ALL SELECT r.r_name, 'Region' FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  UNION ALL SELECT categoria_sitio, 'Categoria' FROM catalog
  UNION ALL SELECT tipo_viajero, 'TipoViajero' FROM prof
  UNION ALL SELECT unnest([{', '.join(repr(a) for a in TS.ASPECT_LEXICON)}]), 'Aspecto'
) WHERE nodo IS NOT NULL""", "prof", "catalog"))
def _graph_nodes(p: Pipeline) -> DataFrame:
    """Graph nodes of every kind."""
    cities = GR.city_regions(table(p.spark, p.sf_dir, "nation"), table(p.spark, p.sf_dir, "region"))
    return GR.nodes(p.profiles, p.catalog, cities, TS.aspect_nodes(p.spark))


@register("graph_edges", O.sql("""
SELECT id_usuario AS origen, url_sitio AS destino, 'VISITO' AS relacion, calificacion,
  fecha_interaccion AS fecha, CAST(NULL AS INTEGER) AS polaridad
FROM inter WHERE url_sitio IS NOT NULL
UNION ALL
SELECT DISTINCT url_sitio, ubicacion, 'UBICADO_EN', CAST(NULL AS DOUBLE), CAST(NULL AS DATE), CAST(NULL AS INTEGER)
FROM catalog WHERE ubicacion IS NOT NULL
UNION ALL
SELECT DISTINCT n.n_name, r.r_name, 'UBICADO_EN', CAST(NULL AS DOUBLE), CAST(NULL AS DATE), CAST(NULL AS INTEGER)
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE n.n_name IN (SELECT ubicacion FROM catalog)
UNION ALL
SELECT DISTINCT url_sitio, categoria_sitio, 'PERTENECE_A', CAST(NULL AS DOUBLE), CAST(NULL AS DATE), CAST(NULL AS INTEGER)
FROM catalog WHERE categoria_sitio IS NOT NULL
UNION ALL
SELECT url_sitio, aspecto, 'OFRECE_ASPECTO', CAST(NULL AS DOUBLE), CAST(NULL AS DATE), CAST(sum(polaridad) AS INTEGER)
FROM aspect_mentions GROUP BY url_sitio, aspecto""", "inter", "catalog", "aspect_mentions"))
def _graph_edges(p: Pipeline) -> DataFrame:
    """VISITO, UBICADO_EN, PERTENECE_A and OFRECE_ASPECTO edges."""
    cities = GR.city_regions(table(p.spark, p.sf_dir, "nation"), table(p.spark, p.sf_dir, "region"))
    return GR.edges(p.interactions, p.catalog, cities, _site_aspects(p))


def _paths_fragment() -> str:
    t = O.topk_places_fragment(6)
    if "graph_paths" not in O._FRAGMENTS:
        O.fragment("graph_paths", f"""
SELECT c.id_usuario, c.url_sitio, c.rank, c.nombre_sitio, c.via, c.nodo, a.soporte
FROM (SELECT id_usuario, url_sitio, rank, nombre_sitio, 'categoría' AS via, categoria_sitio AS nodo FROM {t}
      UNION ALL SELECT id_usuario, url_sitio, rank, nombre_sitio, 'ubicación', ubicacion FROM {t}) c
JOIN (SELECT id_usuario, via, nodo, count(DISTINCT url_sitio) AS soporte FROM (
        SELECT id_usuario, url_sitio, 'categoría' AS via, categoria_sitio AS nodo FROM inter WHERE url_sitio IS NOT NULL
        UNION ALL SELECT id_usuario, url_sitio, 'ubicación', ubicacion FROM inter WHERE url_sitio IS NOT NULL)
      WHERE nodo IS NOT NULL GROUP BY id_usuario, via, nodo) a
  ON a.id_usuario = c.id_usuario AND a.via = c.via AND a.nodo = c.nodo
WHERE c.nodo IS NOT NULL""", t, "inter")
    return "graph_paths"


@register("graph_paths", O.sql("SELECT * FROM graph_paths", _paths_fragment()))
def _graph_paths(p: Pipeline) -> DataFrame:
    """2-hop paths from each user's history to each retrieved site."""
    return GR.history_paths(p.interactions, p.topk_places(6))


# Two hops from a user's visits to what the sites have, a third one to the
# region of a city or back to a retrieved site with the same.
PATTERNS = [("VISITO", "UBICADO_EN"), ("VISITO", "PERTENECE_A"), ("VISITO", "OFRECE_ASPECTO"), ("VISITO", "UBICADO_EN", "UBICADO_EN")]
TO_RETRIEVED = tuple(("VISITO", r, "~" + r) for r in ("UBICADO_EN", "PERTENECE_A", "OFRECE_ASPECTO"))
_PREFIXES = sorted({(">".join(q[:i]), q[i]) for q in (*PATTERNS, *TO_RETRIEVED) for i in range(len(q))})
_TEXT = {True: [">".join(q) for q in TO_RETRIEVED], False: [">".join(q) for q in PATTERNS]}


@register("graph_paths_k", O.sql(f"""
SELECT * FROM (
  WITH RECURSIVE e AS (
    SELECT DISTINCT id_usuario AS origen, url_sitio AS destino, 'VISITO' AS r FROM inter WHERE url_sitio IS NOT NULL
    UNION SELECT url_sitio, ubicacion, 'UBICADO_EN' FROM catalog
    UNION SELECT n.n_name, r.r_name, 'UBICADO_EN' FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
          WHERE n.n_name IN (SELECT ubicacion FROM catalog)
    UNION SELECT url_sitio, categoria_sitio, 'PERTENECE_A' FROM catalog
    UNION SELECT url_sitio, aspecto, 'OFRECE_ASPECTO' FROM aspect_mentions),
  steps AS (SELECT origen AS desde, destino AS hasta, r AS paso FROM e WHERE origen IS NOT NULL AND destino IS NOT NULL
            UNION ALL SELECT destino, origen, '~' || r FROM e WHERE origen IS NOT NULL AND destino IS NOT NULL),
  allowed(tipo, paso) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _PREFIXES)}),
  walks AS (
    SELECT id_usuario AS inicio, '' AS tipo, 0 AS saltos, id_usuario AS nodo FROM prof
    UNION ALL
    SELECT w.inicio, CASE WHEN w.tipo = '' THEN s.paso ELSE w.tipo || '>' || s.paso END, w.saltos + 1, s.hasta
    FROM walks w JOIN steps s ON s.desde = w.nodo JOIN allowed a ON a.tipo = w.tipo AND a.paso = s.paso)
  SELECT inicio, tipo, saltos, nodo, count(*) AS caminos FROM walks
  WHERE tipo IN ({', '.join(repr(x) for x in _TEXT[False])})
     OR (tipo IN ({', '.join(repr(x) for x in _TEXT[True])})
         AND (inicio, nodo) IN (SELECT (id_usuario, url_sitio) FROM {O.topk_places_fragment(6)}))
  GROUP BY ALL)""", "prof", "inter", "catalog", "aspect_mentions", O.topk_places_fragment(6)))
def _graph_paths_k(p: Pipeline) -> DataFrame:
    """Numbers of paths of two and three hops over the edge table, from
    every user to what the visited sites have and on to the regions and the
    retrieved sites."""
    retrieved = p.topk_places(6).select(F.col("id_usuario").alias("inicio"), F.col("url_sitio").alias("nodo"))
    return PC.path_counts(_graph_edges(p), p.profiles.select(F.col("id_usuario").alias("inicio")), [*PATTERNS, *TO_RETRIEVED],
                          retrieved, TO_RETRIEVED)


@register("graph_context", O.sql(f"""
SELECT id_usuario, CAST(count(*) AS INTEGER) AS caminos,
  concat(string_agg({render_sql(GR.PATH_TEMPLATE, nombre_sitio='nombre_sitio', via='via', nodo='nodo', soporte='soporte')},
                    '. ' ORDER BY rank, via), '.') AS contexto_grafo
FROM graph_paths GROUP BY id_usuario""", _paths_fragment()))
def _graph_context(p: Pipeline) -> DataFrame:
    """Path sentences per user, ready to be injected into a prompt."""
    return GR.graph_context(GR.history_paths(p.interactions, p.topk_places(6)))


@register("prompt_graph", O.sql(f"""
SELECT l.id_usuario, l.n_candidatos,
  {render_sql(fixed.DIRECT_PROMPT_TEMPLATE, top_n="'3'", user_context="concat_ws(chr(10), u.contexto, g.contexto_grafo)", candidates_json='l.candidates_json')} AS prompt
FROM direct_lists l JOIN user_texts u ON u.id_usuario = l.id_usuario
LEFT JOIN (SELECT id_usuario,
  concat(string_agg({render_sql(GR.PATH_TEMPLATE, nombre_sitio='nombre_sitio', via='via', nodo='nodo', soporte='soporte')},
                    '. ' ORDER BY rank, via), '.') AS contexto_grafo
  FROM graph_paths GROUP BY id_usuario) g ON g.id_usuario = l.id_usuario""", "direct_lists", "user_texts", _paths_fragment()))
def _prompt_graph(p: Pipeline) -> DataFrame:
    """The direct prompt with the path sentences in the user's context."""
    topk = p.topk_places(6)
    paths = GR.graph_context(GR.history_paths(p.interactions, topk))
    return PR.direct_prompts(p.user_texts, topk, 3, context=paths).select("id_usuario", "n_candidatos", "prompt")


# --- text signals ---------------------------------------------------------------------------------
@register("implicit_vectors", O.sql(f"""
SELECT t.id_usuario, t.bucket, round(t.t / n.c, 6) AS valor FROM (
  SELECT id_usuario, {O.bucket_sql('tok')} AS bucket, count(*) AS t FROM (
    SELECT id_usuario, unnest(string_split(lower(comentario), ' ')) AS tok FROM inter WHERE comentario IS NOT NULL)
  GROUP BY id_usuario, bucket) t
JOIN (SELECT id_usuario, count(*) AS c FROM inter WHERE comentario IS NOT NULL GROUP BY id_usuario) n
  ON n.id_usuario = t.id_usuario""", "inter"))
def _implicit_vectors(p: Pipeline) -> DataFrame:
    """Implicit-only user vectors from whole comment texts."""
    return TS.implicit_vectors(p.commented)


def _enrichment_texts(p: Pipeline) -> DataFrame:
    b = table(p.spark, p.sf_dir, "benchmark")
    return b.select(F.concat(F.lit("site/"), F.col("item_id").cast("string")).alias("url_sitio"),
                    F.col("text").alias("texto"))


@register("item_enrichment", O.sql("""
SELECT t.url_sitio, CAST(b.text IS NOT NULL AS INTEGER) AS enriquecido,
  CASE WHEN b.text IS NOT NULL THEN concat_ws(' ', t.documento, b.text) ELSE t.documento END AS documento_enriquecido,
  CAST(len(string_split(lower(CASE WHEN b.text IS NOT NULL THEN concat_ws(' ', t.documento, b.text) ELSE t.documento END), ' ')) AS INTEGER) AS tokens
FROM place_texts t LEFT JOIN benchmark b ON concat('site/', CAST(b.item_id AS VARCHAR)) = t.url_sitio""", "place_texts"))
def _item_enrichment(p: Pipeline) -> DataFrame:
    """Site documents extended with the external passage of the site."""
    return TS.item_enrichment(p.place_texts, _enrichment_texts(p))


@register("aspect_polarity", O.sql("SELECT * FROM aspect_mentions", "aspect_mentions"))
def _aspect_polarity(p: Pipeline) -> DataFrame:
    """Aspect mentions in whole comments with comment polarity."""
    return TS.aspect_mentions(p.commented)


@register("geo_grounding", O.sql(f"""
SELECT r.id_usuario, r.rank, r.url_sitio, r.ubicacion,
  CAST(instr(u.contexto, r.ubicacion) > 0 AS INTEGER) AS fundamentado
FROM {O.topk_places_fragment(6)} r JOIN user_texts u ON u.id_usuario = r.id_usuario""",
    O.topk_places_fragment(6), "user_texts"))
def _geo_grounding(p: Pipeline) -> DataFrame:
    """Is each recommended location named in the user's own context."""
    return TS.geo_grounding(p.topk_places(6), p.user_texts)


_NEARBY = " Cerca de {siguiente}."


def _words_sql(c: str) -> str:
    return f"' ' || trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')) || ' '"


@register("justification_grounding", O.sql(f"""
SELECT id_usuario, posicion, count(n) AS n_nombrados, count(n) FILTER (WHERE NOT ok) AS n_no_declarados,
  coalesce(string_agg(trim(n), '; ' ORDER BY trim(n)) FILTER (WHERE NOT ok), '') AS no_declarados,
  CAST(count(n) FILTER (WHERE NOT ok) = 0 AS INTEGER) AS fundamentado
FROM (
  WITH names AS (SELECT DISTINCT {_words_sql('x')} AS n FROM (
                   SELECT nombre_sitio AS x FROM catalog UNION ALL SELECT ubicacion FROM catalog)
                 WHERE regexp_matches(x, '[\\p{{L}}\\p{{M}}\\p{{N}}]')),
  listed AS (SELECT *, lead(nombre_sitio) OVER (PARTITION BY id_usuario ORDER BY rank) AS siguiente FROM {O.topk_places_fragment(6)}),
  items AS (SELECT id_usuario, CAST(rank AS INTEGER) AS posicion,
              {_words_sql(render_sql(DIRECT_REASON + _NEARBY, categoria_sitio='categoria_sitio', ubicacion='ubicacion', siguiente='siguiente'))} AS j,
              {_words_sql("concat_ws(' . ', nombre_sitio, ubicacion)")} AS own FROM listed WHERE rank <= 3),
  ctx AS (SELECT id_usuario AS u, {_words_sql("coalesce(contexto, '')")} AS c FROM user_texts),
  hits AS (SELECT i.*, n FROM items i JOIN names ON contains(i.j, n))
  SELECT i.id_usuario, i.posicion, h.n, coalesce(contains(h.own, h.n) OR contains(c.c, h.n), false) AS ok
  FROM items i LEFT JOIN hits h USING (id_usuario, posicion) LEFT JOIN ctx c ON c.u = i.id_usuario)
GROUP BY id_usuario, posicion""", O.topk_places_fragment(6), "user_texts", "catalog"))
def _justification_grounding(p: Pipeline) -> DataFrame:
    """The places that the justifications of the first three items name
    (each also names the next candidate), and those that neither the user's
    context nor the item itself declares."""
    topk = p.topk_places(6)
    following = F.lead("nombre_sitio").over(Window.partitionBy("id_usuario").orderBy("rank"))
    items = topk.withColumn("siguiente", following).where("rank <= 3").select(
        "id_usuario", F.col("rank").cast("int").alias("posicion"), "nombre_sitio", "ubicacion",
        render(DIRECT_REASON + _NEARBY, **{c: F.col(c) for c in ("categoria_sitio", "ubicacion", "siguiente")}).alias("justificacion"))
    return GD.ground_justifications(items, p.user_texts, write_once(GD.place_dictionary(p.catalog), "place-names"))


_FORMS_SQL = """(SELECT 'explicita' AS forma, narrativa_explicita AS texto FROM user_texts
      UNION ALL SELECT 'implicita', narrativa_implicita FROM user_texts
      UNION ALL SELECT 'documento', documento FROM user_texts
      UNION ALL SELECT 'contexto', contexto FROM user_texts
      UNION ALL SELECT 'sitio', documento FROM place_texts)"""


def _forms(p: Pipeline) -> DataFrame:
    forms = F.array(*[F.struct(F.lit(form).alias("forma"), F.col(c).alias("texto")) for form, c in (
        ("explicita", "narrativa_explicita"), ("implicita", "narrativa_implicita"), ("documento", "documento"), ("contexto", "contexto"))])
    users = p.user_texts.select(F.explode(forms).alias("f")).select("f.forma", "f.texto")
    return users.unionByName(p.place_texts.select(F.lit("sitio").alias("forma"), F.col("documento").alias("texto")))


@register("narrative_stats", O.sql(f"""
SELECT forma, count(*) AS n, round(avg(length(texto)), 4) AS caracteres_medios,
  CAST(max(length(texto)) AS INTEGER) AS caracteres_max,
  round(avg(len(string_split(lower(texto), ' '))), 4) AS tokens_medios
FROM {_FORMS_SQL}
WHERE texto IS NOT NULL AND texto <> '' GROUP BY forma""", "user_texts", "place_texts"))
def _narrative_stats(p: Pipeline) -> DataFrame:
    """Length and token statistics of every narrative form."""
    return TS.narrative_stats(_forms(p))


_POINTS_SQL = f"CAST([{', '.join(map(str, TS.PERCENTILES))}] AS DOUBLE[])"


@register("narrative_percentiles", O.sql(f"""
SELECT forma, medida, percentil, round(valor, 4) AS valor FROM (
  SELECT forma, medida, unnest({_POINTS_SQL}) AS percentil, unnest(quantile_cont(v, [{', '.join(map(str, TS.PERCENTILES))}])) AS valor FROM (
    SELECT forma, 'caracteres' AS medida, CAST(length(texto) AS DOUBLE) AS v FROM {_FORMS_SQL} WHERE texto <> ''
    UNION ALL SELECT forma, 'tokens', CAST(len(string_split(lower(texto), ' ')) AS DOUBLE) FROM {_FORMS_SQL} WHERE texto <> '')
  GROUP BY forma, medida)""", "user_texts", "place_texts"))
def _narrative_percentiles(p: Pipeline) -> DataFrame:
    """Percentiles of characters and tokens of every narrative form."""
    return TS.narrative_percentiles(_forms(p))


# --- collaborative baseline, calibration ------------------------------------------------


@register("cf_cooccurrence", O.sql(f"""
SELECT id_usuario, CAST(rank AS INTEGER) AS rank, url_sitio, puntuacion FROM (
  WITH v AS (SELECT DISTINCT id_usuario AS u, url_sitio AS i FROM inter WHERE url_sitio IS NOT NULL),
  c AS (SELECT i, count(*) AS n FROM v GROUP BY i),
  p AS (SELECT a.i, b.i AS j, count(*) AS n FROM v a JOIN v b ON a.u = b.u AND a.i <> b.i GROUP BY a.i, b.i),
  near AS (SELECT p.i, j, p.n / sqrt(CAST(x.n * y.n AS DOUBLE)) AS sim FROM p JOIN c x ON x.i = p.i JOIN c y ON y.i = p.j
           QUALIFY row_number() OVER (PARTITION BY p.i ORDER BY p.n / sqrt(CAST(x.n * y.n AS DOUBLE)) DESC, j) <= {CO.NEIGHBOURS}),
  s AS (SELECT u, j, round(sum(sim), 6) AS s FROM v JOIN near USING (i) GROUP BY u, j)
  SELECT u AS id_usuario, j AS url_sitio, s AS puntuacion, row_number() OVER (PARTITION BY u ORDER BY s DESC, j) AS rank
  FROM s WHERE (u, j) NOT IN (SELECT (u, i) FROM v) AND j IN (SELECT url_sitio FROM catalog))
WHERE rank <= {EVAL_N}""", "inter", "catalog"))
def _cf_cooccurrence(p: Pipeline) -> DataFrame:
    """Top-10 unvisited sites by co-occurrence with the visited ones."""
    return CO.cooccurrence_recommendations(p.consumed, p.catalog, EVAL_N)


@register("cf_als")
def _cf_als(p: Pipeline) -> DataFrame:
    """E23 (learned variant): implicit ALS factors, exact top-10 by inner
    product with consumed sites excluded."""
    return CF.cf_recommendations(p.interactions, p.consumed, EVAL_N)


@register("json_valid_rate", O.sql(f"""
SELECT cfg.k AS top_k, cfg.n AS top_n, count(DISTINCT t.id_usuario) AS respuestas,
  count(DISTINCT CASE WHEN CAST(t.id_usuario AS BIGINT) % 7 NOT IN ({_NO_JSON}, {_NO_LIST}) THEN t.id_usuario END) AS validas,
  round(count(DISTINCT CASE WHEN CAST(t.id_usuario AS BIGINT) % 7 NOT IN ({_NO_JSON}, {_NO_LIST}) THEN t.id_usuario END)
        / count(DISTINCT t.id_usuario), 6) AS tasa
FROM {O.topk_places_fragment(max(k for k, _ in SWEEP))} t
JOIN (VALUES {', '.join(f'({k}, {n})' for k, n in SWEEP)}) cfg(k, n) ON t.rank <= least(cfg.k, cfg.n)
GROUP BY cfg.k, cfg.n""", O.topk_places_fragment(max(k for k, _ in SWEEP))))
def _json_valid_rate(p: Pipeline) -> DataFrame:
    """Share of well-formed answers per (K, N) configuration, as the
    parser finds them in answers some of which are malformed."""
    hits = p.topk_places(max(k for k, _ in SWEEP))
    sweep = R.config_sweep(hits, SWEEP, [fixed.DEFAULT_GENERATOR], carry=("nombre_sitio", "categoria_sitio", "ubicacion"))
    sweep = sweep.withColumn("justificacion", F.lit("")).withColumn(
        "cfg_user", F.concat_ws("|", "top_k", "top_n", "id_usuario"))
    answers = _mixed_answers(sweep, "cfg_user")
    _, rejected = G.parse_responses(answers, "cfg_user", "direct", max(n for _, n in SWEEP))
    status = answers.select("cfg_user").join(
        rejected.where("estado <> 'excedente'").select("cfg_user", F.lit(1).alias("bad")), "cfg_user", "left")
    parts = F.split("cfg_user", r"\|")
    return status.groupBy(parts[0].cast("int").alias("top_k"), parts[1].cast("int").alias("top_n")).agg(
        F.count(F.lit(1)).alias("respuestas"),
        F.count(F.when(F.col("bad").isNull(), 1)).alias("validas"),
    ).withColumn("tasa", F.round(F.col("validas") / F.col("respuestas"), 6))
