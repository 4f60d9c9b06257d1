"""Lookups, sweep capping, metrics on hand-computed fixtures, ILD identity,
graph paths, pipeline parameters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from sendero.operators import evaluate as E
from sendero.operators import graph as GR
from sendero.operators import lookups as L
from sendero.operators import recommend as R
from sendero.plans.pipeline import Pipeline


def test_labels_parse_back(spark):
    prof = spark.createDataFrame([("7", "Ana - B"), ("8", None)], "id_usuario string, nombre string")
    got = {r["etiqueta"]: r["id_parseado"] for r in L.user_labels(prof).collect()}
    assert got == {"7 - Ana - B": "7", "8 - ": "8"}
    sel = spark.createDataFrame([("site/1", "N", "C", "L")], "url_sitio string, nombre_sitio string, categoria_sitio string, ubicacion string")
    r = L.place_labels(sel).first()
    assert r["etiqueta"] == "N (C - L) | ID: site/1" and r["id_parseado"] == "site/1"


def test_sweep_caps_n_by_k(spark):
    cands = spark.createDataFrame([("u", i, f"s{i}") for i in range(1, 6)], "id_usuario string, rank int, url_sitio string")
    rows = R.config_sweep(cands, [(2, 5), (5, 3)], ["m"]).collect()
    per = {}
    for r in rows:
        per.setdefault((r["top_k"], r["top_n"]), []).append(r["rank"])
    assert sorted(per[(2, 5)]) == [1, 2] and sorted(per[(5, 3)]) == [1, 2, 3]


def test_ranking_metrics_hand_computed(spark):
    recs = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1), ("b", "w", 2)],
                                 "id_usuario string, url_sitio string, rank int")
    rel = spark.createDataFrame([("a", "y"), ("a", "q"), ("b", "nope")], "id_usuario string, url_sitio string")
    prof = spark.createDataFrame([("a",), ("b",)], "id_usuario string")
    m = {r["metrica"]: r["valor"] for r in E.ranking_metrics(E.user_ranking_stats(recs, rel, prof), 2, "t").collect()}
    assert m["hit_rate"] == 0.5
    assert m["mrr"] == 0.25
    assert m["precision"] == 0.25
    assert m["recall"] == 0.25
    ndcg_a = (1 / math.log2(3)) / (1 + 1 / math.log2(3))
    assert m["ndcg"] == pytest.approx(round(ndcg_a / 2, 6))


def test_ild_identity_matches_pairs(spark):
    rng = np.random.default_rng(5)
    vecs = {f"s{i}": rng.random(6) for i in range(5)}
    v = spark.createDataFrame([(k, x.tolist()) for k, x in vecs.items()], "url_sitio string, embedding array<double>")
    recs = spark.createDataFrame([("u", k) for k in vecs], "id_usuario string, url_sitio string")
    got = E.intra_list_diversity(recs, v).first()["diversidad"]
    keys = list(vecs)
    unit = {k: x / np.linalg.norm(x) for k, x in vecs.items()}
    pairs = [1 - unit[a] @ unit[b] for i, a in enumerate(keys) for b in keys[i + 1:]]
    assert got == pytest.approx(np.mean(pairs), abs=1e-6)


def test_leave_one_out_holds_latest_new_site(spark):
    inter = spark.createDataFrame(
        [(1, "u", "a"), (2, "u", "b"), (3, "u", "a"), (4, "u", "c"), (5, "u", "b")],
        "id_interaccion long, id_usuario string, url_sitio string").withColumn("orden", F.col("id_interaccion"))
    held, train = E.leave_one_out(inter)
    assert [tuple(r) for r in held.collect()] == [("u", "c")]
    assert sorted(r["id_interaccion"] for r in train.collect()) == [1, 2, 3, 5]


def test_history_paths(spark):
    inter = spark.createDataFrame([("u", "h1", "C1", "L1"), ("u", "h2", "C1", "L2")],
                                  "id_usuario string, url_sitio string, categoria_sitio string, ubicacion string")
    cands = spark.createDataFrame([("u", "s", 1, "S", "C1", "L9")],
                                  "id_usuario string, url_sitio string, rank int, nombre_sitio string, categoria_sitio string, ubicacion string")
    paths = GR.history_paths(inter, cands).collect()
    assert [(r["via"], r["nodo"], r["soporte"]) for r in paths] == [("categoría", "C1", 2)]
    ctx = GR.graph_context(GR.history_paths(inter, cands)).first()["contexto_grafo"]
    assert ctx == "S comparte categoría C1 con 2 sitio(s) de su historial."


def test_custom_user_document_and_lookup(spark):
    p = Pipeline(spark, SF_SMALL, user_document=lambda e, i: e)
    docs = p.user_texts.select("documento", "narrativa_explicita").collect()
    assert all(r[0] == r[1] for r in docs)
    one = Pipeline(spark, SF_SMALL).lookup_user(" 3 ", 6, 3).collect()
    assert {r["id_usuario"] for r in one} == {"3"} and len(one) == 3
    with pytest.raises(ValueError):
        Pipeline(spark, SF_SMALL).lookup_user("no-such-user")
    site = Pipeline(spark, SF_SMALL).lookup_site(" site/3 ", 10, 2).collect()
    assert {r["url_sitio"] for r in site} == {"site/3"} and len(site) == 2
    with pytest.raises(ValueError):
        Pipeline(spark, SF_SMALL).lookup_site("site/none")


def test_dense_index(spark):
    from sendero.operators.collaborative import dense_index

    df = spark.range(0, 500).select((F.col("id") % 137).cast("string").alias("k")).repartition(7)
    idx = dense_index(df, "k", "i").collect()
    assert sorted(r["i"] for r in idx) == list(range(137))
    assert len({r["k"] for r in idx}) == 137


def test_custom_batch_embedder(spark):
    from sendero.operators.embed import PandasEmbedder, TableEmbedder

    def letters(texts):
        return [[float(t.lower().count(c)) for c in "aeiou"] for t in texts]

    p = Pipeline(spark, SF_SMALL, embedder=PandasEmbedder(letters))
    recs = p.topk_places(3).collect()
    assert recs and {r["rank"] for r in recs} <= {1, 2, 3}
    plan = p.place_vectors._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan
    vecs = spark.createDataFrame([("a", [1.0, 2.0])], "k string, embedding array<float>")
    rows = spark.createDataFrame([("u1", "a"), ("u2", "b")], "id string, k string")
    got = TableEmbedder(vecs, "k")(rows, "id").collect()
    assert [(r["id"], r["embedding"]) for r in got] == [("u1", [1.0, 2.0])]


def test_protocols_read_written_interactions(spark):
    from sendero.plans.pipeline import Pipeline
    from sendero.plans.registered import evaluation as V

    p = Pipeline(spark, "/root/testdata/sf0.001")
    plain = p.interactions
    p.keep_interactions()
    assert sorted(map(str, p.interactions.collect())) == sorted(map(str, plain.collect()))
    tp, held = V._protocol_data(p, "leave_one_out")
    # Parsing, joins with parts and the held-out pairs are done once, not by each reader.
    for frame in (p.interactions, tp.interactions, held):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1 and "Join" not in plan and "events.parquet" not in plan
    want_held, want_train = V.E.leave_one_out(plain)
    assert sorted(map(str, held.collect())) == sorted(map(str, want_held.collect()))
    assert sorted(map(str, tp.interactions.collect())) == sorted(map(str, want_train.collect()))


def test_diversity_makes_no_row_per_vector_element(spark):
    rng = np.random.default_rng(2)
    vec = {f"s{i}": rng.random(16) for i in range(6)}
    lists = {"a": ["s0", "s1", "s2"], "b": ["s3", "s4"], "one": ["s5"], "none": ["x", "y"], "part": ["s0", "x"]}
    vectors = spark.createDataFrame([(s, v.tolist()) for s, v in vec.items()], "url_sitio string, embedding array<double>")
    recs = spark.createDataFrame([(u, s) for u, sites in lists.items() for s in sites], "id_usuario string, url_sitio string")
    frame = E.intra_list_diversity(recs, vectors)
    assert "Generate" not in frame._jdf.queryExecution().executedPlan().toString()
    want = []
    for sites in (x for x in lists.values() if len(x) > 1 and any(s in vec for s in x)):
        total = sum(vec[s] / np.linalg.norm(vec[s]) for s in sites if s in vec)
        want.append(1 - (total @ total - len(sites)) / (len(sites) * (len(sites) - 1)))
    row = frame.first()
    assert row.usuarios == 3 and abs(row.diversidad - sum(want) / 3) < 1e-6
