"""Inputs as users have them: quoted cells, text ids, repeated ids, failures."""

import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from sendero.operators import collaborative as CF
from sendero.operators import generate as G
from sendero.operators import prompts as PR
from sendero.operators import text_signals as TS
from sendero.operators.clean import clean_interactions, clean_profiles
from sendero.operators.embed import HashedTokenEmbedder
from sendero.operators.similarity import _select_topk, block_rows, plan_blocks
from sendero.plans.pipeline import Pipeline
from sendero.sources.csv import read_interactions_csv, read_profiles_csv
from sendero.sources.index import PLACE_METADATA, VectorIndex

PROFILES = '''id_usuario,nombre,edad,tipo_viajero
1,"Ana ""La""
dos lineas, B",25.0,Cultural
2,Luis,x,Relax
1,Otra,30,Aventura
'''
INTERACTIONS = '''id_interaccion,id_usuario,fecha_interaccion,url_sitio,nombre_sitio,categoria_sitio,ubicacion,tipo_interaccion,comentario
INT-1,1,2024-01-02,a,A,c,u,Reserva,"buen
servicio, ""muy"" bueno"
INT-2,2,2024-01-01,b,B,c,u,Click,
INT-3,2,2024-01-03,a,A segunda,c,u,Click,
INT-4,2,2024-01-04,c,C,d,v,Click,
'''


@pytest.fixture()
def files(tmp_path):
    p, i = tmp_path / "p.csv", tmp_path / "i.csv"
    p.write_text(PROFILES, encoding="latin-1")
    i.write_text(INTERACTIONS, encoding="latin-1")
    return str(p), str(i)


def test_quoted_cells_fractions_and_repeated_profiles(spark, files):
    rows = {r.id_usuario: r for r in clean_profiles(read_profiles_csv(spark, files[0])).collect()}
    assert set(rows) == {"1", "2"}
    assert rows["1"].nombre == 'Ana "La"\ndos lineas, B' and rows["1"].edad == 25 and rows["2"].edad is None


def test_text_ids_keep_the_file_order(spark, files):
    p = Pipeline.from_csv(spark, *files)
    assert {(r.url_sitio, r.nombre_sitio) for r in p.catalog.collect()} == {("a", "A"), ("b", "B"), ("c", "C")}
    assert [r.url_sitio for r in p.topk_places(3).where("id_usuario = '2'").collect()] == []
    assert {r.url_sitio for r in p.topk_places(3).where("id_usuario = '1'").collect()} == {"b", "c"}
    comment = [r.comentario for r in read_interactions_csv(spark, files[1]).collect()][0]
    assert comment == 'buen\nservicio, "muy" bueno'


def test_an_order_always_exists(spark):
    raw = spark.createDataFrame([("x", "1", "2024-01-02", "a", "second"), ("y", "1", "2024-01-01", "a", "first"), (None, "1", None, "b", "B")],
                                "id_interaccion string, id_usuario string, fecha_interaccion string, url_sitio string, nombre_sitio string")
    rows = clean_interactions(raw).orderBy("orden").collect()
    assert all(r.orden is not None for r in rows)
    assert [r.nombre_sitio for r in rows if r.url_sitio == "a"] == ["first", "second"]


def test_comments_without_url_stay_apart(spark):
    raw = spark.createDataFrame([("1", "u", None, "El servicio es bueno"), ("2", "u", "s", "El servicio es bueno"), ("k", "v", None, "mal servicio malo")],
                                "id_interaccion string, id_usuario string, url_sitio string, comentario string")
    rows = TS.aspect_mentions(clean_interactions(raw)).collect()
    assert sorted((str(r.id_interaccion), r.url_sitio is None, r.aspecto, r.polaridad) for r in rows) == [
        ("1", True, "servicio", 1), ("2", False, "servicio", 1), ("None", True, "servicio", -1)]


def _rows(spark, rows):
    return spark.createDataFrame([(i, d, [1.0], (n, None, None, i)) for i, d, n in rows],
                                 "id string, document string, embedding array<double>, "
                                 "metadata struct<nombre_sitio:string,categoria_sitio:string,ubicacion:string,url_sitio:string>")


def test_collections_survive_repeats_and_failed_writes(spark, tmp_path):
    idx = VectorIndex(spark, str(tmp_path / "c"), PLACE_METADATA)
    batch = _rows(spark, [("a", "d1", "x"), ("b", "d2", "x"), ("a", "d3", "x")])
    idx.upsert(batch)
    idx.upsert(batch)
    idx.insert_new(_rows(spark, [("c", "d", "x"), ("c", "e", "x"), ("a", "new", "x")]))
    want = {("a", "d3"), ("b", "d2"), ("c", "e")}
    assert idx.count() == 3 and {(r.id, r.document) for r in idx.read().collect()} == want
    before = idx.read()
    broken = batch.withColumn("document", F.raise_error(F.lit("lost midway")).cast("string"))
    with pytest.raises(Exception, match="lost midway"):
        idx.overwrite(broken)
    with pytest.raises(Exception, match="lost midway"):
        idx.upsert(broken)
    assert {(r.id, r.document) for r in idx.read().collect()} == want
    idx.upsert(_rows(spark, [("b", "later", "x")]))
    assert {(r.id, r.document) for r in before.collect()} == want  # a reader of the version before
    assert {(r.id, r.document) for r in idx.read().collect()} == {("a", "d3"), ("b", "later"), ("c", "e")}


def test_one_failing_call_is_one_row(spark):
    prompts = spark.createDataFrame([(str(i), "m", "p" if i != 3 else "bad") for i in range(6)], "id_usuario string, modelo_usado string, prompt string")

    def client(pdf: pd.DataFrame):
        if (pdf["prompt"] == "bad").any():
            raise ValueError("refused")
        return ['{"recomendaciones": []}'] * len(pdf)

    answers = G.generate(prompts, "id_usuario", client)
    assert [(r.id_usuario, r.error) for r in answers.where("error is not null").collect()] == [("3", "ValueError: refused")]
    _, rejected = G.parse_responses(answers, "id_usuario", "direct")
    assert {(r.id_usuario, r.estado) for r in rejected.collect()} == {("3", "sin_respuesta")} | {(str(i), "lista_vacia") for i in (0, 1, 2, 4, 5)}


def test_surplus_items_are_rejected_with_a_reason(spark):
    answers = spark.createDataFrame([("u", "m", '{"recomendaciones": [{"nombre_sitio": "A"}, {"nombre_sitio": "B"}, {"nombre_sitio": "C"}]}')],
                                    "id_usuario string, modelo_usado string, respuesta string")
    items, rejected = G.parse_responses(answers, "id_usuario", "direct", 2)
    assert [r.nombre_sitio for r in items.orderBy("posicion").collect()] == ["A", "B"]
    assert [(r.estado, "C" in r.respuesta) for r in rejected.collect()] == [("excedente", True)]


def test_n_over_k_warns():
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert PR.check_k_n(2, 5) == 2
    assert len(seen) == 1


def test_ties_are_exact_and_vectorised():
    rng = np.random.default_rng(0)
    S = rng.integers(0, 4, (200, 30)).astype(float)
    S[rng.random(S.shape) < 0.2] = -np.inf
    for k in (1, 5, 29, 30, 40):
        idx, vals = _select_topk(S, k)
        want = np.array([sorted(range(30), key=lambda c, r=r: (-r[c], c))[:k] for r in S])
        finite = np.isfinite(vals)
        assert (idx[finite] == want[finite]).all() and (np.take_along_axis(S, want, 1) == vals).all()


def test_blocks_follow_the_vector_length():
    assert block_rows(4096) * 4096 * 8 <= 128 << 20 and block_rows(64) > block_rows(4096)
    blocks, groups = plan_blocks(10_000, 10, 8, block_rows(64), block_rows(64))
    assert blocks == 1 and groups == 16
    # Few queries against many items: blocks of items instead of copies of them.
    blocks, groups = plan_blocks(1_000, 15_000, 8, block_rows(64), block_rows(64))
    assert blocks > 1 and blocks * groups >= 16


def test_requested_subjects_alone_are_scored(spark):
    p = Pipeline(spark, SF_SMALL)
    everyone = {(r.id_usuario, r["rank"]): r.url_sitio for r in p.recommend_direct().collect()}
    embedded = []

    class Spy(HashedTokenEmbedder):
        def __call__(self, df, id_col, text_col):
            embedded.append((id_col, df.count()))
            return super().__call__(df, id_col, text_col)

    q = Pipeline(spark, SF_SMALL, embedder=Spy())
    got = {(r.id_usuario, r["rank"]): r.url_sitio for r in q.lookup_user(" 4 ").collect()}
    assert got == {k: v for k, v in everyone.items() if k[0] == "4"} and got
    assert ("id_usuario", 1) in embedded and max(n for c, n in embedded if c == "id_usuario") == 1


def test_als_lists_against_brute_force(spark):
    p = Pipeline(spark, SF_SMALL)
    factors = tuple(x.cache() for x in CF.als_factors(p.interactions))
    users, items = (f.collect() for f in factors)
    rows = CF.cf_recommendations(p.interactions, p.consumed, 10, factors).collect()
    consumed = {(r.id_usuario, r.url_sitio) for r in p.consumed.collect()}
    assert rows and not {(r.id_usuario, r.url_sitio) for r in rows} & consumed
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.id_usuario, []).append(r.puntuacion)
    for u in users:
        scores = sorted((float(np.dot(u.embedding, i.embedding)) for i in items if (u.id_usuario, i.url_sitio) not in consumed), reverse=True)[:10]
        assert got.get(u.id_usuario, []) == pytest.approx(scores, abs=1e-4)
