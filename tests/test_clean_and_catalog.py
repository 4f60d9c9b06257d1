"""Cleaning and catalogue rules (FIXTURES §3)."""

from conftest import inter_rows
from sendero.operators.aggregates import consumed_sites, place_catalog, place_selector
from sendero.sources.csv import read_profiles_csv


def test_blank_and_null_users_dropped(spark):
    rows = [{"id_interaccion": "1", "id_usuario": None, "url_sitio": "a"},
            {"id_interaccion": "2", "id_usuario": "  ", "url_sitio": "a"},
            {"id_interaccion": "3", "id_usuario": " 7 ", "url_sitio": "a"}]
    got = [r["id_usuario"] for r in inter_rows(spark, rows).collect()]
    assert got == ["7"]


def test_first_row_without_name_loses_site(spark):
    rows = [{"id_interaccion": "1", "id_usuario": "u", "url_sitio": "a", "nombre_sitio": None},
            {"id_interaccion": "2", "id_usuario": "u", "url_sitio": "a", "nombre_sitio": "N1"},
            {"id_interaccion": "3", "id_usuario": "u", "url_sitio": None, "nombre_sitio": "X"},
            {"id_interaccion": "4", "id_usuario": "u", "url_sitio": " b ", "nombre_sitio": "B"},
            {"id_interaccion": "5", "id_usuario": "u", "url_sitio": "b", "nombre_sitio": "B2"}]
    inter = inter_rows(spark, rows)
    assert sorted(r["url_sitio"] for r in place_catalog(inter).collect()) == ["b"]
    sel = {r["url_sitio"]: r["nombre_sitio"] for r in place_selector(inter).collect()}
    assert sel["a"] is None and sel["b"] == "B"
    assert sorted(r["url_sitio"] for r in consumed_sites(inter).collect()) == ["a", "b"]


def test_csv_padded_header_latin1_null_tokens(spark, tmpdir_path):
    path = f"{tmpdir_path}/p.csv"
    with open(path, "wb") as f:
        f.write(" id_usuario , edad,nombre,tipo_viajero\n 7 ,30,Jos\xe9,N/A\n".encode("latin-1"))
    df = read_profiles_csv(spark, path)
    r = df.first()
    assert r["edad"] == "30" and r["nombre"] == "José" and r["tipo_viajero"] is None
    assert r["id_usuario"] == " 7 " and "genero" in df.columns
