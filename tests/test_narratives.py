"""Narratives and per-user picks on literal edge fixtures (FIXTURES §3)."""

from pyspark.sql import functions as F

from conftest import inter_rows
from sendero.functions import narratives as N
from sendero.functions.text import multi_value_text
from sendero.operators.aggregates import implicit_profile
from sendero.operators.clean import clean_profiles


def _row(i, **kw):
    base = {"id_interaccion": str(i), "id_usuario": "u1", "url_sitio": f"s{i}", "nombre_sitio": f"N{i}",
            "categoria_sitio": "C", "ubicacion": "L", "tipo_interaccion": "Click"}
    base.update(kw)
    return base


def _implicit(spark, rows, columns=None):
    out = implicit_profile(inter_rows(spark, rows, columns)).collect()
    return {r["id_usuario"]: r for r in out}


def test_multi_value_text(spark):
    df = spark.createDataFrame([("|a|b|",), ("a",), (None,)], "x string")
    got = [r[0] for r in df.select(multi_value_text(F.col("x"))).collect()]
    assert got == ["a, b", "a", ""]


def test_explicit_null_cell_is_empty(spark):
    prof = clean_profiles(spark.createDataFrame([("7", "Ana", "30", None)], "id_usuario string, nombre string, edad string, tipo_viajero string"))
    text = prof.select(N.explicit_narrative()).first()[0]
    assert "Tipo de viajero:  con presupuesto" in text
    assert "nan" not in text and "None" not in text
    assert "de 30 años" in text


def test_bookings_first_three_duplicates_kept(spark):
    rows = [_row(1, tipo_interaccion="Reserva", nombre_sitio="A"), _row(2, tipo_interaccion="reserva", nombre_sitio="A"),
            _row(3, tipo_interaccion="RESERVA", nombre_sitio="B"), _row(4, tipo_interaccion="Reserva", nombre_sitio="C")]
    r = _implicit(spark, rows)["u1"]
    assert r["reservas"] == ["A", "A", "B"]
    assert "Reservó en: A, A, B." in r["narrativa_implicita"]


def test_null_booked_name_dropped(spark):
    rows = [_row(1, tipo_interaccion="Reserva", nombre_sitio=None), _row(2, tipo_interaccion="Reserva", nombre_sitio="A")]
    assert _implicit(spark, rows)["u1"]["reservas"] == ["A"]


def test_frequency_tie_by_name(spark):
    rows = [_row(1, categoria_sitio="B"), _row(2, categoria_sitio="A")]
    assert _implicit(spark, rows)["u1"]["top_categorias"] == ["A", "B"]


def test_all_null_defaults(spark):
    rows = [_row(1, categoria_sitio=None, ubicacion=None)]
    text = _implicit(spark, rows)["u1"]["narrativa_implicita"]
    assert text == "Historial del usuario: interactúa con categorías diversas en varias."


def test_non_numeric_rating(spark):
    rows = [_row(1, calificacion="4"), _row(2, calificacion="x"), _row(3, calificacion=None), _row(4, calificacion="4.5")]
    assert _implicit(spark, rows)["u1"]["mejor_valorados"] == ["N1", "N4"]


def test_missing_rating_column(spark):
    cols = ["id_interaccion", "id_usuario", "url_sitio", "nombre_sitio", "categoria_sitio", "ubicacion", "tipo_interaccion"]
    text = _implicit(spark, [_row(1)], cols)["u1"]["narrativa_implicita"]
    assert "Valoró positivamente" not in text


def test_context_forms(spark):
    df = spark.createDataFrame([("E", "I"), ("E", "")], "e string, i string")
    got = [r[0] for r in df.select(N.user_context(F.col("e"), F.col("i"))).collect()]
    assert got == ["E\n[COMPORTAMIENTO RECIENTE] I", "[COLD START - PERFIL DECLARADO] E"]
    got = [r[0] for r in df.select(N.full_narrative(F.col("e"), F.col("i"))).collect()]
    assert got == ["E I", "E"]
