"""Places named in texts against a search for every name in every text."""

import random
import re

import pytest

from sendero.operators import grounding as GD

SITES = [("Museo del Prado", "Madrid"), ("Prado", "Madrid"), ("El Prado de San Sebastián", "Sevilla"), ("St. John's Park", "Córdoba"),
         ("Park", None), ("Ávila", "Ávila"), ("Avila", "Castilla"), ("...", " "), ("Playa 3", "Cádiz"), (None, "CÁDIZ")]


def _words(text):
    return " " + " ".join(re.findall(r"[^\W_]+", (text or "").lower())) + " "


def _names(spark):
    return GD.place_dictionary(spark.createDataFrame(SITES, "nombre_sitio string, ubicacion string"))


def _brute(texts):
    names = {_words(n) for row in SITES for n in row if _words(n).strip()}
    return {(k, n) for k, t in texts for n in names if n in _words(t)}


def _texts():
    rng = random.Random(7)
    pieces = ["Museo", "del", "Prado", "el prado", "de San Sebastián", "St John\'s", "park", "PARK", "Ávila", "avila", "playa", "3", "Cádiz,", "madrid",
              "cerca", "—", "prados", "Madridejos", "Sevilla."]
    texts = [(str(n), " ".join(rng.choices(pieces, k=rng.randint(1, 12)))) for n in range(200)]
    return texts + [("null", None), ("empty", ""), ("signs", "... , !"), ("long", "Museo del Prado, " * 20_000 + "Ávila"), ("0", "Park")]


@pytest.mark.parametrize("bound", [GD.DICTIONARY_BYTES, 0])
def test_named_places_equal_a_search_for_all_names(spark, bound):
    texts = _texts()
    frame = spark.createDataFrame(texts, "k string, t string").repartition(4)
    got = GD.named_places(frame, "k", "t", _names(spark), bound).collect()
    assert len(got) == len(set(got))
    assert {(r.k, r.lugar) for r in got} == _brute(texts)
    assert ("long", " ávila ") in {(r.k, r.lugar) for r in got}


def test_no_names_and_no_texts(spark):
    frame = spark.createDataFrame([("a", "Madrid")], "k string, t string")
    none = spark.createDataFrame([], "lugar string")
    assert GD.named_places(frame, "k", "t", none).count() == 0
    for bound in (GD.DICTIONARY_BYTES, 0):
        assert GD.named_places(frame.limit(0), "k", "t", _names(spark), bound).count() == 0


@pytest.mark.parametrize("bound", [GD.DICTIONARY_BYTES, 0])
def test_undeclared_places_are_flagged(spark, bound):
    items = spark.createDataFrame([
        ("u", 1, "Prado", "Madrid", "El Prado, en Madrid, como Sevilla y Ávila."), ("u", 2, "Park", None, "St John\'s Park es un park."),
        ("u", 3, "Park", None, None), ("v", 1, "Avila", "Castilla", "Avila, no Ávila")],
        "id_usuario string, posicion int, nombre_sitio string, ubicacion string, justificacion string")
    contexts = spark.createDataFrame([("u", "Ha visitado Sevilla."), ("v", None)], "id_usuario string, contexto string")
    got = {(r.id_usuario, r.posicion): (r.n_nombrados, r.n_no_declarados, r.no_declarados, r.fundamentado)
           for r in GD.ground_justifications(items, contexts, _names(spark), dictionary_bytes=bound).collect()}
    assert got == {("u", 1): (4, 1, "ávila", 0), ("u", 2): (2, 1, "st john s park", 0), ("u", 3): (0, 0, "", 1), ("v", 1): (2, 1, "ávila", 0)}
