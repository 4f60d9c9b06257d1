"""Per-user split by rank and percentiles against plain Python."""

import random
from datetime import date, timedelta

import numpy as np

from conftest import inter_rows
from sendero.operators import text_signals as TS
from sendero.operators.evaluate import split_by_rank


def test_split_by_rank(spark):
    rng = random.Random(5)
    rows = [{"id_interaccion": str(i), "id_usuario": "hot" if i % 3 == 0 else f"u{rng.randrange(20)}", "url_sitio": rng.choice(["a", "b", None]),
             "fecha_interaccion": rng.choice([None, str(date(2024, 1, 1) + timedelta(rng.randrange(40)))])} for i in range(300)]
    rows.append({"id_interaccion": "300", "id_usuario": "alone", "url_sitio": "a", "fecha_interaccion": None})
    got = {r["id_interaccion"]: (r["rango"], r["particion"]) for r in split_by_rank(inter_rows(spark, rows)).collect()}
    want = {}
    for r in rows:
        mine = [x["fecha_interaccion"] or "9999" for x in rows if x["id_usuario"] == r["id_usuario"]]
        rank = sum(x < (r["fecha_interaccion"] or "9999") for x in mine) / (len(mine) - 1) if len(mine) > 1 else 0.0
        want[int(r["id_interaccion"])] = (rank, "train" if rank < 0.8 else "test")
    assert {int(k): v for k, v in got.items()} == want
    assert split_by_rank(inter_rows(spark, [])).collect() == []


def test_percentiles(spark):
    rng = random.Random(6)
    texts = [(rng.choice("ab"), " ".join(["xy"] * rng.randrange(30))) for _ in range(200)] + [("a", None), ("c", "")]
    frame = spark.createDataFrame(texts, "forma string, texto string")
    got = {(r["forma"], r["medida"], r["percentil"]): r["valor"] for r in TS.narrative_percentiles(frame).collect()}
    for form in "ab":
        mine = [t for f, t in texts if f == form and t]
        for measure, values in (("caracteres", [len(t) for t in mine]), ("tokens", [len(t.split(" ")) for t in mine])):
            for p in TS.PERCENTILES:
                assert abs(got.pop((form, measure, p)) - np.percentile(values, 100 * p)) < 1e-4
    assert not got
