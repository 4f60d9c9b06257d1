"""End to end from the two CSV inputs, as a user of the reference would run."""

import os

from sendero.__main__ import main
from sendero.plans.pipeline import Pipeline

PROFILES = """id_usuario,nombre,edad,genero,nacionalidad,idioma_principal,nivel_estudios,ocupacion,estado_civil,tiene_hijos,presupuesto_viaje,tipo_viajero,duracion_estadia_promedio,epoca_preferida,compania_viaje,destino_frecuente,alojamiento_preferido,nivel_actividad,dispositivo_principal,intereses_principales,actividades_preferidas
1,Ana,30,Femenino,España,Español,Universitario,Docente,Soltero,No,Medio,Cultural,5,Verano,Pareja,Europa,Hotel,Alta,Móvil,museos|arte,visitas guiadas
2,Luis,45,Masculino,México,Español,Secundario,Chef,Casado,Sí,Alto,Gastronómico,3,Invierno,Familia,América,Hostal,Media,PC,cocina|vino,catas
3,Eva,28,Femenino,Francia,Francés,Universitario,Guía,Soltero,No,Bajo,Aventura,7,Verano,Solo,Europa,Camping,Alta,Móvil,montaña,senderismo
"""
INTERACTIONS = """id_interaccion,id_usuario,fecha_interaccion,hora_dia,dispositivo_usado,url_sitio,nombre_sitio,categoria_sitio,ubicacion,tipo_interaccion,calificacion,comentario,tiempo_visita_segundos
1,1,2024-01-01,Mañana,Móvil,a,Museo del Prado,Museo,Madrid,Reserva,5,Excelente servicio,300
2,1,2024-01-02,Tarde,Móvil,b,Playa Norte,Playa,Valencia,Click,,,20
3,2,2024-01-03,Noche,PC,c,Mercado Central,Gastronomía,Valencia,Favorito,4,,100
4,2,2024-01-04,Noche,PC, a ,Museo del Prado,Museo,Madrid,Calificación,x,,50
5,1,2024-01-05,Tarde,Móvil,c,Mercado Central,Gastronomía,Valencia,Click,,,10
6,1,2024-01-06,Tarde,Móvil,d,Ruta Pirineo,Naturaleza,Huesca,Click,,,10
"""


def _write(tmp):
    p, i = os.path.join(tmp, "p.csv"), os.path.join(tmp, "i.csv")
    with open(p, "wb") as f:
        f.write(PROFILES.encode("latin-1"))
    with open(i, "wb") as f:
        f.write(INTERACTIONS.encode("latin-1"))
    return p, i


def test_csv_pipeline(spark, tmpdir_path):
    p_csv, i_csv = _write(tmpdir_path)
    p = Pipeline.from_csv(spark, p_csv, i_csv)
    recs = p.topk_places(6).collect()
    consumed = {(r["id_usuario"], r["url_sitio"]) for r in p.consumed.collect()}
    assert ("2", "a") in consumed  # padded url trimmed
    assert not [r for r in recs if (r["id_usuario"], r["url_sitio"]) in consumed]
    by_user = {}
    for r in recs:
        by_user.setdefault(r["id_usuario"], []).append(r["url_sitio"])
    assert "1" not in by_user  # user 1 consumed every site: no candidates
    assert sorted(by_user["3"]) == ["a", "b", "c", "d"]  # cold start: all sites
    ctx = {r["id_usuario"]: r["contexto"] for r in p.user_texts.collect()}
    assert ctx["3"].startswith("[COLD START - PERFIL DECLARADO] Usuario Femenino de 28 años")
    assert "Reservó en: Museo del Prado." in ctx["1"]
    assert "Intereses principales: museos, arte." in ctx["1"]


def test_cli_recommend_and_index(spark, tmpdir_path):
    p_csv, i_csv = _write(tmpdir_path)
    out = os.path.join(tmpdir_path, "out")
    main(["recommend", "--profiles", p_csv, "--interactions", i_csv, "--out", out, "--k", "3", "--n", "2"])
    recs = spark.read.parquet(os.path.join(out, "recomendaciones")).collect()
    assert recs and max(r["rank"] for r in recs) <= 2


def test_cli_other_commands(spark, tmpdir_path):
    p_csv, i_csv = _write(tmpdir_path)
    base = ["--profiles", p_csv, "--interactions", i_csv]
    out = os.path.join(tmpdir_path, "cli")
    main(["inverse", *base, "--out", out, "--k", "2", "--n", "1"])
    inv = spark.read.parquet(os.path.join(out, "usuarios_recomendados")).collect()
    assert inv and all(r["rank"] == 1 for r in inv)
    main(["index", *base, "--out", out])
    from sendero.sources import index as IX

    assert IX.VectorIndex(spark, os.path.join(out, IX.PLACES), IX.PLACE_METADATA).count() == 4
    assert IX.VectorIndex(spark, os.path.join(out, IX.USERS), IX.USER_METADATA).count() == 3
    tpl = os.path.join(tmpdir_path, "t.txt")
    with open(tpl, "w", encoding="utf-8") as f:
        f.write("N={top_n} U={user_context} C={candidates_json}")
    main(["prompts", *base, "--out", out, "--template", tpl, "--model", "m1"])
    pr = spark.read.parquet(os.path.join(out, "prompts")).collect()
    assert pr and all(r["prompt"].startswith("N=3 U=") and r["modelo_usado"] == "m1" for r in pr)
    main(["evaluate", *base, "--out", out, "--n", "2"])
    m = spark.read.parquet(os.path.join(out, "metricas")).collect()
    assert {r["protocolo"] for r in m} == {"temporal", "leave_one_out"}
