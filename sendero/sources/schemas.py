"""Declared schemas of the two inputs and of the index tables."""

from pyspark.sql import types as T

# Profile columns in file order; every one is read as text and typed by the
# cleaning step, so malformed cells become nulls instead of failing the scan.
PROFILE_COLUMNS = [
    "id_usuario", "nombre", "edad", "genero", "nacionalidad", "idioma_principal",
    "nivel_estudios", "ocupacion", "estado_civil", "tiene_hijos",
    "presupuesto_viaje", "tipo_viajero", "duracion_estadia_promedio",
    "epoca_preferida", "compania_viaje", "destino_frecuente",
    "alojamiento_preferido", "nivel_actividad", "dispositivo_principal",
    "intereses_principales", "actividades_preferidas",
]

INTERACTION_COLUMNS = [
    "id_interaccion", "id_usuario", "fecha_interaccion", "hora_dia",
    "dispositivo_usado", "url_sitio", "nombre_sitio", "categoria_sitio",
    "ubicacion", "tipo_interaccion", "calificacion", "comentario",
    "tiempo_visita_segundos",
]

# Typed form after cleaning.
PROFILE_TYPES = {c: T.StringType() for c in PROFILE_COLUMNS} | {
    "edad": T.IntegerType(),
    "duracion_estadia_promedio": T.IntegerType(),
}
INTERACTION_TYPES = {c: T.StringType() for c in INTERACTION_COLUMNS} | {
    "id_interaccion": T.LongType(),
    "fecha_interaccion": T.DateType(),
    "calificacion": T.DoubleType(),
    "tiempo_visita_segundos": T.LongType(),
}


def all_strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


PLACE_METADATA = T.StructType([
    T.StructField("nombre_sitio", T.StringType()),
    T.StructField("categoria_sitio", T.StringType()),
    T.StructField("ubicacion", T.StringType()),
    T.StructField("url_sitio", T.StringType()),
])

USER_METADATA = T.StructType([
    T.StructField("id_usuario", T.StringType()),
    T.StructField("nombre", T.StringType()),
    T.StructField("nacionalidad", T.StringType()),
    T.StructField("tipo_viajero", T.StringType()),
    T.StructField("presupuesto_viaje", T.StringType()),
])


def index_schema(metadata: T.StructType, element: T.DataType = T.DoubleType()) -> T.StructType:
    """Row layout of a vector collection: id, document, embedding, metadata."""
    return T.StructType([
        T.StructField("id", T.StringType(), False),
        T.StructField("document", T.StringType()),
        T.StructField("embedding", T.ArrayType(element)),
        T.StructField("metadata", metadata),
    ])
