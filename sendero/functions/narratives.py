"""Narratives (row -> text) as column expressions.

Each function returns a ``Column`` so the text is built inside the JVM with
whole-stage code generation; nothing leaves for Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sendero.functions import fixed
from sendero.functions.text import multi_value_text, render

_EXPLICIT_FIELDS = [
    "genero", "edad", "nacionalidad", "idioma_principal", "ocupacion",
    "tipo_viajero", "presupuesto_viaje", "compania_viaje",
    "duracion_estadia_promedio", "epoca_preferida", "destino_frecuente",
    "alojamiento_preferido", "nivel_actividad",
]


def explicit_narrative() -> Column:
    """Declared profile in the fixed Spanish template (null -> empty)."""
    values = {name: F.col(name) for name in _EXPLICIT_FIELDS}
    values["intereses"] = multi_value_text(F.col("intereses_principales"))
    values["actividades"] = multi_value_text(F.col("actividades_preferidas"))
    # The template starts and ends with literal text, so no outer trim is needed.
    return render(fixed.EXPLICIT_TEMPLATE, **values)


def _place(template: str) -> Column:
    return render(
        template,
        nombre_sitio=F.col("nombre_sitio"),
        categoria_sitio=F.col("categoria_sitio"),
        ubicacion=F.col("ubicacion"),
    )


def place_catalogue_text() -> Column:
    """``Lugar turístico: …`` form."""
    return _place(fixed.PLACE_TEMPLATE_CATALOGUE)


def place_document() -> Column:
    """``Lugar: …`` form, the indexed document of a site."""
    return _place(fixed.PLACE_TEMPLATE_INDEX)


def place_query_context() -> Column:
    """``Nombre: …`` form, the query text of the inverse pipeline."""
    return _place(fixed.PLACE_TEMPLATE_QUERY)


def implicit_from_parts(cats: Column, locs: Column, booked: Column, favs: Column, rated: Column) -> Column:
    """N5 from the per-user picks (arrays of names, possibly empty).

    The first sentence is always present; each optional sentence is null when
    its list is empty and ``concat_ws`` skips it.
    """
    first = render(
        fixed.HISTORY_TEMPLATE,
        cats=F.when(F.size(cats) > 0, F.array_join(cats, ", ")).otherwise(F.lit(fixed.DEFAULT_CATEGORIES)),
        lugares=F.when(F.size(locs) > 0, F.array_join(locs, ", ")).otherwise(F.lit(fixed.DEFAULT_LOCATIONS)),
    )

    def optional(template: str, arr: Column) -> Column:
        return F.when(F.size(arr) > 0, render(template, items=F.array_join(arr, ", ")))

    return F.concat_ws(
        " ",
        first,
        optional(fixed.BOOKED_TEMPLATE, booked),
        optional(fixed.FAVOURITE_TEMPLATE, favs),
        optional(fixed.TOP_RATED_TEMPLATE, rated),
    )


def full_narrative(explicit: Column, implicit: Column) -> Column:
    """Indexed user document, ``explicit implicit`` or explicit alone."""
    has = implicit.isNotNull() & (implicit != "")
    return F.when(has, F.concat(explicit, F.lit(" "), implicit)).otherwise(explicit)


def user_context(explicit: Column, implicit: Column) -> Column:
    """Query text of the direct pipeline (history marker or cold start)."""
    has = implicit.isNotNull() & (implicit != "")
    return F.when(has, F.concat(explicit, F.lit(fixed.RECENT_BEHAVIOUR_MARKER), implicit)).otherwise(
        F.concat(F.lit(fixed.COLD_START_MARKER), explicit)
    )
