"""Text helpers as Spark column expressions (JVM-side, no UDF)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\{\{|\}\}|\{(\w+)\}")


def _pieces(template: str):
    """Split a template into ("lit", text) / ("var", name) pieces, reading it
    left to right like ``str.format``: ``{{`` and ``}}`` are literal braces."""
    pos, buf = 0, []
    for m in _TOKEN.finditer(template):
        buf.append(template[pos:m.start()])
        pos = m.end()
        if m.group(1) is None:
            buf.append(m.group(0)[0])
        else:
            yield "lit", "".join(buf)
            buf = []
            yield "var", m.group(1)
    buf.append(template[pos:])
    yield "lit", "".join(buf)


def template_variables(template: str) -> set[str]:
    return {piece for kind, piece in _pieces(template) if kind == "var"}


def render(template: str, **values: Column) -> Column:
    """Fill ``{name}`` slots with columns; a null value renders as empty text."""
    cols: list[Column] = []
    for kind, piece in _pieces(template):
        if kind == "lit":
            if piece:
                cols.append(F.lit(piece))
        else:
            cols.append(F.coalesce(values[piece].cast("string"), F.lit("")))
    return F.concat(*cols)


def sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def render_sql(template: str, **values: str) -> str:
    """The same rendering written as portable SQL (used by the oracle)."""
    parts: list[str] = []
    for kind, piece in _pieces(template):
        if kind == "lit":
            if piece:
                parts.append(sql_literal(piece))
        else:
            parts.append(f"coalesce(CAST({values[piece]} AS VARCHAR), '')")
    return "concat(" + ", ".join(parts) + ")"


def multi_value_text(c: Column) -> Column:
    """``a|b|c`` -> ``a, b, c`` with leading/trailing commas and blanks removed."""
    return F.coalesce(F.btrim(F.replace(c, F.lit("|"), F.lit(", ")), F.lit(", ")), F.lit(""))




def blank_to_null(c: Column) -> Column:
    t = F.trim(c.cast("string"))
    return F.when(t == "", F.lit(None)).otherwise(t)
