"""Places that a text names, and justifications that name undeclared ones.

A text names a place where the place's words stand in it one after the other;
words are maximal runs of letters, marks and digits, in lower case, so
punctuation and blanks don't matter, accents do, and names may overlap.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sendero.session import ship_package

# A dictionary of more bytes isn't sent to the tasks: its names are joined.
DICTIONARY_BYTES = 32 << 20


def words_text(c: Column) -> Column:
    """The words of a text in lower case, a blank before and after each."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " ")), F.lit(" "))


def place_dictionary(catalog: DataFrame) -> DataFrame:
    """(lugar): the distinct names of sites and of their locations, as words;
    names without a word are none."""
    names = catalog.select(F.explode(F.array("nombre_sitio", "ubicacion")).alias("n"))
    return names.select(words_text(F.col("n")).alias("lugar")).where(F.trim("lugar") != "").distinct()


def named_places(texts: DataFrame, key: str, text: str, names: DataFrame, dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """(key, lugar), once for each place of ``names`` (of
    ``place_dictionary``) that the text names.  A dictionary within the bound
    goes to the tasks as one Aho-Corasick automaton, which reads each whole text
    once; beyond it the word n-grams of the texts, of the lengths that names
    have, are joined with the names.  Null and empty texts name nothing;
    repeated keys count as one text each and their places as one set."""
    words = texts.select(F.col(key), words_text(F.col(text)).alias("_t")).where(F.trim("_t") != "")
    size = names.agg(F.sum(F.octet_length("lugar"))).first()[0] or 0
    if not size:
        return words.select(key, F.lit(None).cast("string").alias("lugar")).where(F.lit(False))
    if size <= dictionary_bytes:
        ship_package(texts.sparkSession)
        found = words.mapInPandas(_finder([r["lugar"] for r in names.collect()]), f"`{key}` string, lugar string")
    else:
        found = _by_grams(words, key, names)
    return found.distinct()


def _finder(names: list[str]):
    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in names:
            automaton.add_word(name, name)
        automaton.make_automaton()
        for pdf in batches:
            keys, places = [], []
            for k, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                hits = {name for _, name in automaton.iter(text)}
                keys.extend([k] * len(hits))
                places.extend(hits)
            yield pd.DataFrame({pdf.columns[0]: keys, "lugar": places}, dtype=object)

    return run


def _by_grams(words: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """One row for each distinct n-gram of a text meets one name at most, so
    a word that many names begin with multiplies nothing."""
    lengths = sorted(r["n"] for r in names.select(F.size(F.split(F.btrim("lugar"), " ")).alias("n")).distinct().collect())
    # Exploding one array makes the words a column that each n-gram only reads;
    # as an expression they would be split anew for every n-gram.
    words = words.select(key, F.explode(F.array(F.split(F.btrim("_t"), " "))).alias("_w"))
    w = F.col("_w")

    def grams(n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(" "), F.array_join(F.slice(w, i, n), " "), F.lit(" ")))

    every = words.select(key, F.explode(F.array_distinct(F.flatten(F.array(*[grams(n) for n in lengths])))).alias("lugar"))
    return every.join(names, "lugar", "left_semi").select(key, "lugar")


def ground_justifications(items: DataFrame, contexts: DataFrame, names: DataFrame, key: str = "id_usuario",
                          dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """Per answer item (key, posicion, nombre_sitio, ubicacion,
    justificacion) the places its justification names, and those among them
    that are not declared: named neither by the subject's context (key,
    contexto) nor by the item's own name and location.

    Returns (key, posicion, n_nombrados, n_no_declarados, no_declarados: the
    names sorted and joined by '; ', fundamentado: 1 if there are none)."""
    rows = items.select(key, "posicion", F.concat_ws("|", key, "posicion").alias("_item"), "justificacion",
                        F.concat_ws(" . ", "nombre_sitio", "ubicacion").alias("_own"))
    named = named_places(rows, "_item", "justificacion", names, dictionary_bytes)
    own = named_places(rows, "_item", "_own", names, dictionary_bytes).withColumn("_mine", F.lit(1))
    said = named_places(contexts, key, "contexto", names, dictionary_bytes).withColumn("_said", F.lit(1))
    pairs = rows.select(key, "posicion", "_item").join(named, "_item", "left")
    judged = pairs.join(own, ["_item", "lugar"], "left").join(said, [key, "lugar"], "left")
    new = F.when(F.col("_mine").isNull() & F.col("_said").isNull(), F.trim("lugar"))
    return judged.groupBy(key, "posicion").agg(
        F.count("lugar").alias("n_nombrados"), F.count(new).alias("n_no_declarados"),
        F.array_join(F.array_sort(F.collect_list(new)), "; ").alias("no_declarados"),
    ).withColumn("fundamentado", (F.col("n_no_declarados") == 0).cast("int"))
