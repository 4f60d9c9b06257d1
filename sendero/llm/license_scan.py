"""License scan: ordered signature rules behind a keyword prefilter.

One pass without Python.  A document whose text holds none of the keywords is
done after counting its words.  The others are normalised (words joined by
single blanks) and meet the rules of the keywords they hold in an equi-join
with the broadcast rule table (a fixed list); each pattern is tried there.
Of overlapping detections one that lies inside another of the same or a
higher priority is suppressed: by running maxima over the detections of a
document in the order of their places, so a text full of licenses costs its
number of detections, not their pairs.

Four base phrases are always reported beside the rules: their places, the
words where the first and the last of them begin, and their labels.  The
score is the highest confidence of the detections that stay, 0 without any.

Defined results: a null text has no words and no labels; repeated rows and
identifiers are told apart by row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sendero.llm.common import RAW_WORD, ascii_lower, text_or_empty, words_of
from sendero.llm.license_rules import LEVELS, rules

# Base phrase and its label.
BASE_PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
_BASE_KEYWORDS = ["general", "apache", "cc", "license"]
# "cc" is a part of many words, so its prefilter asks for the pair; the other
# keywords of rules with cc stand for themselves.
_CC = r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"
_RULES = "level int, keyword string, label string, confidence double, pattern string, rule int"


def rule_table(docs: DataFrame) -> DataFrame:
    """The rules, numbered in order, and one empty rule for every document."""
    rows = [(r.level, r.keyword, r.label, r.confidence, f"(?<= ){r.pattern}(?= )", i) for i, r in enumerate(rules())]
    return docs.sparkSession.createDataFrame([*rows, (-1, "", None, None, None, -1)], _RULES)


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _base_columns(norm: Column) -> list[Column]:
    """n_base, first_word, last_word, base labels from the padded word line."""
    count, first, last, labels = F.lit(0), [], [], []
    for phrase, label in BASE_PHRASES:
        padded = f" {phrase} "
        here = F.contains(norm, F.lit(padded))
        count = count + F.when(here, F.regexp_count(norm, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0)
        first.append(F.when(here, _blanks(F.substring_index(norm, padded, 1))))
        last.append(F.when(here, F.col("n_words") - _blanks(F.substring_index(norm, padded, -1)) - len(phrase.split())))
        labels.append(F.when(here, F.lit(label)))
    return [F.coalesce(count, F.lit(0)).cast("long").alias("n_base"), F.array_min(F.array(*first)).cast("long").alias("first_word"),
            F.array_max(F.array(*last)).cast("long").alias("last_word"),
            F.array_sort(F.array_compact(F.array(*labels))).alias("base_labels")]


def detections(docs: DataFrame) -> DataFrame:
    """Rows of ``_row``: one per document (level -1) with doc_id, n_words and
    the base columns, and one per detection with its place in the padded word
    line (start, end), level, rule, label, confidence and ``kept``."""
    keywords = sorted({r.keyword for r in rules()} | set(_BASE_KEYWORDS))
    low = F.lower("_text")  # A-Z become a-z, so no keyword is missed
    present = F.filter(F.array(*[F.lit(k) for k in keywords if k != "cc"]), lambda k: F.contains(F.col("_low"), k))
    present = F.concat(present, F.when(F.col("_low").rlike(_CC), F.array(F.lit("cc"))).otherwise(F.array().cast("array<string>")))
    line = F.concat(F.lit(" "), F.array_join(words_of(ascii_lower(F.col("_text"))), " "), F.lit(" "))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", text_or_empty().alias("_text"))
    rows = rows.select("_row", "doc_id", "_text", F.regexp_count("_text", F.lit(RAW_WORD)).cast("long").alias("n_words"), low.alias("_low"))
    rows = rows.select("_row", "doc_id", "_text", "n_words", present.alias("_present"))
    rows = rows.select("_row", "doc_id", "n_words", "_present", F.when(F.size("_present") > 0, line).alias("_line"))
    rows = rows.select("_row", "doc_id", "n_words", "_line", *_base_columns(F.col("_line")),
                       F.explode(F.concat(F.array(F.lit("")), "_present")).alias("keyword"))
    tried = rows.join(F.broadcast(rule_table(docs)), "keyword")  # a fixed list of rules
    tried = tried.where((F.col("rule") < 0) | F.expr("_line rlike pattern"))
    places = F.when(F.col("rule") >= 0, F.arrays_zip(
        F.expr("split(_line, pattern)").alias("gap"), F.expr("regexp_extract_all(_line, pattern, 0)").alias("hit")))
    found = tried.withColumn("_places", places).select(
        "_row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "level", "rule", "label", "confidence",
        F.posexplode_outer("_places").alias("_i", "_place"))
    found = found.where((F.col("rule") < 0) | F.col("_place.hit").isNotNull()).withColumn("_hit", F.length("_place.hit")).withColumn(
        "_step", F.length("_place.gap") + F.col("_hit")).drop("_place").repartition("_row")
    sofar = Window.partitionBy("_row", "rule").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("end", F.sum("_step").over(sofar)).withColumn("start", F.col("end") - F.col("_hit"))
    before = Window.partitionBy("_row").orderBy("start", F.col("end").desc(), "level", "rule").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.lit(False)
    for level in LEVELS:
        reach = F.max(F.when(F.col("level").between(0, level), F.col("end"))).over(before)
        inside = F.when(F.col("level") == level, F.coalesce(reach >= F.col("end"), F.lit(False))).otherwise(inside)
    return found.withColumn("kept", (F.col("level") >= 0) & ~inside).drop("_i", "_hit", "_step")


def license_scan(docs: DataFrame) -> DataFrame:
    """Per document: the base columns, all labels, and the score."""
    carried = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    per_row = detections(docs).groupBy("_row").agg(
        *[F.max_by(c, -F.col("level")).alias(c) for c in carried],
        F.collect_set(F.when(F.col("kept"), F.col("label"))).alias("found"),
        F.coalesce(F.max(F.when(F.col("kept"), F.col("confidence"))), F.lit(0.0)).alias("score"),
        F.count_if("kept").alias("n_detections"))
    return per_row.select(
        *carried[:-1], F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", "found")), ",").alias("labels"), "score", "n_detections")
