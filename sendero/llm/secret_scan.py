"""Secret scan: base patterns, and character Markov models for the rest.

Base spans (assigned values, access keys, hexadecimal runs) are found by
pattern.  Two first-order Markov models over characters are trained from
labelled samples: the strings in base spans of sampled documents stand for
random strings, the long words that recur in sampled documents for ordinary
identifiers.  Any further token of ``TOKEN_LENGTH`` or more characters whose
mean log-likelihood ratio per transition reaches ``BAR`` is a span of kind
``markov``, unless it overlaps a base span.

Everything runs in DataFrame expressions.  The place of a match comes from
the pieces that splitting at the pattern leaves, summed up in a window over
the matches of the document.

Defined results: a null text is the empty text and has no spans; repeated
rows and identifiers are told apart by row; without samples both models are
uniform and add nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sendero.llm.common import text_or_empty

# The base kinds, in order, and their patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
MIN_ASSIGNED = 12
# A part of every text that ASSIGN matches, in lower case.
_ASSIGN_PARTS = ("password", "passwd", "secret", "token", "key")

TOKEN_LENGTH = 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{TOKEN_LENGTH},}}"
WORD = r"[A-Za-z0-9+/_=-]{8,}"
BAR = 0.7
SMOOTH = 10.0
SAMPLE_DOCS = 20_000  # documents whose base spans are samples of random strings
SAMPLE_WORD_DOCS = 4_000  # documents whose words are samples of identifiers
_STATES = 128


def _contains_any(col: Column, parts: tuple[str, ...]) -> Column:
    out = F.contains(col, F.lit(parts[0]))
    for part in parts[1:]:
        out = out | F.contains(col, F.lit(part))
    return out


def _gates(text: Column) -> dict[str, Column]:
    """Whether a text can hold a kind at all."""
    return {
        "assign": _contains_any(F.lower(text), _ASSIGN_PARTS) & text.rlike(ASSIGN),
        "access": F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS),
        "hex": text.rlike(HEX),
        "markov": text.rlike(TOKEN),
    }


def _matches(text: Column, kind: str, gate: Column) -> Column:
    """Structs of kind number, rank, piece before, match and the part that counts."""
    pattern, group = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0), "markov": (TOKEN, 0)}[kind]
    zipped = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
                          F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    structs = F.transform(zipped, lambda x, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"),
        x["part"].alias("part")))
    return F.when(gate, F.filter(structs, lambda x: x["hit"].isNotNull())).otherwise(
        F.array().cast("array<struct<kind:int,i:int,gap:int,hit:int,part:string>>"))


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.ascii(c))


def _transitions(token: Column) -> Column:
    """Numbers of the character pairs of a token."""
    codes = _codes(token)
    return F.zip_with(F.slice(codes, 1, F.length(token) - 1), F.slice(codes, 2, F.greatest(F.length(token) - 1, F.lit(0))),
                      lambda a, b: a * _STATES + b)


def _sample(docs: DataFrame, rows: int) -> DataFrame:
    """The texts of ``rows`` documents in the order of a hash of doc_id."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(text_or_empty()).alias("text"))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_word_docs: int = SAMPLE_WORD_DOCS) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each character pair."""
    text = F.col("text")
    gates = _gates(text)
    spans = F.concat(*[F.transform(_matches(text, k, gates[k]), lambda x: x["part"]) for k in KINDS[:3]])
    random = _sample(docs, sample_docs).select(F.explode(spans).alias("token")).where(F.length("token") >= MIN_ASSIGNED).select(
        F.lit(True).alias("random"), "token", F.lit(1).cast("long").alias("docs"))
    words = F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: ~w.rlike(HEX) & ~F.contains(w, F.lit("AKIA")))
    ordinary = _sample(docs, sample_word_docs).select(F.explode(F.array_distinct(words)).alias("token"))
    # Identifiers recur; a random string that no pattern knows stands in one document.
    ordinary = ordinary.groupBy("token").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1").select(
        F.lit(False).alias("random"), "token", "docs")
    pairs = random.unionByName(ordinary).select("random", "docs", F.explode(_transitions(F.col("token"))).alias("pair"))
    counts = {True: {}, False: {}}
    for r in pairs.groupBy("random", "pair").agg(F.sum("docs").alias("n")).collect():  # two 128 x 128 tables
        counts[r["random"]][r["pair"]] = r["n"]
    return log_ratios(counts[True], counts[False])


def _model(counts: dict[int, int], alphabet: list[int]) -> dict[int, float]:
    """Probability of each pair's second character after its first: counts,
    smoothed by the characters' own frequencies (add-one) with weight ``SMOOTH``."""
    single = {b: sum(counts.get(a * _STATES + b, 0) for a in alphabet) for b in alphabet}
    every = sum(single.values()) + len(alphabet)
    after = {a: sum(counts.get(a * _STATES + b, 0) for b in alphabet) for a in alphabet}
    return {a * _STATES + b: (counts.get(a * _STATES + b, 0) + SMOOTH * (single[b] + 1) / every) / (after[a] + SMOOTH)
            for a in alphabet for b in alphabet}


def log_ratios(random: dict[int, int], ordinary: dict[int, int]) -> list[float]:
    alphabet = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]
    p, q = _model(random, alphabet), _model(ordinary, alphabet)
    out = [0.0] * (_STATES * _STATES)
    for pair in p:
        out[pair] = math.log(p[pair]) - math.log(q[pair])
    return out


def mean_ratio(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio per transition of a token."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")  # folded into one literal
    total = F.aggregate(_transitions(token), F.lit(0.0), lambda s, pair: s + F.element_at(table, pair + 1))
    return total / F.greatest(F.length(token) - 1, F.lit(1))


def find_spans(docs: DataFrame, ratios: list[float], bar: float = BAR) -> DataFrame:
    """Rows of ``_row``: one per document (kind -1) with its doc_id, and one
    per span with kind (number), start and end."""
    text = F.col("_text")
    gates = _gates(text)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", text_or_empty().alias("_text"))
    one = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit(0).alias("hit"), F.lit(None).cast("string").alias("part")))
    found = rows.select("_row", "doc_id", F.explode(F.concat(one, *[_matches(text, k, gates[k]) for k in KINDS])).alias("m"))
    found = found.select("_row", F.when(F.col("m.kind") < 0, F.col("doc_id")).alias("doc_id"), "m.kind", "m.i", "m.gap", "m.hit", "m.part")
    markov = F.col("kind") == KINDS.index("markov")
    holds = F.when(F.col("kind") == 0, F.length("part") >= MIN_ASSIGNED).when(markov, mean_ratio(F.col("part"), ratios) >= bar).otherwise(True)
    found = found.select("_row", "doc_id", "kind", "i", "gap", "hit", holds.alias("holds")).repartition("_row")
    sofar = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(sofar)).withColumn("start", F.col("end") - F.col("hit"))
    found = found.where("holds").withColumn("base", F.col("kind").between(0, 2))
    order = Window.partitionBy("_row").orderBy("start", "kind")
    covered = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0)) > F.col("start")
    reached = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing)) < F.col("end")
    found = found.withColumn("overlaps", F.coalesce(covered, F.lit(False)) | F.coalesce(reached, F.lit(False)))
    return found.where((F.col("kind") != KINDS.index("markov")) | ~F.col("overlaps")).select("_row", "doc_id", "kind", "start", "end")


def secret_scan(docs: DataFrame, bar: float = BAR) -> DataFrame:
    """Per document: the number of spans of each kind, a digest of the base
    spans, and all spans as kind:start:end (code points, end exclusive)."""
    spans = find_spans(docs.select("doc_id", "text"), train(docs.select("doc_id", "text")), bar)
    names = F.array(*[F.lit(k) for k in KINDS])
    per_row = spans.groupBy("_row").agg(
        F.max("doc_id").alias("doc_id"), *[F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sort_array(F.collect_list(F.when(F.col("kind") >= 0, F.struct("start", "kind", "end")))).alias("spans"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["kind"] < KINDS.index("markov"))
    return per_row.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(base), 256).alias("base_sha256"),
                          joined(F.col("spans")).alias("spans"), "n_markov")
