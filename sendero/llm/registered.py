"""The registered query of each operator, with production parameters, over
its whole table; the oracle SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sendero.llm import (collocations, decontaminate, exact_dedup, filter_audit, license_scan, line_dedup, lm_score, mixing,
                         quality, secret_scan, simhash, suffix_dedup, toxicity)
from sendero.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.cut_documents(table(spark, sf_dir, "documents"))
    return cut.select(F.col("_row.doc_id").alias("doc_id"), "text", "n_lines", "n_removed",
                      F.array_join("starts", ",").alias("run_starts"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), part="source")


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_secret_scan, op3_toxicity, op4_decontamination, op5_simhash, op6_line_dedup, op7_lm_score,
    op8_quality, op9_mixing, op10_license_scan, op11_collocations,
    op12_suffix_dedup, op13_filter_audit)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""

_OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, w[i:i + 9] AS win, len(w[i:i + 9]) AS k
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, i, w[i:i + k - 1] AS win
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)),
hit AS (SELECT r, item, i, bw.k FROM dw JOIN bw USING (win)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit
            FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
listed AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(items, '') AS items
FROM d LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""

_OP6 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, md5(coalesce(text, '')) AS m FROM documents),
lines AS (SELECT r, doc_id, m, n, line, trim(line, E' \\t\\n\\r\\x0b\\x0c') AS t
          FROM (SELECT r, doc_id, m, unnest(string_split(coalesce(text, ''), E'\\n')) AS line,
                       generate_subscripts(string_split(coalesce(text, ''), E'\\n'), 1) AS n FROM d)),
full_lines AS (SELECT r, doc_id, m, n, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t,
                      row_number() OVER (PARTITION BY r ORDER BY n) - 1 AS p FROM lines WHERE t <> ''),
runs AS (SELECT r, doc_id, m, p, t || E'\\n' || lead(t) OVER (PARTITION BY r ORDER BY p) AS run FROM full_lines),
later AS (SELECT r, p FROM (SELECT r, p, (doc_id, m, p) AS here,
                 first_value((doc_id, m, p)) OVER (PARTITION BY run ORDER BY doc_id NULLS LAST, m, p) AS first_place
                 FROM runs WHERE run IS NOT NULL) WHERE here IS DISTINCT FROM first_place),
alone AS (SELECT r, p FROM (SELECT r, p, (doc_id, m, p) AS here,
                 first_value((doc_id, m, p)) OVER (PARTITION BY t ORDER BY doc_id NULLS LAST, m, p) AS first_place
                 FROM full_lines WHERE len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) > 20) WHERE here IS DISTINCT FROM first_place),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, p + k AS p FROM later, (VALUES (0), (1)) v(k) UNION ALL SELECT r, p FROM alone)),
kept AS (SELECT l.r, l.n, l.line, g.r IS NOT NULL AS gone
         FROM lines l LEFT JOIN full_lines f USING (r, n) LEFT JOIN gone g ON g.r = f.r AND g.p = f.p),
texts AS (SELECT r, string_agg(line, E'\\n' ORDER BY n) FILTER (NOT gone) AS text, count(*) FILTER (gone) AS n_removed FROM kept GROUP BY r),
counts AS (SELECT r, count(*) AS n_lines FROM full_lines GROUP BY r),
starts AS (SELECT r, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS run_starts FROM later GROUP BY r)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, coalesce(n_lines, 0) AS n_lines,
       t.n_removed, coalesce(run_starts, '') AS run_starts
FROM d JOIN texts t USING (r) LEFT JOIN counts USING (r) LEFT JOIN starts USING (r)
"""

_OP9 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS room FROM s),
c AS (SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(room) OVER before, 0))
               / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
      FROM w WINDOW before AS (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, room / weight) FILTER (level * weight < room) AS water FROM c),
t AS (SELECT source, source_size, CASE WHEN level * weight >= room THEN CAST(room AS DOUBLE) ELSE water * weight END AS target FROM c, l),
x AS (SELECT doc_id, d.source, size, source_size, target,
             CASE WHEN source_size > 0 THEN CAST(round(target / source_size * 1000000000) AS BIGINT) ELSE 0 END AS step,
             CAST('0x' || substr(md5('mix-1:' || coalesce('s' || d.source, 'null')), 1, 8) AS BIGINT) % 1000000000 AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, CAST(sum(step) OVER (PARTITION BY source ORDER BY size DESC, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT) + start AS upto FROM x)
SELECT doc_id, size, source_size, target, (upto // 1000000000 - (upto - step) // 1000000000) * size AS taken FROM y
"""

_OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT r, i, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS p FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
n AS (SELECT count(*) AS n FROM t),
c1 AS (SELECT w, count(*) AS c FROM t GROUP BY w), o1 AS (SELECT r, w, count(*) AS c FROM t GROUP BY r, w),
c2 AS (SELECT p, w, count(*) AS c FROM t WHERE i > 1 GROUP BY p, w), o2 AS (SELECT r, p, w, count(*) AS c FROM t WHERE i > 1 GROUP BY r, p, w),
x AS (SELECT t.r, t.i, greatest(c1.c - o1.c, 0.5) / greatest(n - len(d.w), 1) AS one, c2.c - o2.c AS two, cp.c - op.c AS ctx
      FROM t JOIN d ON d.r = t.r CROSS JOIN n JOIN c1 ON c1.w = t.w JOIN o1 ON o1.r = t.r AND o1.w = t.w
      LEFT JOIN c2 ON c2.p = t.p AND c2.w = t.w LEFT JOIN o2 ON o2.r = t.r AND o2.p = t.p AND o2.w = t.w
      LEFT JOIN c1 cp ON cp.w = t.p LEFT JOIN o1 op ON op.r = t.r AND op.w = t.p),
s AS (SELECT r, sum(CASE WHEN i = 1 THEN ln(one) WHEN two > 0 THEN ln(two / ctx) ELSE ln(CAST(0.4 AS DOUBLE)) + ln(one) END) AS s FROM x GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s, 0), 6) AS score,
       CASE WHEN len(w) > 0 THEN round(s / len(w), 6) END AS mean_score FROM d LEFT JOIN s USING (r)
"""

_OP11 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, sum(len(w)) AS n FROM q GROUP BY lang),
c AS (SELECT lang, k, phrase, count(*) AS f
      FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
            FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM q, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE len(w) >= k))
      GROUP BY lang, k, phrase HAVING count(*) >= 100),
x AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM c WHERE k > 1),
y AS (SELECT x.lang, x.phrase, a, cut, l.f AS l, r.f AS r, n, CAST(1000 AS HUGEINT) * a * n // (CAST(l.f AS HUGEINT) * r.f) AS score
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM x) x JOIN t USING (lang)
      JOIN c l ON l.lang = x.lang AND l.phrase = array_to_string(w[1:cut], ' ')
      JOIN c r ON r.lang = x.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT z.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z
      WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.lang = z.lang AND b.a >= z.a AND len(b.phrase) > len(z.phrase)
                        AND contains(' ' || b.phrase || ' ', ' ' || z.phrase || ' ')))
SELECT lang, rank, phrase, a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o WHERE rank <= 2000
"""

_OP12 = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS g FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
ranges AS (SELECT doc_id, i, max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM later),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b
          FROM (SELECT doc_id, i, sum(CASE WHEN upto IS NULL OR i > upto THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM ranges)
          GROUP BY doc_id, k),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS head, max(b) AS b,
                sum(b - a) AS n_removed, count(*) AS n_spans FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(b, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT part, doc_id, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
             100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
m AS (SELECT part, [a, b, c, d, e] AS fails, doc_id,
             coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good,
             coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic FROM f),
n AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
v(x) AS (VALUES (1), (2), (3), (4), (5)),
p AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM v a, v b, v c, v d, v e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT part, array_to_string(list_transform(o, lambda x: chr(CAST(64 + x AS INTEGER))), '') AS filter_order, v.x AS step, o[v.x] AS flt,
             fails[o[v.x]] AS hit, len(list_filter(o[1:v.x - 1], lambda y: fails[y])) > 0 AS earlier,
             len(list_filter(fails, lambda y: y)) AS k, n, good, toxic FROM n, p, v),
g AS (SELECT part, filter_order, step, flt, sum(CASE WHEN NOT hit AND NOT earlier THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN hit AND NOT earlier THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND earlier THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN hit AND k = 1 THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN hit AND NOT earlier THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN hit AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, flt) AS BIGINT) AS shapley
FROM g
"""

ORACLE = {"op11_collocations": _OP11, "op12_suffix_dedup": _OP12, "op13_filter_audit": _OP13, "op1_exact_dedup": _OP1, "op4_decontamination": _OP4, "op6_line_dedup": _OP6, "op7_lm_score": _OP7, "op9_mixing": _OP9}
