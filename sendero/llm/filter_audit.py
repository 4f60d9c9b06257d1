"""Filter interaction audit.

Five filters judge every whole text; the audit says, for every order in which
they could be applied, what each one removes, what it would have removed had
not an earlier one done so, and what it alone catches.

The filters over one text are expressions.  The fifth (an identical text with
a smaller doc_id exists) is an existential self-join: texts whose hash stands
more than once are compared whole, and a left-semi join on hash, exact text
and smaller doc_id marks the ids.  The ids that fail each filter are united
into bit combinations, which are counted by part; all orders follow from those
counts, at most 32 rows a part, and no document is looked at again.

The join's right side holds each repeated text once, with its smallest
doc_id, so a text that a third of all rows share meets one row; it is written
first, so that adaptive execution can split the left side at such a hash.

Defined results: a null text is the empty text (under 200 words, nothing
else); a very long text is judged whole; repeated rows of a doc_id are
documents of their own, but not smaller than one another; a row without
doc_id is smaller than none and has none smaller, and carries no label; a
document is good (toxic) if any of its labels is 1; a null part is the empty
string; further columns pass by; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sendero.llm.common import UPPER, text_or_empty
from sendero.llm.steps import Steps

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT = 50  # per cent of the words
MAX_UPPER = 2  # per cent of the code points
SYMBOLS = "[#$%&*|]"
_BLANKS = r"[\x20\x09-\x0D]+"
_BIT = {letter: 1 << i for i, letter in enumerate(FILTERS)}


def _word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, _BLANKS), "")


def own_failures(text: Column, words: Column) -> Column:
    """Bits of the filters that look at one text alone."""
    n = F.size(words)
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    fails = {
        "A": n < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n,
        "C": 100 * upper > MAX_UPPER * F.length(text),
        "D": text.rlike(SYMBOLS),
    }
    bits = F.lit(0)
    for letter, cond in fails.items():
        bits = bits + F.when(cond, _BIT[letter]).otherwise(0)
    return bits


def identical_to_smaller(rows: DataFrame, steps: Steps) -> DataFrame:
    """_part, _doc, _hash of the rows whose text some row with a smaller _doc
    has, too.  ``rows``: _part, _doc, _hash, _text."""
    shared = rows.groupBy("_hash").agg(F.min("_doc").alias("low"), F.max("_doc").alias("high")).where("low < high")
    shared = steps.write(shared.select("_hash"), "audit-hashes")
    copies = steps.write(rows.join(shared, "_hash", "left_semi"), "audit-copies")
    owners = steps.write(copies.groupBy("_hash", "_text").agg(F.min("_doc").alias("_doc")), "audit-owners")
    a, b = copies.alias("a"), owners.alias("b")
    same = (F.col("a._hash") == F.col("b._hash")) & (F.col("a._text") == F.col("b._text")) & (F.col("b._doc") < F.col("a._doc"))
    marked = steps.write(a.join(b, same, "left_semi").select("_part", "_doc", "_hash"), "audit-marked")
    steps.done(shared, copies, owners)
    return marked


def failures(docs: DataFrame, part: str, steps: Steps) -> DataFrame:
    """_part, _doc, _mask, _rows: the bit combination of the filters that a
    document fails, and how many such rows there are (over one only where
    doc_id, text and part are repeated)."""
    key = F.coalesce(F.col(f"`{part}`").cast("string"), F.lit(""))
    rows = docs.select(key.alias("_part"), F.col("doc_id").cast("long").alias("_doc"), text_or_empty().alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    marked = identical_to_smaller(rows, steps)
    ids = ("_part", "_doc", "_hash")
    judged = rows.withColumn("_words", _word_list(F.col("_text"))).select(
        *ids, own_failures(F.col("_text"), F.col("_words")).alias("_bits"), F.lit(1).alias("_row"))
    united = judged.unionByName(marked.select(*ids, F.lit(_BIT["E"]).alias("_bits"), F.lit(0).alias("_row")))
    masks = united.groupBy(*ids).agg(F.bit_or("_bits").alias("_mask"), F.sum("_row").alias("_rows"))
    masks = steps.write(masks.select("_part", "_doc", "_mask", "_rows"), "audit-masks")
    steps.done(marked)
    return masks


def combinations(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail exactly
    the filters of ``mask``, and how many of those are labelled good and toxic."""
    steps = Steps(docs.sparkSession)
    masks = failures(docs, part, steps)
    known = labels.groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("_good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("_toxic")).where("_doc IS NOT NULL")
    none = F.lit(0)
    # Rows without an id have no label; they stay out of the join.
    labelled = masks.where("_doc IS NOT NULL").join(known, "_doc", "left").select(
        "_part", "_mask", "_rows", F.coalesce("_good", none).alias("_good"), F.coalesce("_toxic", none).alias("_toxic"))
    labelled = labelled.unionByName(masks.where("_doc IS NULL").select("_part", "_mask", "_rows", none.alias("_good"), none.alias("_toxic")))
    counted = steps.write(labelled.groupBy("_part", "_mask").agg(
        F.sum("_rows").alias("n"), F.sum(F.col("_rows") * F.col("_good")).alias("good"),
        F.sum(F.col("_rows") * F.col("_toxic")).alias("toxic")), "audit-counts")
    steps.done(masks)
    return counted.select(F.col("_part").alias("part"), F.col("_mask").alias("mask"), "n", "good", "toxic")


def orders(counts: DataFrame) -> DataFrame:
    """The audit of all orders from the counts of bit combinations: part,
    filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley."""
    steps = []
    for order in map("".join, permutations(FILTERS)):
        for i, letter in enumerate(order):
            steps.append(F.struct(F.lit(order).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(_BIT[letter]).alias("bit"),
                                  F.lit(sum(_BIT[x] for x in order[:i])).alias("before")))
    rows = counts.select("*", F.explode(F.array(*steps)).alias("s")).select("*", "s.*")
    mask, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    fails, earlier = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0

    def total(cond: Column, value: Column = F.col("n")) -> Column:
        return F.sum(F.when(cond, value).otherwise(0)).cast("long")

    # Of the orders of the filters that a document fails, each filter comes
    # first in the same share, and the first one removes the document.
    n_orders = len(steps) // len(FILTERS)
    share = F.expr(f"n * ({n_orders} div greatest(bit_count(mask), 1))")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(mask.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(fails & ~earlier, F.col("good")).alias("good_lost"),
        total(fails & ~earlier, F.col("toxic")).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    return orders(combinations(docs, labels, part))
