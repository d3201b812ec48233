"""What filters do to each other in every order: a recursive enumeration of filter prefixes.

Every row is reduced to a bit mask of the filters that it fails, and rows are
counted by (part, mask), at most 2^filters cells a part. A recursive query
then starts from the empty prefix of each part, extends every prefix by each
unused letter, joins the part's cells and carries the bits applied so far. One
level of the recursion is one step: it emits what this filter keeps, removes and
finds gone already. Full orders read their steps from their prefixes, so no
prefix is counted twice. A prefix of k letters stands in (filters - k)! orders,
which weighs it in the Shapley sum.

Only masks and ids travel, never texts: repeats of a text are found by its
SHA-256, as the least and the greatest id of each digest; a digest that a third
of all rows share is one row after the partial aggregation, and the rows join it
in a join that adaptive execution splits.

Defined results: a null text is empty; a null part is the empty string; a row
with a null id is nobody's copy (no id is smaller), and an id that stands twice
does not make a copy of itself; labels that repeat count if any of them is 1.
Empty tables give no rows. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import n_words, table
from hindcast.session import stage

SPACE = "[\\x20\\x09-\\x0D]+"
LETTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
SIGNS = "[#$%&*|]"
COUNTS = ("docs", "good", "toxic")
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"

#: {cells}: part, cells array<struct<mask, docs, good, toxic>>. {letters}: array of (name, bit).
WALK = """
WITH RECURSIVE walk AS (
  SELECT part, '' AS filter_order, '' AS letter, 0 AS applied, 0 AS step,
         0L AS kept, 0L AS removed, 0L AS redundant, 0L AS unique_fails, 0L AS good_lost, 0L AS toxic_lost
  FROM {cells}
  UNION ALL
  SELECT part, concat(filter_order, next.name), next.name, applied | next.bit, step + 1,
         aggregate(filter(cells, c -> c.mask & (applied | next.bit) = 0), 0L, (s, c) -> s + c.docs),
         aggregate(filter(cells, c -> c.mask & applied = 0 AND c.mask & next.bit != 0), 0L, (s, c) -> s + c.docs),
         aggregate(filter(cells, c -> c.mask & applied != 0 AND c.mask & next.bit != 0), 0L, (s, c) -> s + c.docs),
         aggregate(filter(cells, c -> c.mask = next.bit), 0L, (s, c) -> s + c.docs),
         aggregate(filter(cells, c -> c.mask & applied = 0 AND c.mask & next.bit != 0), 0L, (s, c) -> s + c.good),
         aggregate(filter(cells, c -> c.mask & applied = 0 AND c.mask & next.bit != 0), 0L, (s, c) -> s + c.toxic)
  FROM (
    SELECT w.part, w.filter_order, w.applied, w.step, m.cells, next
    FROM walk w JOIN {cells} m ON w.part = m.part
    LATERAL VIEW explode(filter({letters}, l -> l.bit & w.applied = 0)) unused AS next)
)
SELECT * FROM walk WHERE step > 0
"""


def fails(text: Column) -> Column:
    """The bits of the filters that look at one text alone: A 1, B 2, C 4, D 8."""
    words = F.array_remove(F.split(text, SPACE), "")
    distinct = F.size(F.array_distinct(words)).cast("long")
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    tests = (
        n_words(text) < MIN_WORDS,
        100 * distinct < MIN_DISTINCT_PERCENT * n_words(text),
        100 * capitals > MAX_CAPITAL_PERCENT * F.char_length(text).cast("long"),
        text.rlike(SIGNS),
    )
    mask = F.lit(0)
    for k, failed in enumerate(tests):
        mask = mask.bitwiseOR(F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)))
    return mask


def flagged(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """doc_id, part, mask (a bit for each failed filter), good and toxic (0 or 1) of every document."""
    whole = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole, 256)).alias("digest"), fails(whole).alias("mask"),
    )
    narrow = stage(narrow, "masks")
    ids = narrow.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    copied = ids.filter(F.col("least") < F.col("most")).select("digest", "least")
    copy = F.when(F.col("least") < F.col("doc_id"), F.lit(1 << LETTERS.index("E"))).otherwise(F.lit(0))
    marks = labels.groupBy(F.col("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    return (
        narrow.join(copied, "digest", "left")
        .select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask"))
        .join(marks, "doc_id", "left")
        .select("doc_id", "part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    )


def mask_cells(rows: DataFrame) -> DataFrame:
    """part and its cells: one (mask, docs, good, toxic) for each mask that occurs."""
    counted = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("docs"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))


def prefixes(cells: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """One row for each part and non-empty prefix of distinct letters, with its last step's counts."""
    spark = cells.sparkSession
    known = ", ".join(f"named_struct('name', '{name}', 'bit', {1 << k})" for k, name in enumerate(letters))
    before = spark.conf.get(ROW_LIMIT, None)
    # The rows are parts times prefixes, whatever the number of parts.
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return stage(spark.sql(WALK.replace("{letters}", f"array({known})"), cells=stage(cells, "cells")), "prefixes")
    finally:
        if before is None:
            spark.conf.unset(ROW_LIMIT)
        else:
            spark.conf.set(ROW_LIMIT, before)


def audit(rows: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """Every step of every order of the filters. rows: part, mask, good, toxic."""
    letters = list(letters)
    n = len(letters)
    walk = prefixes(mask_cells(rows), letters)
    orders_with = F.factorial(F.lit(n) - F.col("step"))
    shapley = walk.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders_with).alias("shapley"))
    steps = walk.filter(F.col("step") == n).select("part", F.col("filter_order").alias("whole"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k"))
    steps = steps.withColumn("filter_order", F.substring("whole", F.lit(1), F.col("k")))
    return (
        steps.join(walk, ["part", "filter_order"])
        .join(shapley, ["part", "letter"])
        .select("part", F.col("whole").alias("filter_order"), "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
