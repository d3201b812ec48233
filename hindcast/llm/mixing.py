"""Mix sources to target weights with hash-threshold histograms.

Every source gets a share of all words by its weight; no source is repeated
more than `max_repeats` times, and what such a source cannot take is shared
again among the others. Inside a source the decision is one comparison: a
document is taken `whole` times, and once more if its hash lies under the
source's threshold. The threshold comes from histograms: words summed by
(source, leading hash bits) show the bucket in which the budget ends, and only
that bucket is split by the next bits. Nothing is sorted, the selections for a
smaller and a larger budget are nested, and a rerun decides alike.

Nulls: a null source is a source of its own (ordered last); a null text has
size 0; a null id hashes as an empty text. Rows with the same id share a hash
and are taken or left together. Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm.common import n_words, table, unused
from hindcast.operators.scale import global_rank, small
from hindcast.session import stage

HASH_DIGITS = 15
LEVEL_DIGITS = 3
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3


def selection_hash(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 of the id's text."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, HASH_DIGITS)
    return F.conv(digits, 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """`source`, `source_size` and the words to take from it, `target`.

    The level at which the shares stand is raised until no further source is
    over its limit; each round is one sum over the sources.
    """
    ranked = global_rank(sources.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "_rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = stage(ranked.select("source", "source_size", weight.cast("long").alias("_weight")), "sources")
    limit = F.col("source_size") * max_repeats
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = None, -1
    while True:
        over = F.lit(False) if level is None else F.lit(level) * F.col("_weight") > limit
        spent, open_weight, n = ranked.agg(
            F.coalesce(F.sum(F.when(over, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("_weight"))), F.lit(0)),
            F.count(F.when(over, 1)),
        ).first()
        if n == stopped or not open_weight:
            break
        stopped, level = n, (total - spent) / open_weight
    share = F.lit(float(level or 0.0)) * F.col("_weight")
    return ranked.select("source", "source_size", F.least(share, limit.cast("double")).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source the whole repeats (`whole`) and the hash under which a document is taken once more (`bound`).

    sized: source, size, hash. targets: of `source_targets`. Each round reads
    only the rows of the bucket in which a budget ends, so work falls by 16 to
    the power LEVEL_DIGITS from round to round.
    """
    n_sources = targets.count()
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("_rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # _low: first hash of the bucket in which the budget ends; _spent: words under it.
    edge = stage(plan.select("source", "_rest", F.lit(0).cast("long").alias("_low"), F.lit(0).cast("long").alias("_spent")), "edges")
    done = []
    digits = 0
    rows = sized.select(F.col("source").alias("_of"), "size", "hash")
    while True:
        digits += LEVEL_DIGITS
        low = 4 * (HASH_DIGITS - digits)
        high = low + 4 * LEVEL_DIGITS
        same = F.col("_of").eqNullSafe(F.col("source")) & (F.shiftright("hash", high) == F.shiftright("_low", high))
        buckets = (
            rows.join(small(edge, n_sources), same)
            .groupBy("source", "_rest", "_spent", F.shiftright("hash", low).alias("_bucket"))
            .agg(F.sum("size").alias("_words"), F.min("hash").alias("_first"), F.max("hash").alias("_final"))
        )
        # At most 16 ** LEVEL_DIGITS buckets for a source; those up to the one in which the budget ends.
        ordered = Window.partitionBy("source").orderBy("_bucket")
        upto = F.col("_spent") + F.sum("_words").over(ordered)
        found = stage(
            buckets.withColumn("_upto", upto)
            .filter(F.col("_upto") > F.col("_rest"))
            .groupBy("source")
            .agg(F.min(F.struct("_bucket", "_words", "_first", "_final", "_upto", "_rest")).alias("_at")),
            "histogram",
        ).select("source", "_at.*", (F.col("_at._upto") - F.col("_at._words")).alias("_before"))
        single = F.col("_first") == F.col("_final")
        # The bucket is one hash: it joins if that brings the sum nearer.
        nearer = F.col("_upto") - F.col("_rest") < F.col("_rest") - F.col("_before")
        bound = F.when(nearer, F.col("_first") + 1).otherwise(F.col("_first"))
        done.append(found.filter(single).select("source", bound.alias("bound")))
        edge = stage(
            found.filter(~single).select("source", "_rest", F.shiftleft("_bucket", low).alias("_low"), F.col("_before").alias("_spent")), "edges"
        )
        if digits >= HASH_DIGITS or edge.isEmpty():
            break
    bounds = done[0]
    for more in done[1:]:
        bounds = bounds.unionByName(more)
    bounds = bounds.withColumnRenamed("source", "_s")
    # A source without a boundary takes every document once more, or none is left to take.
    return stage(
        plan.join(small(bounds, n_sources), F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", "source_size", "target", "whole",
            F.coalesce("bound", F.when(F.col("_rest") > 0, F.lit(16**HASH_DIGITS)).otherwise(F.lit(0))).alias("bound"),
        ),
        "thresholds",
    )


def fit(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Thresholds for rows of (source, size, hash)."""
    sources = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    return thresholds(sized, source_targets(sources, weights, max_repeats))


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
    weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """The rows of the mixture: each document as often as it is taken, columns unchanged.

    Sizes and hashes go through a narrow written table; the texts are read once
    more only to be filtered, and never shuffled.
    """
    sized = stage(docs.select(F.col(source).alias("source"), n_words(F.col(text)).alias("size"), selection_hash(F.col(doc_id)).alias("hash")), "sizes")
    fitted = fit(sized, weights, max_repeats)
    of, whole, bound = (unused(c, docs.columns) for c in ("_mix_of", "_mix_whole", "_mix_bound"))
    rule = fitted.select(F.col("source").alias(of), F.col("whole").alias(whole), F.col("bound").alias(bound))
    once_more = (selection_hash(docs[doc_id]) < F.col(bound)).cast("int")
    joined = docs.join(small(rule, rule.count()), docs[source].eqNullSafe(F.col(of)))
    copies = unused("_mix_copy", docs.columns)
    taken = F.col(whole).cast("int") + once_more
    return (
        joined.filter(taken > 0)
        .withColumn(copies, F.explode(F.array_repeat(F.lit(0), taken)))
        .select(*[docs[c] for c in docs.columns])
    )


def op1_mixing_sources(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), selection_hash(F.col("doc_id")).alias("hash")), "sizes")
    fitted = fit(sized)
    fitted = fitted.select(F.col("source").alias("_s"), "source_size", "target", "whole", "bound")
    joined = sized.join(small(fitted, fitted.count()), F.col("source").eqNullSafe(F.col("_s")))
    taken = F.col("size") * (F.col("whole") + (F.col("hash") < F.col("bound")).cast("long"))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
