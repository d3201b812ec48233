"""Counts, rates and thresholds over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.fixed_values import (
    F1_GAP_WARNING,
    LABEL_THRESHOLD,
    THRESHOLD_FIRST,
    THRESHOLD_LAST,
    THRESHOLD_POINTS,
)


def threshold_grid() -> list[float]:
    """Evenly spaced thresholds; the last one is the exact end point."""
    step = (THRESHOLD_LAST - THRESHOLD_FIRST) / (THRESHOLD_POINTS - 1)
    return [i * step + THRESHOLD_FIRST for i in range(THRESHOLD_POINTS - 1)] + [THRESHOLD_LAST]


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """n_pos, n_neg and the positive-class weight; null weight with no positive."""
    y = F.col(label)
    return df.agg(F.count_if(y == 1).alias("n_pos"), F.count_if(y == 0).alias("n_neg")).withColumn(
        "scale_pos_weight", F.col("n_neg") / F.nullif("n_pos", F.lit(0))
    )


def confusion(predicted: Column, actual: Column) -> list[Column]:
    return [
        F.count_if(predicted & (actual == 1)).alias("tp"),
        F.count_if(predicted & (actual == 0)).alias("fp"),
        F.count_if(~predicted & (actual == 0)).alias("tn"),
        F.count_if(~predicted & (actual == 1)).alias("fn"),
    ]


def confusion_counts(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    return df.agg(*confusion(F.col(prediction) == 1, F.col(label)))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def prf1(counts: DataFrame) -> DataFrame:
    """Add precision, recall and f1; a zero denominator gives 0."""
    rated = counts.withColumns(
        {
            "precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        }
    )
    both = F.col("precision") + F.col("recall")
    return rated.withColumn(
        "f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0)), F.lit(0.0))
    )


def at_or_above(score: Column, threshold: Column | float) -> Column:
    """NaN is never at or above a threshold."""
    return F.coalesce((score >= threshold) & ~F.isnan(score), F.lit(False))


def threshold_f1(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """tp/fp/fn and F1 at every grid threshold, from one pass over the rows.

    Each row is reduced to the number of thresholds it reaches, rows are counted
    per such number (at most 20 groups), and the groups are unfolded.
    """
    grid = threshold_grid()
    reached = sum((at_or_above(F.col(score), t).cast("int") for t in grid), F.lit(0))
    groups = df.groupBy(reached.alias("reached")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    # Threshold number i is predicted positive by every group reaching >= i;
    # the same unfolding carries the misses, so no second pass is needed.
    steps = groups.select(
        F.explode(F.sequence(F.lit(1), F.lit(len(grid)))).alias("step"), "reached", "pos", "neg"
    )
    hit = F.col("reached") >= F.col("step")
    counts = steps.groupBy("step").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"),
    )
    values = F.array(*[F.lit(t) for t in grid])
    return prf1(counts).withColumn("threshold", F.element_at(values, F.col("step")))


def best_threshold(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """The row of the best F1; ties go to the smallest threshold."""
    return threshold_f1(df, score, label).orderBy(F.desc("f1"), F.asc("threshold")).limit(1)


def fit_threshold(df: DataFrame, score: str = "score", label: str = "label") -> float:
    """The chosen threshold as a number; both classes must occur."""
    best = best_threshold(df, score, label).first()
    if best is None or best.tp + best.fn == 0 or best.fp + best.tn == 0:
        raise ValueError("cannot fit a threshold: fewer than two classes")
    return float(best.threshold)


def split_metrics(df: DataFrame, threshold: float, score: str = "score", label: str = "label", split: str = "split") -> DataFrame:
    counts = df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"), *confusion(at_or_above(F.col(score), F.lit(threshold)), F.col(label))
    )
    return prf1(counts)


def f1_gap(metrics: DataFrame, split: str = "split") -> DataFrame:
    """Distance of train and test F1 and whether it is large."""
    side = lambda name: F.max(F.when(F.col(split) == name, F.col("f1")))
    return metrics.agg(side("train").alias("train_f1"), side("test").alias("test_f1")).select(
        "train_f1",
        "test_f1",
        F.abs(F.col("train_f1") - F.col("test_f1")).alias("f1_gap"),
        (F.abs(F.col("train_f1") - F.col("test_f1")) > F1_GAP_WARNING).alias("large_gap"),
    )


def log_loss(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Mean negative log-likelihood; probabilities clipped to [eps, 1 - eps]."""
    eps = 2.220446049250313e-16  # FIXED VALUE: double precision epsilon
    p = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), F.col(score)))
    loss = F.when(F.col(label) == 1, -F.ln(p)).otherwise(-F.ln(1.0 - p))
    return df.groupBy(*by).agg(F.avg(loss).alias("log_loss"), F.count(F.lit(1)).alias("rows"))


def label_rate(df: DataFrame, by: Sequence[str] = (), label: str = "label_high_risk", sentiment: str | None = None) -> DataFrame:
    extra = [F.min(sentiment).alias("sentiment_min"), F.max(sentiment).alias("sentiment_max")] if sentiment else []
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(label) == 1).alias("positive"),
        F.avg(F.col(label).cast("double")).alias("label_rate"),
        *extra,
    )


def dataset_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free fingerprint: count, xor and sum of per-row SHA-256 lanes.

    Each field is written with its length before it and null as a sign of its
    own, so different rows have different texts.
    """
    texts = [F.col(c).cast("string") for c in columns]
    fields = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    digest = F.sha2(F.concat(*fields), 256)
    lane = lambda start: F.conv(F.substring("_d", start, 15), 16, 10).cast("long")
    return df.select(digest.alias("_d")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(lane(1)).alias("xor_a"),
        F.bit_xor(lane(16)).alias("xor_b"),
        F.sum(lane(31).cast("decimal(38,0)")).cast("string").alias("sum_c"),
    )


def pick_winner(candidates: DataFrame) -> DataFrame:
    """Lowest mean loss; ties go to the smaller depth, step and rounds."""
    return candidates.orderBy("mean_log_loss", "max_depth", "step_size", "rounds").limit(1)


def decision_rates(decisions: DataFrame, by: Sequence[str] = ("ticker", "action")) -> DataFrame:
    return decisions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((F.col("decision") == "reject").cast("double")).alias("reject_rate"),
    )


def label_definition() -> str:
    return f"fwd_return_5d < {LABEL_THRESHOLD}"
