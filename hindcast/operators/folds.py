"""Time-ordered splits and expanding folds, from one exact global rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.fixed_values import MIN_FOLD_ROWS, TIME_FOLDS, TRAIN_FRACTION
from hindcast.operators.scale import global_rank


class SplitError(ValueError):
    """Too few rows or classes for the requested split."""


def time_rank(df: DataFrame, clock: str = "published_at", tie: str = "event_id") -> DataFrame:
    """1-based position by time, ties by id, in column `time_rank`."""
    return global_rank(df, [clock, tie], "time_rank")


def assign_split(ranked: DataFrame, n: int, fraction: float = TRAIN_FRACTION) -> DataFrame:
    n_train = int(n * fraction)
    return ranked.withColumn("split", F.when(F.col("time_rank") <= n_train, F.lit("train")).otherwise(F.lit("test")))


def time_split(df: DataFrame, fraction: float = TRAIN_FRACTION, clock: str = "published_at", tie: str = "event_id") -> DataFrame:
    """First int(fraction * n) rows by time are `train`, the rest `test`."""
    ranked = time_rank(df, clock, tie)
    n = ranked.count()
    n_train = int(n * fraction)
    if n_train < TIME_FOLDS + 1 or n - n_train < 1:
        raise SplitError(f"split too small: {n} rows, {n_train} for training")
    return assign_split(ranked, n, fraction)


def split_bounds(split: DataFrame, clock: str = "published_at") -> DataFrame:
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.min(clock).alias("first"), F.max(clock).alias("last")
    )


def fold_bounds(n: int, folds: int = TIME_FOLDS) -> list[tuple[int, int, int]]:
    """(fold, last training rank, last validation rank) of expanding folds."""
    size = n // (folds + 1)
    first = n - folds * size
    return [(f, first + (f - 1) * size, first + f * size) for f in range(1, folds + 1)]


def time_folds(ranked: DataFrame, n: int, folds: int = TIME_FOLDS) -> DataFrame:
    """Rows with fold and role: fold f validates on one slice of n // (folds+1)
    rows and trains on everything before it. A row occurs once per fold."""
    bounds = F.array(
        *[
            F.struct(F.lit(f).alias("fold"), F.lit(start).alias("start"), F.lit(end).alias("end"))
            for f, start, end in fold_bounds(n, folds)
        ]
    )
    rank = F.col("time_rank")
    used = ranked.withColumn("_b", F.explode(F.filter(bounds, lambda b: rank <= b["end"])))
    role = F.when(rank <= F.col("_b.start"), F.lit("train")).otherwise(F.lit("validate"))
    return used.withColumns({"fold": F.col("_b.fold"), "role": role}).drop("_b")


def check_folds(folded: DataFrame, label: str = "label", min_rows: int = MIN_FOLD_ROWS) -> DataFrame:
    """Fail unless every fold has enough validation rows and both classes."""
    stats = folded.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(label).alias("classes")
    )
    bad = stats.filter(
        ((F.col("role") == "validate") & (F.col("rows") < min_rows)) | (F.col("classes") < 2)
    ).first()
    if bad is not None:
        raise SplitError(f"fold {bad.fold} {bad.role}: {bad.rows} rows, {bad.classes} class(es)")
    return folded
