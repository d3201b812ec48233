"""Shared tools for hot keys, exact ranks and size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.session import stage

MAX_BROADCAST_ROWS = 1_000_000
HOT_KEY_ROWS = 1_000_000
SALTS = 32
HASH_BUCKET_HEX_DIGITS = 4


def small(df: DataFrame, rows: int, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the known row count allows.

    Beyond the bound there is no hint and the join is planned from its size.
    """
    return F.broadcast(df) if rows <= max_rows else df


def bounded(df: DataFrame, name: str, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Stage a lookup side, count it, and hint a broadcast if it is small."""
    staged = stage(df, name)
    return small(staged, staged.count(), max_rows)


def computed_once(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep costly columns from being recomputed by the filters put on them.

    A filter on a projected column is pushed below the projection with the
    expression inlined at every use, so one parsed document may be parsed dozens
    of times. Columns that come out of a generator are not inlined.
    """
    names = [c for c in df.columns if c in set(names)]
    rest = [c for c in df.columns if c not in names]
    packed = df.select(*rest, F.explode(F.array(F.struct(*names))).alias("_once"))
    return packed.select(*[F.col(f"_once.{c}").alias(c) if c in names else F.col(c) for c in df.columns])


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Keys held by more than `min_rows` rows; counted with map-side combine."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return stage(counts.filter(F.col("_n") > min_rows).select(*keys), "hot-keys")


def skew_join(
    many: DataFrame,
    few: DataFrame,
    keys: Sequence[str],
    how: str,
    spread_by: Column,
    min_rows: int = HOT_KEY_ROWS,
    salts: int = SALTS,
) -> tuple[DataFrame, bool]:
    """Equi-join whose hot keys (on the `many` side) are spread over salts.

    Rows of `few` are repeated for hot keys only. Salts come from a hash of the
    row, so a retried task gives the same rows. Returns the join and whether
    salts are in use; when they are, column `_salt` is kept for a second level.
    """
    keys = list(keys)
    hot = hot_keys(many, keys, min_rows)
    n_hot = hot.count()
    if n_hot == 0:
        return many.join(few, keys, how), False
    # At most total_rows / min_rows keys can be hot; the count is still checked.
    flagged = small(hot.withColumn("_hot", F.lit(True)), n_hot)
    left = many.join(flagged, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).otherwise(0)
    )
    right = few.join(flagged, keys, "left").withColumn(
        "_salt",
        F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
    )
    return left.drop("_hot").join(right.drop("_hot"), [*keys, "_salt"], how), True


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salted: bool = False) -> DataFrame:
    """First k rows per key, position in `rank` (1-based).

    `row_number <= k` is planned with a group limit before the shuffle. With
    salts, each (key, salt) is cut to k first, so no task sees a whole hot key.
    """
    if salted:
        local = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_local", F.row_number().over(local)).filter(F.col("_local") <= k).drop("_local", "_salt")
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def first_rows(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of each key with the smallest `order`, a number that no two rows share.

    Only keys and numbers are aggregated (fixed-width buffers, merged before the
    shuffle); the rows themselves are fetched by their number afterwards.
    """
    firsts = df.groupBy(*keys).agg(F.min(order).alias(order)).select(order)
    return df.join(firsts, order, "left_semi").select(*df.columns)


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Exact 1-based position of every row under a total order, at any size.

    Range partitioning samples its input, so stage an expensive input first.

    Range-partition on the full order (a repeated leading value still splits on
    the next column), sort inside partitions, pin the position by staging, then
    add the row count of the earlier partitions.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    pinned = stage(ordered.withColumn("_mono", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright(F.col("_mono"), 33)
    # One row per range partition, not per input row: bounded by the number of
    # shuffle partitions.
    counts = pinned.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    position = F.col("_mono") - F.shiftleft(F.col("_part"), 33) + 1 + F.col("_offset")
    return (
        pinned.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, position.cast("long"))
        .drop("_part", "_mono", "_offset")
    )


def running_sum(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact sum of `value` over all rows up to each one under a total order, as `global_rank` does it. Stage an expensive input first."""
    pinned = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    sums = pinned.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = pinned.withColumn(name, F.sum(value).over(inside)).join(F.broadcast(offsets), "_part")
    return summed.withColumn(name, F.col(name) + F.col("_offset")).drop("_part", "_offset")


def first_by_hash(df: DataFrame, groups: Sequence[str], hash_col: str, tie: str, limit: int, name: str) -> DataFrame:
    """First `limit` rows per group in hash order, with their position.

    Counts per (group, hash prefix) give each prefix its offset; prefixes that
    start past the limit are dropped before any sort, so a hot group never has
    to pass through one task.
    """
    groups = list(groups)
    tagged = df.withColumn("_prefix", F.substring(hash_col, 1, HASH_BUCKET_HEX_DIGITS))
    counts = tagged.groupBy(*groups, "_prefix").agg(F.count(F.lit(1)).alias("_rows"))
    by_group = [F.col(g) for g in groups] or [F.lit(0)]
    # At most 16**digits rows per group.
    before = Window.partitionBy(*by_group).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    needed = offsets.filter(F.col("_offset") < limit).drop("_rows")
    inside = Window.partitionBy(*groups, "_prefix").orderBy(hash_col, tie)
    return (
        tagged.join(bounded(needed, "prefixes"), [*groups, "_prefix"])
        .withColumn(name, (F.col("_offset") + F.row_number().over(inside)).cast("long"))
        .filter(F.col(name) <= limit)
        .drop("_prefix", "_offset")
    )
