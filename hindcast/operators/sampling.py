"""Deterministic stratified sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.fixed_values import SAMPLE_SEED, SAMPLE_TARGET
from hindcast.operators.scale import first_by_hash
from hindcast.session import stage


def stratified_sample(
    df: DataFrame,
    n_strata: int,
    target: int = SAMPLE_TARGET,
    seed: int = SAMPLE_SEED,
    stratum: str = "ticker",
    id_col: str = "event_id",
) -> DataFrame:
    """`target // n_strata` rows per stratum, topped up from the rest.

    Order is the hash of seed and id, so the sample does not depend on how the
    rows are partitioned. All rows are kept when there are no more than target.
    Any sampled row is among the first `target` of its own stratum, so the
    second step only sees that many rows per stratum.
    """
    per_stratum = max(1, target // n_strata)
    hashed = df.withColumn("_hash", F.sha2(F.concat(F.lit(str(seed)), F.col(id_col)), 256))
    first = first_by_hash(hashed, [stratum], "_hash", id_col, target, "_place")
    # Stratum rows sort before top-up rows: one leading digit on the hash.
    staged = stage(
        first.withColumn(
            "_turn", F.concat(F.when(F.col("_place") <= per_stratum, F.lit("0")).otherwise(F.lit("1")), "_hash")
        ),
        "sample",
    )
    chosen = first_by_hash(staged, [], "_turn", id_col, target, "_turn_place")
    return chosen.drop("_hash", "_place", "_turn", "_turn_place")
