"""Training table -> saved gate model, chosen on time-ordered folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.fixed_values import FEATURE_NAMES, GRID_DEPTH, GRID_ROUNDS, GRID_STEP
from hindcast.operators.evaluation import (
    class_balance,
    dataset_fingerprint,
    f1_gap,
    fit_threshold,
    label_definition,
    split_metrics,
)
from hindcast.operators.folds import split_bounds, time_split
from hindcast.operators.training import (
    ModelCard,
    hpo_time_grid,
    SecondOrderTrees,
    SparkTrees,
    save_model,
    weighted,
    winner,
)
from hindcast.session import stage
from hindcast.sources.files import check_training_table


class TrainError(ValueError):
    """The table cannot be trained on."""


def train_gate(
    table: DataFrame,
    path: str | None = None,
    bundle_id: str = "hindcast-gate",
    model_version: str = "1",
    depths: Sequence[int] = GRID_DEPTH,
    steps: Sequence[float] = GRID_STEP,
    rounds: Sequence[int] = GRID_ROUNDS,
    learner: SparkTrees | SecondOrderTrees | None = None,
):
    """Split by time, search on the first 80 %, refit, fit the threshold on the
    training rows only, measure both splits. Returns model, card and metrics."""
    learner = learner or SparkTrees()
    data = time_split(check_training_table(table)).withColumn("label", F.col("label_high_risk").cast("double"))
    bounds = {r.split: r for r in split_bounds(data).collect()}  # two rows
    balance = class_balance(data.filter(F.col("split") == "train")).first()
    if not balance.n_pos:
        raise TrainError("no positive label in the training rows")
    # Trees make many passes over the rows.
    rows = weighted(data, balance.scale_pos_weight).select(
        "event_id", "time_rank", "split", "label", "weight", *FEATURE_NAMES
    ).cache()
    try:
        train = rows.filter(F.col("split") == "train")
        grid = hpo_time_grid(train, bounds["train"].rows, depths, steps, rounds, learner=learner)
        best = winner(grid)
        model = learner.fit(train, best.max_depth, best.step_size, best.rounds)
        scored = stage(learner.score(model, rows), "scored")
    finally:
        rows.unpersist()
    threshold = fit_threshold(scored.filter(F.col("split") == "train"))
    metrics = stage(split_metrics(scored, threshold), "metrics")
    by_split = {r.split: r.asDict() for r in metrics.collect()}  # two rows
    gap = f1_gap(metrics).first().asDict()
    fingerprint = dataset_fingerprint(table, [*FEATURE_NAMES, "label_high_risk"]).first()
    card = ModelCard(
        bundle_id=bundle_id,
        model_version=model_version,
        bundle_kind="trained",
        family=learner.family,
        score_threshold=threshold,
        label_definition=label_definition(),
        train_start=str(bounds["train"].first),
        train_end=str(bounds["train"].last),
        dataset_hash=f"{fingerprint.rows}-{fingerprint.xor_a:x}-{fingerprint.xor_b:x}-{fingerprint.sum_c}",
        metrics={
            "splits": by_split,
            "gap": gap,
            "scale_pos_weight": balance.scale_pos_weight,
            "winner": {"max_depth": best.max_depth, "step_size": best.step_size, "rounds": best.rounds},
            "mean_log_loss": best.mean_log_loss,
        },
    )
    if path:
        save_model(model, card, path)
    return model, card, metrics
