"""Boosted-tree gate model on Spark ML."""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.fixed_values import (
    FEATURE_NAMES,
    FEATURE_SUBSAMPLE,
    GRID_DEPTH,
    GRID_ROUNDS,
    GRID_STEP,
    ROW_SUBSAMPLE,
    SAMPLE_SEED,
    SCORE_KIND,
    TIME_FOLDS,
)
from hindcast.operators import boosting
from hindcast.operators.evaluation import log_loss, pick_winner
from hindcast.operators.folds import check_folds, fold_bounds, time_folds
from hindcast.session import stage


class ModelRefused(ValueError):
    """A saved model does not fit the contract of the caller."""


@dataclass
class ModelCard:
    """Metadata kept as one JSON row next to the saved model."""

    bundle_id: str
    model_version: str
    bundle_kind: str
    score_threshold: float
    feature_names: list[str] = field(default_factory=lambda: list(FEATURE_NAMES))
    score_kind: str = SCORE_KIND
    threshold_fitting: str = "train_f1_max"
    vol_veto_enabled: bool = False
    vol_veto_threshold: float | None = None
    policy_version: str = "v1"
    label_definition: str = ""
    train_start: str = ""
    train_end: str = ""
    dataset_hash: str = ""
    metrics: dict = field(default_factory=dict)
    family: str = "spark-trees"


#: Into how many parts, at most, equal rows are dealt: the parts are what a tree samples.
SAMPLE_LOTS = 16
LOT = "_lot"


def equal_rows(train: DataFrame, ends: Sequence[int] = (), names: Sequence[str] = FEATURE_NAMES, row: str = "event_id") -> DataFrame:
    """Rows of equal features and label as few rows that carry the sum of their weights.

    To a tree a row of weight 3 is three rows of weight 1, so all passes of all fits go over
    what differs. With `ends`, `time_rank` becomes the first of them at or after it (null
    after the last), so a filter `time_rank <= end` keeps what it kept. Rows are dealt into
    lots by a hash of their id, so that a tree's share of the rows does not take or leave
    all equal ones; rows that came out of here are added up by the lots they have.
    """
    lot = F.col(LOT) if LOT in train.columns else F.pmod(F.xxhash64(F.col(row).cast("string")), F.lit(SAMPLE_LOTS)).cast("int")
    keys = {LOT: lot, "label": F.col("label"), **{n: F.col(n) for n in names}}
    if ends:
        keys["time_rank"] = F.coalesce(*[F.when(F.col("time_rank") <= end, F.lit(end)) for end in sorted(ends)]).cast("long")
    return train.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.sum("weight").alias("weight"))


class SparkTrees:
    """Spark's boosted trees: first-order, subsets of features by node."""

    family = "spark-trees"

    def rows(self, train: DataFrame, ends: Sequence[int]) -> DataFrame:
        """What `fit` is given for ranks up to one of `ends`."""
        return stage(equal_rows(train, ends), "equal-rows")

    def fit(self, train: DataFrame, max_depth: int, step_size: float, rounds: int) -> PipelineModel:
        return fit_gate_model(train, max_depth, step_size, rounds)

    def score(self, model: PipelineModel, df: DataFrame) -> DataFrame:
        return score_rows(model, df)

    def losses(self, model: PipelineModel, rows: DataFrame, rounds: Sequence[int]) -> dict[int, float]:
        # Mean of 2 * log(1 + exp(-2 y f)) after each round: twice the log loss.
        curve = model.stages[-1].evaluateEachIteration(model.stages[0].transform(rows.withColumn("weight", F.lit(1.0))))
        return {r: curve[r - 1] / 2 for r in rounds}


class SecondOrderTrees:
    """Second-order trees with lambda, and features drawn by tree; `options` go to `boosting.fit_boosted`."""

    family = "second-order"

    def __init__(self, names: Sequence[str] = FEATURE_NAMES, **options):
        self.names, self.options = names, options

    def rows(self, train: DataFrame, ends: Sequence[int]) -> DataFrame:
        """All rows: a tree's share is drawn by the row's id."""
        return train

    def fit(self, train: DataFrame, max_depth: int, step_size: float, rounds: int) -> boosting.Boosted:
        return boosting.fit_boosted(train, max_depth, step_size, rounds, self.names, **self.options)

    def score(self, model: boosting.Boosted, df: DataFrame) -> DataFrame:
        return boosting.score_boosted(model, df)

    def losses(self, model: boosting.Boosted, rows: DataFrame, rounds: Sequence[int]) -> dict[int, float]:
        return boosting.log_losses(model, rows, rounds)


def ordered_features(df: DataFrame, names: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """Vector in contract order; a null or missing feature is an error."""
    return VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="error").transform(df)


def weighted(df: DataFrame, scale_pos_weight: float, label: str = "label_high_risk") -> DataFrame:
    return df.withColumns(
        {
            "label": F.col(label).cast("double"),
            "weight": F.when(F.col(label) == 1, F.lit(float(scale_pos_weight))).otherwise(F.lit(1.0)),
        }
    )


def fit_gate_model(
    train: DataFrame,
    max_depth: int,
    step_size: float,
    rounds: int,
    names: Sequence[str] = FEATURE_NAMES,
    row_share: float = ROW_SUBSAMPLE,
    feature_share: float = FEATURE_SUBSAMPLE,
) -> PipelineModel:
    """`train` has the features, `label`, `weight` and an event_id; the shares are what a tree sees of rows and a node of features.

    Equal rows are added up first, and ordered, so that tasks that are repeated sample alike.
    """
    train = equal_rows(train, names=names).sortWithinPartitions(LOT, "label", *names)
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight",
        maxDepth=max_depth, stepSize=step_size, maxIter=rounds,
        subsamplingRate=row_share, featureSubsetStrategy="all" if feature_share >= 1 else str(feature_share), seed=SAMPLE_SEED,
    )
    assemble = VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="error")
    return Pipeline(stages=[assemble, trees]).fit(train)


def score_rows(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    probability = vector_to_array("probability")
    return model.transform(df).withColumn(out, probability[1]).drop("features", "rawPrediction", "probability", "prediction")


def hpo_time_grid(
    train: DataFrame,
    n: int,
    depths: Sequence[int] = GRID_DEPTH,
    steps: Sequence[float] = GRID_STEP,
    rounds: Sequence[int] = GRID_ROUNDS,
    folds: int = TIME_FOLDS,
    submit: int = 4,
    learner: SparkTrees | SecondOrderTrees | None = None,
) -> DataFrame:
    """Mean validation log loss of every grid point over expanding folds.

    `train` carries time_rank, features, label and weight and should be cached;
    a fold is a range of ranks over it, not a copy. Boosting adds trees one at a time with a seed per tree, so a model of
    few rounds is the head of the longer one: one fit per (depth, step, fold)
    serves every number of rounds. Fits are submitted from a few threads, over the
    rows as the learner takes them (`rows`); losses are means over all validation rows.
    """
    spark = train.sparkSession
    check_folds(time_folds(train.select("time_rank", "label"), n, folds))
    longest = max(rounds)
    rank = F.col("time_rank")
    learner = learner or SparkTrees()
    learnt = learner.rows(train, [start for _, start, _ in fold_bounds(n, folds)])

    def losses(task: tuple[int, float, tuple[int, int, int]]) -> list[tuple]:
        depth, step, (fold, start, end) = task
        model = learner.fit(learnt.filter(rank <= start), depth, step, longest)
        curve = learner.losses(model, train.filter((rank > start) & (rank <= end)), rounds)
        return [(depth, float(step), r, fold, start, end, curve[r]) for r in rounds]

    tasks = [(d, s, b) for d in depths for s in steps for b in fold_bounds(n, folds)]
    with ThreadPoolExecutor(submit) as pool:
        found = [row for rows in pool.map(losses, tasks) for row in rows]
    schema = "max_depth int, step_size double, rounds int, fold int, last_train_rank long, last_rank long, log_loss double"
    per_fold = spark.createDataFrame(found, schema)
    return per_fold.groupBy("max_depth", "step_size", "rounds").agg(
        F.array_sort(F.collect_list(F.struct("fold", "last_train_rank", "last_rank", "log_loss"))).alias("folds"),
        F.avg("log_loss").alias("mean_log_loss"),
    )


def winner(grid: DataFrame):
    return pick_winner(grid).first()


def validation_loss(model: PipelineModel, rows: DataFrame) -> float:
    return log_loss(score_rows(model, rows)).first().log_loss


def save_model(model: PipelineModel | boosting.Boosted, card: ModelCard, path: str) -> None:
    spark = SparkSession.getActiveSession()
    if isinstance(model, boosting.Boosted):
        card.family = SecondOrderTrees.family
        trees = spark.createDataFrame([(json.dumps(model.to_dict()),)], "trees string")
        trees.coalesce(1).write.mode("overwrite").text(f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(asdict(card)),)], "card string").coalesce(1).write.mode("overwrite").text(
        f"{path}/card"
    )


def load_model(
    spark: SparkSession, path: str, required_kind: str | None = None, names: Sequence[str] = FEATURE_NAMES
) -> tuple[PipelineModel | boosting.Boosted, ModelCard]:
    """Load, refusing a model whose contract differs from the caller's."""
    try:
        card = ModelCard(**json.loads(spark.read.text(f"{path}/card").first()[0]))
    except Exception as exc:
        raise ModelRefused(f"model refused: no readable card under {path}: {exc}") from exc
    if list(card.feature_names) != list(names):
        raise ModelRefused(f"model refused: features {card.feature_names}, expected {list(names)}")
    if card.score_kind != SCORE_KIND:
        raise ModelRefused(f"model refused: score kind {card.score_kind!r}, expected {SCORE_KIND!r}")
    if required_kind and card.bundle_kind != required_kind:
        raise ModelRefused(f"model refused: kind {card.bundle_kind!r}, required {required_kind!r}")
    if card.family == SecondOrderTrees.family:
        return boosting.Boosted.from_dict(json.loads(spark.read.text(f"{path}/model").first()[0])), card
    return PipelineModel.load(f"{path}/model"), card
