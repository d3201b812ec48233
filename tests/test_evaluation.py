import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.fixed_values import FEATURE_NAMES
from hindcast.operators import evaluation, folds, sentiment, training
from hindcast.plans.train_gate import TrainError, train_gate
from hindcast.sinks.tables import sink_training_parquet

RNG = random.Random(3)
SCORED = [(i, round(RNG.random(), 2), RNG.random() < 0.3) for i in range(500)]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, s, int(y)) for i, s, y in SCORED] + [(900, float("nan"), 1)]
    return spark.createDataFrame(rows, "id int, score double, label int")


def brute(threshold):
    rows = [(s, y) for _, s, y in SCORED] + [(float("nan"), True)]
    hit = [(s >= threshold, y) for s, y in rows]
    tp, fp = sum(p and y for p, y in hit), sum(p and not y for p, y in hit)
    tn, fn = sum(not p and not y for p, y in hit), sum(not p and y for p, y in hit)
    p, r = (tp / (tp + fp) if tp + fp else 0.0), (tp / (tp + fn) if tp + fn else 0.0)
    return tp, fp, tn, fn, (2 * p * r / (p + r) if p + r else 0.0)


def test_grid_is_linspace():
    assert evaluation.threshold_grid() == list(np.linspace(0.05, 0.95, 19))


def test_threshold_sweep_equals_brute_force(scored):
    rows = evaluation.threshold_f1(scored).collect()
    assert len(rows) == 19
    for r in rows:
        assert (r.tp, r.fp, r.tn, r.fn, r.f1) == brute(r.threshold)
    best = max(evaluation.threshold_grid(), key=lambda t: (brute(t)[4], -t))
    assert evaluation.fit_threshold(scored) == best


def test_threshold_needs_two_classes(scored):
    with pytest.raises(ValueError):
        evaluation.fit_threshold(scored.filter("label = 1"))


def test_zero_division_gives_zero(spark):
    df = spark.createDataFrame([(0, 0, 5, 0), (0, 0, 5, 2), (0, 3, 0, 0)], "tp long, fp long, tn long, fn long")
    assert [(r.precision, r.recall, r.f1) for r in evaluation.prf1(df).collect()] == [(0.0, 0.0, 0.0)] * 3


def test_log_loss_clips(spark):
    df = spark.createDataFrame([(1.0, 1), (0.0, 1), (0.25, 0)], "score double, label int")
    eps = 2.220446049250313e-16
    expected = (-math.log(1 - eps) - math.log(eps) - math.log(0.75)) / 3
    assert evaluation.log_loss(df).first().log_loss == pytest.approx(expected)


def test_fingerprint_ignores_order_but_not_content(scored):
    a = evaluation.dataset_fingerprint(scored, ["id", "label"]).first()
    assert a == evaluation.dataset_fingerprint(scored.repartition(5), ["id", "label"]).first()
    changed = scored.withColumn("label", F.when(F.col("id") == 7, 1 - F.col("label")).otherwise(F.col("label")))
    assert a != evaluation.dataset_fingerprint(changed, ["id", "label"]).first()


def test_winner_ties(spark):
    rows = [(3, 0.05, 40, 0.5), (2, 0.1, 40, 0.5), (2, 0.05, 60, 0.5), (2, 0.05, 40, 0.6)]
    df = spark.createDataFrame(rows, "max_depth int, step_size double, rounds int, mean_log_loss double")
    assert tuple(evaluation.pick_winner(df).first())[:3] == (2, 0.05, 60)


def test_rank_is_exact_with_a_hot_instant(spark):
    rows = spark.range(900).selectExpr(
        "id AS event_id", "CASE WHEN id % 3 = 0 THEN TIMESTAMP_NTZ'2020-01-01' ELSE TIMESTAMP_NTZ'2020-01-01' + make_dt_interval(0, 0, cast((id * 7919) % 500 AS int), 0) END AS published_at"
    )
    got = [(r.time_rank, r.event_id) for r in folds.time_rank(rows.repartition(6)).collect()]
    order = [r.event_id for r in rows.orderBy("published_at", "event_id").collect()]
    assert sorted(got) == list(enumerate(order, 1))


def test_split_and_guards(spark):
    df = spark.range(120).selectExpr("id AS event_id", "TIMESTAMP_NTZ'2020-01-01' + make_dt_interval(cast(119 - id AS int), 0, 0, 0) AS published_at")
    bounds = {r.split: r for r in folds.split_bounds(folds.time_split(df)).collect()}
    assert (bounds["train"].rows, bounds["test"].rows) == (96, 24)
    assert bounds["train"]["last"] < bounds["test"]["first"]
    with pytest.raises(folds.SplitError):
        folds.time_split(df.limit(4))


def test_folds_expand_like_the_library(spark):
    # n = 97: slices of 24, the remainder goes to the first training part.
    assert folds.fold_bounds(97) == [(1, 25, 49), (2, 49, 73), (3, 73, 97)]
    df = spark.range(97).selectExpr("id + 1 AS time_rank", "cast(id % 2 AS int) AS label")
    counts = {(r.fold, r.role): r["count"] for r in folds.time_folds(df, 97).groupBy("fold", "role").count().collect()}
    assert counts == {(1, "train"): 25, (1, "validate"): 24, (2, "train"): 49, (2, "validate"): 24, (3, "train"): 73, (3, "validate"): 24}
    with pytest.raises(folds.SplitError):
        folds.check_folds(folds.time_folds(df.filter("time_rank <= 36"), 36))
    with pytest.raises(folds.SplitError):
        folds.check_folds(folds.time_folds(df.withColumn("label", F.lit(0)), 97))


@pytest.fixture(scope="module")
def training_table(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(160):
        y = int(rng.random() < 0.35 or i in (0, 159))
        x = [float(v) for v in rng.normal(size=5) + 1.5 * y]
        rows.append((f"e{i:03d}", "h", "AAPL", datetime(2020, 1, 1) + timedelta(days=i), datetime(2020, 1, 1).date(), *x, 0.0, y, "d", "h", "1"))
    cols = "event_id string, headline string, ticker string, published_at timestamp_ntz, feature_as_of date, " + ", ".join(
        f"{n} double" for n in FEATURE_NAMES
    ) + ", fwd_return_5d double, label_high_risk int, source_dataset_id string, source_row_hash string, builder_version string"
    return spark.createDataFrame(rows, cols)


def test_rounds_of_one_fit_are_heads_of_the_longer_one(spark, training_table):
    train = training.weighted(training_table, 2.0).withColumn("time_rank", F.row_number().over(
        __import__("pyspark").sql.Window.orderBy("published_at"))).cache()
    grid = training.hpo_time_grid(train, 160, depths=(2,), steps=(0.1,), rounds=(3, 6)).orderBy("rounds").collect()
    for row in grid:
        fold, start, end = folds.fold_bounds(160)[0]
        model = training.fit_gate_model(train.filter(F.col("time_rank") <= start), 2, 0.1, row.rounds)
        loss = training.validation_loss(model, train.filter((F.col("time_rank") > start) & (F.col("time_rank") <= end)))
        assert row.folds[0].log_loss == pytest.approx(loss, rel=1e-6)


def test_fits_go_over_what_differs(spark, monkeypatch):
    """Equal rows are added up: the trees are those of all rows, from few rows, whatever the number of copies."""
    rows = spark.range(4000).selectExpr(
        "concat('e', id) AS event_id", "id + 1 AS time_rank", "cast(id % 6 IN (1, 4) OR id % 35 = 0 AS double) AS label", "IF(id % 6 = 1, 2.0D, 1.0D) AS weight",
        *[f"cast(id % 6 + {i} AS double) AS {n}" for i, n in enumerate(FEATURE_NAMES)],
    ).cache()
    given = []
    whole = training.GBTClassifier._fit
    monkeypatch.setattr(training.GBTClassifier, "_fit", lambda self, df: given.append(df.count()) or whole(self, df))
    few = training.SparkTrees().rows(rows, [1000, 2000])
    model = training.fit_gate_model(few.filter("time_rank <= 2000"), 2, 0.1, 4, row_share=1.0, feature_share=1.0)
    assert given[0] <= 6 * 2 * training.SAMPLE_LOTS
    trees = training.GBTClassifier(labelCol="label", weightCol="weight", maxDepth=2, stepSize=0.1, maxIter=4, seed=training.SAMPLE_SEED)
    plain = training.Pipeline(stages=[training.VectorAssembler(inputCols=list(FEATURE_NAMES), outputCol="features"), trees]).fit(rows.filter("time_rank <= 2000"))
    scores = [[r.score for r in training.score_rows(m, rows).orderBy("time_rank").limit(6).collect()] for m in (model, plain)]
    assert scores[0] == pytest.approx(scores[1], rel=1e-9) and len({round(x, 6) for x in scores[0]}) > 1
    for end in (1000, 2000):
        kept = [df.filter(F.col("time_rank") <= end).groupBy("label").agg(F.sum("weight")).orderBy("label").collect() for df in (few, rows)]
        assert kept[0] == kept[1]
    assert few.agg(F.sum("weight")).first()[0] == rows.agg(F.sum("weight")).first()[0]


def test_train_save_load_score(spark, training_table, folder):
    model, card, metrics = train_gate(training_table, f"{folder}/m", depths=(2,), steps=(0.1,), rounds=(5,))
    assert 0.05 <= card.score_threshold <= 0.95
    sizes = {r.split: r.rows for r in metrics.collect()}
    assert sizes == {"train": 128, "test": 32}
    loaded, again = training.load_model(spark, f"{folder}/m", "trained")
    assert again.score_threshold == card.score_threshold and again.dataset_hash == card.dataset_hash
    a = training.score_rows(model, training_table).select("event_id", "score").collect()
    assert sorted(a) == sorted(training.score_rows(loaded, training_table).select("event_id", "score").collect())
    with pytest.raises(training.ModelRefused, match="kind"):
        training.load_model(spark, f"{folder}/m", "other")
    with pytest.raises(training.ModelRefused, match="features"):
        training.load_model(spark, f"{folder}/m", names=tuple(reversed(FEATURE_NAMES)))
    with pytest.raises(training.ModelRefused, match="card"):
        training.load_model(spark, f"{folder}/none")


def test_no_positive_rows(training_table):
    with pytest.raises(TrainError):
        train_gate(training_table.withColumn("label_high_risk", F.lit(0)))


def test_training_sink(spark, training_table, folder):
    path = sink_training_parquet(training_table, f"{folder}/training_events.parquet")
    assert spark.read.parquet(path).count() == 160
    with pytest.raises(ValueError):
        sink_training_parquet(training_table, f"{folder}/training_events.parquet", development=True)


def test_sentiment_resume_scores_only_what_is_missing(spark):
    df = spark.createDataFrame([(i, f"h{i % 4}", 0.5 if i % 2 else None) for i in range(40)], "event_id int, headline string, existing_sentiment double")

    def predict(frames):
        for pdf in frames:
            assert set(pdf["headline"]) <= {"h0", "h2"}, "scored a row that has a score"
            yield pdf.assign(positive=0.7, negative=pdf["headline"].map({"h0": 0.1, "h2": 0.2}))

    rows = sentiment.sentiment_resume(df, predict=predict).collect()
    assert len(rows) == 40
    for r in rows:
        assert r.finbert_sentiment == pytest.approx(0.5 if r.event_id % 2 else (0.6 if r.headline == "h0" else 0.5))
