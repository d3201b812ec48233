"""Second-order boosting against the same rules worked out row by row."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from hindcast.operators import boosting

NAMES = ["a", "b", "c"]
SCHEMA = "event_id long, a double, b double, c double, label double, weight double"


def rows(seed, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.randint(0, 9), rng.random()
        out.append((i, float(a), b, 4.0, float(rng.random() < (0.8 if (a > 5) != (b > 0.4) else 0.15)), 3.0 if i % 4 == 0 else 1.0))
    return out


def brute(data, cuts, depth, step, rounds, lam=1.0, min_child=1.0, sample=None, columns=None):
    margins = {r[0]: 0.0 for r in data}
    for t in range(rounds):
        names = columns(t) if columns else NAMES
        gh = {}
        for r in data:
            p = 1 / (1 + math.exp(-margins[r[0]]))
            gh[r[0]] = (r[5] * (p - r[4]), r[5] * p * (1 - p))
        seen = [r for r in data if sample is None or r[0] in sample[t]]

        def grow(inside, d):
            G, H = (sum(gh[r[0]][k] for r in inside) for k in (0, 1))
            best, most = None, 0.0
            for name in names if d else ():
                col = 1 + NAMES.index(name)
                for c in cuts[name]:
                    left = [r for r in inside if r[col] <= c]
                    gl, hl = (sum(gh[r[0]][k] for r in left) for k in (0, 1))
                    if hl < min_child or H - hl < min_child:
                        continue
                    gain = round(gl * gl / (hl + lam) + (G - gl) ** 2 / (H - hl + lam) - G * G / (H + lam), 9)
                    if gain > most:
                        best, most = (col, c), gain
            if best is None:
                return lambda r: -G / (H + lam)
            col, c = best
            lo, hi = grow([r for r in inside if r[col] <= c], d - 1), grow([r for r in inside if r[col] > c], d - 1)
            return lambda r: lo(r) if r[col] <= c else hi(r)

        tree = grow(seen, depth)
        for r in data:
            margins[r[0]] += step * tree(r)
    return {i: 1 / (1 + math.exp(-m)) for i, m in margins.items()}


def scores(spark, model, data):
    df = spark.createDataFrame(data, SCHEMA)
    return {r.event_id: r.score for r in boosting.score_boosted(model, df).select("event_id", "score").collect()}


@pytest.mark.parametrize("depth, rounds", [(1, 3), (2, 10), (3, 2)])
def test_scores_equal_the_rules(spark, depth, rounds):
    data = rows(depth)
    cuts = {"a": list(map(float, range(9))), "b": [0.2, 0.4, 0.6, 0.8], "c": [4.0]}
    model = boosting.fit_boosted(spark.createDataFrame(data, SCHEMA).repartition(3), depth, 0.3, rounds, NAMES, row_share=1.0, feature_share=1.0, cuts=cuts)
    want = brute(data, cuts, depth, 0.3, rounds)
    assert scores(spark, model, data) == pytest.approx(want, abs=1e-9)
    # Saved and read back, and its head.
    again = boosting.Boosted.from_dict(json.loads(json.dumps(model.to_dict())))
    assert again == model
    assert scores(spark, model.head(1), data) == pytest.approx(brute(data, cuts, depth, 0.3, 1), abs=1e-9)


def test_shares_are_by_tree_and_repeatable(spark):
    data = rows(9)
    df = spark.createDataFrame(data, SCHEMA)
    cuts = {"a": [2.0, 5.0], "b": [0.4], "c": []}
    sample = [{r.event_id for r in df.filter(boosting.in_sample(t, "event_id", 0.6, 42)).collect()} for t in range(4)]
    assert all(120 < len(s) < 240 for s in sample) and sample[0] != sample[1]
    fit = lambda d: boosting.fit_boosted(d, 2, 0.3, 4, NAMES, row_share=0.6, feature_share=0.7, cuts=cuts)
    model = fit(df)
    drawn = [boosting.columns_of(t, NAMES, 0.7, 42) for t in range(12)]
    assert {len(c) for c in drawn} == {2} and len({tuple(c) for c in drawn}) > 1
    assert scores(spark, model, data) == pytest.approx(brute(data, cuts, 2, 0.3, 4, sample=sample, columns=lambda t: boosting.columns_of(t, NAMES, 0.7, 42)), abs=1e-9)
    assert scores(spark, fit(df.repartition(7)), data) == pytest.approx(scores(spark, model, data))


def test_quantile_cuts_and_losses(spark):
    data = rows(4)
    df = spark.createDataFrame(data, SCHEMA)
    cuts = boosting.quantile_cuts(df, NAMES, 8)
    assert cuts["c"] == [] and len(cuts["b"]) == 7 and set(cuts["a"]) <= set(map(float, range(9)))
    model = boosting.fit_boosted(df, 2, 0.3, 12, NAMES)
    losses = boosting.log_losses(model, df, [1, 6, 12])
    assert losses[12] < losses[6] < losses[1] < math.log(2)
    p = scores(spark, model, data)
    by_hand = -sum(math.log(p[r[0]] if r[4] else 1 - p[r[0]]) for r in data) / len(data)
    assert losses[12] == pytest.approx(by_hand)


def test_odd_inputs(spark):
    with pytest.raises(ValueError, match="null or NaN"):
        boosting.fit_boosted(spark.createDataFrame([(1, 1.0, None, 1.0, 0.0, 1.0)], SCHEMA), 1, 0.1, 1, NAMES)
    one = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0, 1.0), (2, 1.0, 1.0, 1.0, 1.0, 1.0)], SCHEMA)
    model = boosting.fit_boosted(one, 2, 0.5, 2, NAMES, row_share=1.0)
    assert model.trees[0].feature is None and boosting.score_boosted(model, one).filter(F.col("score") <= 0.5).isEmpty()
    none = boosting.fit_boosted(one.limit(0), 2, 0.5, 1, NAMES)
    assert none.trees[0].weight == 0.0
