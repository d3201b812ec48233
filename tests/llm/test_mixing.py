import pytest
from pyspark.sql import functions as F

from hindcast.llm.mixing import MAX_REPEATS, fit, mix, source_targets

DOCS = "doc_id long, text string, source string, size long, whole string"


def shares(sizes, weights=(1, 2, 3)):
    """Water filling by hand: raise the level until it is used up."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        level = (total - sum(MAX_REPEATS * sizes[s] for s in capped)) / (sum(weight[s] for s in open_) or 1)
        over = {s for s in open_ if level * weight[s] > MAX_REPEATS * sizes[s]}
        if not over:
            return {s: float(MAX_REPEATS * sizes[s]) if s in capped else level * weight[s] for s in names}
        capped |= over


@pytest.mark.parametrize(
    "sizes",
    [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1, "c": 1000, None: 5}, {"z": 0, "é": 7, "Z": 900, "a": 3, None: 0}, {"a": 10}, {"a": 0}],
)
def test_targets(spark, sizes):
    rows = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r["source"]: pytest.approx(r["target"]) for r in rows} == shares(sizes)


def corpus(spark):
    rows = [(k, "w " * (k % 50 + 1), ["big", "big", "big", "small", None][k % 5], 7, "x") for k in range(800)]
    rows += [(1000, None, "big", 1, None), (1001, "", "only empty", 1, None), (None, "a b c", "small", 1, None), (3, "w " * 4, "small", 1, "x")]
    return spark.createDataFrame(rows, DOCS)


def test_mix_takes_what_the_thresholds_say(spark):
    docs = corpus(spark)
    taken = mix(docs)
    assert taken.columns == docs.columns
    n = lambda df: {r["source"]: r["n"] for r in df.groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != ""))).alias("n")).collect()}
    have, got = n(docs.fillna("", ["text"])), n(taken.fillna("", ["text"]))
    want = shares({s: v for s, v in have.items()})
    for s in ("big", "small", None):
        assert abs(got[s] - want[s]) <= 50
    assert max(r["count"] for r in taken.filter("doc_id is not null and doc_id <> 3").groupBy("doc_id").count().collect()) <= MAX_REPEATS
    again = sorted(map(str, mix(docs.repartition(7)).collect()))
    assert again == sorted(map(str, taken.collect()))


def test_one_hash_for_all_rows(spark):
    docs = spark.createDataFrame([(5, "a b c", s, 0, "") for s in "ab" * 20], DOCS)
    assert mix(docs).count() in (0, 20, 40, 60, 80)


def test_empty(spark):
    assert mix(spark.createDataFrame([], DOCS)).count() == 0
    assert fit(spark.createDataFrame([], "source string, size long, hash long")).count() == 0
