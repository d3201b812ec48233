"""Row numbers that do not move, and what workers remember."""

import pytest
from pyspark.sql import functions as F

from hindcast.llm import common
from hindcast.llm.common import in_arrow, numbered, remembered
from hindcast.llm.language import identify, learn
from hindcast.llm.toxicity import Model, learn as learn_toxicity, score


def numbers(df):
    return {r["text"]: r["_row"] for r in numbered(df, "_row").collect()}


def test_numbers_do_not_move_with_the_splits(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    rows = [(k, f"text {k}", "x", 1) for k in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, _path string, _file long").repartition(5).write.option("parquet.block.size", 4096).parquet(path)
    first = numbers(spark.read.parquet(path))
    assert len(set(first.values())) == 3000 and len({n >> common.FILE_ROWS_BITS for n in first.values()}) == 5
    settings = {"spark.sql.leafNodeDefaultParallelism": "2", "spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1"}
    kept = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        again = spark.read.parquet(path)
        assert again.rdd.getNumPartitions() > 5
        assert numbers(again) == first
        # Filters and chosen columns leave them alone.
        assert numbers(again.filter("doc_id % 7 = 0").select("text")) == {f"text {k}": first[f"text {k}"] for k in range(0, 3000, 7)}
        # The plain number does move.
        moved = again.select("text", F.monotonically_increasing_id().alias("n")).collect()
        assert any(r["n"] != (first[r["text"]]) for r in moved)
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_frames_that_are_not_tables_are_numbered_too(spark):
    df = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    assert numbered(df, "_row").columns == ["doc_id", "text", "_row"]
    assert len(set(numbers(df).values())) == 50
    assert len(set(numbers(df.unionByName(df.withColumn("text", F.concat("text", F.lit("b"))))).values())) == 100
    assert numbers(df.limit(0)) == {}


def test_other_modules_tasks_forget(spark):
    calls = []
    kept = remembered(2)(lambda k: calls.append(k) or k)
    try:
        kept(1), kept(1)
        common.forget_others(kept.__module__)
        kept(1)
        assert calls == [1]
        common.forget_others("other")
        kept(1)
        assert calls == [1, 1]
    finally:
        common._remembered.remove(kept)

    def run(batches):
        yield from batches

    assert sorted(r[0] for r in spark.range(5).transform(in_arrow, run, "id long").collect()) == list(range(5))


@pytest.mark.parametrize("names", ["score double, predicted int", "SCORE double, _score int", "lang_pred string, bits int"])
def test_scores_beside_columns_of_the_same_name(spark, names):
    docs = spark.createDataFrame([(1, "abc", None, None), (1, None, None, None)], f"doc_id long, text string, {names}")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    toxic = score(docs, learn_toxicity(docs.select("doc_id", "text"), labels))
    assert isinstance(learn_toxicity(docs.select("doc_id", "text"), labels), Model)
    known = learn(docs.select("text", F.lit("aa").alias("lang")))
    for out in (toxic, identify(docs, known)):
        assert out.columns[:4] == docs.columns and len({c.lower() for c in out.columns}) == len(out.columns)
        assert out.select(*out.columns).count() == 2
