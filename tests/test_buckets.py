"""Points in key buckets: no shuffle to read, whole replays, merges by slot."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Row

from hindcast.sinks import buckets

SCHEMA = "point_id string, document_id string, text string, ticker string, available_at timestamp_ntz, source string, vector array<double>, topic string, partition int, offset long"


def batch(spark, rows):
    """rows: (point, text, offset)."""
    made = [(p, p, t, "A", datetime(2024, 1, 1), "s", [1.0], "n", 0, o) for p, t, o in rows]
    return spark.createDataFrame(made, SCHEMA)


def texts(spark, path):
    return {r["point_id"]: r["text"] for r in buckets.read_bucketed(spark, path).collect()}


def fill(spark, path, n, rng, first=0, **options):
    expected = {}
    for k in range(first, first + n):
        rows = [(f"p{rng.randrange(60)}", f"t{k}.{i}", i) for i in range(40)]
        buckets.upsert_bucketed(batch(spark, rows), path, k, "run", buckets=8, slots=4, **options)
        for p, t, _ in rows:
            expected[p] = t
    return expected


def test_newest_rows_without_a_shuffle(spark, folder):
    expected = fill(spark, folder, 3, random.Random(1))
    out = buckets.read_bucketed(spark, folder)
    assert {r["point_id"]: r["text"] for r in out.collect()} == expected and out.columns == list(buckets.POINT_COLUMNS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_merges_keep_the_rows_and_rewrite_due_slots_only(spark, folder):
    rng = random.Random(2)
    expected = fill(spark, folder, 3, rng)
    assert buckets.compact_bucketed(spark, folder) == []
    expected |= fill(spark, folder, 1, rng, first=3)
    before = buckets.pieces(spark, folder)
    slots = buckets.compact_bucketed(spark, folder)
    after = buckets.pieces(spark, folder)
    assert slots and texts(spark, folder) == expected
    for s in range(4):
        old, new = ([r["piece"] for r in pieces if r["slot"] == s] for pieces in (before, after))
        assert (len(new) < len(old)) if s in slots else (new == old)
    # A slot with one busy point: only that slot is due.
    busy = [("p1", f"again {k}", k) for k in range(40)]
    for k in range(10, 14):
        buckets.upsert_bucketed(batch(spark, busy), folder, k, "run", buckets=8, slots=4)
    home = batch(spark, busy[:1]).select(buckets._slot(8, 4)).first()[0]
    untouched = [r for r in buckets.pieces(spark, folder) if r["slot"] != home]
    assert buckets.compact_bucketed(spark, folder) == [home]
    assert [r for r in buckets.pieces(spark, folder) if r["slot"] != home] == untouched
    assert texts(spark, folder) == expected | {"p1": "again 39"}


def test_a_replay_stands_for_its_batch(spark, folder):
    first = [(f"p{k}", "old", k) for k in range(20)]
    buckets.upsert_bucketed(batch(spark, first), folder, 0, "run", buckets=8, slots=4)
    buckets.upsert_bucketed(batch(spark, first[:5]), folder, 0, "run", buckets=8, slots=4)
    assert texts(spark, folder) == {p: "old" for p, _, _ in first[:5]}
    buckets.upsert_bucketed(batch(spark, first), folder, 0, "other", buckets=8, slots=4)
    assert len(texts(spark, folder)) == 20
    with pytest.raises(ValueError, match="8 buckets"):
        buckets.upsert_bucketed(batch(spark, first), folder, 1, "run", buckets=16, slots=4)


def test_a_write_that_fails_takes_nothing_away(spark, folder):
    expected = fill(spark, folder, 1, random.Random(3))
    bad = batch(spark, [("p1", "x", 0)]).withColumn("text", F.expr("raise_error('no')").cast("string"))
    with pytest.raises(Exception, match="no"):
        buckets.upsert_bucketed(bad, folder, 1, "run", buckets=8, slots=4)
    assert texts(spark, folder) == expected


def most_rows_of_a_task(table):
    return max(len(p) for p in table.rdd.mapPartitions(lambda rows: [list(rows)]).collect())


def test_buckets_are_dealt_on_as_the_table_grows(spark, folder):
    """No task's rows grow with the table: not of a first large batch, nor of many small ones."""
    rng = random.Random(4)
    expected = {f"p{k}": f"first {k}" for k in range(400)}
    few = {"buckets": 4, "slots": 2, "bucket_rows": 10}
    buckets.upsert_bucketed(batch(spark, [(p, t, k) for k, (p, t) in enumerate(expected.items())]), folder, 0, "run", **few)
    home = {r["point_id"]: r["slot"] for r in buckets._table(spark, folder, buckets.pieces(spark, folder)).collect()}
    for k in range(1, 7):
        rows = [(f"p{rng.randrange(1200)}", f"t{k}.{i}", i) for i in range(150)]
        for _ in range(2):  # a replay stands for its batch, whether the table has grown or not
            buckets.upsert_bucketed(batch(spark, rows), folder, k, "run", **few)
        expected |= {p: t for p, t, _ in rows}
        assert texts(spark, folder) == expected
        live = buckets.pieces(spark, folder)
        table = buckets._table(spark, folder, live)
        assert most_rows_of_a_task(buckets._newest(table)) < 30
        # Every point is in the slot it began in.
        assert not [r for r in table.select("point_id", "slot").collect() if home.setdefault(r["point_id"], r["slot"]) != r["slot"]]
        assert "Exchange" not in buckets.read_bucketed(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert len({r["parts"] for r in live}) == 1 and live[0]["parts"] > 16
    while buckets.compact_bucketed(spark, folder, 2):
        assert texts(spark, folder) == expected


def test_empty_batches_and_null_ids(spark, folder):
    buckets.upsert_bucketed(batch(spark, [(None, "a", 0), (None, "b", 1), ("p", "c", 2)]), folder, 0, "run", buckets=8, slots=4)
    buckets.upsert_bucketed(batch(spark, []), folder, 1, "run", buckets=8, slots=4)
    assert texts(spark, folder) == {None: "b", "p": "c"}


def test_tiers():
    live = [Row(slot=s, piece=f"{s}.{k}", n_rows=n) for s, sizes in ((0, [1, 2, 3, 3, 70]), (1, [1, 20, 5]), (2, [5, 6, 7, 8, 1])) for k, n in enumerate(sizes)]
    assert [r["piece"] for r in buckets.due(live, 4)] == ["0.0", "0.1", "0.2", "0.3", "2.0", "2.1", "2.2", "2.3"]
