"""Same-ticker as-of context against a look at every hit."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hindcast.operators import context

T0 = datetime(2024, 3, 12, 14, 30)


def rows(seed, n_events=120, n_hits=400):
    rng = random.Random(seed)
    at = lambda: T0 + timedelta(minutes=rng.choice([5, 5, 5, rng.randint(0, 60)]))
    ticker = lambda: rng.choice(["HOT"] * 6 + ["B", "C", None])
    events = [(f"e{i}", ticker() or "NONE", at()) for i in range(n_events)] + [("e-null", None, T0), ("e-clock", "HOT", None), ("e-early", "HOT", T0 - timedelta(days=1))]
    hits = [(f"d{rng.randint(0, 10**6)}-{i}", ticker(), at() if rng.random() < 0.95 else None, i) for i in range(n_hits)]
    return events, hits


def brute(events, hits, k):
    out = set()
    for e, t, at in events:
        seen = [h for h in hits if t is not None and at is not None and h[1] == t and h[2] is not None and h[2] <= at]
        best = sorted(sorted(seen, key=lambda h: h[0]), key=lambda h: h[2], reverse=True)[:k]
        out |= {(e, len(seen), n + 1, h[0], h[3]) for n, h in enumerate(best)} or {(e, 0, None, None, None)}
    return out


def frames(spark, events, hits):
    e = spark.createDataFrame(events, "event_id string, ticker string, published_at timestamp_ntz")
    return e.repartition(3), spark.createDataFrame(hits, "document_id string, ticker string, available_at timestamp_ntz, extra int").repartition(5)


@pytest.mark.parametrize("k", [1, 4])
def test_newest_visible_equals_brute_force(spark, k):
    events, hits = rows(k)
    got = context.newest_visible(*frames(spark, events, hits), k, ["extra"])
    assert {(r.event_id, r.n_visible, r.rank, r.document_id, r.extra) for r in got.collect()} == brute(events, hits, k)


def test_a_hit_at_the_instant_is_seen_and_a_later_one_is_not(spark):
    hits = [("edge", "A", T0, 1), ("late", "A", T0 + timedelta(microseconds=1), 2), ("other", "B", T0, 3)]
    got = context.newest_visible(*frames(spark, [("e", "A", T0)], hits), 5).collect()
    assert [(r.n_visible, r.rank, r.document_id) for r in got] == [(1, 1, "edge")]


def test_empty_sides(spark):
    events, hits = rows(3)
    e, h = frames(spark, events, hits)
    assert context.newest_visible(e.limit(0), h).count() == 0
    none = context.newest_visible(e, h.limit(0)).collect()
    assert len(none) == len(events) and all(r.n_visible == 0 and r.rank is None for r in none)


def test_no_task_holds_a_hot_ticker_and_no_range_join(spark):
    """Ranks are dealt by ticker, time and id: the shares of one hot instant go to several partitions."""
    hits = spark.range(4000).selectExpr("concat('d', id) AS document_id", "'HOT' AS ticker", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS available_at")
    events = spark.range(4000).selectExpr("concat('e', id) AS event_id", "'HOT' AS ticker", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS published_at")
    starts = context.ticker_starts(hits)
    counted = context.count_visible(events, hits, starts)
    assert counted.filter(F.col("n_visible") == 4000).count() == 4000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = context.ranked_hits(hits, starts)
        sizes = placed.groupBy(F.spark_partition_id()).count()
        assert placed.count() == 4000 and sizes.agg(F.max("count")).first()[0] < 2500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    plan = context.newest_visible(events, hits, 3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_what_moves_follows_the_instants_not_the_hits(spark, monkeypatch):
    """Of very many hits of one instant only the k smallest ids are placed; ranks of all hits are not needed."""
    ranked = []
    monkeypatch.setattr(context, "global_rank", lambda *args: ranked.append(args))
    hits = spark.range(5000).selectExpr("concat('d', lpad(id, 6, '0')) AS document_id", "'HOT' AS ticker", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS available_at")
    events = spark.range(300).selectExpr("concat('e', id) AS event_id", "'HOT' AS ticker", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, id % 3, 0) AS published_at")
    at = context.instants(events, hits)
    assert sorted((r.asked, r.upto) for r in at.collect()) == [(True, 5000)] * 3
    got = context.newest_visible(events, hits, 2).groupBy("n_visible", "rank", "document_id").count().collect()
    assert sorted(map(tuple, got)) == [(5000, 1, "d000000", 300), (5000, 2, "d000001", 300)] and not ranked
