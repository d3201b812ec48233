"""Sessions and price windows against plain Python."""

import bisect
import math
import os
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.operators import prices
from hindcast.operators import sessions as calendars
from hindcast.session import stage

RNG = random.Random(11)
DAYS = [d for d in (date(2020, 1, 1) + timedelta(i) for i in range(120)) if d.weekday() < 5 and RNG.random() > 0.06]


def close_at(d):
    return datetime(d.year, d.month, d.day, 21 if d.month < 3 else 20)


@pytest.fixture(scope="module")
def sessions(spark):
    days = spark.createDataFrame([(d,) for d in DAYS for _ in range(2)], "session_date date")
    clock = F.expr("cast(session_date AS timestamp_ntz) + make_dt_interval(0, IF(month(session_date) < 3, 21, 20), 0, 0)")
    return stage(calendars.scan_sessions(days, clock), "test-sessions")


def event_clocks():
    first, last = datetime(2019, 12, 30), datetime(2020, 5, 5)
    clocks = [first + (last - first) * RNG.random() for _ in range(400)]
    clocks = [c.replace(microsecond=0) for c in clocks]
    edges = [close_at(d) + timedelta(seconds=s) for d in DAYS for s in (-1, 0, 1)]
    return clocks + edges + [first, last]


def test_asof_joins_equal_bisect(spark, sessions):
    closes = [close_at(d) for d in DAYS]
    clocks = event_clocks()
    events = spark.createDataFrame([(i, c) for i, c in enumerate(clocks)], "event_id int, published_at timestamp_ntz")
    rows = calendars.join_sessions(events, sessions).collect()
    assert len(rows) == len(clocks)
    at = lambda i: DAYS[i] if i is not None and 0 <= i < len(DAYS) else None
    for r in rows:
        done = bisect.bisect_right(closes, r.published_at)
        start = bisect.bisect_left(closes, r.published_at)
        feature = done - 1 if done else None
        label = start if start < len(DAYS) else None
        assert (r.feature_idx, r.feature_as_of) == (feature, at(feature)), r
        assert (r.label_idx, r.label_start) == (label, at(label)), r


def test_tuesday_morning_uses_monday(spark, sessions):
    tuesday = next(d for d in DAYS if d.weekday() == 1 and d - timedelta(1) in DAYS)
    event = spark.createDataFrame([(datetime.combine(tuesday, datetime.min.time()) + timedelta(hours=15),)], "published_at timestamp_ntz")
    row = calendars.join_sessions(event, sessions).first()
    assert (row.feature_as_of, row.label_start) == (tuesday - timedelta(1), tuesday)


def test_asof_plan_is_an_equi_join(spark, sessions):
    events = spark.createDataFrame([(datetime(2020, 2, 3, 12),)], "published_at timestamp_ntz")
    plan = calendars.join_sessions(events, sessions)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_session_offset_out_of_range(spark, sessions):
    df = spark.createDataFrame([(0,), (len(DAYS) - 1,)], "idx int")
    assert [r.d for r in calendars.session_offset(df, sessions, "idx", 5, "d").orderBy("idx").collect()] == [DAYS[5], None]
    assert [r.d for r in calendars.session_offset(df, sessions, "idx", -5, "d").orderBy("idx").collect()] == [None, DAYS[-6]]


@pytest.fixture(scope="module")
def series():
    out = {}
    for ticker, gap in (("A", 0.0), ("B", 0.03), ("SPY", 0.0)):
        level, rows = 100.0, {}
        for d in DAYS:
            level *= 1 + RNG.uniform(-0.03, 0.03)
            if RNG.random() >= gap:
                rows[d] = level
        out[ticker] = rows
    out["B"][DAYS[40]] = 0.0
    out["B"][DAYS[70]] = float("nan")
    return out


@pytest.fixture(scope="module")
def closes(spark, series):
    rows = [(t, d, c) for t, s in series.items() for d, c in s.items()]
    weekend = [("A", date(2020, 1, 4), 5.0)]
    return spark.createDataFrame(rows + weekend, "ticker string, session_date date, close double")


def expected_features(series, ticker, i):
    get = lambda t, j: (lambda c: c if c is not None and math.isfinite(c) else None)(series[t].get(DAYS[j])) if 0 <= j < len(DAYS) else None
    def ret(t, a, b):
        x, y = get(t, a), get(t, b)
        return None if x is None or y is None or x == 0 else y / x - 1

    window = [get(ticker, j) for j in range(i - 20, i + 1)]
    vol = None
    if None not in window and 0.0 not in window[:-1]:
        vol = float(np.std(np.diff(window) / np.array(window[:-1]), ddof=1) * np.sqrt(252))
    return ret(ticker, i - 5, i), ret(ticker, i - 20, i), ret("SPY", i - 5, i), vol, ret(ticker, i, i + 5)


def test_windows_equal_numpy(sessions, closes, series):
    rows = prices.price_features(closes, sessions).collect()
    finite = sum(math.isfinite(c) for s in series.values() for c in s.values())
    assert len(rows) == finite
    for r in rows:
        got = (r.return_5d_prior, r.return_20d_prior, r.spy_return_5d, r.volatility_20d, r.fwd_return_5d)
        for g, e in zip(got, expected_features(series, r.ticker, r.session_idx), strict=True):
            assert (g is None and e is None) or g == pytest.approx(e, abs=1e-12), r


def test_event_features_broadcast_and_salted_agree(spark, sessions, closes):
    clocks = event_clocks()
    events = spark.createDataFrame(
        [(str(i), ("A", "B", "NONE")[i % 3], c) for i, c in enumerate(clocks)],
        "event_id string, ticker string, published_at timestamp_ntz",
    )
    # Half of all events share one instant, and so one (ticker, session) key.
    hot = spark.range(1000).selectExpr("concat('h', id) AS event_id", "'A' AS ticker", "TIMESTAMP_NTZ'2020-03-10 15:00:00' AS published_at")
    dated = calendars.join_sessions(events.unionByName(hot), sessions)
    features = prices.price_features(closes, sessions)
    small = sorted(map(tuple, prices.join_event_features(dated, features).select("event_id", *prices.COMPLETE).collect()))
    import hindcast.operators.scale as scale

    old = scale.skew_join.__defaults__
    try:
        scale.skew_join.__defaults__ = (100, 4)
        salted = prices.join_event_features(dated, features, max_rows=0).select("event_id", *prices.COMPLETE)
        assert sorted(map(tuple, salted.collect()), key=str) == sorted(small, key=str)
    finally:
        scale.skew_join.__defaults__ = old
    complete, dropped = prices.complete_rows(prices.join_event_features(dated, features))
    assert complete.count() + dropped.count() == len(small) and dropped.count() > 0


def test_coverage(spark, closes):
    days = spark.createDataFrame([(DAYS[0],), (DAYS[0],), (date(2020, 1, 5),), (DAYS[1],), (None,)], "day date")
    days = days.withColumn("ticker", F.lit("A"))
    row = prices.join_coverage(days, closes).first()
    assert (row.days, row.days_with_close, row.coverage) == (3, 2, 0.6667)
    assert prices.join_coverage(days.filter("false"), closes).count() == 0


def test_scan_closes_range(closes):
    rows = prices.scan_closes(closes, DAYS[3], DAYS[5], ["A"]).collect()
    assert sorted(r.session_date for r in rows) == DAYS[3:6]


def test_folders_of_absent_tickers_are_not_read(spark, folder):
    """A file that cannot be read stands in an absent ticker's folder."""
    days = [(t, date(2024, 1, 1 + i), float(i)) for t in ("A", "B", "C") for i in range(9)]
    path = f"{folder}/closes"
    prices.write_closes(spark.createDataFrame(days, "ticker string, session_date date, close double"), path)
    os.makedirs(f"{path}/ticker=ZZ")
    with open(f"{path}/ticker=ZZ/part-0.parquet", "wb") as f:
        f.write(b"not a table")
    closes = prices.read_closes(spark, path)
    with pytest.raises(Exception, match="part-0.parquet|Parquet"):
        closes.count()
    events = spark.createDataFrame([("1", "A"), ("2", "A"), ("3", "C"), ("4", "none"), ("5", None), ("6", "")], "event_id string, ticker string")
    got = prices.closes_of(events, closes)
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.ticker, r.n) for r in got.groupBy("ticker").agg(F.count("close").alias("n")).collect()} == {("A", 9), ("C", 9)}
