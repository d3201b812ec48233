"""Exchange sessions and the two as-of joins, as equi-joins on the UTC day.

A session table has one row per trading day, so its size is bounded by the
number of calendar days whatever the number of events. The broadcasts here are
hinted only after that count has been checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.operators.scale import small


def scan_sessions(days: DataFrame, close_clock: Column | None = None, date_col: str = "session_date") -> DataFrame:
    """sessions(session_idx, session_date, close_ts) from any table of days.

    `close_clock` is an expression over `session_date`; the default is 16:00 on
    that day, zone-less UTC. Days merge map-side; the sorted array holds one
    entry per trading day.
    """
    ordered = days.agg(F.array_sort(F.collect_set(F.col(date_col).cast("date"))).alias("_days"))
    sessions = ordered.select(F.posexplode("_days").alias("session_idx", "session_date"))
    close = close_clock
    if close is None:
        close = F.col("session_date").cast("timestamp_ntz") + F.expr("INTERVAL 16 HOURS")
    return sessions.withColumn("close_ts", close)


def day_calendar(sessions: DataFrame) -> DataFrame:
    """One row per UTC day from the first close to the last.

    day, close_ts (null on days without a close), sessions closed before the
    day, and the dates of the neighbouring sessions. Assumes at most one close
    per UTC day.
    """
    s = sessions.withColumn("day", F.to_date("close_ts"))
    after = s.select((F.col("session_idx") - 1).alias("session_idx"), F.col("session_date").alias("next_date"), F.col("day").alias("next_day"))
    before = s.select((F.col("session_idx") + 1).alias("session_idx"), F.col("session_date").alias("prev_date"))
    chain = s.join(after, "session_idx", "left").join(before, "session_idx", "left")
    last_covered = F.coalesce(F.date_sub("next_day", 1), F.col("day"))
    days = chain.withColumn("_day", F.explode(F.sequence("day", last_covered)))
    closes_today = F.col("_day") == F.col("day")
    return days.select(
        F.col("_day").alias("day"),
        F.when(closes_today, F.col("close_ts")).alias("close_ts"),
        F.when(closes_today, F.col("session_idx")).otherwise(F.col("session_idx") + 1).alias("closed_before"),
        F.when(closes_today, F.col("prev_date")).otherwise(F.col("session_date")).alias("prev_date"),
        F.when(closes_today, F.col("session_date")).alias("own_date"),
        "next_date",
    )


def join_sessions(events: DataFrame, sessions: DataFrame, clock: str = "published_at") -> DataFrame:
    """Both as-of joins in one pass over the events.

    Adds feature_idx / feature_as_of (last session closed at or before the
    event) and label_idx / label_start (first session closing at or after it);
    null where there is no such session. On an exact close both are that
    session.
    """
    edge = sessions.agg(
        F.min(F.to_date("close_ts")).alias("first_day"),
        F.max(F.to_date("close_ts")).alias("last_day"),
        F.min("session_date").alias("first_date"),
        F.max("session_date").alias("last_date"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    if not edge.n:
        # Without sessions no event has one.
        none = {"feature_idx": "int", "feature_as_of": "date", "label_idx": "int", "label_start": "date"}
        return events.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in none.items()])
    calendar = day_calendar(sessions)
    # One row per day between the first and the last close.
    calendar = small(
        calendar.select([F.col(c).alias(f"_{c}") for c in calendar.columns]), (edge.last_day - edge.first_day).days + 1
    )
    joined = events.withColumn("_day", F.to_date(clock)).join(calendar, "_day", "left")
    close = F.col("_close_ts")
    closed = F.coalesce(close <= F.col(clock), F.lit(False))
    at_close = F.coalesce(close == F.col(clock), F.lit(False))
    own_is_next = F.coalesce(close >= F.col(clock), F.lit(False))
    too_early = F.col("_day") < F.lit(edge.first_day)
    too_late = F.col("_day") > F.lit(edge.last_day)
    n_closed = (
        F.when(too_early, F.lit(0))
        .when(too_late, F.lit(edge.n))
        .otherwise(F.col("_closed_before") + closed.cast("int"))
        .cast("int")
    )
    label_idx = F.when(at_close, n_closed - 1).otherwise(n_closed)
    feature_as_of = (
        F.when(too_late, F.lit(edge.last_date)).when(closed, F.col("_own_date")).otherwise(F.col("_prev_date"))
    )
    label_start = (
        F.when(too_early, F.lit(edge.first_date)).when(own_is_next, F.col("_own_date")).otherwise(F.col("_next_date"))
    )
    return joined.select(
        *events.columns,
        F.nullif(n_closed - 1, F.lit(-1)).alias("feature_idx"),
        feature_as_of.alias("feature_as_of"),
        F.when(label_idx < edge.n, label_idx).alias("label_idx"),
        label_start.alias("label_start"),
    )


def join_feature_session(events: DataFrame, sessions: DataFrame, clock: str = "published_at") -> DataFrame:
    """Backward as-of join only."""
    return join_sessions(events, sessions, clock).drop("label_idx", "label_start")


def join_label_session(events: DataFrame, sessions: DataFrame, clock: str = "published_at") -> DataFrame:
    """Forward as-of join only."""
    return join_sessions(events, sessions, clock).drop("feature_idx", "feature_as_of")


def session_offset(df: DataFrame, sessions: DataFrame, idx: str, n: int, name: str) -> DataFrame:
    """Date of the session n places after (or before) index column `idx`."""
    target = sessions.select((F.col("session_idx") - n).cast("int").alias(idx), F.col("session_date").alias(name))
    return df.join(small(target, sessions.count()), idx, "left")
