"""Price windows per (ticker, session) and their joins to events.

Windows run on the price table, never on events: a ticker has at most one row
per session, so a window partition is bounded by the number of sessions. Frames
are RANGE frames over the session position; a missing close is then a gap in
the frame, which gives the same nulls as a dense ticker x session grid without
building the product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.fixed_values import (
    BENCHMARK,
    FORWARD_SESSIONS,
    LONG_RETURN_SESSIONS,
    SESSIONS_PER_YEAR,
    SHORT_RETURN_SESSIONS,
)
from hindcast.functions.risk import finite, label_high_risk, simple_return
from hindcast.operators.scale import MAX_BROADCAST_ROWS, bounded, skew_join, small
from hindcast.session import stage


def scan_closes(closes: DataFrame, start=None, end=None, tickers: Sequence[str] | None = None) -> DataFrame:
    """closes(ticker, session_date, close) in a date range; not-finite -> null."""
    rows = closes.select("ticker", F.col("session_date").cast("date").alias("session_date"), F.col("close").cast("double").alias("close"))
    if tickers is not None:
        rows = rows.filter(F.col("ticker").isin(list(tickers)))
    if start is not None:
        rows = rows.filter(F.col("session_date") >= F.lit(start))
    if end is not None:
        rows = rows.filter(F.col("session_date") <= F.lit(end))
    return rows.withColumn("close", finite(F.col("close")))


CLOSE_COLUMNS = "session_date date, close double, ticker string"


def write_closes(closes: DataFrame, path: str) -> None:
    """Closes in a folder a ticker. Dealt by ticker and year, so that a long series is not one task."""
    rows = scan_closes(closes)
    rows.repartition("ticker", F.year("session_date")).write.partitionBy("ticker").parquet(path)


def read_closes(spark: SparkSession, path: str) -> DataFrame:
    """What `write_closes` wrote; the schema is known, so no file is opened to plan a query."""
    return spark.read.schema(CLOSE_COLUMNS).parquet(path)


def closes_of(events: DataFrame, closes: DataFrame) -> DataFrame:
    """The closes of the tickers that occur in the events.

    The tickers (one row each, size-checked broadcast) prune the folders of `closes`
    when the query runs: those of other tickers are not opened. The comparison
    tells the planner that the tickers are a selection.
    """
    wanted = bounded(events.filter(F.col("ticker") > "").select("ticker").distinct(), "tickers")
    return closes.join(wanted.filter(F.col("ticker") > ""), "ticker", "left_semi")


def join_closes(closes: DataFrame, sessions: DataFrame) -> DataFrame:
    """Closes that fall on a session, with the session's position."""
    positions = small(sessions.select("session_idx", "session_date"), sessions.count())
    return scan_closes(closes).filter(F.col("close").isNotNull()).join(positions, "session_date")


def _at(offset: int) -> Column:
    """Close exactly `offset` sessions away, null when there is none."""
    w = Window.partitionBy("ticker").orderBy("session_idx").rangeBetween(offset, offset)
    return F.first("close").over(w)


def _span(first: int, last: int):
    return Window.partitionBy("ticker").orderBy("session_idx").rangeBetween(first, last)


def prior_return(n: int) -> Column:
    return simple_return(_at(-n), F.col("close"))


def forward_return(n: int) -> Column:
    return simple_return(F.col("close"), _at(n))


def with_volatility(priced: DataFrame, n: int = LONG_RETURN_SESSIONS, name: str = "volatility_20d") -> DataFrame:
    """Sample deviation of the last n one-session returns, per year.

    Null unless all n returns exist, that is all n + 1 closes and no zero base.
    """
    daily = priced.withColumn("_r1", finite(prior_return(1)))
    span = _span(-(n - 1), 0)
    deviation = F.stddev_samp("_r1").over(span) * F.sqrt(F.lit(float(SESSIONS_PER_YEAR)))
    return daily.withColumn(name, F.when(F.count("_r1").over(span) == n, deviation)).drop("_r1")


def join_benchmark(priced: DataFrame, benchmark: str = BENCHMARK, n_sessions: int | None = None) -> DataFrame:
    """Add the benchmark's short return of the same session.

    With the number of sessions known, the benchmark's side is broadcast as far
    as that allows, and prices aren't shuffled for it.
    """
    slice_ = priced.filter(F.col("ticker") == benchmark).select(
        "session_idx", F.col("return_5d_prior").alias("spy_return_5d")
    )
    # At most one row per session on this side, so the join cannot be skewed.
    return priced.join(slice_ if n_sessions is None else small(slice_, n_sessions), "session_idx", "left")


def price_features(closes: DataFrame, sessions: DataFrame, benchmark: str = BENCHMARK) -> DataFrame:
    """All windowed columns per (ticker, session_idx)."""
    priced = join_closes(closes, sessions).withColumns(
        {
            "return_5d_prior": finite(prior_return(SHORT_RETURN_SESSIONS)),
            "return_20d_prior": finite(prior_return(LONG_RETURN_SESSIONS)),
            "fwd_return_5d": finite(forward_return(FORWARD_SESSIONS)),
        }
    )
    return join_benchmark(with_volatility(priced), benchmark, sessions.count())


def join_event_features(
    events: DataFrame, features: DataFrame, id_col: str = "event_id", max_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Attach session features at feature_idx and the label at label_idx.

    The feature table is broadcast while its checked row count allows; past
    that, (ticker, session) keys with very many events are spread over salts.
    """
    staged = stage(features, "price-features")
    rows = staged.count()
    at_feature = staged.select(
        "ticker", F.col("session_idx").alias("feature_idx"),
        "volatility_20d", "return_5d_prior", "return_20d_prior", "spy_return_5d",
    )
    at_label = staged.select("ticker", F.col("session_idx").alias("label_idx"), "fwd_return_5d")
    if rows <= max_rows:
        both = events.join(small(at_feature, rows, max_rows), ["ticker", "feature_idx"], "left").join(
            small(at_label, rows, max_rows), ["ticker", "label_idx"], "left"
        )
    else:
        # Counted twice and joined twice: computed once.
        events = stage(events, "events")
        one, _ = skew_join(events, at_feature, ["ticker", "feature_idx"], "left", F.col(id_col))
        both, _ = skew_join(one.drop("_salt"), at_label, ["ticker", "label_idx"], "left", F.col(id_col))
        both = both.drop("_salt")
    return both.withColumn("label_high_risk", label_high_risk(F.col("fwd_return_5d")))


COMPLETE = ("volatility_20d", "return_5d_prior", "return_20d_prior", "spy_return_5d", "fwd_return_5d")


def drop_counts() -> list[Column]:
    """rows_sampled = dropped_features + dropped_label + rows, as aggregates over joined events."""
    features = F.lit(True)
    for c in COMPLETE[:-1]:
        features = features & F.col(c).isNotNull()
    label = F.col(COMPLETE[-1]).isNotNull()
    return [
        F.count(F.lit(1)).alias("rows_sampled"),
        F.count_if(~features).alias("dropped_features"),
        F.count_if(features & ~label).alias("dropped_label"),
        F.count_if(features & label).alias("rows"),
    ]


def complete_rows(joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with every feature and the label, and the rows to drop and count."""
    ok = F.lit(True)
    for c in COMPLETE:
        ok = ok & F.col(c).isNotNull()
    return joined.filter(ok), joined.filter(~ok)


def join_coverage(days: DataFrame, closes: DataFrame) -> DataFrame:
    """Share of the distinct headline days (ticker, day) that have a close, for each ticker."""
    distinct_days = days.select("ticker", "day").filter(F.col("day").isNotNull()).distinct()
    priced = closes.select("ticker", F.col("session_date").alias("day"), F.lit(1).alias("hit"))
    return (
        distinct_days.join(priced.distinct(), ["ticker", "day"], "left")
        .groupBy("ticker")
        .agg(F.count(F.lit(1)).alias("days"), F.count("hit").alias("days_with_close"))
        .withColumn("coverage", F.round(F.col("days_with_close") / F.nullif("days", F.lit(0)), 4))
    )
