"""Landed feed documents -> records and a summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from hindcast.fixed_values import MAX_FEED_ITEMS, UNIVERSE
from hindcast.functions.ids import DEFAULT_PREFIX
from hindcast.session import stage
from hindcast.sinks.tables import sink_news_raw
from hindcast.sources.feeds import feed_events, feed_summary, parse_feeds


def feed_to_events(
    documents: DataFrame,
    target: str,
    fmt: str = "parquet",
    universe: Sequence[str] = UNIVERSE,
    max_items: int = MAX_FEED_ITEMS,
    prefix: str = DEFAULT_PREFIX,
) -> DataFrame:
    """Publish the newest items of every document; returns the summary."""
    # Parsed once: the records and the summary both read the staged copy.
    parsed = stage(parse_feeds(documents, universe, max_items, prefix), "feeds")
    sink_news_raw(feed_events(parsed, prefix), target, fmt)
    return feed_summary(parsed)
