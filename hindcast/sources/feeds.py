"""RSS documents -> news events, all documents at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.fixed_values import UNIVERSE
from hindcast.functions.clocks import iso_utc, parse_rss_date
from hindcast.functions.ids import DEFAULT_PREFIX, rss_event_id, rss_item_key
from hindcast.functions.text import normalize_ticker, strip
from hindcast.operators.scale import computed_once

_ITEM = "struct<title: string, link: string, guid: string, pubDate: string>"
# `rss` holds a channel; a bare `channel` root holds the items itself.
_FEED = f"channel struct<item: array<{_ITEM}>, title: string>, item array<{_ITEM}>, _broken string"
_XML_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_broken",
    "ignoreNamespace": "true",
    "attributePrefix": "_",
}


def scan_feed_documents(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed files, one small document per file, under ticker=SYMBOL/."""
    return spark.read.text(path, wholetext=True).select(
        F.col("ticker"), F.input_file_name().alias("document"), F.col("value").alias("xml")
    )


def root_element(xml: Column) -> Column:
    """Local name of the first element, past prolog, comments and doctype."""
    body = F.regexp_replace(xml, r"(?s)<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>", "")
    return F.regexp_extract(body, r"<(?:[\w.-]+:)?([\w.-]+)", 1)


def _text(item: Column, name: str) -> Column:
    return F.nullif(strip(item[name]), F.lit(""))


def parse_feeds(
    documents: DataFrame,
    universe: Sequence[str] = UNIVERSE,
    max_items: int | None = None,
    prefix: str = DEFAULT_PREFIX,
) -> DataFrame:
    """documents(ticker, document, xml) -> the same rows with their items.

    Adds `items` (good items; with `max_items` only so many, in feed order),
    `n_items` (before that cut), `skipped` (items without title or date) and `error`
    (null when the document is a feed of a universe ticker).
    """
    if max_items is not None and max_items < 1:
        raise ValueError(f"max_items must be at least 1, got {max_items}")
    root = root_element(F.col("xml"))
    parsed = documents.withColumns(
        {"_feed": F.from_xml("xml", _FEED, _XML_OPTIONS), "_root": root, "ticker": normalize_ticker(F.col("ticker"))}
    )
    broken = F.col("_feed").isNull() | F.col("_feed._broken").isNotNull()
    # An empty channel element reads as null, so its presence is seen in the text.
    has_channel = (F.col("_root") == "channel") | (
        (F.col("_root") == "rss") & F.col("xml").rlike(r"<(?:[\w.-]+:)?channel[\s/>]")
    )
    error = (
        F.when(~F.coalesce(F.col("ticker").isin(list(universe)), F.lit(False)), F.lit("out of universe"))
        .when(broken, F.lit("invalid XML"))
        .when(~has_channel, F.lit("channel not found"))
    )
    every = F.when(F.col("_root") == "rss", F.col("_feed.channel.item")).otherwise(F.col("_feed.item"))
    shaped = F.transform(
        F.coalesce(every, F.array().cast(f"array<{_ITEM}>")),
        lambda i: F.struct(
            _text(i, "title").alias("title"),
            _text(i, "link").alias("link"),
            _text(i, "guid").alias("guid"),
            parse_rss_date(_text(i, "pubDate")).alias("published_at"),
        ),
    )
    good = F.filter("_items", lambda i: i["title"].isNotNull() & i["published_at"].isNotNull())
    none = F.lit(0)
    shaped_docs = (
        parsed.withColumn("error", error)
        .withColumn("_items", F.when(F.col("error").isNull(), shaped))
        .withColumn("_good", good)
        .withColumns(
            {
                "items": F.col("_good") if max_items is None else F.slice("_good", 1, max_items),
                "n_items": F.coalesce(F.size("_good"), none),
                "skipped": F.coalesce(F.size("_items") - F.size("_good"), none),
            }
        )
        .drop("_feed", "_root", "_items", "_good", "xml")
    )
    return computed_once(shaped_docs, ["error", "items", "n_items", "skipped"])


def feed_events(parsed: DataFrame, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """One news event per kept item; ids are stable over re-polls."""
    items = parsed.filter(F.col("error").isNull()).select(
        "ticker", "document", F.posexplode("items").alias("item_pos", "item")
    )
    key = rss_item_key(
        F.col("item.guid"), F.col("item.link"), F.col("item.title"), iso_utc(F.col("item.published_at"))
    )
    return items.select(
        rss_event_id(F.col("ticker"), key, prefix).alias("event_id"),
        F.col("item.title").alias("headline"),
        "ticker",
        F.lit("rss").alias("source"),
        F.col("item.published_at").alias("published_at"),
        F.col("item.link").alias("url"),
        "document",
        "item_pos",
    )


def feed_summary(parsed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """fetched, produced, skipped, cut by an item limit, and errors; ok when there is no error.

    A bad document counts as fetched and as an error and stops nothing else.
    """
    ok = F.col("error").isNull()
    return parsed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("fetched"),
        F.coalesce(F.sum(F.when(ok, F.size("items"))), F.lit(0)).alias("produced"),
        F.coalesce(F.sum(F.when(ok, F.col("skipped"))), F.lit(0)).alias("skipped_items"),
        F.coalesce(F.sum(F.when(ok, F.col("n_items") - F.coalesce(F.size("items"), F.lit(0)))), F.lit(0)).alias("cut_items"),
        F.count("error").alias("errors"),
    ).withColumn("ok", F.col("errors") == 0)
