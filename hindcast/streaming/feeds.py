"""Landed feed files -> event records, in micro-batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.fixed_values import MAX_FEED_ITEMS, POLL_INTERVAL, UNIVERSE
from hindcast.functions.ids import DEFAULT_PREFIX
from hindcast.sinks.runs import write_batch
from hindcast.sinks.tables import news_records
from hindcast.sources.feeds import feed_events, feed_summary, parse_feeds


def stream_feed_documents(spark: SparkSession, path: str, fmt: str = "text") -> DataFrame:
    """Newly landed documents.

    `text`: one document per file under ticker=SYMBOL/, as a poller lands them.
    `parquet`: tables of (ticker, document, xml), for pollers that batch.
    """
    if fmt == "parquet":
        return spark.readStream.schema("ticker string, document string, xml string").parquet(path)
    return (
        spark.readStream.format("text").option("wholetext", "true").schema("value string, ticker string").load(path)
        .select("ticker", F.input_file_name().alias("document"), F.col("value").alias("xml"))
    )


def feed_micro_batch(
    documents: DataFrame,
    records_path: str,
    summary_path: str,
    checkpoint: str,
    universe: Sequence[str] = UNIVERSE,
    max_items: int = MAX_FEED_ITEMS,
    prefix: str = DEFAULT_PREFIX,
    available_now: bool = False,
    interval: str = POLL_INTERVAL,
):
    """Parse each batch, write its records and one summary row per ticker.

    Bad documents are counted and stop nothing. Item ids are stable, so a
    document that lands twice yields the same events.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_feeds(batch, universe, max_items, prefix).persist()
        try:
            events = feed_events(parsed, prefix)
            numbered = news_records(events).withColumns(
                {"partition": F.spark_partition_id(), "offset": F.monotonically_increasing_id()}
            )
            write_batch(numbered, records_path, batch_id)
            write_batch(feed_summary(parsed, ["ticker"]), summary_path, batch_id)
        finally:
            parsed.unpersist()

    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return (
        documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
