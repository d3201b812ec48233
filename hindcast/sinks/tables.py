"""Batch writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.fixed_values import NEWS_TOPIC
from hindcast.functions.wire import encode_payload
from hindcast.session import stage
from hindcast.sinks.runs import write_batch
from hindcast.sinks.snapshots import write_snapshot
from hindcast.sources.files import select_training_columns

CANONICAL_NAME = "training_events.parquet"


def sort_by_time(df: DataFrame) -> DataFrame:
    """Range partitions in time order, sorted inside: a total order on disk.

    Staged first: range partitioning samples its input, which would run it twice.
    """
    return stage(df, "unsorted").repartitionByRange("published_at", "event_id").sortWithinPartitions("published_at", "event_id")


def sink_training_parquet(df: DataFrame, path: str, development: bool = False) -> str:
    """Write the training table as a new snapshot of `path`; returns the snapshot's folder.

    Readers of `snapshots.read_snapshot(path)` see the old table until the new one is
    whole. Development output (no sentiment) may not take the canonical name.
    """
    if development and CANONICAL_NAME in path:
        raise ValueError(f"development output cannot be written as {CANONICAL_NAME}")
    return write_snapshot(sort_by_time(select_training_columns(df)), path)


def news_records(events: DataFrame, topic: str = NEWS_TOPIC) -> DataFrame:
    """Key and value of each event, ready for a topic."""
    url = F.col("url") if "url" in events.columns else F.lit(None).cast("string")
    return events.select(
        F.col("event_id").cast("binary").alias("key"),
        encode_payload(
            F.col("event_id"), F.col("headline"), F.col("ticker"), F.col("source"), F.col("published_at"), url
        ).cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
    )


def sink_news_raw(events: DataFrame, target: str, fmt: str = "kafka", topic: str = NEWS_TOPIC) -> None:
    """Publish to a broker (`target` = servers) or to Parquet files."""
    records = news_records(events, topic)
    if fmt == "kafka":
        records.write.format("kafka").option("kafka.bootstrap.servers", target).option("kafka.acks", "all").save()
        return
    # A file has no broker to number its records; numbers count within one append, so each has a folder of its own.
    numbered = records.withColumns({"partition": F.spark_partition_id(), "offset": F.monotonically_increasing_id()})
    write_batch(numbered, target, 0, uuid.uuid4().hex, fmt)


def sink_run_records(envelopes: DataFrame, path: str, compression: str = "lz4", file_rows: int = 1_000_000) -> None:
    """One JSON document per run, by run date.

    Records repeat their names and stamps, so files are packed ("none" for readers that
    cannot unpack them); a packed file is read by one task, so it has `file_rows` at most.
    """
    dated = envelopes.withColumn("run_date", F.to_date("started_at"))
    dated.write.mode("append").partitionBy("run_date").option("maxRecordsPerFile", file_rows).json(path, compression=compression)


RUN_COLUMNS = "run_id string, event_id string, ticker string, status string, mode string, retrieval_hit_count long, extras variant"


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    """The flat part of stored run records, and their extras as a variant."""
    return spark.read.schema(RUN_COLUMNS).json(path)
