"""Idempotent point table on plain Parquet.

Each batch of a run owns a partition (see `runs`); a replayed batch takes its own
place once it is whole, and a new checkpoint adds to what is stored. Readers take
the newest row per point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.functions.ids import DEFAULT_PREFIX, event_point_id
from hindcast.operators.retrieval import embed_unit
from hindcast.session import stage
from hindcast.sinks.runs import ORDER, ROW, read_batches, write_batch

POINT_COLUMNS = ("point_id", "document_id", "text", "ticker", "available_at", "source", "vector")


def payload_columns(events: DataFrame, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Event -> point without its vector."""
    return events.select(
        event_point_id(F.col("event_id").cast("string"), prefix).alias("point_id"),
        F.col("event_id").cast("string").alias("document_id"),
        F.col("headline").alias("text"),
        "ticker",
        F.col("published_at").cast("timestamp_ntz").alias("available_at"),
        F.lit("qdrant").alias("source"),
        *[c for c in ("topic", "partition", "offset") if c in events.columns],
    )


def points_from_events(events: DataFrame, prefix: str = DEFAULT_PREFIX, encode_text=None) -> DataFrame:
    """Event -> point: unit vector of the headline plus payload columns."""
    return embed_unit(payload_columns(events, prefix), "text", encode_text=encode_text)


def newest(points: DataFrame) -> DataFrame:
    """One row per point: the latest written, then by place in the stream.

    Winners are found on narrow rows; texts and vectors are read for them only.
    """
    latest = Window.partitionBy("point_id").orderBy(*[F.desc(c) for c in ORDER])
    places = points.select("point_id", *ORDER).withColumn("_place", F.row_number().over(latest))
    winners = places.filter(F.col("_place") == 1).select(*ROW)
    return points.join(winners, list(ROW), "left_semi").select(*POINT_COLUMNS)


def upsert_points(points: DataFrame, path: str, batch_id: int, run: str | None = None) -> None:
    """Write one batch; running it again leaves the same table."""
    write_batch(points, path, batch_id, run)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return newest(read_batches(spark, path))


def compact_points(spark: SparkSession, path: str, target: str) -> None:
    """Write the newest rows as a run of their own in a new table, by ticker and time.

    The table being read is never overwritten; readers move to the new path.
    """
    compacted = stage(read_points(spark, path).withColumns({"partition": F.lit(0), "offset": F.lit(0).cast("long")}), "newest")
    write_batch(compacted.repartitionByRange("ticker", "available_at", "point_id"), target, -1, "compacted")
