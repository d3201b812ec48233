"""Stream readers: records as (key, value, topic, partition, offset)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hindcast.fixed_values import NEWS_TOPIC

RECORD_SCHEMA = "key binary, value binary, topic string, partition int, offset long"
#: When a record arrived, for streams that drop redeliveries by time.
ARRIVED = "arrived_at"
PLACE = ("topic", "partition", "offset")


def stream_news_raw(
    spark: SparkSession, servers: str, topic: str = NEWS_TOPIC, max_per_trigger: int | None = None
) -> DataFrame:
    """Topic from the earliest offset; needs the Spark Kafka package.

    Progress lives in the query's checkpoint, which stands for the consumer
    group; offsets are committed only after a batch has been written.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load().select("key", "value", "topic", "partition", "offset")


def stream_record_files(spark: SparkSession, path: str, files_per_trigger: int | None = None, timed: bool = False) -> DataFrame:
    """The same records landed as Parquet files; `timed`: with the time of their arrival."""
    reader = spark.readStream.schema(f"{RECORD_SCHEMA}, {ARRIVED} timestamp" if timed else RECORD_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def without_redeliveries(records: DataFrame, within: str) -> DataFrame:
    """Each (topic, partition, offset) once, as far as its deliveries arrive less than `within` apart.

    The state holds places only, and a place leaves it once the watermark has
    passed its arrival by `within`, so it is bounded by the records of that time. A
    later redelivery passes and is settled where points are read (`points.newest`).
    """
    return records.withWatermark(ARRIVED, within).dropDuplicatesWithinWatermark(list(PLACE)).drop(ARRIVED)
