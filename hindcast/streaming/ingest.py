"""Record stream -> point table, with a dead-letter table.

What the source rules ask of a consumer loop comes from the engine here:
offsets are committed after `foreachBatch` returns (at least once), a failed
batch is replayed as a whole before anything later (nothing overtakes), and
partitions owned by a run and its batch make the replay harmless.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.fixed_values import DLQ_TOPIC, MAX_ATTEMPTS, POLL_INTERVAL, UNIVERSE
from hindcast.functions.ids import DEFAULT_PREFIX
from hindcast.functions.vectors import unit
from hindcast.operators.payloads import decode_payload
from hindcast.sinks.points import payload_columns, points_from_events, upsert_points
from hindcast.sinks.runs import current_run, write_batch
from hindcast.sources.streams import PLACE
from hindcast.streaming.attempts import encode_with_attempts, guarded


def sink_dlq(bad: DataFrame, target: str, batch_id: int, fmt: str = "parquet", run: str | None = None) -> None:
    """Original key and bytes, with the reason and the place they came from."""
    rows = bad.select("key", "value", "reason", "topic", "partition", "offset")
    if fmt == "kafka":
        records = rows.select("key", "value", F.lit(DLQ_TOPIC).alias("topic"))
        records.write.format("kafka").option("kafka.bootstrap.servers", target).option("kafka.acks", "all").save()
        return
    write_batch(rows, target, batch_id, run, fmt)


def with_attempts(write: Callable[[], None], attempts: int = MAX_ATTEMPTS) -> None:
    """Repeat a failing write; the last failure ends the batch."""
    for attempt in range(1, attempts + 1):
        try:
            return write()
        except Exception:
            if attempt == attempts:
                raise


def encoded_points(good: DataFrame, bad: DataFrame, prefix: str, encode_text, ledger: str, attempts: int) -> tuple[DataFrame, DataFrame]:
    """Points of what the encoder takes, and the dead letters with what it has refused for good."""
    rows = payload_columns(good, prefix)

    def encode(pending: DataFrame) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pending.schema)
        raw = pending.mapInPandas(guarded(encode_text), f"{fields}, vector array<float>, _error string")
        return raw.withColumn("vector", unit(F.col("vector")))

    passed, given_up = encode_with_attempts(rows, encode, ledger, attempts)
    if passed is None:
        passed = encode(rows.limit(0)).drop("_error")
    if given_up is not None:
        # A record that is delivered twice is refused twice.
        reasons = given_up.groupBy(*PLACE).agg(F.min("reason").alias("reason"))
        refused = good.drop("reason").join(reasons, list(PLACE))
        bad = bad.select("key", "value", "reason", *PLACE).unionByName(refused.select("key", "value", "reason", *PLACE))
    return passed, bad


def ingest_batch(
    points_path: str,
    dlq_path: str,
    universe: Sequence[str] = UNIVERSE,
    prefix: str = DEFAULT_PREFIX,
    encode_text=None,
    attempts: int = MAX_ATTEMPTS,
    dlq_format: str = "parquet",
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: decode once, write both splits.

    A record that cannot be decoded never will be, so it goes to the dead
    letters at once. One that a caller's encoder refuses is tried `attempts` times,
    over replays, and then goes there too (see `attempts`). A failing write is
    repeated and then ends the batch.

    Records are dealt to tasks by their place: decoding costs far more than moving them,
    and a landed file's rows may all be one split's.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run_id = current_run(spark)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        decoded = decode_payload(batch.repartition(parts, *PLACE), universe=universe).persist()
        try:
            good = decoded.filter(F.col("reason").isNull())
            bad = decoded.filter(F.col("reason").isNotNull())
            if encode_text is None:
                points = points_from_events(good, prefix)
            else:
                points, bad = encoded_points(good, bad, prefix, encode_text, f"{points_path}/_attempts", attempts)
            with_attempts(lambda: upsert_points(points, points_path, batch_id, run_id), attempts)
            with_attempts(lambda: sink_dlq(bad, dlq_path, batch_id, dlq_format, run_id), attempts)
        finally:
            decoded.unpersist()

    return run


def stream_ingest(
    records: DataFrame,
    points_path: str,
    dlq_path: str,
    checkpoint: str,
    available_now: bool = False,
    interval: str = POLL_INTERVAL,
    **options,
):
    """Start the ingest query; returns the running query."""
    writer = records.writeStream.foreachBatch(ingest_batch(points_path, dlq_path, **options)).option(
        "checkpointLocation", checkpoint
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
