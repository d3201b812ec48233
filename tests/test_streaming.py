import json
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hindcast.operators.retrieval import embed_unit
from hindcast.sinks import points as point_sink
from hindcast.sinks.runs import read_batches, write_batch
from hindcast.sinks.snapshots import current_snapshot, read_snapshot, write_snapshot
from hindcast.sinks.tables import sink_news_raw
from hindcast.sources.streams import RECORD_SCHEMA, stream_record_files, without_redeliveries
from hindcast.streaming.attempts import guarded
from hindcast.streaming.ingest import ingest_batch, stream_ingest, with_attempts


def record(offset, headline="Up", event=None, **change):
    body = {
        "payload_version": "1", "event_id": event or f"e{offset}", "headline": headline, "ticker": "AAPL", "source": "rss",
        "published_at": f"2024-03-12T14:{offset % 60:02d}:00Z",
    } | change
    return (b"k%d" % offset, json.dumps(body).encode(), "news.raw", 0, offset)


def land(spark, folder, rows):
    rows = [(bytearray(k), bytearray(v), t, p, o) for k, v, t, p, o in rows]
    spark.createDataFrame(rows, RECORD_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def ingest(spark, folder, **options):
    query = stream_ingest(
        stream_record_files(spark, f"{folder}/in"), f"{folder}/points", f"{folder}/dlq", f"{folder}/ck", available_now=True, **options
    )
    query.awaitTermination()
    return point_sink.read_points(spark, f"{folder}/points")


def test_ingest_restart_redelivery_and_poison(spark, folder):
    poison = (b"p", b"not json", "news.raw", 0, 3)
    land(spark, folder, [record(0), record(1), poison, record(4, ticker="TSLA")])
    assert ingest(spark, folder).count() == 2
    # Restart from the checkpoint: old files are not read again. One record is
    # delivered twice, one event changes.
    land(spark, folder, [record(1), record(1), record(5, headline="Changed", event="e0")])
    points = {r.document_id: r for r in ingest(spark, folder).collect()}
    assert set(points) == {"e0", "e1"}
    assert points["e0"].text == "Changed" and points["e0"].available_at == datetime(2024, 3, 12, 14, 5)
    assert points["e1"].point_id == str(uuid.uuid5(uuid.NAMESPACE_URL, "hindcast:event:e1"))
    dead = spark.read.parquet(f"{folder}/dlq").orderBy("offset").collect()
    assert [(bytes(r.key), bytes(r.value), r.reason, r.offset) for r in dead] == [
        (b"p", b"not json", "invalid JSON payload", 3), (b"k4", record(4, ticker="TSLA")[1], "invalid: ticker", 4),
    ]
    compact = f"{folder}/compact"
    point_sink.compact_points(spark, f"{folder}/points", compact)
    again = {r.document_id: r.text for r in point_sink.read_points(spark, compact).collect()}
    assert again == {k: r.text for k, r in points.items()}


def test_a_replayed_batch_rewrites_itself(spark, folder):
    rows = [(bytearray(k), bytearray(v), t, p, o) for k, v, t, p, o in (record(0), record(1))]
    batch = spark.createDataFrame(rows, RECORD_SCHEMA)
    run = ingest_batch(f"{folder}/points", f"{folder}/dlq")
    run(batch, 7)
    run(batch, 7)
    assert read_batches(spark, f"{folder}/points").count() == 2


def test_a_replay_that_fails_takes_nothing_away(spark, folder):
    rows = spark.range(10).withColumn("offset", F.col("id"))
    write_batch(rows, f"{folder}/t", 3, "r")
    bad = rows.withColumn("id", F.when(F.col("id") == 7, F.raise_error(F.lit("half-way")).cast("long")).otherwise(F.col("id")))
    for _ in range(2):
        with pytest.raises(Exception, match="half-way"):
            write_batch(bad, f"{folder}/t", 3, "r")
        assert read_batches(spark, f"{folder}/t").count() == 10
    write_batch(rows.limit(4), f"{folder}/t", 3, "r")
    write_batch(rows.limit(1), f"{folder}/t", 4, "r")
    assert sorted(r.batch_id for r in read_batches(spark, f"{folder}/t").collect()) == [3, 3, 3, 3, 4]


def test_a_snapshot_that_fails_takes_nothing_away(spark, folder):
    rows = spark.range(10)
    first = write_snapshot(rows, f"{folder}/s")
    bad = rows.select(F.when(F.col("id") == 7, F.raise_error(F.lit("half-way")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="half-way"):
        write_snapshot(bad, f"{folder}/s")
    assert current_snapshot(spark, f"{folder}/s") == first and read_snapshot(spark, f"{folder}/s").count() == 10
    held = read_snapshot(spark, f"{folder}/s")
    write_snapshot(spark.range(3), f"{folder}/s")
    assert read_snapshot(spark, f"{folder}/s").count() == 3
    # One who has resolved the pointer before goes on reading.
    assert held.count() == 10


def refuses(word, calls=None):
    def encode(frames):
        for frame in frames:
            if frame["text"].str.contains(word).any():
                raise ValueError(f"no {word}")
            yield frame.assign(vector=[[3.0, 4.0]] * len(frame))

    return encode


def test_a_refused_record_goes_to_the_dead_letters_after_three_attempts(spark, folder):
    land(spark, folder, [record(0), record(1, headline="bad one"), record(2), record(2), record(3, headline="bad two")])
    points = {r.document_id: list(r.vector) for r in ingest(spark, folder, encode_text=refuses("bad")).collect()}
    assert set(points) == {"e0", "e2"} and points["e0"] == pytest.approx([0.6, 0.8])
    dead = read_batches(spark, f"{folder}/dlq").orderBy("offset").collect()
    assert [(r.offset, r.reason) for r in dead] == [(1, "encoder: ValueError: no bad"), (3, "encoder: ValueError: no bad")]
    tried = spark.read.parquet(f"{folder}/points/_attempts").orderBy("offset", "attempt").collect()
    assert [(r.offset, r.attempt) for r in tried] == [(o, a) for o in (1, 3) for a in (1, 2, 3)]


def test_attempts_survive_restarts(spark, folder):
    """A batch of which nothing passes is replayed, until its record has had its attempts."""
    land(spark, folder, [record(5, headline="bad")])
    for _ in range(2):
        with pytest.raises(Exception, match="no bad"):
            ingest(spark, folder, encode_text=refuses("bad"))
    land(spark, folder, [record(6)])
    assert {r.document_id for r in ingest(spark, folder, encode_text=refuses("bad")).collect()} == {"e6"}
    assert [(r.offset, r.reason) for r in read_batches(spark, f"{folder}/dlq").collect()] == [(5, "encoder: ValueError: no bad")]


def test_an_encoder_is_started_once_unless_it_fails():
    import pandas as pd

    starts = []

    def encode(frames):
        starts.append(1)
        for frame in frames:
            if "bad" in set(frame["text"]):
                raise ValueError("bad")
            yield frame.assign(vector=[[1.0]] * len(frame))

    frames = [pd.DataFrame({"text": t}) for t in (["a", "b"], [], ["c"], ["d", "bad", "e"], ["f"])]
    out = pd.concat(list(guarded(encode)(iter(frames))))
    assert out["text"].tolist() == ["a", "b", "c", "d", "bad", "e", "f"]
    assert out["_error"].notna().tolist() == [False] * 4 + [True] + [False] * 2
    assert len(starts) == 4


def test_failing_sink_stops_the_batch_and_nothing_overtakes(spark, folder):
    land(spark, folder, [record(0)])
    land(spark, folder, [record(1)])

    def broken(frames):
        raise RuntimeError("encoder down")
        yield from frames

    with pytest.raises(Exception, match="encoder down"):
        ingest(spark, folder, encode_text=broken)
    # Nothing was committed, so the next run starts with the same records.
    assert {r.document_id for r in ingest(spark, folder).collect()} == {"e0", "e1"}


def test_records_that_all_fail_cost_one_call_each_and_leave_in_one_frame():
    import pandas as pd

    calls = []

    def encode(frames):
        for f in frames:
            calls.append(len(f))
            if (f["n"] >= 8).any():
                raise ValueError("no")
            yield f.assign(vector=[[1.0]] * len(f))

    out = list(guarded(encode)(iter([pd.DataFrame({"n": range(8, 72)})])))
    assert len(calls) <= 64 + 6 and [len(f) for f in out] == [64] and out[0]["_error"].notna().all()
    mixed = list(guarded(encode)(iter([pd.DataFrame({"n": [1, 9, 2, 3, 10, 4, 5, 6, 7]})])))
    assert len(mixed) == 1
    rows = mixed[0].sort_values("n")
    assert list(rows["n"]) == [1, 2, 3, 4, 5, 6, 7, 9, 10] and list(rows["_error"].notna()) == [False] * 7 + [True] * 2


def test_attempts_are_bounded():
    calls = []

    def fail():
        calls.append(1)
        raise OSError("sink")

    with pytest.raises(OSError):
        with_attempts(fail, 3)
    assert len(calls) == 3

    def second_time():
        calls.append(1)
        if len(calls) < 5:
            raise OSError("sink")

    with_attempts(second_time, 3)
    assert len(calls) == 5


def test_published_records_round_trip(spark, folder):
    events = spark.createDataFrame(
        [("e0", "Up é", "AAPL", "rss", datetime(2024, 3, 12, 14, 0), None)],
        "event_id string, headline string, ticker string, source string, published_at timestamp_ntz, url string",
    )
    sink_news_raw(events, f"{folder}/in", "parquet")
    row = ingest(spark, folder).first()
    assert (row.document_id, row.text, row.available_at) == ("e0", "Up é", datetime(2024, 3, 12, 14, 0))
    assert "url" not in json.loads(spark.read.parquet(f"{folder}/in").select(F.col("value").cast("string")).first()[0])
    vector = embed_unit(events.select(F.col("headline").alias("text"))).first().vector
    assert list(row.vector) == list(vector)


def test_redeliveries_within_the_bound_do_not_reach_the_sink(spark, folder):
    def deliver(rows, arrived):
        rows = [(bytearray(k), bytearray(v), t, p, o) for k, v, t, p, o in rows]
        timed = spark.createDataFrame(rows, RECORD_SCHEMA).withColumn("arrived_at", F.lit(arrived).cast("timestamp"))
        timed.write.mode("append").parquet(f"{folder}/in")
        stream = without_redeliveries(stream_record_files(spark, f"{folder}/in", timed=True), "1 hour")
        stream_ingest(stream, f"{folder}/points", f"{folder}/dlq", f"{folder}/ck", available_now=True).awaitTermination()
        return sorted(r.offset for r in read_batches(spark, f"{folder}/points").collect())

    assert deliver([record(0), record(1), record(1)], "2024-05-01 00:00:00") == [0, 1]
    assert deliver([record(0), record(2)], "2024-05-01 00:10:00") == [0, 1, 2]
    assert deliver([record(3)], "2024-05-06 00:00:00") == [0, 1, 2, 3]
    # Beyond the bound a redelivery is stored again and settled by the reader.
    assert deliver([record(0)], "2024-05-11 00:00:00") == [0, 0, 1, 2, 3]
    assert sorted(r.document_id for r in point_sink.read_points(spark, f"{folder}/points").collect()) == ["e0", "e1", "e2", "e3"]


def test_records_of_one_file_are_dealt_to_all_tasks(spark, folder):
    """A landed file with one row group is one task's to read; decoding it is not."""
    from pathlib import Path

    spark.createDataFrame([record(k) for k in range(400)], RECORD_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    ingest_batch(f"{folder}/points", f"{folder}/dlq", universe=("AAPL",))(spark.read.parquet(f"{folder}/in"), 0)
    assert len(list(Path(folder, "points").rglob("part-*.parquet"))) >= 4
    assert point_sink.read_points(spark, f"{folder}/points").count() == 400
