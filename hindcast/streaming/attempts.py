"""Attempts by record, for what fails after decoding.

A frame that the encoder refuses is taken apart, so one bad record costs its
neighbours nothing. Failures are written to a ledger keyed by (topic, partition,
offset) before the batch goes on, so they survive replays and restarts: a record
is tried `attempts` times in all and then goes to the dead letters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.session import stage
from hindcast.sources.streams import PLACE

LEDGER = "topic string, partition int, offset long, attempt int, reason string"
MAX_REASON = 300


class NothingPassed(RuntimeError):
    """Every record of a batch failed: more likely the encoder than the records."""


def guarded(encode: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The same encoder, with failures in a column `_error` instead of an exception.

    `encode` gives one frame for each frame it takes. It is started anew (its model
    loaded again) only after a failure.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        box: list[pd.DataFrame] = []

        def feed() -> Iterator[pd.DataFrame]:
            while box:
                yield box.pop()

        coder: Iterator[pd.DataFrame] | None = None

        def one(frame: pd.DataFrame) -> pd.DataFrame:
            nonlocal coder
            box[:] = [frame]
            coder = coder or iter(encode(feed()))
            try:
                return next(coder).assign(_error=None)
            except Exception:
                coder = None
                raise

        def apart(frame: pd.DataFrame, refused: list[tuple[int, str]]) -> Iterator[tuple[int, pd.DataFrame]]:
            """Pieces of a frame that failed, down to the records that do.

            A piece that passes is followed by one twice as long, one that fails is halved;
            where all fail, each record costs one call.
            """
            start, size = 0, len(frame)
            while start < len(frame):
                piece = frame.iloc[start : start + size]
                try:
                    done = one(piece)
                except Exception as exc:
                    if len(piece) > 1:
                        size = len(piece) // 2
                        continue
                    refused.append((start, f"encoder: {type(exc).__name__}: {exc}"[:MAX_REASON]))
                    start, size = start + 1, 1
                    continue
                yield start, done
                start, size = start + len(piece), 2 * len(piece)

        for frame in frames:
            if frame.empty:
                continue
            refused: list[tuple[int, str]] = []
            # One frame out for a frame in: small ones cost more to send than to encode.
            places, pieces = map(list, zip(*found, strict=True)) if (found := list(apart(frame, refused))) else ([], [])
            at = np.repeat(places, [len(p) for p in pieces]).astype(int)
            if refused:
                rows, reasons = map(list, zip(*refused, strict=True))
                pieces.append(frame.iloc[rows].assign(vector=None, _error=reasons))
                at = np.concatenate([at, rows])
            # Rows stay in the order they came in.
            yield pieces[0] if len(pieces) == 1 else pd.concat(pieces, ignore_index=True).iloc[np.argsort(at, kind="stable")]

    return run


def add_failures(failed: DataFrame, path: str) -> None:
    """failed: topic, partition, offset, attempt, reason."""
    failed.select(*PLACE, "attempt", "reason").write.mode("append").parquet(path)


def attempts_so_far(spark: SparkSession, path: str) -> DataFrame:
    """topic, partition, offset, tried, last_reason."""
    try:
        ledger = spark.read.schema(LEDGER).parquet(path)
    except AnalysisException:  # no failure yet
        ledger = spark.createDataFrame([], LEDGER)
    return ledger.groupBy(*PLACE).agg(F.max("attempt").alias("tried"), F.max_by("reason", "attempt").alias("last_reason"))


def encode_with_attempts(rows: DataFrame, encode: Callable[[DataFrame], DataFrame], ledger: str, attempts: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(encoded rows, rows that have used up their attempts with a `reason`), both staged; None if there are none.

    rows carry topic, partition and offset; `encode` adds `vector` and `_error`.
    A batch of which nothing passes ends with NothingPassed while attempts are left,
    so that it is replayed and nothing overtakes it.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    pending = rows.join(attempts_so_far(spark, ledger), list(PLACE), "left").withColumn("tried", F.coalesce("tried", F.lit(0)))
    pending = stage(pending, "pending")
    passed, given_up, n_passed = None, None, 0
    both = lambda a, b: b if a is None else a.unionByName(b)
    while True:
        # A record whose last attempt failed just before a restart has none left.
        spent = pending.filter(F.col("tried") >= attempts)
        # Spread over tasks by place, not by the files they come in: a refused record costs a call of its own.
        tried = stage(encode(pending.filter(F.col("tried") < attempts).repartition(parts, *PLACE)), "encoded")
        counts = tried.agg(F.count_if(F.col("_error").isNull()).alias("good"), F.count_if(F.col("_error").isNotNull()).alias("bad")).first()
        if not spent.isEmpty():
            given_up = both(given_up, spent.select(*PLACE, F.col("last_reason").alias("reason")))
        if counts["good"]:
            passed = both(passed, tried.filter(F.col("_error").isNull()).drop("_error", "tried", "last_reason"))
            n_passed += counts["good"]
        if not counts["bad"]:
            return passed, given_up
        failed = stage(tried.filter(F.col("_error").isNotNull()).withColumns({"attempt": (F.col("tried") + 1).cast("int"), "reason": F.col("_error")}), "failed")
        add_failures(failed, ledger)
        over = failed.filter(F.col("attempt") >= attempts)
        left = failed.filter(F.col("attempt") < attempts)
        if not over.isEmpty():
            given_up = both(given_up, over.select(*PLACE, "reason"))
        if left.isEmpty():
            return passed, given_up
        if not n_passed:
            raise NothingPassed(left.first()["reason"])
        pending = left.withColumn("tried", F.col("attempt")).drop("attempt", "reason", "vector", "_error")
