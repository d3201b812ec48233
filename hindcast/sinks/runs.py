"""Where a batch is written: a folder for each run, batch and try.

A run is one checkpoint. Batch numbers start at 0 with every new checkpoint, so
they name a batch only together with the run. A replay of a batch writes a new
try beside the old one and then commits it; readers take each batch's newest
committed try, so a replay that fails, or is still running, takes nothing away.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.operators.scale import bounded
from hindcast.sinks.snapshots import commit, commits, new_version

#: Set by the engine for the thread that runs a streaming query; the id is kept in the checkpoint.
QUERY_ID = "sql.streaming.queryId"
BATCH_RUN = "batch"
#: How rows stand in time, over runs: when they were written, then their place in the stream and in the batch.
ORDER = ("written_ns", "partition", "offset", "row_id")
#: What tells stored rows apart.
ROW = ("written_ns", "row_id")


def current_run(spark: SparkSession) -> str:
    """Id of the streaming query that calls, or a fixed name outside of one."""
    return spark.sparkContext.getLocalProperty(QUERY_ID) or BATCH_RUN


TRY = "run string, batch_id long, try string, committed_ns long"


def write_batch(df: DataFrame, path: str, batch_id: int, run: str | None = None, fmt: str = "parquet") -> None:
    """Write one batch of one run; running it again leaves the same rows."""
    run = run or current_run(df.sparkSession)
    attempt = new_version()
    stamped = df.withColumns({"written_ns": F.lit(time.time_ns()), "row_id": F.monotonically_increasing_id()})
    stamped.write.format(fmt).save(f"{path}/run={run}/batch_id={batch_id}/try={attempt}")
    commit(df.sparkSession, path, {"run": run, "batch_id": batch_id, "try": attempt}, TRY)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the newest committed try of every batch."""
    # One row for each batch.
    newest = commits(spark, path, TRY).groupBy("run", "batch_id").agg(F.max_by("try", F.struct("committed_ns", "try")).alias("try"))
    rows = spark.read.option("basePath", path).parquet(path).withColumns({c: F.col(c).cast(kind) for c, kind in (("run", "string"), ("batch_id", "long"), ("try", "string"))})
    return rows.join(bounded(newest, "tries"), ["run", "batch_id", "try"], "left_semi").drop("try")
