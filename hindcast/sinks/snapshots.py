"""Replace a table all at once.

A writer puts the new rows into a folder of their own and then adds one commit
record that names it. Readers take the folder of the newest commit, so until the
record is there they read the old rows, whether the write is running, has failed
half-way or was killed. Nothing that a reader may hold is deleted here; old
folders fall under the storage's retention rule.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "_commits"
VERSION = "version string, committed_ns long"


def new_version() -> str:
    # A letter first: an all-digit name would be read as a number.
    return f"v-{uuid.uuid4().hex}"


def commit(spark: SparkSession, path: str, record: dict, schema: str) -> None:
    """Add one commit record. A failed append leaves none behind."""
    row = spark.createDataFrame([record | {"committed_ns": time.time_ns()}], schema)
    row.coalesce(1).write.mode("append").json(f"{path}/{COMMITS}")


def commits(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/{COMMITS}")


def write_snapshot(df: DataFrame, path: str) -> str:
    """Write the rows beside the old ones, then commit; returns the new rows' folder."""
    version = new_version()
    df.write.parquet(f"{path}/version={version}")
    commit(df.sparkSession, path, {"version": version}, VERSION)
    return f"{path}/version={version}"


def current_snapshot(spark: SparkSession, path: str) -> str:
    """The folder of the newest commit."""
    newest = commits(spark, path, VERSION).orderBy(F.desc("committed_ns"), F.desc("version")).first()
    return f"{path}/version={newest['version']}"


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current_snapshot(spark, path))
