"""Point table in key buckets: reading the newest rows needs no shuffle.

Every upsert writes a piece: a folder of Parquet files dealt into buckets by the hash
of the point id, as Spark's own bucketed tables are. Bucket k of all pieces is read by
one task, so the newest row of a point is found where it is read. Buckets fall into
slots (slot = bucket modulo `slots`), each a folder of its own.

Pieces are merged in size tiers: `fan_in` pieces of about the same size in a slot
become one, which has only their newest rows. A merge reads and writes the slots that
are due and no other; a row is rewritten about once a tier. Commit records say which
pieces a slot has: a merge or a replay names the pieces that it stands for, so readers
see the old ones or the new one, and a write that fails takes nothing away. Replaced
pieces are left for the storage's retention rule.

Buckets are dealt on into `parts` (a power of two) as the table grows, so that a task's
rows stay below about `bucket_rows`: part and bucket come from the same hash, so a slot keeps its
points. When the number doubles, the table's rows are written anew in the commit that
adds the batch, so a row is rewritten a bounded number of times on average.

Edges: rows without a point id share a bucket and count as one point; an empty batch
commits nothing; a table may not change its number of buckets or slots. Versions of one
point cannot be parted.
"""

from __future__ import annotations

import math
import time
import uuid
from collections import defaultdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.sinks.points import POINT_COLUMNS
from hindcast.sinks.runs import ORDER, current_run
from hindcast.sinks.snapshots import COMMITS, commits, new_version

BUCKETS = 64
SLOTS = 16
FAN_IN = 4
BUCKET_ROWS = 100_000
KEY = "point_id"
PIECE = "piece string, label string, slot int, n_rows long, buckets int, slots int, replaces array<string>, columns string, parts int"


def _slot(buckets: int, slots: int):
    return F.pmod(F.pmod(F.hash(KEY), F.lit(buckets)), F.lit(slots)).cast("int")


def _write(df: DataFrame, path: str, buckets: int) -> str:
    """One piece: files by slot and bucket. df has a column slot and a partition for each bucket."""
    piece = new_version()
    name = f"write_{uuid.uuid4().hex}"
    sorted_files = df.write.format("parquet").partitionBy("slot").bucketBy(buckets, KEY).sortBy(KEY)
    try:
        sorted_files.option("path", f"{path}/{piece}").saveAsTable(name)
    finally:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")  # only the name: the files have a path of their own
    return piece


def _slot_rows(spark: SparkSession, path: str, piece: str) -> dict[int, int]:
    # One row for each slot.
    counts = spark.read.schema("slot int").parquet(f"{path}/{piece}").groupBy("slot").count().collect()
    return {r["slot"]: r["count"] for r in counts}


def _commit(spark: SparkSession, path: str, written: list[tuple[str, str, dict[int, list[str]]]], buckets: int, slots: int, columns: str, parts: int) -> None:
    """Commit every slot of some pieces (piece, label, what it stands for) at once (one file)."""
    record = []
    for piece, label, replaces in written:
        rows = _slot_rows(spark, path, piece)
        record += [(piece, label, s, rows.get(s, 0), buckets, slots, replaces.get(s, []), columns, parts, time.time_ns()) for s in sorted({*rows, *replaces})]
    spark.createDataFrame(record, f"{PIECE}, committed_ns long").coalesce(1).write.mode("append").json(f"{path}/{COMMITS}")


def pieces(spark: SparkSession, path: str) -> list[Row]:
    """The live pieces of every slot: committed and not replaced. Merging keeps them few."""
    all_pieces = commits(spark, path, f"{PIECE}, committed_ns long")
    gone = all_pieces.select("slot", F.explode("replaces").alias("piece"))
    return all_pieces.join(gone, ["slot", "piece"], "left_anti").filter("n_rows > 0").orderBy("slot", "committed_ns", "piece").collect()


def _parts(live: list[Row]) -> int:
    """Into how many parts each bucket is dealt; the same for all live pieces."""
    return (live[0]["parts"] or 1) if live else 1


def _table(spark: SparkSession, path: str, live: list[Row]) -> DataFrame:
    """The rows of these pieces as one bucketed table."""
    buckets, columns = live[0]["buckets"] * _parts(live), live[0]["columns"]
    name = f"read_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({columns}, slot INT, piece STRING) USING parquet OPTIONS (path '{path}')"
        f" PARTITIONED BY (slot, piece) CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS"
    )
    places = " ".join(f"PARTITION (slot={r['slot']}, piece='{r['piece']}') LOCATION '{path}/{r['piece']}/slot={r['slot']}'" for r in live)
    spark.sql(f"ALTER TABLE {name} ADD {places}")
    return spark.table(name)


def _newest(rows: DataFrame) -> DataFrame:
    latest = Window.partitionBy(KEY).orderBy(*[F.desc(c) for c in ORDER])
    return rows.withColumn("_place", F.row_number().over(latest)).filter("_place = 1").drop("_place")


def upsert_bucketed(
    points: DataFrame, path: str, batch_id: int, run: str | None = None, buckets: int = BUCKETS, slots: int = SLOTS, bucket_rows: int = BUCKET_ROWS,
) -> None:
    """Add one batch of one run; a replay stands for the batch's earlier pieces.

    The batch's ids are counted first, so stage points that are costly to make.
    """
    spark = points.sparkSession
    label = f"{run or current_run(spark)}/{batch_id}"
    live = _pieces_or_none(spark, path)
    replaces: dict[int, list[str]] = defaultdict(list)
    for r in live:
        if (r["buckets"], r["slots"]) != (buckets, slots):
            raise ValueError(f"the table at {path} has {r['buckets']} buckets in {r['slots']} slots")
        if r["label"] == label:
            replaces[r["slot"]].append(r["piece"])
    others = [r for r in live if r["label"] != label]
    n = sum(r["n_rows"] for r in others) + points.select(KEY).count()
    parts = _parts(live)
    while n > bucket_rows * buckets * parts:
        parts *= 2
    stamped = points.withColumns({"written_ns": F.lit(time.time_ns()), "row_id": F.monotonically_increasing_id()})
    columns = stamped.schema.toDDL()
    written = []
    if others and parts > _parts(live):
        # Rows of the same points meet in the table as it was: only its newest are dealt anew.
        grown = _newest(_table(spark, path, others)).drop("piece").repartition(buckets * parts, KEY)
        stands_for: dict[int, list[str]] = defaultdict(list)
        for r in others:
            stands_for[r["slot"]].append(r["piece"])
        written.append((_write(grown, path, buckets * parts), "merged", stands_for))
    dealt = stamped.withColumn("slot", _slot(buckets, slots)).repartition(buckets * parts, KEY)
    written.append((_write(dealt, path, buckets * parts), label, replaces))
    _commit(spark, path, written, buckets, slots, columns, parts)


def _pieces_or_none(spark: SparkSession, path: str) -> list[Row]:
    try:
        return pieces(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []  # the first batch


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """One row per point, the latest written, then by place in the stream."""
    return _newest(_table(spark, path, pieces(spark, path))).select(*POINT_COLUMNS)


def due(live: list[Row], fan_in: int = FAN_IN) -> list[Row]:
    """Pieces to merge: in each slot those of the smallest size tier that has `fan_in` of them."""
    tiers: dict[int, dict[int, list[Row]]] = defaultdict(lambda: defaultdict(list))
    for r in live:
        tiers[r["slot"]][int(math.log(r["n_rows"], fan_in))].append(r)
    full = [next((own[t] for t in sorted(own) if len(own[t]) >= fan_in), []) for own in tiers.values()]
    return [r for group in full for r in group]


def compact_bucketed(spark: SparkSession, path: str, fan_in: int = FAN_IN) -> list[int]:
    """Merge what is due, once; returns the slots that were rewritten."""
    chosen = due(pieces(spark, path), fan_in)
    if not chosen:
        return []
    replaces: dict[int, list[str]] = defaultdict(list)
    for r in chosen:
        replaces[r["slot"]].append(r["piece"])
    first, parts = chosen[0], _parts(chosen)
    piece = _write(_newest(_table(spark, path, chosen)).drop("piece"), path, first["buckets"] * parts)
    _commit(spark, path, [(piece, "merged", replaces)], first["buckets"], first["slots"], first["columns"], parts)
    return sorted(replaces)
