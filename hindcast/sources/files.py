"""Batch readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.fixed_values import FEATURE_NAMES, TRAINING_COLUMNS, UNIVERSE
from hindcast.functions.text import is_blank
from hindcast.functions.wire import is_json_object, json_fields, json_text
from hindcast.operators.contracts import check_news_event, check_retrieval_hit, require_valid, with_errors
from hindcast.operators.scale import computed_once
from hindcast.sources.archive import SourceError, scan_quoted_csv


HEADLINE_NAMES = ("headline", "title", "article title")

HIT_FIELDS = (
    "document_id string, text string, ticker string, available_at string, source string, score double"
)
FEATURE_FIELDS = ", ".join(f"{name} double" for name in FEATURE_NAMES) + ", feature_as_of date"


def archive_columns(header: Sequence[str]) -> list[Column]:
    """date, stock, headline from a header in any case, with its aliases."""
    found = {c.strip().lower(): c for c in header}
    headline = next((found[n] for n in HEADLINE_NAMES if n in found), None)
    wanted = {"date": found.get("date"), "stock": found.get("stock"), "headline": headline}
    lacking = [name for name, column in wanted.items() if column is None]
    if lacking:
        raise SourceError(f"archive lacks column(s) {lacking}; it has {list(header)}")
    return [F.col(f"`{column}`").alias(name) for name, column in wanted.items()]


def scan_news_csv(spark: SparkSession, path: str, empty_texts: bool = False) -> DataFrame:
    """Headline archive as text columns, plus the byte offset of each row as `row_order`.

    Files are split freely, whether or not quoted fields go over line ends (see `archive`).
    With `empty_texts` a quoted field of nothing is an empty text, else missing.
    """
    rows, header = scan_quoted_csv(spark, path, empty_texts)
    named = rows.select("row_order", *[F.col(f"c{k}").alias(name) for k, name in enumerate(header)])
    return named.select(*archive_columns(header), "row_order")


def parse_events_jsonl(lines: DataFrame, universe: Sequence[str] = UNIVERSE) -> DataFrame:
    """`value` lines -> event columns plus `errors`; blank lines are skipped."""
    names = ("event_id", "headline", "ticker", "source", "published_at", "url")
    docs = lines.filter(~is_blank(F.col("value"))).withColumn("_f", json_fields(F.col("value"), names))
    raw = docs.select(
        is_json_object(F.col("value"), F.col("_f")).alias("_object"), *[json_text(F.col(f"_f.{n}")).alias(n) for n in names]
    )
    checked = check_news_event(raw, universe)
    errors = F.when(F.col("_object"), F.col("errors")).otherwise(F.array(F.lit("json")))
    return computed_once(checked.withColumn("errors", errors).drop("_object"), [*names, "errors"])


def scan_events_jsonl(spark: SparkSession, path: str, universe: Sequence[str] = UNIVERSE, strict: bool = True) -> DataFrame:
    """Replay events. Strict: any bad line, or no line at all, fails the load."""
    events = parse_events_jsonl(spark.read.text(path), universe)
    if not strict:
        return events
    checked = require_valid(events, "event")
    if checked.isEmpty():
        raise SourceError(f"no events in {path}")
    return checked


def explode_hit_map(docs: DataFrame) -> DataFrame:
    """`value` documents {event_id: [hit, ...]} -> one row per hit."""
    parsed = F.from_json("value", T.MapType(T.StringType(), T.ArrayType(T.StructType.fromDDL(HIT_FIELDS))))
    by_event = docs.select(F.explode(parsed).alias("event_id", "hits"))
    return by_event.select("event_id", F.inline("hits"))


def scan_hits(spark: SparkSession, path: str, layout: str = "lines", strict: bool = True) -> DataFrame:
    """Context hits keyed by event: JSON lines, or the map form of fixtures."""
    if layout == "map":
        raw = explode_hit_map(spark.read.text(path, wholetext=True))
    else:
        raw = spark.read.schema(f"event_id string, {HIT_FIELDS}").json(path)
    checked = check_retrieval_hit(raw)
    return require_valid(checked, "hit") if strict else checked


def explode_feature_map(docs: DataFrame) -> DataFrame:
    """`value` documents {event_id: features} -> one row per event."""
    parsed = F.from_json("value", T.MapType(T.StringType(), T.StructType.fromDDL(FEATURE_FIELDS)))
    return docs.select(F.explode(parsed).alias("event_id", "f")).select("event_id", "f.*")


def scan_feature_rows(spark: SparkSession, path: str, layout: str = "parquet", strict: bool = True) -> DataFrame:
    """Precomputed features by event id."""
    if layout == "map":
        rows = explode_feature_map(spark.read.text(path, wholetext=True))
    else:
        rows = spark.read.parquet(path)
    needed = (*FEATURE_NAMES, "feature_as_of")
    lacking = [c for c in needed if c not in rows.columns]
    if lacking:
        raise SourceError(f"feature table lacks {lacking}")
    checked = with_errors(rows, {c: F.col(c).isNotNull() for c in needed})
    return require_valid(checked, "feature") if strict else checked


def scan_training_table(spark: SparkSession, path: str) -> DataFrame:
    return check_training_table(spark.read.parquet(path))


def training_table_problems(df: DataFrame) -> DataFrame:
    """Row count and null/NaN counts of the model inputs, in one pass."""
    bad = [
        F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c)
        for c in (*FEATURE_NAMES, "label_high_risk")
    ]
    return df.agg(F.count(F.lit(1)).alias("rows"), *bad)


def check_training_table(df: DataFrame) -> DataFrame:
    """Required columns, at least one row, no null or NaN in model inputs."""
    lacking = [c for c in (*FEATURE_NAMES, "label_high_risk", "published_at") if c not in df.columns]
    if lacking:
        raise SourceError(f"training table lacks {lacking}")
    stats = training_table_problems(df).first().asDict()
    if stats.pop("rows") == 0:
        raise SourceError("training table is empty")
    dirty = {name: n for name, n in stats.items() if n}
    if dirty:
        raise SourceError(f"null or NaN in model inputs: {dirty}")
    return df.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


def select_training_columns(df: DataFrame) -> DataFrame:
    lacking = [c for c in TRAINING_COLUMNS if c not in df.columns]
    if lacking:
        raise SourceError(f"missing columns: {lacking}")
    return df.select(*TRAINING_COLUMNS)
