"""Payload bytes -> checked news events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.fixed_values import PAYLOAD_VERSION, UNIVERSE
from hindcast.functions.wire import is_absent, is_json_object, is_json_text, json_fields, json_text
from hindcast.operators.contracts import check_news_event
from hindcast.operators.scale import computed_once

_FIELDS = ("event_id", "headline", "ticker", "source", "published_at", "url")


def decode_payload(df: DataFrame, value_col: str = "value", universe: Sequence[str] = UNIVERSE) -> DataFrame:
    """Event columns plus `reason` (null when the record is good).

    Checks run in a fixed order: UTF-8 JSON, object, version, contract.
    """
    parsed = df.withColumn("_text", F.try_validate_utf8(F.col(value_col).cast("string"))).withColumn(
        "_f", json_fields(F.col("_text"), ("payload_version", *_FIELDS))
    )
    text, field = F.col("_text"), lambda name: F.col(f"_f.{name}")
    raw = parsed.withColumns({name: json_text(field(name)) for name in _FIELDS})
    checked = check_news_event(raw, universe)
    # Told apart only for records that are no good anyway.
    what = F.when(
        text.isNull() | text.rlike(r"^\s*\{") | F.try_parse_json(text).isNull(), F.lit("invalid JSON payload")
    ).otherwise(F.lit("payload must be a JSON object"))
    version = json_text(field("payload_version"))
    reason = (
        F.when(~is_json_object(text, F.col("_f")), what)
        .when(F.coalesce(version != PAYLOAD_VERSION, F.lit(True)), F.lit("unknown payload_version"))
        .when(F.size("errors") > 0, F.concat(F.lit("invalid: "), F.array_join("errors", ",")))
        .when(~is_absent(field("url")) & ~is_json_text(field("url")), F.lit("invalid: url"))
    )
    decoded = checked.withColumn("reason", reason).drop("_text", "_f", "errors")
    return computed_once(decoded, [*_FIELDS, "reason"])
