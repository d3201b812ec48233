"""Tables of expectation cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.fixed_values import EXPECTATION_KEYS
from hindcast.functions.text import is_blank
from hindcast.functions.wire import is_json_object
from hindcast.operators.scale import computed_once
from hindcast.sources.files import SourceError
from hindcast.session import stage

_TEXTS = (
    "case_id", "check", "expect", "model", "action", "rationale", "event_id", "headline", "ticker", "source",
    "published_at", "document_id", "text", "available_at", "llm_ticker", "input_ticker", "llm_event_id",
    "input_event_id", "via",
)
_HITS = "array<struct<document_id: string, text: string, ticker: string, available_at: string, source: string, score: double>>"
_CASE = (
    ", ".join(f"{c} string" for c in _TEXTS)
    + ", volatility_20d double, tmp_vol_veto boolean, score double, confidence variant, force_score variant"
    + f", hits {_HITS}, _broken string"
)
_OPTIONS = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_broken"}


def parse_expectations(lines: DataFrame) -> DataFrame:
    """`value` lines -> wide case columns plus `errors`; blank lines skipped.

    confidence and force_score keep their JSON type: a case may carry a text
    where a number belongs, or a sentinel.
    """
    docs = lines.filter(~is_blank(F.col("value"))).withColumn("_case", F.from_json("value", _CASE, _OPTIONS))
    typed = docs.select(
        is_json_object(F.col("value"), F.col("_case")).alias("_object"),
        F.json_object_keys("value").alias("_keys"),
        "_case.*",
    ).drop("_broken")
    lacking = F.lit(None).cast("array<string>")
    for check, needed in EXPECTATION_KEYS.items():
        missing = F.array_except(F.array(*[F.lit(k) for k in needed]), F.col("_keys"))
        lacking = F.when(F.col("check") == check, missing).otherwise(lacking)
    universal = F.filter(
        F.array(
            *[
                F.when(F.coalesce(F.col(k), F.lit("")) == "", F.lit(f"missing {k}"))
                for k in ("case_id", "check", "expect")
            ]
        ),
        lambda e: e.isNotNull(),
    )
    unknown = F.when(
        F.col("check").isNotNull() & ~F.col("check").isin(list(EXPECTATION_KEYS)), F.array(F.lit("unknown check"))
    )
    absent = F.transform(F.coalesce(lacking, F.array().cast("array<string>")), lambda k: F.concat(F.lit("missing key "), k))
    errors = F.concat(universal, F.coalesce(unknown, F.array().cast("array<string>")), absent)
    cases = typed.withColumn(
        "errors", F.when(F.col("_object"), errors).otherwise(F.array(F.lit("not a JSON object")))
    ).drop("_object", "_keys")
    return computed_once(cases, cases.columns)


def duplicate_cases(cases: DataFrame) -> DataFrame:
    counts = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("copies"))
    return counts.filter(F.col("copies") > 1)


def scan_expectations(spark: SparkSession, path: str) -> DataFrame:
    """Cases of one or more JSON-lines files; any malformed case fails the load."""
    cases = stage(parse_expectations(spark.read.text(path)), "cases")
    bad = cases.filter(F.size("errors") > 0).select("case_id", "errors").first()
    if bad is not None:
        raise SourceError(f"case {bad.case_id!r}: {bad.errors}")
    twice = duplicate_cases(cases).first()
    if twice is not None:
        raise SourceError(f"duplicate case_id {twice.case_id!r}")
    if cases.isEmpty():
        raise SourceError(f"no cases in {path}")
    return cases.drop("errors")
