"""Row contracts: an `errors` array per row, and the valid / invalid split."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.fixed_values import ACTIONS, DECISIONS, EVENT_SOURCES, HIT_SOURCES, RATIONALE_MAX_CHARS, UNIVERSE
from hindcast.functions.clocks import has_zone, utc_from_zoned
from hindcast.functions.text import is_blank, normalize_ticker, strip
from hindcast.functions.wire import is_json_object, json_fields, json_number, json_text, strip_fences
from hindcast.operators.scale import computed_once
from hindcast.session import stage


class ContractError(ValueError):
    """Rows break a contract in a strict load."""


def with_errors(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Add `errors`: the names of the checks whose condition is not true."""
    passed = [F.coalesce(ok, F.lit(False)) for ok in checks.values()]
    broken = [F.when(ok, F.lit(None)).otherwise(F.lit(name)) for name, ok in zip(checks, passed, strict=True)]
    # The list is put together by an interpreted filter, so a row without errors passes it by.
    return df.withColumn("errors", F.when(reduce(and_, passed), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*broken))))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.size("errors") == 0
    return df.filter(ok).drop("errors"), df.filter(~ok)


def require_valid(df: DataFrame, what: str) -> DataFrame:
    """Strict load: fail on any invalid row, naming how many and why.

    The rows are staged, so they are parsed once for the check and for the caller.
    """
    df = stage(df, what)
    _, invalid = split_valid(df)
    bad = invalid.agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.flatten(F.collect_set("errors"))).alias("reasons")
    ).first()
    if bad.n:
        raise ContractError(f"{bad.n} invalid {what} row(s): {sorted(set(bad.reasons))}")
    return df.drop("errors")


def _present(c: str) -> Column:
    return F.length(c) > 0


def zoned_clock_ok(text: Column) -> Column:
    """An offset must be written out; a cast alone would accept naive text."""
    return has_zone(text) & utc_from_zoned(text).isNotNull()


def check_news_event(raw: DataFrame, universe: Sequence[str] = UNIVERSE) -> DataFrame:
    """Raw string columns -> cleaned news event columns plus `errors`."""
    ticker = normalize_ticker(F.col("ticker"))
    checked = with_errors(
        raw,
        {
            "event_id": _present("event_id"),
            "headline": ~is_blank(F.col("headline")),
            "ticker": ticker.isin(list(universe)),
            "source": F.col("source").isin(list(EVENT_SOURCES)),
            "published_at": zoned_clock_ok(F.col("published_at")),
        },
    )
    return checked.withColumns(
        {
            "ticker": ticker,
            "headline": strip(F.col("headline")),
            "published_at": utc_from_zoned(F.col("published_at")),
        }
    )


def check_retrieval_hit(raw: DataFrame) -> DataFrame:
    checked = with_errors(
        raw,
        {
            "document_id": _present("document_id"),
            "text": _present("text"),
            "ticker": _present("ticker"),
            "available_at": zoned_clock_ok(F.col("available_at")),
            "source": F.col("source").isin(list(HIT_SOURCES)),
        },
    )
    return checked.withColumns(
        {
            "available_at": utc_from_zoned(F.col("available_at")),
            "score": F.coalesce(F.col("score").cast("double"), F.lit(0.0)),
        }
    )


def proposal_checks(action: Column, confidence: Column, rationale: Column, event_id: Column, ticker: Column) -> dict[str, Column]:
    return {
        "action": action.isin(list(ACTIONS)),
        "confidence": confidence.between(0.0, 1.0) & ~F.isnan(confidence),
        # Characters are counted only where there are more bytes than that.
        "rationale": (rationale != "") & ((F.octet_length(rationale) <= RATIONALE_MAX_CHARS) | (F.length(rationale) <= RATIONALE_MAX_CHARS)),
        "event_id": F.length(event_id) > 0,
        "ticker": F.length(ticker) > 0,
    }


def parse_proposal(df: DataFrame, text_col: str = "response") -> DataFrame:
    """Free text -> proposal columns plus `errors`."""
    names = ("action", "confidence", "rationale", "event_id", "ticker")
    parsed = df.withColumn("_text", strip_fences(F.col(text_col))).withColumn("_f", json_fields(F.col("_text"), names))
    fields = parsed.withColumns(
        {
            "action": json_text(F.col("_f.action")),
            "confidence": json_number(F.col("_f.confidence")),
            "rationale": json_text(F.col("_f.rationale")),
            "proposed_event_id": json_text(F.col("_f.event_id")),
            "proposed_ticker": json_text(F.col("_f.ticker")),
            "_object": is_json_object(F.col("_text"), F.col("_f")),
        }
    )
    checks = {"json": F.col("_object")}
    checks |= {
        name: ~F.col("_object") | F.coalesce(ok, F.lit(False))
        for name, ok in proposal_checks(
            F.col("action"), F.col("confidence"), F.col("rationale"), F.col("proposed_event_id"), F.col("proposed_ticker")
        ).items()
    }
    checked = with_errors(fields, checks).drop("_text", "_f", "_object")
    return computed_once(
        checked, ["action", "confidence", "rationale", "proposed_event_id", "proposed_ticker", "errors"]
    )


def check_proposal(df: DataFrame) -> DataFrame:
    """Typed proposal columns plus `errors`."""
    return with_errors(
        df,
        proposal_checks(
            F.col("action"), F.col("confidence"), F.col("rationale"), F.col("event_id"), F.col("ticker")
        ),
    )


def check_decision(df: DataFrame) -> DataFrame:
    return with_errors(
        df,
        {
            "event_id": F.col("event_id").isNotNull(),
            "ticker": F.col("ticker").isNotNull(),
            "action": F.col("action").isin(list(ACTIONS)),
            "downside_risk_score": F.col("downside_risk_score").between(0.0, 1.0)
            & ~F.isnan("downside_risk_score"),
            "decision": F.col("decision").isin(list(DECISIONS)),
            "decision_reason": F.col("decision_reason").isNotNull(),
            "model_version": F.col("model_version").isNotNull(),
            "bundle_id": F.col("bundle_id").isNotNull(),
            "features_used": F.col("features_used").isNotNull(),
            "feature_as_of": F.col("feature_as_of").isNotNull(),
        },
    )
