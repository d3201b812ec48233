"""Returns, labels, scores and the decision policy as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from hindcast.fixed_values import (
    LABEL_THRESHOLD,
    REASON_APPROVED,
    REASON_NO_RISK,
    REASON_SCORE,
    REASON_VETO,
)
from hindcast.functions.text import fixed


def finite(value: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def simple_return(start: Column, end: Column) -> Column:
    """end / start - 1; null when either is missing or start is zero."""
    return end / F.nullif(start, F.lit(0.0)) - 1


def label_high_risk(forward_return: Column) -> Column:
    return (forward_return < LABEL_THRESHOLD).cast("int")


def sentiment_from_probs(positive: Column, negative: Column) -> Column:
    return positive - negative


def clamp_score(probability: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), probability))


@dataclass(frozen=True)
class Policy:
    """Values the decision needs; kept with the saved model."""

    score_threshold: float
    vol_veto_enabled: bool = False
    vol_veto_threshold: float | None = None
    policy_version: str = "v1"

    def __post_init__(self) -> None:
        if self.vol_veto_enabled and self.vol_veto_threshold is None:
            raise ValueError("volatility veto is on but has no threshold")


def gate_policy(action: Column, score: Column, volatility: Column, policy: Policy) -> Column:
    """struct(decision, reason). Only a BUY can be refused.

    Both are null where the policy can't tell: for an action it doesn't know,
    and for a BUY without a score, or without the volatility that the veto asks for.
    """
    threshold = F.lit(float(policy.score_threshold))
    branches = F.when(
        action.isin("HOLD", "PASS"),
        _verdict("approve", F.format_string(REASON_NO_RISK, action, F.lit(policy.policy_version))),
    ).when(
        (action == "BUY") & (score >= threshold), _verdict("reject", F.format_string(REASON_SCORE, fixed(score, 4), F.lit(f"{policy.score_threshold:.4f}")))
    )
    approved = (action == "BUY") & (score < threshold)
    if policy.vol_veto_enabled:
        veto = F.lit(float(policy.vol_veto_threshold))
        branches = branches.when(
            (action == "BUY") & (volatility >= veto), _verdict("reject", F.format_string(REASON_VETO, fixed(volatility, 4), F.lit(f"{policy.vol_veto_threshold:.4f}")))
        )
        approved = approved & volatility.isNotNull()
    return branches.when(approved, _verdict("approve", F.format_string(REASON_APPROVED, fixed(score, 4), F.lit(f"{policy.score_threshold:.4f}"))))


def _verdict(decision: str, reason: Column) -> Column:
    return F.struct(F.lit(decision).alias("decision"), reason.alias("reason"))
