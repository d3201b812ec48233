"""Identity, scored decisions and run envelopes for all events at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.fixed_values import FEATURE_NAMES
from hindcast.functions.risk import Policy, clamp_score, gate_policy


def join_feature_rows(events: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with their precomputed features, and the events that lack them.

    One left join feeds both: the row of a missing event has no `feature_as_of`.
    """
    joined = events.join(features.withColumn("_found", F.lit(True)), "event_id", "left")
    complete = F.col("_found").isNotNull()
    for name in FEATURE_NAMES:
        complete = complete & F.col(name).isNotNull()
    return joined.filter(complete).drop("_found"), joined.filter(~complete).select(*events.columns)


def stamp_identity(proposals: DataFrame, event_id: str = "event_id", ticker: str = "ticker") -> DataFrame:
    """Event-side identity wins; a differing proposal is flagged.

    Expects the proposal's own ids in proposed_event_id / proposed_ticker next
    to the event's.
    """
    same = F.col("proposed_event_id").eqNullSafe(F.col(event_id).cast("string")) & F.col(
        "proposed_ticker"
    ).eqNullSafe(F.col(ticker))
    return proposals.withColumn("identity_mismatch", ~same).drop("proposed_event_id", "proposed_ticker")


def decide(
    scored: DataFrame,
    policy: Policy,
    model_version: str,
    bundle_id: str,
    features_used: Sequence[str] = FEATURE_NAMES,
) -> DataFrame:
    """action + score + volatility -> decision row with model provenance."""
    score = clamp_score(F.col("score"))
    verdict = gate_policy(F.col("action"), F.col("downside_risk_score"), F.col("volatility_20d"), policy)
    return (
        scored.withColumn("downside_risk_score", score)
        .withColumn("_verdict", verdict)
        .withColumns(
            {
                "decision": F.col("_verdict.decision"),
                "decision_reason": F.col("_verdict.reason"),
                "model_version": F.lit(model_version),
                "bundle_id": F.lit(bundle_id),
                "features_used": F.array(*[F.lit(f) for f in features_used]),
                "policy_version": F.lit(policy.policy_version),
            }
        )
        .drop("_verdict", "score")
    )


def error_code(message: Column) -> Column:
    """Error class of a message."""
    return (
        F.when(message.startswith("model refused"), F.lit("gate_load_error"))
        .when(message.contains("validation error"), F.lit("validation_error"))
        .when(message.contains("model server"), F.lit("model_server_error"))
        .otherwise(F.lit("pipeline_error"))
    )


def free_form(text: Column) -> Column:
    """JSON text of an object as a variant, parsed once; an empty object for anything else."""
    parsed = F.try_parse_json(text)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed).otherwise(F.parse_json(F.lit("{}")))


def extra(name: str, kind: str, column: str = "extras") -> Column:
    """A field of the extras by its path, null where it is absent or of another kind."""
    return F.try_variant_get(F.col(column), f"$.{name}", kind)


def build_envelope(
    rows: DataFrame,
    mode: str = "replay",
    rag_mode: str = "fixture",
    resource_mode: str = "replay_fixture",
    side_output_failed: Column | None = None,
    extras: Column | None = None,
) -> DataFrame:
    """Nested run record per event.

    `extras` is free-form: JSON text of an object, kept as a variant with its own types;
    anything else gives an empty object.

    Status is `error` with a message, `degraded` when only a side output
    failed, else `success`.
    """
    failed = F.col("error_message").isNotNull()
    side = F.coalesce(side_output_failed, F.lit(False)) if side_output_failed is not None else F.lit(False)
    status = F.when(failed, F.lit("error")).when(side, F.lit("degraded")).otherwise(F.lit("success"))
    proposal = F.struct("action", "confidence", "rationale", F.col("event_id").cast("string").alias("event_id"), "ticker")
    decision = F.struct(
        F.col("event_id").cast("string").alias("event_id"), "ticker", "action", "downside_risk_score", "decision",
        "decision_reason", "model_version", "bundle_id", "features_used", "feature_as_of", "policy_version",
    )
    error = F.struct(
        error_code(F.col("error_message")).alias("code"),
        F.col("error_message").alias("message"),
        F.lit(False).alias("retriable"),
    )
    now = F.current_timestamp()
    return rows.select(
        F.uuid().alias("run_id"),
        status.alias("status"),
        F.col("event_id").cast("string").alias("event_id"),
        "ticker",
        F.lit(mode).alias("mode"),
        F.lit(rag_mode).alias("rag_mode"),
        F.lit(resource_mode).alias("resource_mode"),
        F.when(F.col("proposal_ok"), proposal).alias("proposal"),
        F.when(~failed, decision).alias("decision"),
        F.coalesce(F.col("n_hits"), F.lit(0)).alias("retrieval_hit_count"),
        F.when(failed, error).alias("error"),
        now.alias("started_at"),
        now.alias("finished_at"),
        free_form(F.lit("{}") if extras is None else extras).alias("extras"),
    )
