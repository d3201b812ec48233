"""events + hits + proposals + features -> decisions and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.fixed_values import TOP_K
from hindcast.functions.risk import Policy
from hindcast.functions.wire import repair_route
from hindcast.operators.cleaning import unique_event_ids
from hindcast.operators.contracts import parse_proposal
from hindcast.operators.decisions import decide, stamp_identity
from hindcast.operators.retrieval import visible
from hindcast.session import stage

ANSWER = ("action", "confidence", "rationale", "proposed_event_id", "proposed_ticker", "errors")


def last_answers(proposals: DataFrame) -> DataFrame:
    """One parsed answer per event, and its `route`: ok, retry or fail.

    proposals(event_id, attempt, response), attempts from 0. The first valid
    answer counts; without one it is the answer of the last attempt. Attempts
    after a final failure don't count. Of several answers to one attempt the
    smallest text is taken.
    """
    single = proposals.groupBy("event_id", "attempt").agg(F.min("response").alias("response"))
    parsed = parse_proposal(single).withColumn("route", repair_route(F.size("errors") == 0, F.col("attempt")))
    # What ended the event, if anything did; a retry only while nothing has.
    final = F.struct((F.col("route") == "retry").alias("open"), F.when(F.col("route") == "retry", -F.col("attempt")).otherwise(F.col("attempt")).alias("at"))
    row = F.struct("attempt", "route", *ANSWER)
    best = parsed.groupBy("event_id").agg(F.min_by(row, final).alias("_answer"))
    return best.select("event_id", "_answer.*")


def run_decisions(
    events: DataFrame,
    hits: DataFrame,
    proposals: DataFrame,
    scored_features: DataFrame,
    policy: Policy,
    model_version: str,
    bundle_id: str,
    k: int = TOP_K,
) -> DataFrame:
    """One row per event with its decision or an `error_message`; `outcome` is
    accepted, redo (an answer is to be repaired) or failed.

    proposals(event_id, attempt, response) holds the answer texts;
    scored_features holds event_id, score, volatility_20d and feature_as_of,
    one row an event. All joins are equi-joins on event_id, so one hash
    partitioning serves them.
    """
    # Checked for repeated ids and then joined: not computed for each.
    scored_features = unique_event_ids(stage(scored_features, "features"))
    clocks = events.select("event_id", "published_at")
    seen = hits.select("event_id", "available_at").join(clocks, "event_id").filter(visible())
    n_hits = seen.groupBy("event_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n_hits"))
    rows = (
        events.join(n_hits, "event_id", "left")
        .join(last_answers(proposals), "event_id", "left")
        .join(scored_features, "event_id", "left")
    )
    stamped = stamp_identity(rows)
    problems = F.array_join("errors", ",")
    message = (
        F.when(F.col("errors").isNull(), F.lit("no proposal for the event"))
        .when(F.col("route") == "retry", F.concat(F.lit("proposal validation error, repair is due: "), problems))
        .when(F.col("route") == "fail", F.concat(F.lit("proposal validation error after one repair retry: "), problems))
        .when(F.col("score").isNull() | F.col("volatility_20d").isNull(), F.lit("no feature row for the event"))
    )
    valid = F.coalesce(F.size("errors") == 0, F.lit(False))
    outcome = F.when(F.col("error_message").isNull(), F.lit("accepted")).when(F.col("route") == "retry", F.lit("redo")).otherwise(F.lit("failed"))
    checked = stamped.withColumns(
        {
            "error_message": message,
            "proposal_ok": valid,
            "n_hits": F.coalesce("n_hits", F.lit(0)).cast("int"),
            "identity_mismatch": F.when(valid, F.col("identity_mismatch")),
        }
    ).withColumn("outcome", outcome)
    decided = decide(checked, policy, model_version, bundle_id)
    failed = F.col("error_message").isNotNull()
    return decided.withColumns(
        {c: F.when(~failed, F.col(c)) for c in ("decision", "decision_reason", "downside_risk_score")}
    ).drop("errors", "route")
