"""End-to-end jobs on small inputs, and the shape of query plans."""

import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from hindcast.catalog import queries, views
from hindcast.fixed_values import TRAINING_COLUMNS
from hindcast.functions.risk import Policy
from hindcast.operators import sessions as calendars
from hindcast.plans import training_events as build
from hindcast.plans.expectation_suite import expectation_suite, suite_counts
from hindcast.plans.run_decisions import run_decisions
from hindcast.sinks.points import newest
from hindcast.sources.expectations import parse_expectations

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def market(spark):
    days = [d for d in (date(2020, 1, 1) + timedelta(i) for i in range(150)) if d.weekday() < 5]
    rows = [(t, d, 100.0 + (i * 7 % 11) + 3 * k) for k, t in enumerate(("AAPL", "META", "SPY")) for i, d in enumerate(days)]
    closes = spark.createDataFrame(rows, "ticker string, session_date date, close double")
    return closes, calendars.scan_sessions(closes)


def archive(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_order long, date string, stock string, headline string")


ROWS = [(f"2020-03-{d:02d}", s, f"{s} moves {d}") for d in range(2, 28) for s in ("AAPL", "FB")]


def test_build(spark, market):
    options = build.BuildOptions("set", target=20)
    built = build.build_training_events(archive(spark, ROWS), *market, options)
    table = built.table
    assert built.counts == {"rows_sampled": 20, "dropped_features": 0, "dropped_label": 0, "rows": 20}
    assert table.columns == list(TRAINING_COLUMNS) and table.count() == 20
    assert {r.ticker for r in table.collect()} == {"AAPL", "META"}
    again = build.build_training_events(archive(spark, ROWS).repartition(6), *market, options).table
    assert sorted(r.event_id for r in again.collect()) == sorted(r.event_id for r in table.collect())


def test_build_fails_closed(spark, market):
    with pytest.raises(build.BuildError, match="shortfall"):
        build.build_training_events(archive(spark, ROWS), *market, build.BuildOptions("set", target=500))
    late = [("2031-03-02", "FB", "too late")]
    with pytest.raises(build.BuildError, match="fb_meta_v1"):
        build.build_training_events(archive(spark, late), *market, build.BuildOptions("set"), allow_shortfall=True)
    with pytest.raises(build.EmptyResultError, match="no usable row"):
        build.build_training_events(archive(spark, []), *market, build.BuildOptions("set"), allow_shortfall=True)
    closes, sessions = market
    raw = closes.unionByName(spark.createDataFrame([("FB", date(2020, 3, 2), 1.0)], closes.schema))
    with pytest.raises(ValueError, match="forbidden by rule fb_meta_v1"):
        build.build_training_events(archive(spark, ROWS), raw, sessions, build.BuildOptions("set", target=20))
    few = build.build_training_events(archive(spark, ROWS + late), *market, build.BuildOptions("set", target=None), allow_shortfall=True)
    assert few.counts["dropped_label"] == 1 and few.counts["rows_sampled"] == few.counts["rows"] + 1


def test_development_build_has_no_sentiment(spark, market):
    table = build.build_training_events(archive(spark, ROWS), *market, build.BuildOptions("set", target=None, with_sentiment=False)).table
    assert {r.finbert_sentiment for r in table.collect()} == {0.0}


def case(case_id, check, expect, **keys):
    return json.dumps({"case_id": case_id, "check": check, "expect": expect, **keys})


def hit(name, at):
    return {"document_id": name, "text": "t", "ticker": "AAPL", "available_at": at, "source": "fixture"}


AT, BEFORE, AFTER = "2024-03-12T14:30:00Z", "2024-03-12T13:00:00Z", "2024-03-13T12:00:00Z"
CASES = [
    case("s1", "schema", "ok", action="BUY", confidence=0.7),
    case("s2", "schema", "reject", action="SELL", confidence=0.7),
    case("s3", "schema", "reject", action="BUY", confidence=1.5),
    case("s4", "schema", "reject", action="BUY", confidence="0.7"),
    case("s5", "schema", "reject", action="BUY", confidence=0.5, model="NewsEvent", ticker="TSLA"),
    case("s6", "schema", "reject", action="BUY", confidence=0.5, model="RetrievalHit", available_at="2024-03-12T14:30:00"),
    case("i1", "identity", "stamped_from_input", llm_ticker="MSFT", input_ticker="AAPL", llm_event_id="x", input_event_id="e"),
    case("a1", "asof", "future_hit_dropped", published_at=AT, hits=[hit("p", BEFORE), hit("f", AFTER)]),
    case("a2", "asof", "kept", published_at=AT, hits=[hit("eq", AT)]),
    case("a3", "asof", "empty", published_at=AT, hits=[hit("f", AFTER)]),
    case("g1", "gate", "reject", action="BUY", force_score=0.95),
    case("g2", "gate", "approve", action="HOLD", force_score=0.95),
    case("g3", "gate", "approve", action="BUY", force_score="just_below_threshold"),
    case("g4", "gate", "reject", action="BUY", force_score="eq_threshold"),
    case("g5", "gate", "same_decision", action="BUY", force_score=0.95),
    case("g6", "gate", "reject", action="BUY", force_score="just_below_threshold", volatility_20d=0.2, tmp_vol_veto=True),
    case("o1", "oou", "reject", ticker="TSLA"),
    case("o2", "oou", "reject", ticker="NFLX", via="fixture"),
]
WRONG = [
    case("w1", "schema", "reject", action="BUY", confidence=0.7),
    case("w2", "asof", "kept", published_at=AT, hits=[hit("f", AFTER)]),
    case("w3", "gate", "approve", action="BUY", force_score=0.45),
    case("w4", "oou", "reject", ticker="AAPL"),
]


def test_expectation_suite(spark):
    lines = spark.createDataFrame([(c,) for c in CASES + WRONG], "value string")
    results = expectation_suite(parse_expectations(lines), Policy(0.45))
    outcome = {r.case_id: r.passed for r in results.collect()}
    assert all(outcome[json.loads(c)["case_id"]] for c in CASES), outcome
    assert not any(outcome[json.loads(c)["case_id"]] for c in WRONG), outcome
    counts = {r.check: (r.cases, r.passed) for r in suite_counts(results).collect()}
    assert counts["identity"] == (1, 1) and counts["gate"] == (7, 6)


def test_decisions_report_every_event(spark):
    events = spark.createDataFrame(
        [(f"e{i}", "AAPL", "2024-03-12 14:30:00") for i in range(6)], "event_id string, ticker string, at string"
    ).withColumn("published_at", F.col("at").cast("timestamp_ntz"))
    hits = spark.createDataFrame([], "event_id string, document_id string, score double, available_at timestamp_ntz")
    say = lambda **k: json.dumps({"action": "BUY", "confidence": 0.5, "rationale": "r", "event_id": "e0", "ticker": "AAPL"} | k)
    answers = spark.createDataFrame(
        [
            ("e0", 0, say()), ("e0", 0, say()), ("e1", 0, say(action="SELL")), ("e1", 1, say(action="SELL")), ("e2", 0, "?"), ("e2", 1, say()),
            ("e3", 0, say(event_id="zz", ticker="MSFT")), ("e3", 1, "?"), ("e5", 0, "no JSON"),
        ],
        "event_id string, attempt int, response string",
    )
    features = spark.createDataFrame(
        [("e0", 0.9, 0.1), ("e1", 0.9, 0.1), ("e3", 0.1, 0.1), ("e4", 0.1, 0.1)], "event_id string, score double, volatility_20d double"
    ).withColumn("feature_as_of", F.lit("2024-03-11").cast("date"))
    out = run_decisions(events, hits, answers, features, Policy(0.45), "m", "b").collect()
    rows = {r.event_id: r for r in out}
    assert len(out) == len(rows) == 6
    assert {k: r.outcome for k, r in rows.items()} == {"e0": "accepted", "e1": "failed", "e2": "failed", "e3": "accepted", "e4": "failed", "e5": "redo"}
    assert "repair is due: json" in rows["e5"].error_message
    with pytest.raises(ValueError, match="duplicate"):
        run_decisions(events, hits, answers, features.unionByName(features), Policy(0.45), "m", "b")
    assert (rows["e0"].decision, rows["e0"].identity_mismatch, rows["e0"].error_message) == ("reject", False, None)
    assert "action" in rows["e1"].error_message and rows["e1"].decision is None
    assert rows["e2"].error_message == "no feature row for the event"
    assert (rows["e3"].decision, rows["e3"].identity_mismatch) == ("approve", True)
    assert rows["e4"].error_message == "no proposal for the event"


PLANS = (
    "label_rate_by_ticker", "join_event_features", "dedup_first", "ingest_funnel", "topk_hits", "context_prompt", "run_decisions",
    "time_rank", "threshold_f1", "join_coverage", "decode_payload", "stratified_sample", "vector_topk_join",
)


@pytest.mark.parametrize("name", PLANS)
def test_no_product_joins_and_no_row_at_a_time_python(spark, name):
    plan = queries.REGISTRY[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython", "SinglePartition, ENSURE_REQUIREMENTS, [id=window"):
        assert word not in plan, f"{name}: {word}"


def test_first_and_newest_rows_are_not_sort_aggregated(spark):
    point_rows = "point_id string, document_id string, text string, ticker string, available_at timestamp_ntz, source string, vector array<double>"
    stored = spark.createDataFrame([], point_rows + ", written_ns long, partition int, offset long, row_id long")
    for df in (queries.REGISTRY["dedup_first"](spark, SF), newest(stored)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan


def test_scans_read_only_needed_columns(spark):
    plan = views.news_events(spark, SF).select("event_id", "published_at")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_run_records_are_packed_in_files_of_bounded_rows(spark, folder):
    from pathlib import Path

    from hindcast.operators.decisions import build_envelope
    from hindcast.sinks.tables import read_run_records, sink_run_records

    texts = ("action", "rationale", "decision", "decision_reason", "model_version", "bundle_id", "policy_version", "error_message")
    rows = spark.range(40).selectExpr(
        "cast(id AS string) AS event_id", "'A' AS ticker", "cast(id AS int) AS n_hits", "false AS proposal_ok", "cast(null AS date) AS feature_as_of",
        *[f"cast(null AS string) AS {c}" for c in texts], *[f"cast(null AS double) AS {c}" for c in ("confidence", "downside_risk_score", "features_used")],
    ).coalesce(1)
    sink_run_records(build_envelope(rows), f"{folder}/packed", file_rows=10)
    sink_run_records(build_envelope(rows), f"{folder}/plain", "none")
    sizes = {name: [f.stat().st_size for f in Path(folder, name).rglob("part-*")] for name in ("packed", "plain")}
    assert len(sizes["packed"]) == 4 and sum(sizes["packed"]) < sum(sizes["plain"]) / 2
    found = [sorted((r.event_id, r.retrieval_hit_count) for r in read_run_records(spark, f"{folder}/{n}").collect()) for n in ("packed", "plain")]
    assert found[0] == found[1] == sorted((str(k), k) for k in range(40))
