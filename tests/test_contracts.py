import json

import pytest
from pyspark.sql import functions as F

from hindcast.operators import contracts
from hindcast.operators.payloads import decode_payload
from hindcast.sources import expectations, files

GOOD = {
    "event_id": "e1", "headline": " Up ", "ticker": "aapl ", "source": "rss", "published_at": "2024-03-12T14:30:00Z",
    "url": None,
}
NEWS = "event_id string, headline string, ticker string, source string, published_at string, url string"


def errors(df):
    return [r.errors for r in df.collect()]


@pytest.mark.parametrize(
    "change, broken",
    [
        ({}, []), ({"event_id": ""}, ["event_id"]), ({"headline": " \n"}, ["headline"]), ({"headline": None}, ["headline"]),
        ({"ticker": "TSLA"}, ["ticker"]), ({"source": "blog"}, ["source"]),
        ({"published_at": "2024-03-12T14:30:00"}, ["published_at"]), ({"published_at": "soonZ"}, ["published_at"]),
        ({"published_at": "2024-03-12T14:30:00+01:00"}, []),
    ],
)
def test_news_event(spark, change, broken):
    df = spark.createDataFrame([tuple((GOOD | change).values())], NEWS)
    row = contracts.check_news_event(df).first()
    assert row.errors == broken
    if not broken:
        assert (row.ticker, row.headline) == ("AAPL", "Up")


def test_retrieval_hit(spark):
    rows = [("d", "t", "A", "2024-01-01T00:00:00Z", "fixture", None), ("d", "t", "A", "2024-01-01T00:00:00", "web", 0.5)]
    df = spark.createDataFrame(rows, "document_id string, text string, ticker string, available_at string, source string, score double")
    good, bad = contracts.check_retrieval_hit(df).orderBy("source").collect()
    assert good.errors == [] and good.score == 0.0
    assert bad.errors == ["available_at", "source"]


def proposal(**change):
    base = {"action": "BUY", "confidence": 0.7, "rationale": "r", "event_id": "e", "ticker": "A"}
    return json.dumps(base | change)


@pytest.mark.parametrize(
    "answer, broken",
    [
        (proposal(), []), (proposal(action="SELL"), ["action"]), (proposal(confidence=1.5), ["confidence"]),
        (proposal(confidence="0.7"), ["confidence"]), (proposal(confidence=True), ["confidence"]),
        (proposal(confidence=1), []), (proposal(rationale=""), ["rationale"]), (proposal(rationale="r" * 2001), ["rationale"]),
        (proposal(rationale="é" * 2000), []), ("```json\n" + proposal() + "\n```", []), ("I would buy", ["json"]),
        ("[1]", ["json"]), (proposal() + " and more", ["json"]), (proposal() + proposal(), ["json"]),
        (proposal(event_id=5), ["event_id"]), (proposal(rationale="a} b"), []),
    ],
)
def test_parse_proposal(spark, answer, broken):
    df = spark.createDataFrame([(answer,)], "response string")
    assert errors(contracts.parse_proposal(df)) == [broken]


def test_decision(spark):
    row = ("e", "A", "BUY", 1.2, "maybe", "why", "m", "b", ["f"], None)
    df = spark.createDataFrame(
        [row],
        "event_id string, ticker string, action string, downside_risk_score double, decision string, decision_reason string,"
        "model_version string, bundle_id string, features_used array<string>, feature_as_of date",
    )
    assert errors(contracts.check_decision(df)) == [["downside_risk_score", "decision", "feature_as_of"]]


@pytest.mark.parametrize(
    "value, reason",
    [
        (json.dumps({"payload_version": "1", **{k: v for k, v in GOOD.items() if v}}).encode(), None),
        (json.dumps({"payload_version": "1", **GOOD}).encode(), None),
        (json.dumps({"payload_version": "2", **GOOD}).encode(), "unknown payload_version"),
        (json.dumps({"payload_version": 1, **GOOD}).encode(), "unknown payload_version"),
        (json.dumps(GOOD).encode(), "unknown payload_version"),
        (b"not json", "invalid JSON payload"), (b"\xff\xfe{}", "invalid JSON payload"), (b"{'a': 1}", "invalid JSON payload"),
        (b"[1]", "payload must be a JSON object"), (b"null", "payload must be a JSON object"), (b"5", "payload must be a JSON object"),
        (json.dumps({"payload_version": "1", **GOOD, "ticker": "TSLA"}).encode(), "invalid: ticker"),
        (json.dumps({"payload_version": "1", **GOOD, "event_id": 7}).encode(), "invalid: event_id"),
        (json.dumps({"payload_version": "1", **GOOD, "url": 7}).encode(), "invalid: url"),
        (json.dumps({"payload_version": "1", **GOOD}).encode() + b"{}", "invalid JSON payload"),
    ],
)
def test_decode_payload(spark, value, reason):
    df = spark.createDataFrame([(bytearray(value),)], "value binary")
    assert decode_payload(df).first().reason == reason


def test_events_file(spark, folder):
    def load(lines, strict=True):
        path = f"{folder}/{abs(hash(tuple(lines)))}.jsonl"
        open(path, "w").write("\n".join(lines))
        return files.scan_events_jsonl(spark, path, strict=strict)

    good = json.dumps({k: v for k, v in GOOD.items() if v})
    assert load([good, "", "  "]).count() == 1
    for bad in ("{", json.dumps(GOOD | {"ticker": "TSLA"}), json.dumps(GOOD | {"headline": " "})):
        with pytest.raises(contracts.ContractError):
            load([good, bad])
    with pytest.raises(files.SourceError):
        load(["", " "])


def test_hit_and_feature_maps(spark, folder):
    hit = {"document_id": "d", "text": "t", "ticker": "A", "available_at": "2024-01-01T00:00:00Z", "source": "fixture", "score": 0.5}
    open(f"{folder}/hits.json", "w").write(json.dumps({"e1": [hit, hit | {"document_id": "d2"}], "e2": []}, indent=1))
    hits = files.scan_hits(spark, f"{folder}/hits.json", layout="map")
    assert sorted((r.event_id, r.document_id) for r in hits.collect()) == [("e1", "d"), ("e1", "d2")]
    row = {n: 0.5 for n in files.FEATURE_NAMES} | {"feature_as_of": "2024-01-01"}
    open(f"{folder}/features.json", "w").write(json.dumps({"e1": row}))
    assert files.scan_feature_rows(spark, f"{folder}/features.json", layout="map").count() == 1
    del row["volatility_20d"]
    open(f"{folder}/short.json", "w").write(json.dumps({"e1": row}))
    with pytest.raises(contracts.ContractError):
        files.scan_feature_rows(spark, f"{folder}/short.json", layout="map")


def test_training_table_guard(spark):
    cols = "published_at timestamp_ntz, label_high_risk int, " + ", ".join(f"{n} double" for n in files.FEATURE_NAMES)
    row = (None, 1, 0.1, 0.2, 0.3, 0.4, 0.5)
    files.check_training_table(spark.createDataFrame([row], cols))
    for bad in ([row[:2] + (float("nan"),) + row[3:]], [(None, None) + row[2:]], []):
        with pytest.raises(files.SourceError):
            files.check_training_table(spark.createDataFrame(bad, cols))
    with pytest.raises(files.SourceError):
        files.check_training_table(spark.createDataFrame([row], cols).drop("spy_return_5d"))


def test_expectation_loading(spark, folder):
    def load(*cases):
        path = f"{folder}/{abs(hash(str(cases)))}.jsonl"
        open(path, "w").write("\n".join(c if isinstance(c, str) else json.dumps(c) for c in cases) + "\n\n")
        return expectations.scan_expectations(spark, path)

    ok = {"case_id": "c", "check": "gate", "action": "BUY", "force_score": 0.5, "expect": "reject"}
    assert load(ok).count() == 1
    for bad in (
        [ok | {"check": "other"}], [{k: v for k, v in ok.items() if k != "force_score"}], [ok, ok],
        [ok | {"expect": ""}], ["{"], ["[1]"], [],
    ):
        with pytest.raises(files.SourceError):
            load(*bad)


def test_strict_errors_name_the_reason(spark):
    df = contracts.with_errors(spark.range(3), {"small": F.col("id") < 2})
    with pytest.raises(contracts.ContractError, match="1 invalid number row"):
        contracts.require_valid(df, "number")
