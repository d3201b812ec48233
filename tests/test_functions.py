import hashlib
import re
import uuid
from datetime import date, datetime, timezone
from email.utils import parsedate_to_datetime

import pytest
from pyspark.sql import functions as F

from hindcast.functions import clocks, ids, risk, text, wire
from hindcast.functions.risk import Policy


def column(spark, values, fn, dtype="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_normalize_headline_like_python(spark):
    values = ["  Apple\t Rises\n\nAgain ", "ÀÉ x y", "a\x1cb", "plain"]
    expected = [" ".join(v.strip().lower().split()) for v in values]
    assert column(spark, values, text.normalize_headline) == expected
    assert column(spark, ["", " \t\n", " ", None, " x"], text.is_blank) == [True, True, True, True, False]
    assert column(spark, ["\n a b \t"], text.strip) == ["a b"]


def test_ids_equal_the_library(spark):
    names = ["x", "été", "a:b:c", ""]
    assert column(spark, names, ids.uuid5) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    digest = hashlib.sha256(b"apple rises").hexdigest()[:16]
    expected = str(uuid.uuid5(uuid.NAMESPACE_URL, f"p:train:AAPL:2020-01-02:{digest}"))
    got = column(
        spark, ["apple rises"], lambda c: ids.train_event_id(F.lit("AAPL"), F.lit("2020-01-02").cast("date"), c, "p")
    )
    assert got == [expected]
    assert column(spark, ["e1"], lambda c: ids.event_point_id(c, "p")) == [str(uuid.uuid5(uuid.NAMESPACE_URL, "p:event:e1"))]


def test_rss_item_key_order(spark):
    key = lambda g, l: column(spark, ["t"], lambda c: ids.rss_item_key(F.lit(g), F.lit(l), c, F.lit("z")))[0]
    assert key("g", "l") == "g"
    assert key("", "l") == "l"
    assert key(None, None) == hashlib.sha256(b"t|z").hexdigest()[:32]


def test_parse_rss_dates_like_python(spark):
    values = [
        "Mon, 14 Jul 2026 15:30:00 GMT", "14 Jul 2026 15:30:00 -0400", "Tue, 1 Dec 2020 09:05 +0130",
        "Tue, 01 Dec 2020 09:05:06", "Wed, 02 Jul 2003 10:00:00 EST", "Wed, 02 Jul 2003 10:00:00 EDT",
        "2 jul 03 10:00:00 PST", "02 July 2003 10:00:00 Z", "Sat, 02-Jul-2003 10:00:00 GMT",
    ]
    def python(v):
        d = parsedate_to_datetime(v)
        return (d if d.tzinfo else d.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).replace(tzinfo=None)

    assert column(spark, values, clocks.parse_rss_date) == [python(v) for v in values]
    assert column(spark, ["soon", "", None, "32 Jul 2003 10:00:00 GMT"], clocks.parse_rss_date) == [None] * 4


def test_published_at_rules(spark):
    values = [
        "2020-06-05 10:30:54-04:00", "2020-06-05 17:00:00", "2020-01-05 17:00", "2020-06-05", "2020-06-05T20:00:00Z",
        "6/5/2020 17:00", "6/5/2020", "n/a", None, "2020-06-05 10:30:54-0400",
    ]
    assert column(spark, values, clocks.parse_published_at) == [
        datetime(2020, 6, 5, 14, 30, 54), datetime(2020, 6, 5, 21), datetime(2020, 1, 5, 22), None,
        datetime(2020, 6, 5, 20), datetime(2020, 6, 5, 21), None, None, None, datetime(2020, 6, 5, 14, 30, 54),
    ]
    # Date-only text opens at 09:30 New York: 13:30 UTC in summer, 14:30 in winter.
    stamped = column(spark, ["2020-06-05", "2020-01-06", "1/6/2020"], clocks.published_at)
    assert stamped == [datetime(2020, 6, 5, 13, 30), datetime(2020, 1, 6, 14, 30), datetime(2020, 1, 6, 14, 30)]


def test_calendar_date_is_as_written(spark):
    values = ["2020-06-05 23:30:00-04:00", "2020-06-05", "6/5/2020", "Jun 5, 2020", "5 Jun 2020", "bad", "2020-13-01"]
    day = date(2020, 6, 5)
    assert column(spark, values, clocks.parse_calendar_date) == [day] * 5 + [None, None]
    # The coverage rule converts to New York first; a naive value is UTC there.
    assert column(spark, ["2020-06-05 23:30:00-04:00", "2020-06-05 02:00:00"], clocks.exchange_day) == [day, date(2020, 6, 4)]


def test_iso_utc_like_python(spark):
    values = [datetime(2024, 3, 12, 14, 30), datetime(2024, 3, 12, 14, 30, 0, 120000)]
    expected = [v.replace(tzinfo=timezone.utc).isoformat() for v in values]
    assert column(spark, values, clocks.iso_utc, "timestamp_ntz") == expected


def test_label_boundary_and_returns(spark):
    assert column(spark, [-0.03, -0.030001, 0.1, None], risk.label_high_risk, "double") == [0, 1, 0, None]
    assert column(spark, [2.0, 0.0, None], lambda c: risk.simple_return(c, F.lit(3.0)), "double") == [0.5, None, None]
    nan, inf = float("nan"), float("inf")
    assert column(spark, [1.0, nan, inf, -inf], risk.finite, "double") == [1.0, None, None, None]
    assert column(spark, [-0.1, 0.4, 1.7], risk.clamp_score, "double") == [0.0, 0.4, 1.0]


@pytest.mark.parametrize(
    "action, score, vol, veto, expected",
    [
        ("HOLD", 0.99, 9.0, 0.05, "approve"), ("PASS", 0.99, 9.0, 0.05, "approve"),
        ("BUY", 0.45, 0.0, None, "reject"), ("BUY", 0.449999, 0.0, None, "approve"),
        ("SELL", 0.1, 0.0, 0.05, None), ("SELL", 0.9, 9.0, 0.05, None), (None, 0.1, 0.0, None, None), ("BUY", None, 0.0, None, None),
        ("BUY", 0.1, None, 0.05, None), ("BUY", 0.1, None, None, "approve"), ("BUY", 0.9, None, 0.05, "reject"),
        ("BUY", 0.1, 0.05, 0.05, "reject"), ("BUY", 0.1, 0.049, 0.05, "approve"), ("BUY", 0.1, 9.0, None, "approve"),
    ],
)
def test_policy_table(spark, action, score, vol, veto, expected):
    policy = Policy(0.45, veto is not None, veto)
    verdict = risk.gate_policy(F.lit(action), F.lit(score).cast("double"), F.lit(vol).cast("double"), policy)
    assert spark.range(1).select(verdict["decision"]).first()[0] == expected


def test_policy_reason_and_veto_guard(spark):
    verdict = risk.gate_policy(F.lit("BUY"), F.lit(0.5), F.lit(0.1), Policy(0.45))
    assert spark.range(1).select(verdict["reason"]).first()[0] == (
        "BUY rejected: downside_risk_score=0.5000 >= score_threshold=0.4500"
    )
    with pytest.raises(ValueError):
        Policy(0.45, vol_veto_enabled=True)


def test_repair_route_and_fences(spark):
    assert column(spark, [0, 1, 2], lambda c: wire.repair_route(F.lit(False), c), "int") == ["retry", "fail", "fail"]
    assert column(spark, [0], lambda c: wire.repair_route(F.lit(True), c), "int") == ["ok"]
    assert column(spark, ['```json\n{"a":1}\n```', ' {"a":1} ', '```{"a":1}```'], wire.strip_fences) == [
        '{"a":1}', '{"a":1}', '{"a":1}',
    ]


def test_lexicon_sentiment(spark):
    score = lambda c: text.lexicon_sentiment(c, ["gain"], ["loss"])
    assert column(spark, ["Gain, gain and LOSS", "nothing", None], score) == [pytest.approx(1 / 3), 0.0, 0.0]


def test_fixed_decimals_round_the_exact_value(spark):
    """As Python prints them; prices whose share of 2**19 ends in a five at the fifth decimal are ties or nearly so."""
    values = [round(163.84 * i, 2) / 524288 for i in range(1, 3200)] + [0.0, 1.0, 0.99995, 0.99996, 14.0, 123.00005, -0.00375, 0.00005, 2.0**40 + 0.5]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for r in df.select("x", text.fixed(F.col("x"), 4).alias("four"), text.fixed(F.col("x"), 3).alias("three")).collect():
        assert (r.four, r.three) == (f"{r.x:.4f}", f"{r.x:.3f}")


def test_policy_reasons_stay_short_enough_to_be_compiled(spark, folder):
    """The JVM never compiles a method of more than 8000 bytes; a stage that holds the reasons is such a method."""
    rows = spark.createDataFrame([("BUY", 0.5, 14.0), ("BUY", 0.1, 13.99995), ("HOLD", 0.1, None), ("BUY", 0.00375, 0.00375)], "a string, s double, v double")
    rows.write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows").withColumn("got", risk.gate_policy(F.col("a"), F.col("s"), F.col("v"), Policy(0.45, True, 14.0)))
    code = rows._sc._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenString(rows._jdf.queryExecution().executedPlan())
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000
    assert {r.got.reason for r in rows.collect()} == {
        "BUY rejected: downside_risk_score=0.5000 >= score_threshold=0.4500", "HOLD always approve under policy_version=v1",
        "BUY approved: downside_risk_score=0.1000 < score_threshold=0.4500", "BUY approved: downside_risk_score=0.0037 < score_threshold=0.4500",
    }


def test_one_object_and_nothing_behind_it(spark):
    told = {
        '{"a":1}': True, ' {"a":1}\n': True, '{"a":"}"}': True, '{"a":{"b":1}}': True, '{"a":1}}': False, '{"a":1} {"a":2}': False, '{"a":1},{"a":2}': False,
        '{"a":1} x': False, '{}': True, '{': False, '}': False, '': False, '[1]': False, '{"a":"é}"}': True, '{"a":"é"}': True, '{"a":1}{': False, '{a}': False,
    }
    df = spark.createDataFrame([(t,) for t in told], "t string").withColumn("f", wire.json_fields(F.col("t"), ["a"]))
    assert {r[0]: r[1] for r in df.select("t", wire.is_json_object(F.col("t"), F.col("f"))).collect()} == told
    fenced = ["{x} ", "{a}```", "```{a}", "{```}", "{\n}", None, "}{", " {a}"]
    assert column(spark, fenced, wire.strip_fences) == ["{x}", "{a}```", "{a}", "{```}", "{\n}", None, "}{", "{a}"]
