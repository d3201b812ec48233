from datetime import date

import pytest
from pyspark.sql import functions as F

from hindcast.fixed_values import UNIVERSE
from hindcast.operators import cleaning
from hindcast.operators.sampling import stratified_sample
from hindcast.operators.scale import first_by_hash
from hindcast.plans.training_events import BuildOptions, identified
from hindcast.sources import files

ROWS = [
    (0, "2020-06-05", "AAPL", "Apple  rises"),
    (1, "2020-06-05 10:00:00", " aapl", "apple rises "),
    (2, "2020-06-05", "FB", "Face up"),
    (3, "2020-06-05", "GOOG", "Search up"),
    (4, "2020-06-05", "TSLA", "Car up"),
    (5, None, "AAPL", "x"),
    (6, "2020-06-05", "AAPL", "  "),
    (7, "n/a", "AAPL", "bad date"),
    (8, "2020-06-06", "AAPL", "Apple rises"),
]


@pytest.fixture
def archive(spark):
    return spark.createDataFrame(ROWS, "row_order long, date string, stock string, headline string")


def test_funnel_with_and_without_aliases(archive):
    on = cleaning.ingest_funnel(archive).first()
    assert (on.rows_raw, on.rows_universe, on.rows_after_dedup, on.oou_dropped, on.missing_fields_dropped, on.alias_rows) == (
        9, 6, 4, 1, 3, 2,
    )
    off = cleaning.ingest_funnel(archive, apply=False).first()
    assert (off.rows_universe, off.rows_after_dedup, off.oou_dropped, off.alias_rule_version) == (4, 2, 3, "off")
    assert on.alias_rule_version == "fb_meta_v1+goog_googl_v1"


def test_first_duplicate_wins_whatever_the_partitions(archive):
    for df in (archive, archive.repartition(5), archive.orderBy(F.desc("row_order")).coalesce(1)):
        kept = cleaning.clean_archive(df)
        assert sorted(r.row_order for r in kept.collect()) == [0, 2, 3, 8]
    assert {r.ticker for r in cleaning.clean_archive(archive).collect()} == {"AAPL", "META", "GOOGL"}


def test_raw_symbol_stays_in_the_row_hash(archive):
    import hashlib

    rows = identified(cleaning.clean_archive(archive), BuildOptions("d")).filter("row_order = 2").first()
    assert rows.source_row_hash == hashlib.sha256(b"2020-06-05|FB|Face up").hexdigest()
    assert (rows.ticker, rows.calendar_date) == ("META", date(2020, 6, 5))


def test_absent_and_counts(archive):
    named = cleaning.apply_aliases(cleaning.filter_missing(archive))
    absent = {r.ticker for r in cleaning.absent_tickers(named).collect()}
    assert absent == set(UNIVERSE) - {"AAPL", "META", "GOOGL"}
    counts = {r.alias_rule: r.rows for r in cleaning.alias_counts(named).collect()}
    assert counts == {"fb_meta_v1": 1, "goog_googl_v1": 1}


def test_forbidden_symbols(spark):
    ask = lambda *t: spark.createDataFrame([(x,) for x in t], "ticker string")
    assert cleaning.forbid_price_symbols(ask("META", "AAPL")).count() == 2
    for symbol in ("FB", " goog"):
        with pytest.raises(ValueError, match="forbidden"):
            cleaning.forbid_price_symbols(ask("META", symbol))


def test_duplicate_ids_fail(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "event_id string")
    with pytest.raises(ValueError, match="'a'"):
        cleaning.unique_event_ids(df)
    cleaning.unique_event_ids(df.distinct())


def test_header_aliases(spark, folder):
    for header in ("Date,STOCK,Headline", " date ,stock,title", "date,Stock,Article Title"):
        path = f"{folder}/{abs(hash(header))}.csv"
        open(path, "w").write(header + '\n2020-01-01,AAPL,"two\nlines, ""quoted"""\n')
        row = files.scan_news_csv(spark, path).first()
        assert (row.date, row.stock, row.headline) == ("2020-01-01", "AAPL", 'two\nlines, "quoted"')
    open(f"{folder}/bad.csv", "w").write("date,headline\n1,2\n")
    with pytest.raises(files.SourceError, match="stock"):
        files.scan_news_csv(spark, f"{folder}/bad.csv")


def test_csv_order_is_file_order(spark, folder):
    lines = [f"2020-01-{1 + i % 28:02d},AAPL,h{i}" for i in range(500)]
    open(f"{folder}/a.csv", "w").write("date,stock,headline\n" + "\n".join(lines))
    rows = files.scan_news_csv(spark, f"{folder}/a.csv").orderBy("row_order").collect()
    assert [r.headline for r in rows] == [f"h{i}" for i in range(500)]


@pytest.fixture
def many(spark):
    # One ticker holds half of the rows, one has a single row.
    ticker = "CASE WHEN id % 2 = 0 THEN 'HOT' WHEN id = 1 THEN 'ONE' WHEN id % 3 = 0 THEN 'B' ELSE 'C' END"
    return spark.range(400).selectExpr("cast(id AS string) AS event_id", f"{ticker} AS ticker")


def brute_sample(rows, n_strata, target, seed):
    import hashlib

    h = lambda e: hashlib.sha256(f"{seed}{e}".encode()).hexdigest()
    per = max(1, target // n_strata)
    turns = []
    for t in {r.ticker for r in rows}:
        mine = sorted((h(r.event_id), r.event_id) for r in rows if r.ticker == t)
        turns += [(i >= per, key, e) for i, (key, e) in enumerate(mine)]
    return {e for _, _, e in sorted(turns)[:target]}


@pytest.mark.parametrize("target", [3, 100, 399, 1000])
def test_sample_equals_brute_force(many, target):
    expected = brute_sample(many.collect(), 4, target, 42)
    for df in (many, many.repartition(7)):
        got = [r.event_id for r in stratified_sample(df, 4, target).collect()]
        assert len(got) == len(set(got)) == min(target, 400)
        assert set(got) == expected


def test_first_by_hash_positions(many):
    hashed = many.withColumn("h", F.sha2("event_id", 256))
    rows = first_by_hash(hashed, ["ticker"], "h", "event_id", 50, "place").collect()
    for t in ("HOT", "B", "C", "ONE"):
        mine = sorted((r.h, r.place) for r in rows if r.ticker == t)
        assert [p for _, p in mine] == list(range(1, len(mine) + 1))
    assert sum(r.ticker == "HOT" for r in rows) == 50
