"""Domain-shaped views over the test tables.

The tables carry no prices, headlines or feeds, so each domain table is an
expression over one of them that keeps all of its rows. Edge cases (missing
fields, aliases, bad dates, poison payloads ...) are spread over the rows by
remainder of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions.risk import Policy
from hindcast.operators.sessions import scan_sessions
from hindcast.plans.training_events import BuildOptions
from hindcast.session import configure, stage

UNIVERSE = ("A", "B", "N", "R")
ALIASES = (("ax_a_v1", "AX", "A"), ("nx_n_v1", "NX", "N"))
BENCHMARK = "B"
PREFIX = "hindcast"
DATASET_ID = "test-documents"
BUILDER_VERSION = "1"
SAMPLE_TARGET = 200
POLICY = Policy(score_threshold=0.45, vol_veto_enabled=True, vol_veto_threshold=14.0)
MODEL_VERSION = "view-1"
BUNDLE_ID = "view-bundle"


def options(**changes) -> BuildOptions:
    base = dict(
        dataset_id=DATASET_ID, builder_version=BUILDER_VERSION, universe=UNIVERSE, aliases=ALIASES,
        benchmark=BENCHMARK, target=SAMPLE_TARGET, prefix=PREFIX,
    )
    return BuildOptions(**(base | changes))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def news_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as news events."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("event_id"),
        F.expr("concat('Order ', o_orderpriority, ' of customer ', o_custkey)").alias("headline"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END").alias("ticker"),
        F.lit("csv").alias("source"),
        F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 AS int), 0, 0)").alias("published_at"),
    )


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as daily closes per return flag, and over all rows as benchmark.

    One scan: the benchmark is the sum of the per-flag sums. Staged because
    sessions, windows and joins all read it.
    """
    daily = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("ticker"), F.col("l_shipdate").cast("date").alias("session_date"))
        .agg(F.sum(F.col("l_extendedprice") / F.col("l_quantity")).alias("s"), F.count(F.lit(1)).alias("n"))
    )
    daily = stage(daily, "daily")
    benchmark = daily.groupBy(F.lit(BENCHMARK).alias("ticker"), "session_date").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n")
    )
    both = daily.unionByName(benchmark.select(daily.columns))
    return both.select("ticker", "session_date", (F.col("s") / F.col("n")).alias("close"))


def sessions(closes_: DataFrame) -> DataFrame:
    """Weekdays that have a close, closing at 16:00."""
    weekdays = closes_.filter(F.col("ticker") == BENCHMARK).filter(F.weekday("session_date") < 5)
    return stage(scan_sessions(weekdays), "sessions")


def market(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = closes(spark, sf_dir)
    return c, sessions(c)


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a headline archive; the whole text is the headline."""
    day = "date_add(DATE'1996-01-02', cast(n_chars % 1700 AS int))"
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS row_order",
        f"""CASE WHEN doc_id % 43 = 0 THEN NULL
                 WHEN doc_id % 12 = 5 THEN 'n/a'
                 WHEN doc_id % 6 = 0 THEN cast({day} AS string)
                 WHEN doc_id % 6 = 1 THEN concat({day}, ' 10:15:00')
                 WHEN doc_id % 6 = 2 THEN concat({day}, ' 16:45:30-04:00')
                 WHEN doc_id % 6 = 3 THEN concat({day}, 'T20:00:00Z')
                 WHEN doc_id % 6 = 4 THEN date_format({day}, 'M/d/yyyy')
                 ELSE concat({day}, ' 00:00:00') END AS date""",
        """CASE source WHEN 'src0' THEN 'AX' WHEN 'src1' THEN 'NX' WHEN 'src4' THEN ' a ' WHEN 'src16' THEN 'n '
                WHEN 'src14' THEN NULL WHEN 'src15' THEN 'ZZ' WHEN 'src18' THEN 'QX'
                WHEN 'src7' THEN 'N' WHEN 'src8' THEN 'N' WHEN 'src9' THEN 'N' WHEN 'src10' THEN 'N'
                WHEN 'src11' THEN 'R' WHEN 'src12' THEN 'R' WHEN 'src13' THEN 'R' WHEN 'src17' THEN 'R'
                ELSE 'A' END AS stock""",
        "CASE WHEN doc_id % 37 = 0 THEN NULL WHEN doc_id % 41 = 0 THEN '   ' ELSE text END AS headline",
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as context items of its order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("event_id"),
        F.expr(
            "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) AS bigint))"
        ).alias("document_id"),
        F.expr("concat(l_returnflag, ' lot of part ', l_partkey)").alias("text"),
        F.col("l_returnflag").alias("ticker"),
        F.expr("l_shipdate + make_dt_interval(0, l_linenumber, 0, 0)").alias("available_at"),
        F.lit("fixture").alias("source"),
        F.col("l_discount").alias("score"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as points of a ticker, one per minute."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("point_id"),
        F.col("label").cast("string").alias("ticker"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(vec_id AS int), 0)").alias("available_at"),
        F.concat(F.lit("doc-"), F.col("vec_id").cast("string")).alias("document_id"),
        F.concat(F.lit("vector of "), F.col("label").cast("string")).alias("text"),
        F.lit("qdrant").alias("source"),
        F.col("embedding").alias("vector"),
    )


def vector_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vectors as events, up to four hours after their own point."""
    return points(spark, sf_dir).select(
        F.col("point_id").alias("event_id"),
        "point_id",
        "ticker",
        F.expr("available_at + make_dt_interval(0, cast(point_id % 5 AS int), 0, 0)").alias("published_at"),
        "vector",
    )


def raw_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as raw string columns of the news event contract."""
    clock = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        "CASE WHEN event_id % 17 = 0 THEN '' ELSE cast(event_id AS string) END AS event_id",
        """CASE WHEN event_id % 13 = 4 THEN NULL WHEN event_id % 13 = 6 THEN '  '
                ELSE concat('  user ', user_id, ' ', event_type, ' ', props, ' ') END AS headline""",
        """CASE WHEN event_id % 13 = 3 THEN 'TSLA' WHEN event_type = 'click' THEN 'AAPL'
                WHEN event_type = 'view' THEN 'msft' WHEN event_type = 'purchase' THEN ' nvda '
                WHEN event_type = 'signup' THEN 'QQQ' ELSE 'SPY' END AS ticker""",
        "CASE WHEN event_id % 13 = 7 THEN 'blog' WHEN event_id % 2 = 0 THEN 'rss' ELSE 'csv' END AS source",
        f"""CASE WHEN event_id % 13 = 5 THEN {clock} WHEN event_id % 13 = 11 THEN 'soonZ'
                 WHEN event_id % 3 = 0 THEN concat({clock}, 'Z') ELSE concat({clock}, '+00:00') END AS published_at""",
        "CASE WHEN event_id % 13 = 9 THEN concat('https://example.org/', event_id) END AS url",
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as stream records, poison included."""
    good = "to_json(struct('1' AS payload_version, event_id, headline, ticker, source, published_at, url))"
    return raw_news(spark, sf_dir).selectExpr(
        "id",
        "cast(event_id AS binary) AS key",
        f"""cast(CASE WHEN id % 13 = 0 THEN replace({good}, '"payload_version":"1"', '"payload_version":"2"')
                 WHEN id % 13 = 1 THEN concat('oops ', id)
                 WHEN id % 13 = 2 THEN '[1]'
                 WHEN id % 13 = 8 THEN replace({good}, '"event_id":"', '"event_id":5,"x":"')
                 ELSE {good} END AS binary) AS value""",
        "'news.raw' AS topic",
        "cast(id % 4 AS int) AS partition",
        "id AS offset",
    )


def proposal_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as typed proposals."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        "CASE WHEN event_id % 19 = 0 THEN '' ELSE cast(event_id AS string) END AS event_id",
        """CASE event_type WHEN 'click' THEN 'BUY' WHEN 'signup' THEN 'BUY' WHEN 'view' THEN 'HOLD'
                WHEN 'purchase' THEN 'PASS' ELSE 'SELL' END AS action""",
        "value / 300 AS confidence",
        """CASE WHEN event_id % 12 = 4 THEN '' WHEN event_id % 12 = 7 THEN repeat('r', 2001)
                WHEN event_id % 12 = 9 THEN repeat('é', 2000)
                ELSE concat('seen by user ', user_id) END AS rationale""",
        "concat('T', user_id % 3) AS ticker",
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as answer text keyed by the event it is about."""
    doc = "to_json(struct(action, confidence, rationale, event_id, ticker))"
    return proposal_fields(spark, sf_dir).selectExpr(
        "id",
        f"""CASE WHEN id % 12 = 0 THEN concat('```json\\n', {doc}, '\\n```')
                 WHEN id % 12 = 1 THEN to_json(struct(action, cast(confidence AS string) AS confidence, rationale, event_id, ticker))
                 WHEN id % 12 = 2 THEN to_json(struct(action, true AS confidence, rationale, event_id, ticker))
                 WHEN id % 12 = 3 THEN concat('  ```', {doc}, '```  ')
                 WHEN id % 12 = 5 THEN 'I would hold.'
                 WHEN id % 12 = 6 THEN to_json(struct(action, 1 AS confidence, rationale, event_id, ticker))
                 WHEN id % 12 = 8 THEN '"BUY"'
                 ELSE {doc} END AS response""",
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels with a score from the document's length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 1000) / 1000).alias("score"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id", "score", F.col("quality").alias("label")
    )


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as scored binary labels with a clock."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS event_id",
        "o_orderdate AS published_at",
        "o_totalprice / 500000 AS score",
        "cast(o_orderstatus = 'F' OR o_totalprice > 400000 AS int) AS label",
    )


def feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as feed documents of at most 16 items each."""
    items = news_events(spark, sf_dir).selectExpr(
        "cast(event_id AS bigint) AS k", "ticker", "headline", "published_at"
    ).selectExpr(
        "k",
        "CASE WHEN (k DIV 16) % 29 = 3 THEN 'ZZ' ELSE ticker END AS ticker",
        "k DIV 16 AS doc",
        """concat('<item>',
             CASE WHEN k % 9 = 0 THEN '' ELSE concat('<title> ', headline, ' </title>') END,
             CASE WHEN k % 7 = 2 THEN '' ELSE concat('<link>https://example.org/', k, '</link>') END,
             CASE WHEN k % 7 = 2 OR k % 5 = 1 THEN '' ELSE concat('<guid isPermaLink="false">g-', k, '</guid>') END,
             '<pubDate>',
             CASE WHEN k % 11 = 0 THEN 'yesterday'
                  WHEN k % 2 = 0 THEN date_format(published_at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
                  ELSE date_format(published_at, "d MMM yyyy HH:mm '-0430'") END,
             '</pubDate></item>') AS item""",
    )
    # Item order is the key; a document has at most 16 items.
    docs = items.groupBy("ticker", "doc").agg(F.array_sort(F.collect_list(F.struct("k", "item"))).alias("items"))
    return docs.selectExpr(
        "ticker",
        "concat(ticker, '/', doc) AS document",
        """CASE WHEN doc % 31 = 5 THEN '<html><body>busy</body></html>'
                WHEN doc % 31 = 9 THEN concat('<rss><channel>', array_join(items.item, ''))
                WHEN doc % 31 = 11 THEN '<rss version="2.0"><channel></channel></rss>'
                WHEN doc % 2 = 0 THEN concat('<channel><title>c</title>', array_join(items.item, ''), '</channel>')
                ELSE concat('<?xml version="1.0"?><rss version="2.0"><channel><title>c</title>',
                            array_join(items.item, ''), '</channel></rss>') END AS xml""",
    )


def expectation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as expectation cases, one JSON line each."""
    return table(spark, sf_dir, "events").selectExpr(
        """CASE event_type
             WHEN 'view' THEN to_json(struct(concat('c-', event_id) AS case_id, 'schema' AS check,
               CASE WHEN event_id % 4 = 0 THEN 'SELL' WHEN event_id % 4 = 1 THEN 'BUY' WHEN event_id % 4 = 2 THEN 'HOLD' ELSE 'PASS' END AS action,
               value / 100 AS confidence, CASE WHEN event_id % 3 = 0 THEN 'reject' ELSE 'ok' END AS expect))
             WHEN 'click' THEN to_json(struct(concat('c-', event_id) AS case_id, 'gate' AS check,
               CASE WHEN event_id % 3 = 0 THEN 'HOLD' ELSE 'BUY' END AS action,
               CASE WHEN event_id % 5 = 0 THEN 'eq_threshold' ELSE 'just_below_threshold' END AS force_score,
               value / 1000 AS volatility_20d, event_id % 2 = 0 AS tmp_vol_veto, 'approve' AS expect))
             WHEN 'error' THEN to_json(struct(concat('c-', event_id) AS case_id, 'gate' AS check, 'BUY' AS action,
               value / 100 AS force_score, CASE WHEN event_id % 7 = 0 THEN 'same_decision' ELSE 'reject' END AS expect))
             WHEN 'signup' THEN to_json(struct(concat('c-', event_id) AS case_id, 'asof' AS check,
               '2024-03-12T14:30:00Z' AS published_at,
               array(struct('a' AS document_id, CASE WHEN event_id % 3 = 0 THEN '2024-03-12T14:30:00Z' ELSE '2024-03-12T15:30:00+01:00' END AS available_at),
                     struct('b' AS document_id, CASE WHEN event_id % 2 = 0 THEN '2024-03-13T00:00:00Z' ELSE '2024-03-11T00:00:00Z' END AS available_at)) AS hits,
               CASE WHEN event_id % 5 = 0 THEN 'kept' WHEN event_id % 5 = 1 THEN 'empty' ELSE 'future_hit_dropped' END AS expect))
             ELSE CASE WHEN event_id % 2 = 0
               THEN to_json(struct(concat('c-', event_id) AS case_id, 'identity' AS check, 'MSFT' AS llm_ticker,
                 'AAPL' AS input_ticker, 'x' AS llm_event_id, concat('e-', event_id) AS input_event_id,
                 'stamped_from_input' AS expect))
               ELSE to_json(struct(concat('c-', event_id) AS case_id, 'oou' AS check,
               CASE WHEN user_id % 2 = 0 THEN 'TSLA' ELSE ' aapl' END AS ticker, 'reject' AS expect)) END
           END AS value"""
    )
