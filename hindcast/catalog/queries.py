"""One query per operator, over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.catalog import views as v
from hindcast.fixed_values import FEATURE_NAMES, TRAINING_COLUMNS
from hindcast.functions import clocks, ids, risk, text, wire
from hindcast.functions.vectors import dot, unit
from hindcast.operators import cleaning, context, contracts, decisions, evaluation, folds, payloads, prices, retrieval, scale
from hindcast.operators import sentiment as sentiments
from hindcast.operators import sessions as calendars
from hindcast.operators import training
from hindcast.operators.sampling import stratified_sample
from hindcast.plans import training_events as build
from hindcast.plans.expectation_suite import expectation_suite, suite_counts
from hindcast.plans.feed_to_events import feed_to_events
from hindcast.plans.run_decisions import run_decisions
from hindcast.plans.train_gate import train_gate
from hindcast.session import new_path, stage
from hindcast.sinks import buckets
from hindcast.sinks import points as point_sink
from hindcast.sinks import snapshots
from hindcast.sinks import tables as sinks
from hindcast.sinks.runs import read_batches
from hindcast.sources import expectations, feeds, files, streams
from hindcast.streaming.feeds import feed_micro_batch, stream_feed_documents
from hindcast.streaming.ingest import sink_dlq, stream_ingest

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__.removeprefix("q_")] = fn
    return fn


def r6(column) -> F.Column:
    return F.round(column, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


def errors_text(df: DataFrame) -> DataFrame:
    return df.withColumn("errors", F.array_join("errors", ","))


# --- sources ---------------------------------------------------------------


@query
def q_scan_news_csv(spark, sf):
    path = new_path(spark, "archive-csv")
    raw = v.archive(spark, sf).select(F.col("date").alias(" Date"), F.col("stock").alias("STOCK"), F.col("headline").alias("Article Title"))
    raw.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = files.scan_news_csv(spark, path, empty_texts=True)
    return rows.select(text.source_row_hash(F.col("date"), F.col("stock"), F.col("headline")).alias("row_hash")).groupBy(
        "row_hash"
    ).agg(F.count(F.lit(1)).alias("rows"))


@query
def q_scan_events_jsonl(spark, sf):
    path = new_path(spark, "events-jsonl")
    lines = v.payloads(spark, sf).select(F.concat(F.col("value").cast("string"), F.when(F.col("id") % 50 == 0, "\n  ").otherwise("")))
    lines.write.text(path)
    events = files.scan_events_jsonl(spark, path, strict=False)
    return errors_text(events).groupBy("ticker", "errors").agg(
        F.count(F.lit(1)).alias("rows"), F.max("published_at").cast("timestamp_ntz").alias("last_published_at")
    )


@query
def q_scan_hits(spark, sf):
    path = new_path(spark, "hits-jsonl")
    raw = v.hits(spark, sf).withColumn("available_at", clocks.iso_utc(F.col("available_at")))
    # A packed file is read by one task, so none is large.
    raw.write.option("maxRecordsPerFile", 1_000_000).json(path, compression="lz4")
    hits = files.scan_hits(spark, path)
    return hits.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("hits"),
        F.max("available_at").cast("timestamp_ntz").alias("last_available_at"),
        F.max("score").alias("best_score"),
    )


@query
def q_scan_feature_rows(spark, sf):
    path = new_path(spark, "features")
    rows = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("event_id"),
        *[(F.col("o_totalprice") / (i + 1)).alias(n) for i, n in enumerate(FEATURE_NAMES)],
        F.col("o_orderdate").cast("date").alias("feature_as_of"),
    )
    rows.write.parquet(path)
    return files.scan_feature_rows(spark, path).select(
        "event_id", "feature_as_of", *[r6(F.col(n)).alias(n) for n in FEATURE_NAMES]
    )


@query
def q_scan_rss_xml(spark, sf):
    events = feeds.feed_events(feeds.parse_feeds(v.feed_documents(spark, sf), v.UNIVERSE, prefix=v.PREFIX), v.PREFIX)
    return events.select("event_id", "headline", "ticker", "source", "published_at", "url", "document")


@query
def q_scan_closes(spark, sf):
    rows = prices.scan_closes(v.closes(spark, sf), "1996-01-01", "1998-12-31", ["A", "N"])
    return rounded(rows, "close")


@query
def q_scan_closes_partitioned(spark, sf):
    """Closes in a folder a ticker; only the folders of tickers that the events have are read."""
    path = new_path(spark, "closes")
    prices.write_closes(v.closes(spark, sf), path)
    events = v.news_events(spark, sf).filter(F.col("ticker") != "N")
    return rounded(prices.closes_of(events, prices.read_closes(spark, path)).select("ticker", "session_date", "close"), "close")


@query
def q_scan_sessions(spark, sf):
    return v.market(spark, sf)[1]


@query
def q_scan_training_table(spark, sf):
    rows = v.table(spark, sf, "orders").selectExpr(
        "cast(o_orderkey AS string) AS event_id",
        "o_orderdate AS published_at",
        *[f"CASE WHEN o_orderkey % {i + 7} = 0 THEN double('NaN') WHEN o_orderkey % {i + 11} = 0 THEN NULL ELSE o_totalprice END AS {n}" for i, n in enumerate(FEATURE_NAMES)],
        "CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE cast(o_orderkey % 2 AS int) END AS label_high_risk",
    )
    return files.training_table_problems(rows)


@query
def q_scan_expectations(spark, sf):
    path = new_path(spark, "cases")
    v.expectation_lines(spark, sf).write.text(path)
    cases = files_cases(spark, path)
    return cases.groupBy("check", "expect").agg(F.count(F.lit(1)).alias("cases"))


def files_cases(spark, path):
    return expectations.scan_expectations(spark, path)


@query
def q_stream_news_raw(spark, sf):
    """Records of a stream read to its end, counted per partition."""
    landed, out = new_path(spark, "records"), new_path(spark, "records-out")
    v.payloads(spark, sf).select("key", "value", "topic", "partition", "offset").write.parquet(landed)
    reader = streams.stream_record_files(spark, landed, files_per_trigger=4)
    run = reader.writeStream.format("parquet").option("checkpointLocation", new_path(spark, "ck")).option("path", out)
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("topic", "partition").agg(
        F.count(F.lit(1)).alias("records"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset")
    )


# --- sinks -----------------------------------------------------------------


def training_view(spark, sf):
    """Training table of all order events (no sampling)."""
    closes, sessions = v.market(spark, sf)
    events = v.news_events(spark, sf).withColumns(
        {
            "source_dataset_id": F.lit("orders"),
            "source_row_hash": F.sha2(F.col("event_id"), 256),
            "builder_version": F.lit("1"),
        }
    )
    complete, _ = prices.complete_rows(build.featured_events(events, closes, sessions, v.options()))
    return files.select_training_columns(sentiments.score_sentiment(complete))


FEATURE_OUT = ("finbert_sentiment", "volatility_20d", "return_5d_prior", "return_20d_prior", "spy_return_5d", "fwd_return_5d")


@query
def q_sink_training_parquet(spark, sf):
    path = sinks.sink_training_parquet(training_view(spark, sf), new_path(spark, "training_events"))
    return rounded(spark.read.parquet(path), *FEATURE_OUT)


@query
def q_sink_news_raw(spark, sf):
    path = new_path(spark, "news-raw")
    sinks.sink_news_raw(v.news_events(spark, sf), path, "parquet")
    return spark.read.parquet(path).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic")


@query
def q_sink_dlq(spark, sf):
    path = new_path(spark, "dlq")
    decoded = payloads.decode_payload(v.payloads(spark, sf))
    sink_dlq(decoded.filter(F.col("reason").isNotNull()), path, 0)
    return read_batches(spark, path).select(
        F.col("key").cast("string").alias("key"), F.sha2("value", 256).alias("value_hash"), "reason", "topic", "partition", "offset"
    )


@query
def q_upsert_points(spark, sf):
    """Two batches with overlapping ids, the second replayed once."""
    path = new_path(spark, "points")
    rows = v.news_events(spark, sf).withColumns({"partition": F.lit(0), "offset": F.col("event_id").cast("long")})
    moved = rows.filter(F.col("ticker") == "A").withColumns(
        {"headline": F.concat(F.lit("Again: "), "headline"), "published_at": F.expr("published_at + INTERVAL 1 DAY")}
    )
    for batch, df in ((0, rows), (1, moved), (1, moved)):
        point_sink.upsert_points(point_sink.points_from_events(df, v.PREFIX), path, batch)
    return point_sink.read_points(spark, path).select("point_id", "document_id", "text", "ticker", "available_at", "source")


@query
def q_upsert_points_bucketed(spark, sf):
    """The same batches in key buckets, merged while they come in; the second is replayed after a merge."""
    path = new_path(spark, "points")
    rows = v.news_events(spark, sf).withColumns({"partition": F.lit(0), "offset": F.col("event_id").cast("long")})
    again = rows.filter(F.col("ticker") == "A")
    moved = again.withColumns({"headline": F.concat(F.lit("Again: "), "headline"), "published_at": F.expr("published_at + INTERVAL 1 DAY")})
    for batch, df in ((0, rows), (1, again), (2, again), (3, moved), (3, moved)):
        buckets.upsert_bucketed(point_sink.points_from_events(df, v.PREFIX), path, batch, buckets=8, slots=4)
        buckets.compact_bucketed(spark, path, fan_in=2)
    return buckets.read_bucketed(spark, path).select("point_id", "document_id", "text", "ticker", "available_at", "source")


@query
def q_sink_run_records(spark, sf):
    path = new_path(spark, "runs")
    sinks.sink_run_records(decisions.build_envelope(decision_rows(spark, sf)), path)
    runs = spark.read.json(path)
    return runs.groupBy("status", "ticker", F.col("decision.decision").alias("decision"), F.col("error.code").alias("code")).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("retrieval_hit_count").alias("hits"), F.count_distinct("run_id").alias("run_ids")
    )


# --- projections, filters, contracts ---------------------------------------


@query
def q_check_news_event(spark, sf):
    checked = errors_text(contracts.check_news_event(v.raw_news(spark, sf)))
    return checked.select("id", "ticker", "headline", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "errors")


@query
def q_check_retrieval_hit(spark, sf):
    raw = v.hits(spark, sf).select(
        "document_id",
        F.expr("CASE WHEN score = 0.01 THEN '' ELSE text END AS text"),
        "ticker",
        F.when(F.col("score") == 0.02, F.date_format("available_at", "yyyy-MM-dd HH:mm:ss")).otherwise(clocks.iso_utc(F.col("available_at"))).alias("available_at"),
        F.expr("CASE WHEN ticker = 'R' THEN 'web' ELSE source END AS source"),
        F.expr("CASE WHEN score = 0.03 THEN NULL ELSE score END AS score"),
    )
    return errors_text(contracts.check_retrieval_hit(raw)).groupBy("errors").agg(
        F.count(F.lit(1)).alias("rows"), r6(F.sum("score")).alias("score_sum"), F.max("available_at").cast("timestamp_ntz").alias("last_available_at")
    )


@query
def q_check_proposal(spark, sf):
    return errors_text(contracts.check_proposal(v.proposal_fields(spark, sf))).select("id", "action", "errors")


@query
def q_check_decision(spark, sf):
    rows = v.table(spark, sf, "events").selectExpr(
        "event_id AS id",
        "CASE WHEN event_id % 9 = 0 THEN NULL ELSE cast(event_id AS string) END AS event_id",
        "event_type AS ticker",
        "CASE WHEN user_id % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS action",
        "CASE WHEN event_id % 8 = 1 THEN double('NaN') ELSE value / 100 END AS downside_risk_score",
        "CASE WHEN user_id % 5 = 0 THEN 'maybe' ELSE 'reject' END AS decision",
        "props AS decision_reason",
        "'m' AS model_version",
        "'b' AS bundle_id",
        "array(event_type) AS features_used",
        "CASE WHEN event_id % 10 = 3 THEN NULL ELSE cast(ts AS date) END AS feature_as_of",
    )
    return errors_text(contracts.check_decision(rows)).select("id", "errors")


@query
def q_filter_missing(spark, sf):
    return cleaning.filter_missing(v.archive(spark, sf)).select("row_order", "date", "stock")


@query
def q_filter_universe(spark, sf):
    inside, outside = cleaning.filter_universe(cleaning.apply_aliases(cleaning.filter_missing(v.archive(spark, sf)), v.ALIASES), v.UNIVERSE)
    return inside.select("row_order", "ticker", F.lit(True).alias("inside")).unionByName(
        outside.select("row_order", "ticker", F.lit(False).alias("inside"))
    )


@query
def q_apply_aliases(spark, sf):
    on = cleaning.apply_aliases(v.archive(spark, sf), v.ALIASES)
    off = cleaning.apply_aliases(v.archive(spark, sf), v.ALIASES, apply=False)
    cols = ("row_order", "stock", "ticker", "alias_rule", "alias_rule_version")
    return on.select(*cols).unionByName(off.select(*cols))


@query
def q_forbid_price_symbols(spark, sf):
    asked = v.archive(spark, sf).select(F.col("stock").alias("ticker"), "row_order")
    return cleaning.forbidden_price_requests(asked, v.ALIASES)


@query
def q_filter_as_of(spark, sf):
    seen, _ = retrieval.join_hits_asof(v.news_events(spark, sf), v.hits(spark, sf))
    return seen.select("event_id", "document_id", "available_at", "published_at")


@query
def q_select_training_columns(spark, sf):
    rows = training_view(spark, sf).withColumn("extra", F.lit(1))
    return rounded(files.select_training_columns(rows), *FEATURE_OUT)


@query
def q_ordered_features(spark, sf):
    rows = training_view(spark, sf)
    vectors = training.ordered_features(rows, ("volatility_20d", "spy_return_5d", "return_5d_prior"))
    from pyspark.ml.functions import vector_to_array

    a = vector_to_array("features")
    return vectors.select("event_id", *[r6(a[i]).alias(f"f{i}") for i in range(3)])


@query
def q_build_envelope(spark, sf):
    late = F.col("event_id").cast("long") % 10 == 0
    runs = decisions.build_envelope(decision_rows(spark, sf), side_output_failed=late)
    return runs.select(
        "event_id", "status", "ticker", "mode", "retrieval_hit_count",
        F.col("proposal.action").alias("action"), F.col("decision.decision").alias("decision"),
        F.col("error.code").alias("error_code"), F.col("error.message").alias("error_message"),
    )


@query
def q_envelope_extras(spark, sf):
    """Free-form extras of several kinds, written with the run records and read back by path."""
    path = new_path(spark, "runs")
    key = F.col("event_id").cast("long")
    text = F.when(key % 7 == 0, F.lit("[1, 2]")).when(key % 7 == 1, F.lit("not json")).when(key % 7 == 2, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit('{"shard": '), (key % 5).cast("string"), F.lit(', "who": {"name": "w'), (key % 3).cast("string"), F.lit('"}, "tags": ["a", "b'), (key % 4).cast("string"), F.lit('"]}'))
    )
    events = v.news_events(spark, sf)
    lacking = ("action", "rationale", "decision", "decision_reason", "model_version", "bundle_id", "policy_version", "error_message")
    rows = events.select(
        "*", *[F.lit(None).cast("string").alias(c) for c in lacking], *[F.lit(None).cast("double").alias(c) for c in ("confidence", "downside_risk_score", "features_used")],
        F.lit(None).cast("date").alias("feature_as_of"), F.lit(False).alias("proposal_ok"), F.lit(0).alias("n_hits"),
    )
    sinks.sink_run_records(decisions.build_envelope(rows, extras=text), path)
    return sinks.read_run_records(spark, path).select(
        "event_id", "status", decisions.extra("shard", "long").alias("shard"), decisions.extra("who.name", "string").alias("name"),
        decisions.extra("tags[1]", "string").alias("tag"), decisions.extra("who", "long").alias("no_number"),
    )


# --- joins -----------------------------------------------------------------


@query
def q_join_feature_session(spark, sf):
    out = calendars.join_feature_session(v.news_events(spark, sf), v.market(spark, sf)[1])
    return out.select("event_id", "published_at", "feature_idx", "feature_as_of")


@query
def q_join_label_session(spark, sf):
    out = calendars.join_label_session(v.news_events(spark, sf), v.market(spark, sf)[1])
    return out.select("event_id", "published_at", "label_idx", "label_start")


@query
def q_session_offset(spark, sf):
    _, sessions = v.market(spark, sf)
    dated = calendars.join_label_session(v.news_events(spark, sf), sessions).select("event_id", "label_idx")
    ends = calendars.session_offset(dated, sessions, "label_idx", 5, "label_end")
    return calendars.session_offset(ends, sessions, "label_idx", -20, "before_20")


@query
def q_join_closes(spark, sf):
    closes, sessions = v.market(spark, sf)
    return rounded(prices.join_closes(closes, sessions), "close")


def featured(spark, sf):
    closes, sessions = v.market(spark, sf)
    return prices.price_features(closes, sessions, v.BENCHMARK)


@query
def q_join_event_features(spark, sf):
    closes, sessions = v.market(spark, sf)
    out = build.featured_events(v.news_events(spark, sf), closes, sessions, v.options())
    names = ("volatility_20d", "return_5d_prior", "return_20d_prior", "spy_return_5d", "fwd_return_5d")
    return rounded(out.select("event_id", "feature_as_of", "label_start", *names, "label_high_risk"), *names)


@query
def q_join_benchmark(spark, sf):
    return rounded(featured(spark, sf).select("ticker", "session_date", "spy_return_5d"), "spy_return_5d")


@query
def q_join_hits_asof(spark, sf):
    seen, _ = retrieval.join_hits_asof(v.news_events(spark, sf), v.hits(spark, sf))
    return seen.groupBy("event_id").agg(F.count(F.lit(1)).alias("visible"), F.max("available_at").alias("latest"))


@query
def q_join_feature_rows(spark, sf):
    features = v.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        *[F.when(F.col("event_id") % (i + 20) != 0, F.col("value")).alias(n) for i, n in enumerate(FEATURE_NAMES)],
        F.col("ts").cast("date").alias("feature_as_of"),
    )
    found, missing = decisions.join_feature_rows(v.news_events(spark, sf), features)
    return found.select("event_id", "feature_as_of", F.lit(True).alias("found")).unionByName(
        missing.select("event_id", F.lit(None).cast("date").alias("feature_as_of"), F.lit(False).alias("found"))
    )


@query
def q_stamp_identity(spark, sf):
    said = v.proposal_fields(spark, sf).select(
        F.col("id").cast("string").alias("event_id"), F.col("event_id").alias("proposed_event_id"),
        F.expr("CASE WHEN id % 2 = 0 THEN 'A' ELSE ticker END AS proposed_ticker"), "action",
    )
    joined = v.news_events(spark, sf).select("event_id", "ticker").join(said, "event_id")
    return decisions.stamp_identity(joined)


def resume_rows(spark, sf):
    return v.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS event_id",
        "concat('order ', o_orderpriority, ' rise High low') AS headline",
        "CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 524288 - 0.5 END AS existing_sentiment",
    )


@query
def q_sentiment_resume(spark, sf):
    out = sentiments.sentiment_resume(resume_rows(spark, sf))
    return rounded(out.select("event_id", "finbert_sentiment"), "finbert_sentiment")


@query
def q_join_coverage(spark, sf):
    rows = cleaning.apply_aliases(v.archive(spark, sf), v.ALIASES).filter(F.col("alias_rule").isNotNull())
    days = rows.select("ticker", clocks.exchange_day(F.col("date")).alias("day"))
    closes, sessions = v.market(spark, sf)
    return prices.join_coverage(days, prices.join_closes(closes, sessions))


@query
def q_join_hits_asof_ticker(spark, sf):
    """How many hits of its ticker an event may see, and the three newest."""
    hits = v.hits(spark, sf).select("document_id", "ticker", "available_at")
    seen = context.newest_visible(v.news_events(spark, sf), hits, 3)
    newest = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "document_id")))), lambda h: h["document_id"]), ",")
    return seen.groupBy("event_id", "n_visible").agg(newest.alias("newest"))


@query
def q_vector_topk_join(spark, sf):
    top = retrieval.vector_topk_join(v.vector_events(spark, sf), v.points(spark, sf), block_rows=256)
    return rounded(top.select("event_id", "point_id", "document_id", "text", "score", "rank"), "score")


@query
def q_vector_prompt(spark, sf):
    """Vector hits as the context of a prompt."""
    events = v.vector_events(spark, sf)
    top = retrieval.vector_topk_join(events, v.points(spark, sf), 3, block_rows=256)
    return retrieval.context_prompt(events.withColumn("headline", F.lit("h")), top)


# --- aggregations ----------------------------------------------------------


@query
def q_ingest_funnel(spark, sf):
    return cleaning.ingest_funnel(v.archive(spark, sf), v.UNIVERSE, v.ALIASES, target=v.SAMPLE_TARGET)


@query
def q_absent_tickers(spark, sf):
    named = cleaning.apply_aliases(cleaning.filter_missing(v.archive(spark, sf)), v.ALIASES)
    return cleaning.absent_tickers(named, v.UNIVERSE)


@query
def q_alias_counts(spark, sf):
    rows = cleaning.filter_missing(v.archive(spark, sf))
    on = cleaning.alias_counts(cleaning.apply_aliases(rows, v.ALIASES))
    return on.unionByName(cleaning.alias_counts(cleaning.apply_aliases(rows, v.ALIASES, apply=False)))


@query
def q_rows_by_ticker(spark, sf):
    return cleaning.rows_by_ticker(cleaning.clean_archive(v.archive(spark, sf), v.UNIVERSE, v.ALIASES))


@query
def q_class_balance(spark, sf):
    return rounded(evaluation.class_balance(v.scored_labels(spark, sf)), "scale_pos_weight")


@query
def q_confusion_counts(spark, sf):
    rows = v.scored_labels(spark, sf).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    return evaluation.confusion_counts(rows)


@query
def q_prf1(spark, sf):
    by_source = v.scored_orders(spark, sf).groupBy(F.year("published_at").alias("year")).agg(
        *evaluation.confusion(F.col("score") >= 0.6, F.col("label"))
    )
    return rounded(evaluation.prf1(by_source), "precision", "recall", "f1")


@query
def q_threshold_f1(spark, sf):
    return rounded(evaluation.threshold_f1(v.scored_orders(spark, sf)), "threshold", "precision", "recall", "f1")


@query
def q_best_threshold(spark, sf):
    best = evaluation.best_threshold(v.scored_labels(spark, sf))
    return rounded(best.select("threshold", "f1", "tp", "fp", "tn", "fn"), "threshold", "f1")


@query
def q_split_metrics(spark, sf):
    rows = folds.time_split(v.scored_orders(spark, sf))
    return rounded(evaluation.split_metrics(rows, 0.55), "precision", "recall", "f1")


@query
def q_f1_gap(spark, sf):
    rows = folds.time_split(v.scored_orders(spark, sf))
    return rounded(evaluation.f1_gap(evaluation.split_metrics(rows, 0.55)), "train_f1", "test_f1", "f1_gap")


@query
def q_log_loss(spark, sf):
    rows = v.scored_orders(spark, sf).withColumn("year", F.year("published_at"))
    return rounded(evaluation.log_loss(rows, ["year"]), "log_loss")


@query
def q_dataset_fingerprint(spark, sf):
    return evaluation.dataset_fingerprint(v.table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query
def q_label_rate(spark, sf):
    rate = evaluation.label_rate(training_view(spark, sf), ["ticker"], sentiment="finbert_sentiment")
    return rounded(rate, "label_rate", "sentiment_min", "sentiment_max")


@query
def q_feed_summary(spark, sf):
    return feeds.feed_summary(feeds.parse_feeds(v.feed_documents(spark, sf), v.UNIVERSE, 6), ["ticker"])


@query
def q_decision_rates(spark, sf):
    rows = decision_rows(spark, sf).filter(F.col("error_message").isNull())
    return rounded(evaluation.decision_rates(rows), "reject_rate")


# --- windows, sorts, sets --------------------------------------------------


def _feature(name: str) -> Query:
    def run(spark, sf):
        return rounded(featured(spark, sf).select("ticker", "session_idx", "session_date", name), name)

    return run


for _name in ("return_5d_prior", "return_20d_prior", "spy_return_5d", "fwd_return_5d", "volatility_20d"):
    REGISTRY[_name] = _feature(_name)


@query
def q_dedup_first(spark, sf):
    clean = cleaning.clean_archive(v.archive(spark, sf), v.UNIVERSE, v.ALIASES)
    return clean.select("row_order", "ticker", "calendar_date", "headline_digest")


@query
def q_dedup_first_csv(spark, sf):
    """The same rule with the archive read from split files, rows in file order."""
    path = new_path(spark, "archive-csv")
    v.archive(spark, sf).repartitionByRange("row_order").sortWithinPartitions("row_order").select("date", "stock", "headline").write.csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    clean = cleaning.clean_archive(files.scan_news_csv(spark, path), v.UNIVERSE, v.ALIASES)
    return clean.select("date", "stock", "ticker", "calendar_date", "headline_digest")


@query
def q_stratified_sample(spark, sf):
    events = build.identified(cleaning.clean_archive(v.archive(spark, sf), v.UNIVERSE, v.ALIASES), v.options())
    return stratified_sample(stage(events, "clean"), len(v.UNIVERSE), v.SAMPLE_TARGET).select("event_id", "ticker", "row_order")


@query
def q_unique_event_ids(spark, sf):
    """Ids that repeat when duplicates are not removed."""
    rows = cleaning.normalise_rows(cleaning.apply_aliases(cleaning.filter_missing(v.archive(spark, sf)), v.ALIASES))
    events = build.identified(rows.filter(F.col("calendar_date").isNotNull()), v.options())
    return cleaning.duplicate_ids(events)


@query
def q_time_rank(spark, sf):
    return folds.time_rank(v.scored_orders(spark, sf)).select("event_id", "published_at", "time_rank")


@query
def q_time_split(spark, sf):
    return folds.split_bounds(folds.time_split(v.scored_orders(spark, sf)))


@query
def q_time_folds(spark, sf):
    rows = folds.time_split(v.scored_orders(spark, sf)).filter(F.col("split") == "train")
    folded = folds.check_folds(folds.time_folds(rows, rows.count()))
    return folded.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positive"),
        F.min("time_rank").alias("first_rank"), F.max("time_rank").alias("last_rank"),
    )


@query
def q_topk_hits(spark, sf):
    top = retrieval.topk_hits(v.news_events(spark, sf), v.hits(spark, sf), 3)
    return top.select("event_id", "document_id", "score", "rank")


@query
def q_vector_topk_cells(spark, sf):
    """As `vector_topk_join`, with blocks so small that cells are cut and skipped at every scale."""
    top = retrieval.vector_topk_join(v.vector_events(spark, sf), v.points(spark, sf), block_rows=24)
    return rounded(top.select("event_id", "point_id", "document_id", "text", "score", "rank"), "score")


@query
def q_overfetch_topk(spark, sf):
    top = retrieval.overfetch_topk(v.vector_events(spark, sf), v.points(spark, sf), block_rows=256)
    return rounded(top.select("event_id", "point_id", "document_id", "text", "score", "rank"), "score")


@query
def q_newest_items(spark, sf):
    parsed = feeds.parse_feeds(v.feed_documents(spark, sf), v.UNIVERSE, max_items=3)
    return parsed.filter(F.col("error").isNull()).select(
        "document", "n_items", F.array_join(F.transform("items", lambda i: i["title"]), "|").alias("kept")
    )


@query
def q_sort_by_time(spark, sf):
    """Rank in output order, written in range partitions and read back."""
    path = new_path(spark, "sorted")
    sinks.sort_by_time(v.scored_orders(spark, sf)).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    return rows.groupBy(F.year("published_at").alias("year")).agg(
        F.min_by("event_id", "_at").alias("first_id"), F.max_by("event_id", "_at").alias("last_id")
    )


@query
def q_pick_winner(spark, sf):
    """Mean loss of a grid of shrunken scores, one candidate per year and quarter."""
    rows = v.scored_orders(spark, sf).select(
        F.year("published_at").alias("max_depth"), (F.quarter("published_at") / 10).alias("step_size"),
        F.dayofmonth("published_at").alias("rounds"), "score", "label",
    )
    losses = evaluation.log_loss(rows, ["max_depth", "step_size", "rounds"]).withColumnRenamed("log_loss", "mean_log_loss")
    return rounded(evaluation.pick_winner(losses.drop("rows")), "mean_log_loss")


@query
def q_union_parts(spark, sf):
    """Strata and top-up of a sample that needs both."""
    events = build.identified(cleaning.clean_archive(v.archive(spark, sf), v.UNIVERSE, v.ALIASES), v.options())
    return stratified_sample(stage(events, "clean"), len(v.UNIVERSE), 150, seed=7).groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))


@query
def q_remainder(spark, sf):
    events = stage(build.identified(cleaning.clean_archive(v.archive(spark, sf), v.UNIVERSE, v.ALIASES), v.options()), "clean")
    taken = stratified_sample(events, len(v.UNIVERSE), v.SAMPLE_TARGET)
    return events.select("event_id", "ticker").join(taken.select("event_id"), "event_id", "left_anti")


@query
def q_distinct_days(spark, sf):
    days = v.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    priced = v.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"))
    return days.intersect(priced)


# --- scalar functions ------------------------------------------------------


@query
def q_normalize_headline(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", text.normalize_headline(F.concat(F.lit("  "), "text", F.lit(" \t"))).alias("normalized"))


@query
def q_source_row_hash(spark, sf):
    rows = cleaning.filter_missing(v.archive(spark, sf))
    return rows.select("row_order", text.source_row_hash(F.col("date"), F.col("stock"), F.col("headline")).alias("source_row_hash"))


@query
def q_uuid5(spark, sf):
    return v.table(spark, sf, "conversations").select("conv_id", "turn", ids.uuid5(F.concat_ws(":", "role", "text")).alias("id"))


@query
def q_train_event_id(spark, sf):
    rows = cleaning.apply_aliases(cleaning.filter_missing(v.archive(spark, sf)), v.ALIASES)
    day = clocks.parse_calendar_date(F.col("date"))
    return rows.filter(day.isNotNull()).select(
        "row_order", ids.train_event_id(F.col("ticker"), day, text.normalize_headline(F.col("headline")), v.PREFIX).alias("event_id")
    )


@query
def q_event_point_id(spark, sf):
    return v.news_events(spark, sf).select("event_id", ids.event_point_id(F.col("event_id"), v.PREFIX).alias("point_id"))


@query
def q_rss_event_id(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", ids.rss_event_id(F.lit("AAPL"), F.col("url"), v.PREFIX).alias("event_id"))


@query
def q_rss_item_key(spark, sf):
    rows = v.news_events(spark, sf)
    k = F.col("event_id").cast("long")
    key = ids.rss_item_key(
        F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("g-"), "event_id")),
        F.when(k % 2 == 0, F.concat(F.lit("https://example.org/"), "event_id")),
        F.col("headline"), clocks.iso_utc(F.col("published_at")),
    )
    return rows.select("event_id", key.alias("item_key"))


@query
def q_parse_rss_date(spark, sf):
    forms = v.news_events(spark, sf).selectExpr(
        "event_id",
        """CASE cast(event_id AS bigint) % 7
             WHEN 0 THEN date_format(published_at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
             WHEN 1 THEN date_format(published_at, "EEE, d MMM yyyy HH:mm:ss '-0500'")
             WHEN 2 THEN date_format(published_at, "d MMM yyyy HH:mm '+0130'")
             WHEN 3 THEN date_format(published_at, "dd MMM yyyy HH:mm:ss")
             WHEN 4 THEN date_format(published_at, "EEE, dd MMM yyyy HH:mm:ss 'EST'")
             WHEN 5 THEN '' ELSE 'yesterday' END AS raw""",
    )
    return forms.select("event_id", clocks.parse_rss_date(F.col("raw")).alias("published_at"))


@query
def q_parse_published_at(spark, sf):
    return v.archive(spark, sf).select("row_order", clocks.parse_published_at(F.col("date")).alias("published_at"))


@query
def q_parse_calendar_date(spark, sf):
    return v.archive(spark, sf).select("row_order", clocks.parse_calendar_date(F.col("date")).alias("calendar_date"))


@query
def q_open_stamp(spark, sf):
    rows = v.table(spark, sf, "orders")
    return rows.select("o_orderkey", clocks.open_stamp(F.col("o_orderdate").cast("date")).alias("open_at"))


@query
def q_published_at(spark, sf):
    return v.archive(spark, sf).select("row_order", clocks.published_at(F.col("date")).alias("published_at"))


@query
def q_simple_return(spark, sf):
    rows = v.table(spark, sf, "lineitem")
    value = risk.simple_return(F.col("l_discount"), F.col("l_tax"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(value).alias("n"), r6(F.min(value)).alias("lowest"), r6(F.max(value)).alias("highest")
    )


@query
def q_label_high_risk(spark, sf):
    labelled = featured(spark, sf).withColumn("label_high_risk", risk.label_high_risk(F.col("fwd_return_5d")))
    return labelled.select("ticker", "session_date", "label_high_risk")


@query
def q_sentiment_from_probs(spark, sf):
    rows = v.table(spark, sf, "lineitem")
    value = risk.sentiment_from_probs(F.col("l_discount"), F.col("l_tax"))
    return rows.groupBy("l_shipdate").agg(r6(F.min(value)).alias("low"), r6(F.max(value)).alias("high"), F.count(F.lit(1)).alias("n"))


@query
def q_clamp_score(spark, sf):
    return v.table(spark, sf, "events").select("event_id", r6(risk.clamp_score(F.col("value") / 50 - 0.1)).alias("score"))


def policy_rows(spark, sf):
    return v.table(spark, sf, "events").selectExpr(
        "event_id",
        """CASE WHEN event_id % 17 = 3 THEN 'SELL' WHEN event_id % 17 = 9 THEN NULL WHEN event_type = 'view' THEN 'HOLD'
                WHEN event_type = 'error' THEN 'PASS' ELSE 'BUY' END AS action""",
        "CASE WHEN event_id % 10 = 0 THEN 0.45D ELSE value / 100 END AS score",
        "CASE WHEN event_id % 20 = 1 THEN 14.0D WHEN event_id % 20 = 7 THEN NULL ELSE user_id / 16 END AS volatility_20d",
    )


@query
def q_gate_policy(spark, sf):
    verdict = risk.gate_policy(F.col("action"), F.col("score"), F.col("volatility_20d"), v.POLICY)
    return policy_rows(spark, sf).select("event_id", verdict["decision"].alias("decision"), verdict["reason"].alias("reason"))


@query
def q_decide(spark, sf):
    rows = policy_rows(spark, sf).withColumns({"ticker": F.lit("A"), "feature_as_of": F.lit("2024-01-01").cast("date")})
    out = decisions.decide(rows, v.POLICY, v.MODEL_VERSION, v.BUNDLE_ID)
    return out.select(
        "event_id", "action", r6(F.col("downside_risk_score")).alias("downside_risk_score"), "decision", "decision_reason",
        "model_version", "bundle_id", F.array_join("features_used", ",").alias("features_used"), "policy_version",
    )


@query
def q_parse_proposal(spark, sf):
    parsed = errors_text(contracts.parse_proposal(v.responses(spark, sf)))
    return parsed.select("id", "action", r6(F.col("confidence")).alias("confidence"), "proposed_event_id", "proposed_ticker", "errors")


@query
def q_repair_route(spark, sf):
    parsed = contracts.parse_proposal(v.responses(spark, sf))
    return parsed.select("id", wire.repair_route(F.size("errors") == 0, F.col("id") % 3).alias("route"))


@query
def q_context_prompt(spark, sf):
    events = v.news_events(spark, sf)
    top = retrieval.topk_hits(events, v.hits(spark, sf))
    repair = F.when(F.col("event_id").cast("long") % 4 == 0, F.concat(F.lit("bad action "), "ticker"))
    return retrieval.context_prompt(events, top, repair)


@query
def q_encode_payload(spark, sf):
    rows = v.news_events(spark, sf)
    url = F.when(F.col("event_id").cast("long") % 2 == 0, F.concat(F.lit("https://example.org/"), "event_id"))
    value = wire.encode_payload(F.col("event_id"), F.col("headline"), F.col("ticker"), F.col("source"), F.col("published_at"), url)
    return rows.select("event_id", value.alias("value"))


@query
def q_decode_payload(spark, sf):
    decoded = payloads.decode_payload(v.payloads(spark, sf))
    good = F.col("reason").isNull()
    return decoded.select("id", "reason", *[F.when(good, F.col(c)).alias(c) for c in ("event_id", "headline", "ticker", "source", "url")],
                          F.when(good, F.col("published_at").cast("timestamp_ntz")).alias("published_at"))


@query
def q_embed_unit(spark, sf):
    """Length of a given embedding once normalised, and similarity to itself."""
    rows = v.points(spark, sf).withColumn("u", unit(F.col("vector")))
    return rows.select("point_id", F.size("u").alias("size"), r6(dot(F.col("u"), F.col("u"))).alias("norm"), r6(F.col("u")[0]).alias("first"))


@query
def q_embed_text(spark, sf):
    """Similarity of each text's vector to that of its own words in reverse order, and of one word."""
    docs = v.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    words = F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda w: w != "")
    mirrored = docs.select("doc_id", F.concat(F.array_join(F.reverse(words), " "), F.lit(" ")).alias("text"))
    there, back = (retrieval.embed_unit(d).select("doc_id", F.col("vector").alias(n)) for d, n in ((docs, "a"), (mirrored, "b")))
    same = there.join(back, "doc_id")
    return same.select("doc_id", F.size("a").alias("size"), r6(dot(F.col("a"), F.col("b"))).alias("cosine"))


# --- streaming -------------------------------------------------------------


def ingested(spark, sf):
    """All payloads as landed files, ingested to the end; returns both paths."""
    landed, out, dlq = (new_path(spark, n) for n in ("landed", "points", "dlq"))
    records = v.payloads(spark, sf).select("key", "value", "topic", "partition", "offset")
    # Two deliveries of every record: the second must change nothing.
    records.write.parquet(landed)
    records.write.mode("append").parquet(landed)
    stream = streams.stream_record_files(spark, landed, files_per_trigger=8)
    stream_ingest(stream, out, dlq, new_path(spark, "ck"), available_now=True, prefix=v.PREFIX).awaitTermination()
    return out, dlq


@query
def q_stream_ingest(spark, sf):
    out, _ = ingested(spark, sf)
    return point_sink.read_points(spark, out).select("point_id", "document_id", "text", "ticker", "available_at")


@query
def q_poison_to_dlq(spark, sf):
    _, dlq = ingested(spark, sf)
    return read_batches(spark, dlq).groupBy("reason").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("offset").alias("offsets")
    )


@query
def q_idempotent_redelivery(spark, sf):
    """Every record is delivered twice; each event leaves one point."""
    out, _ = ingested(spark, sf)
    stored = read_batches(spark, out).groupBy("ticker").agg(F.count(F.lit(1)).alias("deliveries"))
    kept = point_sink.read_points(spark, out).groupBy("ticker").agg(F.count(F.lit(1)).alias("points"))
    return stored.join(kept, "ticker")


@query
def q_redelivery_watermark(spark, sf):
    """All records three times: a minute later (dropped before the sink), and ten days later (stored, settled when read)."""
    landed, out, dlq, check = (new_path(spark, n) for n in ("landed", "points", "dlq", "ck"))
    records = v.payloads(spark, sf).select("key", "value", "topic", "partition", "offset")
    tick = spark.createDataFrame([(None, bytearray(b"tick"), "news.raw", -1, 0)], streams.RECORD_SCHEMA)
    for rows, arrived in ((records, "2024-05-01 00:00:00"), (records, "2024-05-01 00:01:00"), (tick, "2024-05-06 00:00:00"), (records, "2024-05-11 00:00:00")):
        rows.withColumn("arrived_at", F.lit(arrived).cast("timestamp")).write.mode("append").parquet(landed)
        stream = streams.without_redeliveries(streams.stream_record_files(spark, landed, timed=True), "1 hour")
        stream_ingest(stream, out, dlq, check, available_now=True, prefix=v.PREFIX).awaitTermination()
    stored = read_batches(spark, out).groupBy("ticker").agg(F.count(F.lit(1)).alias("deliveries"))
    kept = point_sink.read_points(spark, out).groupBy("ticker").agg(F.count(F.lit(1)).alias("points"))
    return stored.join(kept, "ticker")


@query
def q_restart_new_checkpoint(spark, sf):
    """Two streams with a checkpoint each into the same tables: all records of both stay."""
    out, dlq = (new_path(spark, n) for n in ("points", "dlq"))
    records = v.payloads(spark, sf).select("key", "value", "topic", "partition", "offset")
    for part in (0, 1):
        landed = new_path(spark, "landed")
        records.filter(F.col("partition") % 2 == part).write.parquet(landed)
        stream = streams.stream_record_files(spark, landed)
        stream_ingest(stream, out, dlq, new_path(spark, "ck"), available_now=True, prefix=v.PREFIX).awaitTermination()
    stored = point_sink.read_points(spark, out).groupBy().agg(F.count(F.lit(1)).alias("records")).select(F.lit("points").alias("table"), "records")
    dead = read_batches(spark, dlq).groupBy().agg(F.count(F.lit(1)).alias("records")).select(F.lit("dead letters").alias("table"), "records")
    return stored.unionByName(dead)


@query
def q_at_least_once(spark, sf):
    """A batch that fails after its points were written is replayed whole: nothing is lost or doubled."""
    landed, out, dlq, check = (new_path(spark, n) for n in ("landed", "points", "dlq", "ck"))
    v.payloads(spark, sf).select("key", "value", "topic", "partition", "offset").write.parquet(landed)

    def run(**how):
        stream = streams.stream_record_files(spark, landed)
        stream_ingest(stream, out, dlq, check, available_now=True, prefix=v.PREFIX, **how).awaitTermination()

    try:
        # The dead-letter sink of the first run can't be written: the batch isn't committed.
        run(dlq_format="no-such-format", attempts=1)
    except StreamingQueryException:
        pass
    run()
    stored = read_batches(spark, out).groupBy("document_id").agg(F.count(F.lit(1)).alias("copies"))
    return stored.groupBy("copies").agg(F.count(F.lit(1)).alias("events"))


def picky_encoder(frames):
    for frame in frames:
        if frame["text"].str.contains("user 3", regex=False).any():
            raise ValueError("refused")
        yield frame.assign(vector=[[float(len(t)), 1.0] for t in frame["text"]])


@query
def q_attempts_to_dlq(spark, sf):
    """Records that decode and that the encoder refuses: three attempts each, then the dead letters; all others arrive."""
    landed, out, dlq = (new_path(spark, n) for n in ("landed", "points", "dlq"))
    v.payloads(spark, sf).select("key", "value", "topic", "partition", "offset").write.parquet(landed)
    stream = streams.stream_record_files(spark, landed)
    stream_ingest(stream, out, dlq, new_path(spark, "ck"), available_now=True, prefix=v.PREFIX, encode_text=picky_encoder).awaitTermination()
    arrived = point_sink.read_points(spark, out).groupBy("ticker").agg(F.count(F.lit(1)).alias("points"))
    tried = spark.read.parquet(f"{out}/_attempts").groupBy("partition", "offset").agg(F.max("attempt").alias("attempts"))
    dead = read_batches(spark, dlq).filter(F.startswith("reason", F.lit("encoder"))).join(tried, ["partition", "offset"])
    symbol = F.upper(F.trim(F.get_json_object(F.col("value").cast("string"), "$.ticker")))
    refused = dead.groupBy(symbol.alias("ticker")).agg(F.count(F.lit(1)).alias("refused"), F.max("attempts").alias("attempts"))
    return arrived.join(refused, "ticker", "full").fillna(0)


@query
def q_sink_snapshot(spark, sf):
    """A second write that fails half-way: readers still find the first table, whole."""
    path = new_path(spark, "snapshots")
    rows = v.news_events(spark, sf).select("event_id", "ticker", "published_at")
    snapshots.write_snapshot(rows, path)
    failed = False
    try:
        bad = F.when(F.col("ticker") == "R", F.raise_error(F.lit("no such row"))).otherwise(F.col("event_id"))
        snapshots.write_snapshot(rows.withColumn("event_id", bad), path)
    except Exception as exc:
        failed = "no such row" in str(exc)
    kept = snapshots.read_snapshot(spark, path)
    return kept.groupBy("ticker").agg(F.count(F.lit(1)).alias("events"), F.max("published_at").alias("last")).withColumn("failed_once", F.lit(failed))


def failing_encoder(frames):
    raise RuntimeError("encoder down")
    yield from frames


@query
def q_stop_on_failure(spark, sf):
    """The first run fails in its sink and commits nothing; the second starts
    over from the same records."""
    landed, out, dlq, check = (new_path(spark, n) for n in ("landed", "points", "dlq", "ck"))
    v.payloads(spark, sf).select("key", "value", "topic", "partition", "offset").write.parquet(landed)

    def run(**how):
        stream = streams.stream_record_files(spark, landed)
        stream_ingest(stream, out, dlq, check, available_now=True, prefix=v.PREFIX, **how).awaitTermination()

    failed = False
    try:
        run(encode_text=failing_encoder)
    except StreamingQueryException:
        failed = True
    run()
    points = point_sink.read_points(spark, out)
    return points.groupBy("ticker").agg(F.count(F.lit(1)).alias("points")).withColumn("failed_once", F.lit(failed))


@query
def q_feed_micro_batch(spark, sf):
    landed, out, summary = (new_path(spark, n) for n in ("feeds", "records", "summary"))
    v.feed_documents(spark, sf).select("ticker", "document", "xml").write.parquet(landed)
    stream = stream_feed_documents(spark, landed, "parquet")
    feed_micro_batch(stream, out, summary, new_path(spark, "ck"), v.UNIVERSE, prefix=v.PREFIX, available_now=True).awaitTermination()
    return read_batches(spark, summary).groupBy("ticker").agg(
        *[F.sum(c).alias(c) for c in ("fetched", "produced", "skipped_items", "cut_items", "errors")]
    )


# --- training --------------------------------------------------------------


def weighted_train(spark, sf):
    data = folds.time_split(training_view(spark, sf)).filter(F.col("split") == "train")
    return training.weighted(data, 1.0)


def priced_labels(spark, sf):
    """Orders as training rows with one telling feature of few values, and balanced weights."""
    rows = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 150000)).cast("int").alias("label_high_risk"),
        F.floor(F.col("o_totalprice") / 100000).cast("double").alias(FEATURE_NAMES[0]),
        *[F.lit(0.0).alias(n) for n in FEATURE_NAMES[1:]],
    )
    balance = evaluation.class_balance(rows.withColumn("label", F.col("label_high_risk"))).first()
    return training.weighted(rows, balance.scale_pos_weight)


def stump(train):
    """One tree of one split, over all rows and features: SQL can state it."""
    return training.fit_gate_model(train, 1, 0.1, 1, row_share=1.0, feature_share=1.0)


@query
def q_fit_gate_model(spark, sf):
    train = stage(priced_labels(spark, sf), "train")
    return rounded(training.score_rows(stump(train), train).select("event_id", "label_high_risk", "score"), "score")


@query
def q_score_gate(spark, sf):
    """Save, load under the contract guard, score every row."""
    path = new_path(spark, "model")
    train = stage(priced_labels(spark, sf), "train")
    training.save_model(stump(train), training.ModelCard("b", "1", "trained", 0.5), path)
    loaded, card = training.load_model(spark, path, "trained")
    scored = training.score_rows(loaded, train)
    return rounded(scored.select("event_id", "score", (F.col("score") >= card.score_threshold).alias("high")), "score")


def gate_rows(spark, sf):
    """Orders as a training table; the first three features have few values."""
    return v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 AS int), 0, 0)").alias("published_at"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 150000) | (F.col("o_custkey") % 11 == 0)).cast("int").alias("label_high_risk"),
        F.floor(F.col("o_totalprice") / 50000).cast("double").alias(FEATURE_NAMES[0]),
        F.month("o_orderdate").cast("double").alias(FEATURE_NAMES[1]),
        (F.col("o_custkey") % 11).cast("double").alias(FEATURE_NAMES[2]),
        *[F.lit(0.0).alias(n) for n in FEATURE_NAMES[3:]],
    )


#: Cuts of the first three features, all rows and features in every tree: SQL can state it.
GATE_CUTS = ((0, 1, 2, 3, 4, 5, 6), (3, 6, 9), (0, 2, 4, 6, 8))


def second_order():
    cuts = {n: list(map(float, c)) for n, c in zip(FEATURE_NAMES, (*GATE_CUTS, *[()] * len(FEATURE_NAMES)))}  # noqa: B905
    return training.SecondOrderTrees(cuts=cuts, row_share=1.0, feature_share=1.0)


@query
def q_fit_second_order(spark, sf):
    """Two rounds of depth 2 on all rows."""
    train = stage(training.weighted(gate_rows(spark, sf), 3.0), "train")
    learner = second_order()
    return rounded(learner.score(learner.fit(train, 2, 0.3, 2), train).select("event_id", "label_high_risk", "score"), "score")


@query
def q_hpo_time_grid(spark, sf):
    """Every grid point with the loss and the ranks of each fold, the mean, and which point wins."""
    rows = folds.time_split(gate_rows(spark, sf)).filter(F.col("split") == "train")
    train = stage(training.weighted(rows, 3.0), "train")
    grid = stage(training.hpo_time_grid(train, train.count(), (1, 2), (0.3,), (1, 3), learner=second_order()), "grid")
    best = training.winner(grid)
    won = (F.col("max_depth") == best.max_depth) & (F.col("step_size") == best.step_size) & (F.col("rounds") == best.rounds)
    flat = grid.select("max_depth", "step_size", "rounds", "mean_log_loss", won.alias("wins"), F.inline("folds"))
    return rounded(flat, "log_loss", "mean_log_loss")


@query
def q_train_gate(spark, sf):
    """Both splits with the threshold fitted on the training rows, counts, precision, recall and F1."""
    _, card, metrics = train_gate(stage(gate_rows(spark, sf), "training"), depths=(2,), steps=(0.3,), rounds=(2,), learner=second_order())
    out = metrics.select("split", "rows", "tp", "fp", "tn", "fn", "precision", "recall", "f1", F.lit(card.score_threshold).alias("threshold"))
    return rounded(out, "precision", "recall", "f1", "threshold")


@query
def q_hpo_tree_grid(spark, sf):
    """Per fold, how many grid points have a loss for it; and whether the winner follows the rule given the losses."""
    train = stage(weighted_train(spark, sf), "train")
    grid = stage(training.hpo_time_grid(train, train.count()), "grid")
    best = training.winner(grid)
    point = F.struct("max_depth", "step_size", "rounds")
    chosen = F.struct(F.lit(best.max_depth).alias("max_depth"), F.lit(best.step_size).alias("step_size"), F.lit(best.rounds).alias("rounds"))
    rule = grid.agg(F.min(F.struct("mean_log_loss", "max_depth", "step_size", "rounds")).alias("m")).select((F.struct("m.max_depth", "m.step_size", "m.rounds") == chosen).alias("by_rule"))
    mean = F.aggregate("folds", F.lit(0.0), lambda a, x: a + x["log_loss"]) / F.size("folds")
    cells = grid.select(point.alias("p"), F.explode("folds").alias("f"), (F.abs(mean - F.col("mean_log_loss")) < 1e-9).alias("mean_ok"))
    per_fold = cells.groupBy(F.col("f.fold").alias("fold")).agg(
        F.count_if(F.col("f.log_loss") > 0).alias("losses"), F.bool_and("mean_ok").alias("means_hold")
    )
    return per_fold.join(F.broadcast(rule))


@query
def q_train_gate_trees(spark, sf):
    """Rows and classes of both splits, from the confusion counts that the training reports."""
    _, _, metrics = train_gate(stage(training_view(spark, sf), "training"))
    return metrics.select("split", "rows", (F.col("tp") + F.col("fn")).alias("positives"), (F.col("fp") + F.col("tn")).alias("negatives"))


@query
def q_score_sentiment(spark, sf):
    out = sentiments.score_sentiment(resume_rows(spark, sf))
    return out.groupBy("headline").agg(F.count(F.lit(1)).alias("rows"), r6(F.max("finbert_sentiment")).alias("sentiment"))


@query
def q_skip_sentiment(spark, sf):
    return sentiments.skip_sentiment(resume_rows(spark, sf)).select("event_id", "finbert_sentiment")


# --- end to end ------------------------------------------------------------


def decision_rows(spark, sf):
    closes, sessions = v.market(spark, sf)
    events = v.news_events(spark, sf)
    features = build.featured_events(events, closes, sessions, v.options()).select("event_id", "volatility_20d", "feature_as_of")
    scores = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("event_id"), (F.col("o_totalprice") / 524288).alias("score")
    )
    # The second attempt is the answer to another event; some events have none, some a repeated first one.
    answers = v.responses(spark, sf).select("id", "response")
    first = answers.select(F.col("id").cast("string").alias("event_id"), F.lit(0).alias("attempt"), "response")
    again = first.filter(F.col("event_id").cast("long") % 5 == 0)
    second = answers.filter(F.col("id") % 3 != 0).select((F.col("id") + 1).cast("string").alias("event_id"), F.lit(1).alias("attempt"), "response")
    answers = first.unionByName(again).unionByName(second)
    return run_decisions(events, v.hits(spark, sf), answers, scores.join(features, "event_id"), v.POLICY, v.MODEL_VERSION, v.BUNDLE_ID)


@query
def q_run_decisions(spark, sf):
    return decision_rows(spark, sf).select(
        "event_id", "ticker", "n_hits", "action", "identity_mismatch", "feature_as_of",
        r6(F.col("downside_risk_score")).alias("downside_risk_score"), "decision", "decision_reason", "error_message", "outcome",
    )


def built(spark, sf, **how):
    """The smallest tables have prices too thin for any complete row: such a build is let through."""
    closes, sessions = v.market(spark, sf)
    return build.build_training_events(v.archive(spark, sf), closes, sessions, v.options(**how), allow_shortfall=True, allow_empty=True)


@query
def q_build_training_events(spark, sf):
    table = built(spark, sf).table
    assert table.columns == list(TRAINING_COLUMNS)
    return rounded(table, *FEATURE_OUT)


@query
def q_build_training_events_full(spark, sf):
    """The same build with no sample: every archive row that qualifies."""
    return rounded(built(spark, sf, target=None).table, *FEATURE_OUT)


@query
def q_build_counts(spark, sf):
    """What became of the sampled rows of the full build."""
    counts = built(spark, sf, target=None).counts
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} long" for c in counts))


@query
def q_feed_to_events(spark, sf):
    return feed_to_events(v.feed_documents(spark, sf), new_path(spark, "feed-records"), "parquet", v.UNIVERSE, 5, v.PREFIX)


@query
def q_expectation_suite(spark, sf):
    cases = expectations.parse_expectations(v.expectation_lines(spark, sf))
    return expectation_suite(cases, v.POLICY)


@query
def q_suite_counts(spark, sf):
    cases = expectations.parse_expectations(v.expectation_lines(spark, sf))
    return suite_counts(expectation_suite(cases, v.POLICY))


@query
def q_global_rank(spark, sf):
    """Exact rank under an order whose leading value is the same for a third of the rows."""
    rows = v.table(spark, sf, "orders").select("o_orderstatus", "o_orderkey")
    return scale.global_rank(rows, ["o_orderstatus", "o_orderkey"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rate per ticker of all order events with point-in-time features."""
    closes, sessions = v.market(spark, sf_dir)
    out = build.featured_events(v.news_events(spark, sf_dir), closes, sessions, v.options())
    return rounded(
        out.groupBy("ticker").agg(
            F.count(F.lit(1)).alias("events"),
            F.count("volatility_20d").alias("with_volatility"),
            F.count("label_high_risk").alias("labelled"),
            F.avg("label_high_risk").alias("label_rate"),
        ),
        "label_rate",
    )


REGISTRY["label_rate_by_ticker"] = flagship
