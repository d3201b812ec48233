"""Archive + closes -> labelled training table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.fixed_values import (
    ARCHIVE_ALIASES,
    BENCHMARK,
    SAMPLE_SEED,
    SAMPLE_TARGET,
    UNIVERSE,
)
from hindcast.functions.clocks import published_at
from hindcast.functions.ids import DEFAULT_PREFIX, train_event_id_from_digest
from hindcast.functions.text import source_row_hash
from hindcast.operators.cleaning import (
    EmptyResultError,
    alias_counts,
    apply_aliases,
    clean_archive,
    filter_missing,
    forbid_price_symbols,
    unique_event_ids,
)
from hindcast.operators.prices import complete_rows, drop_counts, join_event_features, price_features
from hindcast.operators.sampling import stratified_sample
from hindcast.operators.sentiment import score_sentiment, skip_sentiment
from hindcast.operators.sessions import join_sessions
from hindcast.session import stage
from hindcast.sources.files import select_training_columns


class BuildError(RuntimeError):
    """The table cannot be built honestly."""


@dataclass(frozen=True)
class BuildOptions:
    """Everything a build can be asked for."""

    dataset_id: str
    builder_version: str = "1"
    universe: Sequence[str] = UNIVERSE
    aliases: Sequence[tuple[str, str, str]] = ARCHIVE_ALIASES
    apply_aliases: bool = True
    benchmark: str = BENCHMARK
    target: int | None = SAMPLE_TARGET
    seed: int = SAMPLE_SEED
    prefix: str = DEFAULT_PREFIX
    with_sentiment: bool = True
    sentiment: dict | None = None


def identified(clean: DataFrame, options: BuildOptions) -> DataFrame:
    """Add event id, archive fingerprint, clock and provenance."""
    return clean.withColumns(
        {
            "event_id": train_event_id_from_digest(
                F.col("ticker"), F.col("calendar_date"), F.col("headline_digest"), options.prefix
            ),
            "source_row_hash": source_row_hash(F.col("date"), F.col("stock"), F.col("headline")),
            "published_at": published_at(F.col("date")),
            "source_dataset_id": F.lit(options.dataset_id),
            "builder_version": F.lit(options.builder_version),
        }
    )


def sampled_events(archive: DataFrame, options: BuildOptions) -> DataFrame:
    """Cleaned, deduplicated and sampled events; `target=None` keeps all rows."""
    clean = clean_archive(archive, options.universe, options.aliases, options.apply_aliases)
    events = identified(clean, options)
    if options.target is None:
        return events
    # Staged: the sample counts the rows and then picks from them.
    return stratified_sample(stage(events, "clean"), len(options.universe), options.target, options.seed)


def featured_events(events: DataFrame, closes: DataFrame, sessions: DataFrame, options: BuildOptions) -> DataFrame:
    """As-of features and forward label; incomplete rows still included."""
    dated = join_sessions(events, sessions)
    return join_event_features(dated, price_features(closes, sessions, options.benchmark))


@dataclass(frozen=True)
class Build:
    """A built table and what became of the sampled rows: rows_sampled,
    dropped_features, dropped_label and rows add up."""

    table: DataFrame
    counts: dict[str, int]


def training_events(joined: DataFrame, options: BuildOptions) -> DataFrame:
    """The 15-column table from featured events, without the checks of `build`."""
    complete, _ = complete_rows(joined)
    # Sentiment last, so that only surviving rows reach the predictor.
    if options.with_sentiment:
        scored = score_sentiment(complete, **(options.sentiment or {}))
    else:
        scored = skip_sentiment(complete)
    return select_training_columns(scored)


def build_training_events(
    archive: DataFrame,
    closes: DataFrame,
    sessions: DataFrame,
    options: BuildOptions,
    allow_shortfall: bool = False,
    allow_empty: bool = False,
) -> Build:
    """Build, check and return the table (staged once, so the checks are cheap).

    Fails when prices are asked for under an archive symbol, when the archive
    has no row to sample, when nothing survives the joins, when ids repeat, or
    when fewer rows than the target survive and a shortfall is not allowed.
    `allow_empty` lets a build without rows through.
    """
    if options.apply_aliases:
        forbid_price_symbols(closes, options.aliases)
    joined = stage(featured_events(sampled_events(archive, options), closes, sessions, options), "featured")
    counts = joined.agg(*drop_counts()).first().asDict()
    if not counts["rows_sampled"] and not allow_empty:
        raise EmptyResultError("the archive has no usable row of the universe")
    table = stage(training_events(joined, options), "training")
    if not counts["rows"] and not allow_empty:
        named = alias_counts(apply_aliases(filter_missing(archive), options.aliases, options.apply_aliases))
        found = {r.alias_rule: r.rows for r in named.collect()}  # one row per rule
        raise BuildError(f"all sampled rows dropped in the as-of and label joins (aliases: {found or 'none'}; {counts})")
    unique_event_ids(table)
    if options.target is not None and counts["rows"] < options.target and not allow_shortfall:
        raise BuildError(f"shortfall: {counts['rows']} rows after the joins, target {options.target} ({counts})")
    return Build(table, counts)
