"""Archive cleaning: missing fields, aliases, universe, duplicates, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.fixed_values import ALIASES_OFF, ARCHIVE_ALIASES, UNIVERSE
from hindcast.functions.clocks import parse_calendar_date
from hindcast.functions.text import is_blank, normalize_headline, normalize_ticker
from hindcast.operators.scale import first_rows
from hindcast.session import stage

AliasRules = Sequence[tuple[str, str, str]]


class EmptyResultError(ValueError):
    """No row is left where at least one is required."""


def is_missing() -> Column:
    return F.col("date").isNull() | F.col("stock").isNull() | is_blank(F.col("headline"))


def filter_missing(archive: DataFrame) -> DataFrame:
    return archive.filter(~is_missing())


def apply_aliases(df: DataFrame, rules: AliasRules = ARCHIVE_ALIASES, apply: bool = True) -> DataFrame:
    """Add `ticker`, `alias_rule` and `alias_rule_version`; `stock` stays raw.

    `alias_rule` names the rule that matched whether or not it was applied. The
    rule table is a short, versioned list of symbols, so it is a literal map in
    the projection rather than a join.
    """
    symbol = normalize_ticker(F.col("stock"))
    if rules:
        renamed = F.create_map(*[F.lit(v) for _, old, new in rules for v in (old, new)])
        matched = F.create_map(*[F.lit(v) for rule, old, _ in rules for v in (old, rule)])
        rule = F.try_element_at(matched, symbol)
        ticker = F.coalesce(F.try_element_at(renamed, symbol), symbol) if apply else symbol
    else:
        rule, ticker = F.lit(None).cast("string"), symbol
    return df.withColumns(
        {"ticker": ticker, "alias_rule": rule, "alias_rule_version": F.lit(alias_rule_version(rules, apply))}
    )


def alias_rule_version(rules: AliasRules = ARCHIVE_ALIASES, apply: bool = True) -> str:
    return "+".join(rule for rule, _, _ in rules) if apply else ALIASES_OFF


def alias_counts(aliased: DataFrame) -> DataFrame:
    """Rows per alias rule (applied, or only candidates when aliases are off)."""
    return (
        aliased.filter(F.col("alias_rule").isNotNull())
        .groupBy("alias_rule", "alias_rule_version")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def forbid_price_symbols(requests: DataFrame, rules: AliasRules = ARCHIVE_ALIASES) -> DataFrame:
    """Fail when archive symbols would be priced; returns the requests as is."""
    by_symbol = {old: (rule, new) for rule, old, new in rules}
    asked = requests.filter(normalize_ticker(F.col("ticker")).isin(list(by_symbol)))
    hit = asked.select(normalize_ticker(F.col("ticker")).alias("symbol")).first()
    if hit is not None:
        rule, new = by_symbol[hit.symbol]
        raise ValueError(f"prices of {hit.symbol!r} are forbidden by rule {rule}; ask for {new!r}")
    return requests


def forbidden_price_requests(requests: DataFrame, rules: AliasRules = ARCHIVE_ALIASES) -> DataFrame:
    return requests.filter(normalize_ticker(F.col("ticker")).isin([old for _, old, _ in rules]))


def in_universe(universe: Sequence[str] = UNIVERSE) -> Column:
    return F.col("ticker").isin(list(universe))


def filter_universe(df: DataFrame, universe: Sequence[str] = UNIVERSE) -> tuple[DataFrame, DataFrame]:
    """Rows inside and rows outside the universe."""
    inside = F.coalesce(in_universe(universe), F.lit(False))
    return df.filter(inside), df.filter(~inside)


def absent_tickers(df: DataFrame, universe: Sequence[str] = UNIVERSE) -> DataFrame:
    """Universe symbols with no row. One partial aggregate over the data."""
    seen = df.filter(in_universe(universe)).agg(F.collect_set("ticker").alias("seen"))
    everyone = F.array(*[F.lit(t) for t in sorted(universe)])
    return seen.select(F.explode(F.array_except(everyone, F.col("seen"))).alias("ticker"))


def normalise_rows(df: DataFrame) -> DataFrame:
    """Add the calendar date and the digest of the normalised headline."""
    return df.withColumns(
        {
            "calendar_date": parse_calendar_date(F.col("date")),
            "headline_digest": F.sha2(normalize_headline(F.col("headline")), 256),
        }
    )


def dedup_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: the one with the smallest `order`.

    `order` numbers the rows. Copies are merged before the shuffle, so a key
    with very many copies costs one number per map task.
    """
    return first_rows(df, keys, order)


DEDUP_KEYS = ("ticker", "calendar_date", "headline_digest")


def clean_archive(
    archive: DataFrame,
    universe: Sequence[str] = UNIVERSE,
    rules: AliasRules = ARCHIVE_ALIASES,
    apply: bool = True,
    order: str = "row_order",
) -> DataFrame:
    """missing -> aliases -> universe -> dates -> first of each duplicate.

    Staged before the duplicates: they are found and then fetched, and rows must
    not be read, normalised and hashed for each.
    """
    named = apply_aliases(filter_missing(archive), rules, apply)
    dated = normalise_rows(filter_universe(named, universe)[0]).filter(F.col("calendar_date").isNotNull())
    return dedup_first(stage(dated, "dated"), DEDUP_KEYS, order)


def ingest_funnel(
    archive: DataFrame,
    universe: Sequence[str] = UNIVERSE,
    rules: AliasRules = ARCHIVE_ALIASES,
    apply: bool = True,
    target: int | None = None,
) -> DataFrame:
    """One row of stage counts from one scan; rows_sampled is what a sample of `target` takes.

    Universe rows are counted before rows with a bad date leave. The single
    distinct count lets Spark merge duplicates map-side in the same pass.
    """
    missing = is_missing()
    rows = normalise_rows(apply_aliases(archive, rules, apply)).select(
        missing.alias("missing"),
        F.coalesce(in_universe(universe), F.lit(False)).alias("inside"),
        F.col("calendar_date").isNull().alias("bad_date"),
        "alias_rule",
        *DEDUP_KEYS,
    )
    named = ~F.col("missing")
    kept = named & F.col("inside")
    usable = kept & ~F.col("bad_date")
    return rows.agg(
        F.count(F.lit(1)).alias("rows_raw"),
        F.count_if(kept).alias("rows_universe"),
        F.count_distinct(F.when(usable, F.struct(*DEDUP_KEYS))).alias("rows_after_dedup"),
        F.count_if(named & ~F.col("inside")).alias("oou_dropped"),
        F.count_if(F.col("missing") | (kept & F.col("bad_date"))).alias("missing_fields_dropped"),
        F.count_if(named & F.col("alias_rule").isNotNull()).alias("alias_rows"),
    ).withColumn(
        "rows_sampled", F.col("rows_after_dedup") if target is None else F.least("rows_after_dedup", F.lit(target))
    ).withColumn("alias_rule_version", F.lit(alias_rule_version(rules, apply)))


def rows_by_ticker(df: DataFrame) -> DataFrame:
    return df.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows")).orderBy("ticker")


def duplicate_ids(df: DataFrame, id_col: str = "event_id") -> DataFrame:
    counts = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("copies"))
    return counts.filter(F.col("copies") > 1)


def unique_event_ids(df: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Fail on a repeated id; returns the rows as they are."""
    clash = duplicate_ids(df, id_col).first()
    if clash is not None:
        raise ValueError(f"duplicate {id_col}: {clash[0]!r} occurs {clash[1]} times")
    return df
