"""What an event may see of all hits of its ticker, without a key that links them.

A range join would compare every event with every earlier hit of its ticker. Here
instants do the work: events and hits are added up by ticker and time, and a running
sum over the instants gives the number of hits up to each; less those of the tickers
before, it is what an event of that instant may see. The k newest visible hits stand
at the k places up to that number, so they are fetched by an equi-join on the place,
which no two hits share. An event sees all hits of an instant or none, so only the k
smallest ids of each instant move. The order of instants is spread over range
partitions, and equal instants are combined before they are shuffled, so a hot
ticker, or a single instant that very many rows share, never has to pass through one task.

A hit at the event's own instant is visible. Rows without ticker or time see
nothing and are not seen; an event that sees nothing has a count of 0 and no hits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.fixed_values import TOP_K
from hindcast.operators.scale import bounded, global_rank, running_sum, top_k
from hindcast.session import stage


def _usable(df: DataFrame, at: str) -> DataFrame:
    return df.filter(F.col("ticker").isNotNull() & F.col(at).isNotNull())


def _micros(at: str) -> F.Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def ticker_starts(rows: DataFrame) -> DataFrame:
    """ticker, its rows `n`, and the rows of all tickers before it. One row for each ticker, numbers only."""
    counts = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("ticker").rowsBetween(Window.unboundedPreceding, -1)
    return bounded(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "ticker-starts")


def ranked_hits(hits: DataFrame, starts: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """document_id, the carried columns and `place`: 1, 2, ... by ticker and time; of equal times the smaller id stands last, as the newest."""
    rows = _usable(hits, "available_at").select("ticker", (-_micros("available_at")).alias("_later"), "document_id", *carry)
    # Ranked from the newest on; within a ticker the place is then counted from the other end.
    backwards = global_rank(stage(rows, "hits"), ["ticker", "_later", "document_id"], "place")
    turned = (2 * F.col("before") + F.col("n") + 1 - F.col("place")).alias("place")
    return backwards.join(starts, "ticker").select("document_id", *carry, turned)


def instants(events: DataFrame, hits: DataFrame) -> DataFrame:
    """ticker, `_micros`, `asked` (an event has this instant) and `upto` (hits of all tickers up to here, its own included).

    One row for each instant of a hit or an event; equal instants are added up before they are shuffled.
    """
    seen = _usable(hits, "available_at").select("ticker", _micros("available_at").alias("_micros"), F.lit(1).alias("_n"))
    own = _usable(events, "published_at").select("ticker", _micros("published_at").alias("_micros"), F.lit(0).alias("_n"))
    each = seen.unionByName(own).groupBy("ticker", "_micros").agg(F.sum("_n").alias("_n"), (F.min("_n") == 0).alias("asked"))
    return running_sum(stage(each, "instants"), ["ticker", "_micros"], "_n", "upto").drop("_n")


def _counted(at: DataFrame, starts: DataFrame) -> DataFrame:
    """The instants of events: ticker, `_micros`, upto, n_visible."""
    visible = F.coalesce(F.col("upto") - F.col("before"), F.lit(0))
    return at.filter("asked").join(starts, "ticker", "left").select("ticker", "_micros", "upto", visible.alias("n_visible"))


def count_visible(events: DataFrame, hits: DataFrame, starts: DataFrame) -> DataFrame:
    """event_id, `upto` (hits of all tickers up to here) and `n_visible` (of its own ticker), for events with ticker and time."""
    own = _usable(events, "published_at").select(F.col("event_id").cast("string").alias("event_id"), "ticker", _micros("published_at").alias("_micros"))
    return own.join(_counted(instants(events, hits), starts), ["ticker", "_micros"]).select("event_id", "upto", "n_visible")


def newest_visible(events: DataFrame, hits: DataFrame, k: int = TOP_K, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each event and each of its k newest visible hits: event_id, n_visible, rank (1 is the newest), document_id, carried columns.

    Events that see nothing have one row without a hit. An event_id names one event.
    """
    starts = ticker_starts(_usable(hits, "available_at"))
    at = stage(instants(events, hits), "upto")
    # An event sees all of an instant's hits or none: only the k smallest ids of an instant can be among the newest.
    rows = _usable(hits, "available_at").select("ticker", _micros("available_at").alias("_micros"), "document_id", *carry)
    best = top_k(rows.withColumnRenamed("document_id", "_id"), ["ticker", "_micros"], [F.asc("_id")], k).withColumnRenamed("rank", "_r")
    best = best.join(at.select("ticker", "_micros", "upto"), ["ticker", "_micros"])
    placed = best.select((F.col("upto") - F.col("_r") + 1).alias("_place"), F.col("_id").alias("document_id"), *carry)
    counted = _counted(at, starts)
    ranks = F.sequence(F.lit(1).cast("long"), F.least(F.lit(k).cast("long"), "n_visible"))
    wanted = counted.select("*", F.explode_outer(F.when(F.col("n_visible") > 0, ranks)).alias("_r"))
    wanted = wanted.select("ticker", "_micros", "n_visible", F.col("_r").cast("int").alias("rank"), (F.col("upto") - F.col("_r") + 1).alias("_place"))
    found = stage(wanted.join(placed, "_place", "left").drop("_place"), "newest")
    every = events.select(F.col("event_id").cast("string").alias("event_id"), "ticker", _micros("published_at").alias("_micros"))
    shown = stage(every, "clocks").join(found, ["ticker", "_micros"], "left").fillna(0, ["n_visible"])
    return shown.select("event_id", "n_visible", "rank", "document_id", *carry)
