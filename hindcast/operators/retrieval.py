"""What an event was allowed to see: as-of filter and top-k retrieval."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.fixed_values import HIT_LINE, NO_CONTEXT_LINE, OVERFETCH, PROMPT_BODY, REPAIR_NOTE, TOP_K
from hindcast.functions.clocks import iso_utc
from hindcast.functions.text import fixed
from hindcast.functions.vectors import unit
from hindcast.operators.cells import search
from hindcast.operators.scale import skew_join, top_k

BLOCK_ROWS = 2048


def visible(available_at: str = "available_at", published_at: str = "published_at") -> Column:
    """A hit may be seen from its own instant on; equality counts."""
    return F.col(available_at) <= F.col(published_at)


def filter_as_of(hits: DataFrame) -> DataFrame:
    """Hits that already carry their event's clock."""
    return hits.filter(visible())


def filter_nested_as_of(hits: Column, published_at: Column) -> Column:
    """The same rule on an array of hits."""
    return F.filter(hits, lambda h: h["available_at"] <= published_at)


def join_hits_asof(events: DataFrame, hits: DataFrame, min_hot_rows: int | None = None) -> tuple[DataFrame, bool]:
    """Event x its own sidecar hits, future ones removed; linear in the hits.

    Adaptive execution splits the join of a very common event. Only with
    `min_hot_rows` are keys counted first and the hot ones salted; the second
    value tells whether salts are in use.
    """
    clocks = events.select("event_id", "published_at")
    if min_hot_rows is None:
        return filter_as_of(hits.join(clocks, "event_id")), False
    joined, salted = skew_join(hits, clocks, ["event_id"], "inner", F.col("document_id"), min_hot_rows)
    return filter_as_of(joined), salted


def topk_hits(
    events: DataFrame, hits: DataFrame, k: int = TOP_K, min_hot_rows: int | None = None
) -> DataFrame:
    """The k best visible hits per event, ties by document id."""
    seen, salted = join_hits_asof(events, hits, min_hot_rows)
    return top_k(seen, ["event_id"], [F.desc("score"), F.asc("document_id")], k, salted)


@dataclass(frozen=True)
class _block_top:  # noqa: N801
    """Top-k of one block of events against one block of points."""

    k: int
    as_of: bool
    include_self: bool

    def best(self, e_vectors, e_clock, e_points, p_vectors, p_clock, p_ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of events and points, and scores; points are ordered by id."""
        sims = np.round(e_vectors @ p_vectors.T, 9)
        if self.as_of:
            sims[p_clock[None, :] > e_clock[:, None]] = -np.inf
        if not self.include_self:
            sims[p_ids[None, :] == e_points[:, None]] = -np.inf
        # Points are ordered by id, and ties go to the smaller id: take what is
        # as good as the k-th, then sort only that.
        if self.k < sims.shape[1]:
            kth = np.partition(sims, -self.k, axis=1)[:, -self.k]
            row, col = np.nonzero((sims >= kth[:, None]) & (sims > -np.inf))
        else:
            row, col = np.nonzero(sims > -np.inf)
        score = sims[row, col]
        order = np.lexsort((col, -score, row))
        row, col, score = row[order], col[order], score[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        return row[kept], col[kept], score[kept]

    def __call__(self, events: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if events.empty or points.empty:
            return pd.DataFrame({"event_id": [], "point_id": [], "available_at": [], "score": []})
        points = points.sort_values("point_id", ignore_index=True)
        clock, ids = points["available_at"].to_numpy(), points["point_id"].to_numpy()
        row, col, score = self.best(
            np.stack(events["vector"]), events["published_at"].to_numpy(), events["point_id"].to_numpy(), np.stack(points["vector"]), clock, ids
        )
        return pd.DataFrame({"event_id": events["event_id"].to_numpy()[row], "point_id": ids[col], "available_at": clock[col], "score": score})


def split_vectors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a unit vector, and those that can't be compared (no vector, or one without length), to be counted."""
    scaled = df.withColumn("vector", unit(F.col("vector")))
    return scaled.filter(F.col("vector").isNotNull()), scaled.filter(F.col("vector").isNull())


def vector_topk_join(
    events: DataFrame,
    points: DataFrame,
    k: int = TOP_K,
    as_of: bool = True,
    include_self: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact k most similar points of the same ticker per event, as whole hits.

    events(event_id, point_id, ticker, published_at, vector) and
    points(point_id, ticker, available_at, vector, ...); further columns of the
    points come with the hits. Rows without a usable vector match nothing
    (`split_vectors` counts them). Where a ticker has more than `block_rows` rows
    on a side, both sides are cut into cells of at most that many rows, and
    cells that cannot hold a hit are skipped (see `cells`); otherwise a ticker is
    one block. A task compares one tile of blocks with another and emits k rows per event;
    a second, group-limited pass merges the tiles, and payloads are fetched for what
    is left.
    """
    # Fresh column identities: events and points may come from the same table.
    fresh = lambda d, *names: d.select(*[F.col(n).alias(n) for n in (*names, "vector")])
    e, _ = split_vectors(fresh(events, "event_id", "point_id", "ticker", "published_at"))
    p, _ = split_vectors(fresh(points, "point_id", "ticker", "available_at"))
    kernel = _block_top(k, as_of, include_self)
    found = "event_id {0}, point_id {1}, available_at {2}, score double".format(
        *(d.schema[c].dataType.simpleString() for d, c in ((e, "event_id"), (p, "point_id"), (p, "available_at")))
    )
    if one_block_each(events, points, block_rows):
        best = e.groupBy("ticker").cogroup(p.groupBy("ticker")).applyInPandas(lambda ours, theirs: kernel(ours, theirs), found)
    else:
        best = search(e, p, k, as_of, block_rows, kernel, found).best
    top = top_k(best, ["event_id"], [F.desc("score"), F.asc("point_id")], k)
    payload = [c for c in points.columns if c not in ("vector", "available_at")]
    return top.join(points.select(*[F.col(c).alias(c) for c in payload]), "point_id") if len(payload) > 1 else top


def one_block_each(events: DataFrame, points: DataFrame, block_rows: int) -> bool:
    """No ticker has more than `block_rows` rows on either side."""
    rows = events.select("ticker", F.lit(1).alias("e"), F.lit(0).alias("p")).unionByName(points.select("ticker", F.lit(0).alias("e"), F.lit(1).alias("p")))
    largest = rows.groupBy("ticker").agg(F.sum("e").alias("e"), F.sum("p").alias("p")).agg(F.max(F.greatest("e", "p"))).first()[0]
    return (largest or 0) <= block_rows


def overfetch_topk(
    events: DataFrame, points: DataFrame, k: int = TOP_K, factor: int = OVERFETCH, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The other mode: best `factor * k` first, then as-of, then k.

    May return fewer than k although more visible points exist.
    """
    wide = vector_topk_join(events, points, factor * k, as_of=False, block_rows=block_rows).drop("rank")
    seen = filter_as_of(wide.join(events.select("event_id", "published_at"), "event_id"))
    return top_k(seen, ["event_id"], [F.desc("score"), F.asc("point_id")], k)


def nested_hits(top: DataFrame) -> DataFrame:
    """At most k hits per event as one ordered array."""
    hit = F.struct("rank", "document_id", "text", "ticker", "available_at", "source", "score")
    return top.groupBy("event_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))


def context_text(hits: Column) -> Column:
    lines = F.transform(
        hits,
        lambda h: F.format_string(
            HIT_LINE, h["document_id"], fixed(h["score"], 3), iso_utc(h["available_at"]), h["text"]
        ),
    )
    return F.when(F.coalesce(F.size(hits), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(F.lit(NO_CONTEXT_LINE))


def context_prompt(events: DataFrame, top: DataFrame, repair: Column | None = None) -> DataFrame:
    """Prompt text per event from its ordered hits (at most k of them)."""
    joined = events.join(nested_hits(top), "event_id", "left")
    body = F.format_string(
        PROMPT_BODY,
        F.col("event_id").cast("string"), F.col("ticker"), iso_utc(F.col("published_at")), F.col("headline"),
        context_text(F.col("hits")),
    )
    if repair is not None:
        note = F.when(F.length(repair) > 0, F.format_string(REPAIR_NOTE, repair)).otherwise(F.lit(""))
        body = F.concat(body, F.coalesce(note, F.lit("")))
    return joined.select("event_id", F.coalesce(F.size("hits"), F.lit(0)).alias("n_hits"), body.alias("prompt"))


def embed_unit(df: DataFrame, text_col: str = "text", size: int = 384, encode_text=None) -> DataFrame:
    """Add a unit `vector`.

    `encode_text` is an iterator function over pandas frames that adds a
    `vector` column (one model load per worker). Without it, hashed word
    counts stand in, with no Python in the plan.
    """
    if encode_text is not None:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        raw = df.mapInPandas(encode_text, schema=f"{fields}, vector array<float>")
        return raw.withColumn("vector", unit(F.col("vector")))
    words = RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=size)
    scaled = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0)
    hashed = scaled.transform(counts.transform(words.transform(df)))
    return hashed.withColumn("vector", vector_to_array("_unit")).drop("_words", "_counts", "_unit")
