"""Headline sentiment in [-1, 1]."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.risk import sentiment_from_probs
from hindcast.functions.text import lexicon_sentiment
from hindcast.operators.scale import skew_join
from hindcast.session import stage

Predictor = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

# FIXED VALUES: stand-in word lists, used when no predictor is given.
POSITIVE_WORDS = (
    "beat", "beats", "gain", "gains", "growth", "high", "jump", "jumps", "profit", "raise",
    "raises", "rally", "record", "rise", "rises", "strong", "surge", "surges", "upgrade", "win",
)
NEGATIVE_WORDS = (
    "bankruptcy", "cut", "cuts", "decline", "downgrade", "drop", "drops", "fall", "falls", "fraud",
    "lawsuit", "loss", "low", "miss", "misses", "plunge", "probe", "recall", "weak", "warning",
)


def score_sentiment(
    df: DataFrame,
    text: str = "headline",
    out: str = "finbert_sentiment",
    predict: Predictor | None = None,
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
) -> DataFrame:
    """Add a sentiment column.

    `predict` takes frames with the text column and yields them with columns
    `positive` and `negative` (class probabilities); it runs in Arrow batches
    on distinct texts only, one model load per worker. Without it the word
    lists are used, as a plain expression.
    """
    if predict is None:
        return df.withColumn(out, lexicon_sentiment(F.col(text), list(positive), list(negative)))
    scored = (
        df.select(text)
        .filter(F.col(text).isNotNull())
        .distinct()
        .mapInPandas(predict, schema=f"`{text}` string, positive double, negative double")
        .select(text, sentiment_from_probs(F.col("positive"), F.col("negative")).alias(out))
    )
    # Staged, so that a lost executor never runs the model twice; a headline
    # shared by very many rows is joined over salts.
    joined, _ = skew_join(df, stage(scored, "sentiment"), [text], "left", F.struct(*df.columns))
    return joined.drop("_salt")


def sentiment_resume(
    df: DataFrame,
    existing: str = "existing_sentiment",
    text: str = "headline",
    out: str = "finbert_sentiment",
    **options,
) -> DataFrame:
    """Keep scores that exist and compute only the missing ones."""
    if options.get("predict") is None:
        # A plain expression: no second branch, and rows with a score skip it.
        fresh = score_sentiment(df, text, "_fresh", **options)
        return fresh.withColumn(out, F.coalesce(F.col(existing), F.col("_fresh"))).drop("_fresh")
    todo = score_sentiment(df.filter(F.col(existing).isNull()), text, out, **options)
    done = df.filter(F.col(existing).isNotNull()).withColumn(out, F.col(existing))
    return done.unionByName(todo)


def skip_sentiment(df: DataFrame, out: str = "finbert_sentiment") -> DataFrame:
    """Development mode: no scores. Sinks refuse the canonical path for it."""
    return df.withColumn(out, F.lit(0.0))
