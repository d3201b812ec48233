"""Toxicity with a counterfactually regularised classifier.

A logistic model over the words of a text and their beginnings (so that
inflected forms count together). It is learned from labelled texts; for every
learning sentence that names a group, each identity term is also swapped for the
other terms of its set, and the squared change of the score's logit that a swap
makes is added to the loss. A group's mere mention then neither raises nor
lowers a score, which spares neutral sentences about a group.

Feature choice: a feature's number of texts by label is counted by Spark over
the learning rows; those that separate the labels best (by the z value of their
log odds) enter, `max_features` at most, and identity terms always. At most
`max_rows` labelled rows (smallest hash of the id first) take part in learning;
whole texts are read there and in scoring.

Nulls and edges: a null or empty text has no features and gets the model's
base rate; rows without a label or id don't take part in learning; without
labels of both kinds every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm.common import held_out, in_arrow, owners, slices, table, text_array, unused, with_columns, words
from hindcast.session import stage

MAX_ROWS = 20_000
MAX_FEATURES = 4096
MIN_TEXTS = 5
MIN_Z = 3.0
HEADS = (4, 5, 6, 7)
THRESHOLD = 0.3
SWAP_PENALTY = 1.0
RIDGE = 2e-4
STEPS = 400
STEP = 0.3
#: Sets of terms that are swapped for each other; a parameter of `learn`.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"), ("americans", "germans", "mexicans", "chinese", "africans", "europeans"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "einwanderer"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "immigrés"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "inmigrantes"),
)
SENTENCE_END = ".!?"


def features_of(word: str) -> tuple[str, ...]:
    """The word in small letters without marks at its ends, and its beginnings."""
    low = word.lower()
    start, stop = 0, len(low)
    while start < stop and not low[start].isalpha():
        start += 1
    while stop > start and not low[stop - 1].isalpha():
        stop -= 1
    low = low[start:stop]
    return (low, *(f"{low[:k]}*" for k in HEADS if len(low) > k)) if low else ()


def text_features(texts: pa.Array, numbers: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Distinct (text, feature number) pairs and the features by number; with `numbers` given only those."""
    ends, flat = words(texts)
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own: dict[str, int] = {} if numbers is None else numbers
    lists = []
    for w in coded.dictionary.to_pylist():
        if numbers is None:
            lists.append([own.setdefault(f, len(own)) for f in features_of(w)])
        else:
            lists.append([own[f] for f in features_of(w) if f in own])
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), list(own)
    numbered = np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    some = sizes[codes] > 0
    text, codes = owners(ends)[some], codes[some]
    key = np.unique(text * len(sizes) + codes)
    text, codes = key // len(sizes), key % len(sizes)
    n = sizes[codes]
    stops = np.cumsum(n)
    at = np.arange(int(stops[-1])) - np.repeat(stops - n, n) + np.repeat(first[codes], n)
    key = np.unique(np.repeat(text, n) * len(own) + numbered[at])
    return key // len(own), key % len(own), list(own)


def identity_swaps(text: str, terms: Sequence[Sequence[str]]) -> list[tuple[str, str]]:
    """(term, other) for each term in one of the text's sentences and each other term of its set."""
    others = {t: [o for o in group if o != t] for group in terms for t in group}
    found = []
    sentence_marks = str.maketrans(dict.fromkeys(SENTENCE_END, "\n"))
    for sentence in text.translate(sentence_marks).split("\n"):
        for w in sentence.split():
            for term in features_of(w)[:1]:
                found += [(term, other) for other in others.get(term, ())]
    return found


@dataclass
class Model:
    features: list[str]
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        numbers = {f: i for i, f in enumerate(self.features)}
        text, feature, _ = text_features(texts, numbers)
        logit = self.bias + np.bincount(text, weights=self.weights[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_logistic(
    text: np.ndarray, feature: np.ndarray, label: np.ndarray, n_features: int, swaps: np.ndarray, swap_weight: np.ndarray,
    swap_penalty: float = SWAP_PENALTY, ridge: float = RIDGE, steps: int = STEPS, step: float = STEP,
) -> tuple[np.ndarray, float]:
    """Weights of the logistic model with a penalty on each swap's change of the logit.

    text, feature: the pairs that are present. swaps: rows of (feature out,
    feature in, ...) as signed incidence [swap, feature] in triplets
    (swap, feature, sign); swap_weight: how often each swap occurs.
    """
    n = max(1, len(label))
    w, bias = np.zeros(n_features), float(np.log((label.mean() + 1e-3) / (1 - label.mean() + 1e-3))) if len(label) else 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    total = max(1.0, swap_weight.sum())
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(text, weights=w[feature], minlength=n), -30, 30)))
        error = p - label
        grad = np.bincount(feature, weights=error[text], minlength=n_features) / n + ridge * w
        if len(swap_weight):
            change = np.bincount(swaps[0], weights=swaps[2] * w[swaps[1]], minlength=len(swap_weight))
            grad += 2 * swap_penalty * np.bincount(swaps[1], weights=(swap_weight * change)[swaps[0]] * swaps[2], minlength=n_features) / total
        whole = np.append(grad, error.mean())
        m, v = 0.9 * m + 0.1 * whole, 0.99 * v + 0.01 * whole**2
        move = step * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias


def learn(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
    max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES,
) -> Model:
    """Learn from the labelled rows among docs (doc_id, text)."""
    spark = docs.sparkSession
    order = F.xxhash64("doc_id")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(order, "doc_id").limit(max_rows)
    # Bounded by max_rows, so the ids can go to all tasks.
    rows = stage(docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(stage(known, "labelled")), "doc_id"), "labelled-texts")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    if not n_bad or not n_good:
        return Model([], np.zeros(0), -30.0)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            who, what, names = text_features(text_array(batch.column("text")))
            y = batch.column("y").to_numpy(zero_copy_only=False)
            bad = np.bincount(what, weights=y[who], minlength=len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(bad), pa.array(np.bincount(what, minlength=len(names)) - bad)], names=["f", "bad", "good"]
            )

    by_feature = rows.transform(in_arrow, counts, "f string, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (n_bad - F.col("bad") + 0.5)) - F.log((F.col("good") + 0.5) / (n_good - F.col("good") + 0.5))
    spread = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    chosen = by_feature.filter(F.col("bad") + F.col("good") >= MIN_TEXTS).withColumn("z", odds / spread).filter(F.abs("z") >= MIN_Z)
    names = [r["f"] for r in chosen.orderBy(F.desc(F.abs("z")), "f").limit(max_features).select("f").collect()]
    names = list(dict.fromkeys([*names, *(t for group in terms for t in group)]))
    numbers = {f: i for i, f in enumerate(names)}
    sent = spark.sparkContext.broadcast((numbers, tuple(map(tuple, terms))))
    swapped_words = [t for group in terms for t in group]

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, groups = sent.value
        for batch in slices(batches, "text"):
            texts = text_array(batch.column("text"))
            who, what, _ = text_features(texts, own)
            stops = np.searchsorted(who, np.arange(len(texts) + 1))
            low = pa.compute.utf8_lower(texts)
            named = np.zeros(len(texts), bool)
            for t in swapped_words:
                named |= pa.compute.match_substring(low, t).to_numpy(zero_copy_only=False)
            swaps = [[f"{a}\t{b}" for a, b in identity_swaps(texts[i].as_py(), groups)] if named[i] else [] for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(what, pa.int64())), pa.array(swaps, pa.list_(pa.string()))],
                names=["y", "features", "swaps"],
            )

    # At most max_rows rows, each with chosen features only.
    got = rows.transform(in_arrow, present, "y int, features array<long>, swaps array<string>").toPandas()
    label_of = got["y"].to_numpy(float)
    n = np.array([len(x) for x in got["features"]], np.int64)
    feature = np.concatenate([np.asarray(x, np.int64) for x in got["features"]]) if n.sum() else np.zeros(0, np.int64)
    pairs: dict[str, int] = {}
    for found in got["swaps"]:
        for pair in found:
            pairs[pair] = pairs.get(pair, 0) + 1
    triplets: list[tuple[int, int, float]] = []
    for k, pair in enumerate(pairs):
        for word, sign in zip(pair.split("\t"), (-1.0, 1.0), strict=True):
            triplets += [(k, numbers[f], sign) for f in features_of(word) if f in numbers]
    swaps = [np.array(x) for x in zip(*triplets, strict=True)] if triplets else [np.zeros(0, int)] * 3
    weights, bias = fit_logistic(np.repeat(np.arange(len(got)), n), feature, label_of, len(names), swaps, np.array(list(pairs.values()), float))
    return Model(names, weights, bias)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted (with `_` before the name if docs has such a column)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    value, label = unused("score", docs.columns), unused("predicted", docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(value, T.DoubleType()), T.StructField(label, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            got = sent.value.scores(text_array(batch.column(text)))
            yield with_columns(batch, **{value: got, label: pa.array((got >= threshold).astype(np.int32))})

    return docs.transform(in_arrow, run, schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs.filter(~held_out(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
