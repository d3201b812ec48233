"""Language identification by prediction by partial matching.

Per language, a variable-order tree of byte contexts (up to ORDER bytes) holds
how often each byte followed each context in the learning texts. The statistics
are then frozen, and a text's score for a language is the exact length of its
code: a byte seen after the context costs by its count; an unseen one costs the
escape and is coded after the next shorter context, with the bytes already
excluded left out (method C: the escape counts as often as the context had
different bytes); under the shortest context all remaining bytes are alike.
The language with the shortest code wins.

Counting is a Spark aggregation over all learning texts: each task sums its
(language, context, byte) triples before the shuffle. The model keeps the
`max_contexts` most frequent contexts of each length, so its size is bounded
whatever the corpus; shorter contexts stand in for those left out. Scoring is
two table reads a byte for all languages at once.

Nulls and edges: a null or empty text, or one without a letter, is `und` with
score 0; learning skips null texts and languages; without any learning text
every text is `und`; equal code lengths go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm.common import held_out, in_arrow, slices, table, text_array, unused, with_columns
from hindcast.session import stage

ORDER = 3
MAX_CONTEXTS = 12_000
UNKNOWN = "und"
#: Bytes put before each text in learning and scoring.
LEAD = b"\n" * ORDER
COUNT_CHUNK = 4_000_000


def _lead(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts with LEAD before each; first and last position of each text's own bytes."""
    parts = [t.as_py().encode() for t in texts]
    sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    data = np.frombuffer(b"".join(x for p in parts for x in (LEAD, p)), np.uint8)
    stops = np.cumsum(sizes + ORDER)
    return data, stops - sizes, stops


def _grams(data: np.ndarray) -> np.ndarray:
    """At each position the byte and the ORDER bytes before it as one number (the first ORDER positions: 0)."""
    wide = data.astype(np.int64)
    gram = wide.copy()
    for k in range(1, ORDER + 1):
        gram[k:] |= wide[:-k] << (8 * k)
    gram[:ORDER] = 0
    return gram


def count_contexts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): how often each byte followed each context of ORDER bytes."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in pending.items():
                grams, which = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(which.reshape(-1), weights=np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])
            pending.clear()

        for batch in slices(batches, text):
            texts, langs = text_array(batch.column(text)), batch.column(lang)
            for name in pc.unique(langs).to_pylist():
                data, starts, stops = _lead(texts.filter(pc.equal(langs, name)))
                own = np.zeros(len(data) + 1, np.int64)
                np.add.at(own, starts, 1)
                np.add.at(own, stops, -1)
                grams, n = np.unique(_grams(data)[np.cumsum(own[:-1]) > 0], return_counts=True)
                pending.setdefault(name, []).append((grams, n))
                waiting += len(grams)
            if waiting > COUNT_CHUNK:
                yield from flush()
                waiting = 0
        yield from flush()

    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    return known.transform(in_arrow, run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Trees:
    """Frozen counts: per context length its contexts, and per language rows of (context, byte, count)."""

    langs: list[str]
    #: contexts[k]: sorted numbers of the contexts of k bytes.
    contexts: list[np.ndarray]
    #: counts[k]: (language, context index, byte, count).
    counts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    built: tuple | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"built": None}

    def tables(self) -> tuple[list[np.ndarray], np.ndarray]:
        """next context tables and the cost of each byte in bits, [context * 256 + byte, language]."""
        if self.built is None:
            self.built = _build(self)
        return self.built


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", max_contexts: int = MAX_CONTEXTS) -> Trees:
    """Count over all docs and keep the most frequent contexts of each length.

    What reaches the driver is bounded: max_contexts contexts a length, each
    with at most 256 bytes a language.
    """
    full = stage(count_contexts(docs, text, lang), "grams")
    langs = sorted(r[0] for r in full.select("lang").distinct().collect())
    contexts, counts = [np.zeros(1, np.int64)], []
    for k in range(ORDER + 1):
        grams = full.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
        grams = grams.select("lang", F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(F.lit(255)).alias("byte"), "n")
        if k:
            # A context counts with the sum of its counts; a context's parent is kept before it.
            parents = set(contexts[k - 1].tolist())
            top = grams.groupBy("context").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "context").limit(max_contexts)
            kept = [c for (c,) in top.select("context").collect() if (c & ((1 << (8 * (k - 1))) - 1)) in parents]
            contexts.append(np.array(sorted(kept), np.int64))
            ids = docs.sparkSession.createDataFrame([(int(c),) for c in contexts[k]], "context long")
            grams = grams.join(F.broadcast(ids), "context")
        got = grams.toPandas()
        counts.append(
            (
                np.searchsorted(langs, got["lang"].to_numpy(dtype=object)).astype(np.int16) if len(got) else np.zeros(0, np.int16),
                np.searchsorted(contexts[k], got["context"].to_numpy(np.int64)).astype(np.int32),
                got["byte"].to_numpy(np.int64).astype(np.uint8),
                got["n"].to_numpy(np.int64),
            )
        )
    return Trees(langs, contexts, counts)


def _build(trees: Trees) -> tuple[list[np.ndarray], np.ndarray]:
    """Row numbers of the contexts, longest first in use, and the cost table.

    Rows: contexts of length 0, then 1, 2, .... step[k][row of a k-byte context
    * 256 + the byte before it] is the row of the context that is one byte
    longer, or the same row if that one isn't kept.
    """
    base = np.cumsum([0, *map(len, trees.contexts)])
    steps = []
    for k in range(ORDER):
        short, long = trees.contexts[k], trees.contexts[k + 1]
        step = np.repeat(np.arange(len(short)) + base[k], 256)
        parent = np.searchsorted(short, long & ((1 << (8 * k)) - 1))
        step[parent * 256 + (long >> (8 * k))] = base[k + 1] + np.arange(len(long))
        steps.append(step.astype(np.int32))
    cost = np.empty((int(base[-1]) * 256, len(trees.langs)), np.float32)
    for which in range(len(trees.langs)):
        count = [np.zeros((len(c), 256), np.float32) for c in trees.contexts]
        for k, (lang, context, byte, n) in enumerate(trees.counts):
            mine = lang == which
            count[k][context[mine], byte[mine]] = n[mine]
        for k, own in enumerate(trees.contexts):
            up = [np.searchsorted(trees.contexts[j], own & ((1 << (8 * j)) - 1)) for j in range(k + 1)]
            for at in range(0, len(own), 2000):
                part = slice(at, at + 2000)
                p = np.zeros((len(own[part]), 256), np.float64)
                open_mass = np.ones((len(p), 1))
                excluded = np.zeros(p.shape, bool)
                for j in range(k, -1, -1):
                    n = np.where(excluded, 0, count[j][up[j][part]])
                    seen = n > 0
                    distinct = seen.sum(1, keepdims=True)
                    total = n.sum(1, keepdims=True, dtype=np.float64)
                    # No escape is needed once every byte has been seen.
                    left = (excluded | seen).sum(1, keepdims=True) < 256
                    whole = total + np.where(left, distinct, 0)
                    some = total > 0
                    p += np.where(some, open_mass * n / np.where(some, whole, 1), 0)
                    open_mass = np.where(some, open_mass * np.where(left, distinct, 0) / np.where(some, whole, 1), open_mass)
                    excluded |= seen
                rest = (~excluded).sum(1, keepdims=True)
                p += np.where(excluded, 0, open_mass / np.maximum(rest, 1))
                cost[(base[k] + at) * 256 : (base[k] + at) * 256 + p.size, which] = -np.log2(p).reshape(-1)
    return steps, cost


def code_lengths(trees: Trees, texts: pa.Array) -> np.ndarray:
    """Bits of each text under each language, [text, language]."""
    steps, cost = trees.tables()
    data, starts, stops = _lead(texts)
    wide = data.astype(np.int32)
    row = np.zeros(len(data), np.int32)
    first = 0
    for k, step in enumerate(steps):
        before = np.zeros(len(data), np.int32)
        before[k + 1 :] = wide[: len(data) - k - 1]
        # A row below `first` is a shorter context that already found no longer one.
        grown = row >= first
        row = np.where(grown, step[np.where(grown, row - first, 0) * 256 + before], row)
        first += len(trees.contexts[k])
    at = row.astype(np.int64) * 256 + data
    out = np.empty((len(texts), len(trees.langs)))
    for k in range(len(trees.langs)):
        upto = np.concatenate(([0.0], np.cumsum(cost[at, k], dtype=np.float64)))
        out[:, k] = upto[stops] - upto[starts]
    return out


def identify(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (share of the best language among all, by code length) and bits (of the best).

    A name that docs has already gets `_` before it.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(trees)
    names = np.array([*trees.langs, UNKNOWN], dtype=object)
    lang_name, score_name, bits_name = (unused(c, docs.columns) for c in ("lang_pred", "score", "bits"))
    extra = [T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType()), T.StructField(bits_name, T.DoubleType())]
    schema = T.StructType([*docs.schema.fields, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = model.value
        for batch in slices(batches, text):
            texts = text_array(batch.column(text))
            n = len(texts)
            best, score, bits = np.full(n, len(frozen.langs)), np.zeros(n), np.zeros(n)
            told = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            if frozen.langs:
                lengths = code_lengths(frozen, texts)
                winner = lengths.argmin(1)
                least = lengths[np.arange(n), winner]
                share = 1 / np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(1)
                best, score, bits = np.where(told, winner, best), np.where(told, share, 0.0), np.where(told, least, 0.0)
            yield with_columns(batch, **{lang_name: pa.array(names[best], pa.string()), score_name: score, bits_name: bits})

    return docs.transform(in_arrow, run, schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = learn(docs.filter(~held_out(F.col("doc_id"))))
    scored = identify(docs.select("doc_id", "text"), trees)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
