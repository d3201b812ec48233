"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over SPAN neighbouring words; only the words under its
ones are hashed, so a replaced word under a zero doesn't hide a passage. Seed
hashes of the documents are joined with those of the benchmark, and around each
hit the document and the item are compared word by word on that alignment: the
best stretch counts an equal word as 1 and a substitution as -`penalty`. A
document is contaminated by an item if the stretch has `min_overlap` equal words,
or all words of a shorter item. Items with fewer words than a mask covers are
searched whole. The masks miss no such stretch of MIN_OVERLAP equal words; a
smaller `min_overlap` or `penalty` needs other masks.

Words are compared in small letters and without marks at their ends; words of
marks only are passed over. The benchmark side is cut into blocks of at most
`block_words` words, each sent to all tasks; a larger benchmark means more passes
over the documents, not a larger broadcast. Documents are never shuffled.

Nulls: a null text has no words; a null item matches nothing. Every row of the
documents is judged by itself, so repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm.common import GOLDEN, hash_strings, in_arrow, mix64, n_words, slices, table, text_array, words
from hindcast.session import stage

#: One of them hits every stretch of MIN_OVERLAP equal words that gains from both ends on at PENALTY or more (proved in the tests).
MASKS = ("1110111", "11101101", "10110111", "1111000101", "1110100011")
MIN_OVERLAP = 10
PENALTY = 2
BLOCK_WORDS = 2_000_000
FILTER_BITS = 22
CHUNK = 2_000_000
FOUND = ("item_id", "doc_start", "item_start", "n_span", "n_same")


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each text's words, and a hash for each word in its plain form."""
    ends, flat = words(texts)
    coded = flat.dictionary_encode()
    plain = pa.compute.utf8_trim(pa.compute.utf8_lower(coded.dictionary), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»„“”‘’…–—")
    empty = (pa.compute.binary_length(plain).to_numpy(zero_copy_only=False) == 0) if len(plain) else np.zeros(0, bool)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kept = ~empty[codes]
    upto = np.concatenate(([0], np.cumsum(kept)))
    return upto[ends], hash_strings(plain)[codes[kept]]


def seed_hashes(hashes: np.ndarray, places: Sequence[int]) -> np.ndarray:
    """At each position the hash of the words at the given places from it."""
    n = len(hashes) - places[-1]
    out = np.full(max(0, n), len(places), np.uint64)
    for k in places if n > 0 else ():
        out = (out ^ hashes[k : k + n]) * GOLDEN
        out ^= out >> np.uint64(29)
    return mix64(out)


@dataclass
class Index:
    """One block of the benchmark: its words, and per mask the sorted seed hashes with their positions."""

    items: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    seeds: list[tuple[tuple[int, ...], np.ndarray, np.ndarray]]
    #: One bit for each value of the low FILTER_BITS of a seed hash, over all masks.
    passes: np.ndarray

    @staticmethod
    def of(items: np.ndarray, texts: pa.Array, masks: Sequence[str]) -> Index:
        ends, hashes = plain_words(texts)
        size = np.diff(ends)
        seeds, passes = [], np.zeros(1 << FILTER_BITS, bool)
        shortest = min(map(len, masks))
        plans = [(tuple(k for k, c in enumerate(m) if c == "1"), len(m)) for m in masks]
        # Short items: all their words in a row, one plan for each length in use.
        plans += [(tuple(range(n)), -n) for n in sorted(set(size[(size > 0) & (size < shortest)].tolist()))]
        for places, span in plans:
            h = seed_hashes(hashes, places)
            at = np.arange(len(h))
            item = np.searchsorted(ends, at, side="right") - 1
            fits = (at + abs(span) <= ends[item + 1]) & ((size[item] == -span) if span < 0 else True)
            at = at[fits]
            order = np.argsort(h[at], kind="stable")
            seeds.append((places, h[at][order], at[order]))
            passes[(h[at] & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        return Index(items, ends, hashes, seeds, passes)


def _stretches(same: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each segment of `same` its best stretch: first, end (within the segment) and equal words."""
    n = len(sizes)
    # One prefix sum more than places in each segment; later segments lie lower, so that minima don't cross.
    first = starts + np.arange(n)
    place = np.arange(len(same)) + np.repeat(np.arange(n), sizes) + 1
    gains = np.zeros(len(same) + n, np.int64)
    gains[place] = np.where(same, 1, -penalty)
    deep = (penalty + 1) * (int(sizes.max(initial=0)) + 2)
    gains[first] = -deep * 2
    prefix = np.cumsum(gains)
    # Undo the sum of the segment before, so that each begins at its own level.
    prefix -= np.repeat(prefix[first] + 2 * deep * np.arange(n), sizes + 1)
    low = np.minimum.accumulate(prefix)
    index = np.arange(len(prefix))
    origin = np.maximum.accumulate(np.where(prefix == low, index, 0))
    gain = prefix - low
    best = np.maximum.reduceat(gain, first)
    segment = np.repeat(np.arange(n), sizes + 1)
    at = np.flatnonzero(gain == best[segment])
    end = at[np.unique(segment[at], return_index=True)[1]]
    begin = origin[end]
    equal = np.concatenate(([0], np.cumsum(same)))
    shift = np.arange(n)
    return begin - first, end - first, equal[end - shift] - equal[begin - shift]


def find(texts: pa.Array, index: Index, min_overlap: int = MIN_OVERLAP, penalty: int = PENALTY) -> dict[str, np.ndarray]:
    """Contaminating items by text: `text` (its index) and FOUND, one best stretch for each text and item."""
    ends, hashes = plain_words(texts)
    low = np.uint64((1 << FILTER_BITS) - 1)
    found = []
    for places, sorted_hashes, positions in index.seeds:
        h = seed_hashes(hashes, places)
        at = np.flatnonzero(index.passes[(h & low).astype(np.int64)])
        a = np.searchsorted(sorted_hashes, h[at], side="left")
        n = np.searchsorted(sorted_hashes, h[at], side="right") - a
        at, a, n = at[n > 0], a[n > 0], n[n > 0]
        text = np.searchsorted(ends, at, side="right") - 1
        inside = at + places[-1] < ends[text + 1]
        at, a, n = at[inside], a[inside], n[inside]
        stops = np.cumsum(n)
        if len(stops):
            q = positions[np.arange(int(stops[-1])) - np.repeat(stops - n, n) + np.repeat(a, n)]
            p = np.repeat(at, n)
            # An alignment is a text, an item and the distance of their words.
            found.append(np.unique(np.stack([np.searchsorted(ends, p, side="right") - 1, np.searchsorted(index.ends, q, side="right") - 1, p - q]), axis=1))
    empty = {c: np.zeros(0, np.int64) for c in ("text", "item", *FOUND[1:])}
    if not found:
        return empty
    text, item, shift = np.unique(np.concatenate(found, axis=1), axis=1)
    first = np.maximum(index.ends[item], ends[text] - shift)
    size = np.minimum(index.ends[item + 1], ends[text + 1] - shift) - first
    parts = []
    heavy = np.cumsum(size) // CHUNK
    for k in np.unique(heavy):
        own = heavy == k
        t, i, s, f, n = text[own], item[own], shift[own], first[own], size[own]
        stops = np.cumsum(n)
        q = np.arange(int(stops[-1])) - np.repeat(stops - n, n) + np.repeat(f, n)
        begin, end, same = _stretches(index.hashes[q] == hashes[q + np.repeat(s, n)], stops - n, n, penalty)
        need = np.minimum(min_overlap, index.ends[i + 1] - index.ends[i])
        good = same >= need
        parts.append(np.stack([t, i, f + begin + s - ends[t], f + begin - index.ends[i], end - begin, same])[:, good])
    rows = np.concatenate(parts, axis=1)
    # The best for each text and item; ties go to the first in the text.
    rows = rows[:, np.lexsort((rows[3], rows[2], -rows[5], rows[1], rows[0]))]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
    return dict(zip(empty, rows[:, new], strict=True))


def indexes(benchmark: DataFrame, text: str = "text", masks: Sequence[str] = MASKS, block_words: int = BLOCK_WORDS) -> Iterator[Index]:
    """The benchmark in blocks of about block_words words (a longer item stands alone)."""
    items = stage(benchmark.filter(F.col(text).isNotNull()).select("item_id", F.col(text).alias("text"), n_words(F.col(text)).alias("_n")), "benchmark")
    total = items.agg(F.sum("_n")).first()[0] or 0
    blocks = 1 + total // block_words
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        got = part.select("item_id", "text").toArrow().combine_chunks()
        if got.num_rows:
            yield Index.of(got.column("item_id").to_numpy(), text_array(got.column("text")), masks)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """One row for each document and item that it contains: doc_id, item_id, doc_start and item_start (words), n_span, n_same."""
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in FOUND]])
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = spark.createDataFrame([], schema)
    for index in indexes(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                got = find(text_array(batch.column("text")), sent.value, min_overlap)
                ids = batch.column("doc_id").take(pa.array(got["text"]))
                columns = [ids, pa.array(sent.value.items[got["item"]].astype(np.int64)), *[pa.array(got[c].astype(np.int64)) for c in FOUND[1:]]]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

        out = out.unionByName(narrow.transform(in_arrow, run, schema))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """The documents without any benchmark item, columns unchanged."""
    spark = docs.sparkSession
    for index in indexes(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text):
                got = find(text_array(batch.column(text)), sent.value, min_overlap)
                clean = np.ones(batch.num_rows, bool)
                clean[got["text"]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.transform(in_arrow, run, docs.schema)
    return docs


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
