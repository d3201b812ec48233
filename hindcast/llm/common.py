"""Column and Arrow helpers shared by the text operators.

A word is a run of bytes other than space and \\x09-\\x0D. Arrow batches are cut
into slices of bounded size, so that memory in a task follows the slice and the
longest single text, not the partition.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from hindcast.operators.scale import small
from hindcast.session import stage

WORD = "[^\\x20\\x09-\\x0D]+"
BATCH_BYTES = "16m"
SLICE_BYTES = 2_000_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def give_back() -> None:
    """Return freed memory to the system: workers live on idle between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


_remembered: list = []


def remembered(maxsize: int) -> Callable:
    """lru_cache for what a worker keeps from task to task; tasks of other modules drop it."""

    def wrap(make: Callable) -> Callable:
        kept = lru_cache(maxsize)(make)
        _remembered.append(kept)
        return kept

    return wrap


def forget_others(module: str) -> None:
    for kept in _remembered:
        if kept.__module__ != module:
            kept.cache_clear()


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow whose workers keep no memory after a task but what `run`'s module remembers."""
    module = run.__module__

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(module)
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(once, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one file may hold.
FILE_ROWS_BITS = 40


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number for each row: its file's place among all file names, and its place in the file.

    It is the same in every scan, however files are split over tasks then. docs is a
    Parquet table, filtered or with columns selected at most; other frames (and tables
    of other formats) are written first. File names reach the driver, as they do when
    Spark lists the files.
    """
    path, place = unused("_path", docs.columns), unused("_place", docs.columns)
    try:
        meta = docs.metadataColumn("_metadata")
        placed = docs.select("*", meta["file_path"].alias(path), meta["row_index"].alias(place))
    except AnalysisException:  # not read from Parquet files
        return numbered(stage(docs, "unnumbered"), name)
    paths = sorted(r[0] for r in placed.select(path).distinct().collect())
    file = unused("_file", docs.columns)
    files = docs.sparkSession.createDataFrame(list(enumerate(paths)), f"{file} long, {path} string")
    number = F.shiftleft(file, FILE_ROWS_BITS).bitwiseOR(F.col(place))
    return placed.join(small(files, len(paths)), path).select(*docs.columns, number.alias(name))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id's text, modulo 4, is 2. A null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def unused(wanted: str, taken: list[str]) -> str:
    """A column name that no input column has."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = f"_{wanted}"
    return wanted


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each (one more than texts), both starting at 0."""
    n = len(texts)
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], dtype=np.int32, count=n + 1, offset=4 * texts.offset) if n else np.zeros(1, np.int32)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends.astype(np.int64) - int(ends[0])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices whose texts hold about `limit` bytes at most (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = int(total[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's words, and all words in order."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    ends = lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    some = pc.greater(pc.binary_length(flat), 0)
    kept = some.to_numpy(zero_copy_only=False)
    if kept.all():
        return ends, flat
    upto = np.concatenate(([0], np.cumsum(kept)))
    return upto[ends], flat.filter(some)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets, an exact code for each word, and the distinct words by code."""
    ends, flat = words(texts)
    coded = flat.dictionary_encode()
    return ends, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (multiply and shift, wrapping)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= MIX
    x ^= x >> np.uint64(29)
    x *= GOLDEN
    x ^= x >> np.uint64(32)
    return x


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hashes of each string's bytes."""
    import xxhash

    data, ends = raw(text_array(values))
    whole = data.tobytes()
    stops = ends.tolist()
    return np.fromiter(
        (xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(stops[:-1], stops[1:], strict=True)), dtype=np.uint64, count=len(values)
    )


def owners(ends: np.ndarray) -> np.ndarray:
    """For each item the index of the text that it belongs to."""
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends))


def per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of each text's values (empty texts: 0)."""
    upto = np.concatenate((np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)))
    return upto[ends[1:]] - upto[ends[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def with_columns(batch: pa.RecordBatch, **columns: object) -> pa.RecordBatch:
    arrays = list(batch.columns) + [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *columns])
