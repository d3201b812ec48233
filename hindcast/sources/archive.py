"""A quoted text archive, split freely over tasks.

A quoted field may hold line ends, so whether a line starts a row depends on all
quotes before it in the file. Reading such files whole makes one task of each. Here
a file is read by its lines, in whatever ranges the reader deals out:

1. Every task walks its range's lines in order and notes, for both states in which
   the range may begin (at a row's start, or inside quotes), the state before and
   after each line and the last row start. The noted lines are written once.
2. A range maps either state to a state: it keeps it, swaps it or sets it. A window
   over the ranges of a file (one row for each range) composes these maps: the last
   range that sets the state, and the parity of the swaps since.
3. With the true state, lines that are a row by themselves are rows where they
   stand; only lines of rows that go over line ends are shuffled, by their row's start.

A row is numbered by its byte offset (files in the order of their paths, each
behind the one before), which does not depend on how the files were split.

The rules are those of the engine's own reader for whole files (quote and escape
are the double quote): a quote opens a field only at its start, a doubled quote is
a quote, and a closing quote followed by anything but a comma leaves the
field open to the next comma. Only a NUL, which that reader drops before a quote or at
a row's end, and U+FFFF, at which it breaks off, are kept here. Empty lines are skipped. A file whose first line ends
in CR LF has such line ends, and they are read as LF inside quotes too; a lone CR
ends no line. A file that ends inside quotes is refused with the place of
its last row, as everything behind it would be one row.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.operators.scale import bounded, computed_once
from hindcast.session import stage


class SourceError(ValueError):
    """An input does not have the required shape."""


#: r_: as if the range began at a row's start; q_: as if inside quotes. at, r_start and q_start count from the range's first line; -1: none yet.
NOTED = "file string, block long, at long, size long, value binary, cr boolean, r_in boolean, q_in boolean, r_out boolean, q_out boolean, r_start long, q_start long"

#: Without an escape of the escape, NUL would count as one and be dropped.
RULES = {"escape": '"', "charToEscapeQuoteEscaping": '"'}
#: Read for nothing between commas, so that a quoted empty text is not taken for it.
NOTHING = "\x01"
#: The parser breaks off at U+FFFF outside of quotes, so another character stands for it there.
HIDDEN = [("\x02", "\x02a"), ("\uffff", "\x02b")]


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line that begins inside quotes, or at a row's start, ends inside quotes."""
    at = 0
    while True:
        if inside:
            quote = line.find(b'"', at)
            if quote < 0:
                return True
            if line[quote + 1 : quote + 2] == b'"':
                at = quote + 2
                continue
            comma = line.find(b",", quote + 1)
            if comma < 0:
                return False
            at, inside = comma + 1, False
        elif line[at : at + 1] == b'"':
            at, inside = at + 1, True
        else:
            opening = line.find(b',"', at)
            if opening < 0:
                return False
            at, inside = opening + 2, True


class _Range:
    """The walk over one range of a file, batch after batch."""

    def __init__(self) -> None:
        self.at = 0
        self.state = [False, True]
        self.start = [-1, -1]

    def note(self, values: pa.Array) -> list[np.ndarray]:
        """at, size, and for both beginnings: state before, state after, last row start."""
        n = len(values)
        size = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        at = self.at + np.cumsum(size) - size
        self.at += int(size.sum())
        quoted = np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))
        lines = values.take(pa.array(quoted)).to_pylist()
        before, after, starts = [], [], []
        for k in (0, 1):
            state, found = self.state[k], np.empty(len(quoted) + 1, bool)
            found[0] = state
            for i, line in enumerate(lines):
                state = found[i + 1] = ends_inside(line, state)
            # A line without quotes leaves the state as it is.
            own = found[np.searchsorted(quoted, np.arange(n), side="left")]
            before.append(own)
            after.append(np.append(own[1:], state))
            starts.append(np.maximum(np.maximum.accumulate(np.where(own, -1, at)), self.start[k]))
            self.state[k], self.start[k] = bool(state), int(starts[k][-1])
        return [at, size, before[0], before[1], after[0], after[1], starts[0], starts[1]]


def _note_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in NOTED.split(", ")]
    here, walk = None, _Range()
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column(0), batch.column(1)
        changed = np.flatnonzero(
            np.append(True, pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False) | pc.not_equal(block[1:], block[:-1]).to_numpy(zero_copy_only=False))
        )
        for a, b in zip(changed.tolist(), [*changed[1:].tolist(), batch.num_rows], strict=True):
            key = (file[a].as_py(), block[a].as_py())
            if key != here:
                here, walk = key, _Range()
            part = batch.slice(a, b - a)
            noted = walk.note(part.column(2))
            columns = [part.column(0), part.column(1), pa.array(noted[0]), pa.array(noted[1]), part.column(2), pc.ends_with(part.column(2), "\r"), *[pa.array(x) for x in noted[2:]]]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def noted_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines with both possible states, written once."""
    lines = spark.read.option("lineSep", "\n").text(path)
    narrow = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    return stage(narrow.mapInArrow(_note_lines, NOTED), "archive-lines")


def settled_ranges(lines: DataFrame) -> DataFrame:
    """For each range (file, block): its true first state, its offset, and the last row start before it."""
    ranges = lines.groupBy("file", "block").agg(
        F.max(F.col("at") + F.col("size")).alias("bytes"),
        F.max_by("r_out", "at").alias("r_out"), F.max_by("q_out", "at").alias("q_out"),
        F.max("r_start").alias("r_start"), F.max("q_start").alias("q_start"), F.min_by("cr", "at").alias("cr"),
    )
    # A row for each range of a file, not of its lines.
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sets, swaps = F.col("r_out") == F.col("q_out"), (F.col("r_out") & ~F.col("q_out")).cast("int")
    counted = ranges.withColumn("swaps", F.sum(swaps).over(upto)).withColumn("set", F.when(sets, F.struct("r_out", "swaps")))
    last_set = F.last("set", ignorenulls=True).over(before)
    swaps_before = F.coalesce(F.last("swaps").over(before), F.lit(0))
    value = F.coalesce(last_set["r_out"].cast("int"), F.lit(0)) + swaps_before - F.coalesce(last_set["swaps"], F.lit(0))
    known = counted.withColumns({"inside": value % 2 == 1, "offset": F.coalesce(F.sum("bytes").over(before), F.lit(0))})
    own = F.when(F.col("inside"), F.col("q_start")).otherwise(F.col("r_start"))
    known = known.withColumn("last_start", F.when(own >= 0, own + F.col("offset")))
    known = known.withColumn("start_before", F.max("last_start").over(before))
    known = known.withColumn("open_at_end", F.when(F.col("inside"), F.col("q_out")).otherwise(F.col("r_out")))
    # One row for each file.
    files = ranges.groupBy("file").agg(F.sum("bytes").alias("file_bytes"), F.max("block").alias("last_block"), F.min_by("cr", "block").alias("crlf"))
    files = files.withColumn("base", F.coalesce(F.sum("file_bytes").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return known.join(files, "file").select(
        "file", "block", "inside", "offset", "start_before", "base", "crlf",
        (F.col("open_at_end") & (F.col("block") == F.col("last_block"))).alias("unclosed"),
        F.coalesce("last_start", "start_before").alias("last_start"),
    )


def archive_records(spark: SparkSession, path: str) -> DataFrame:
    """row_order (byte offset), record (text without its line end), first (of its file)."""
    lines = noted_lines(spark, path)
    ranges = bounded(settled_ranges(lines), "archive-ranges")
    open_ = ranges.filter("unclosed").select("file", "last_start").first()
    if open_ is not None:
        raise SourceError(f"{open_['file']} ends inside quotes; its last row starts at byte {open_['last_start']}")
    both = lines.join(ranges, ["file", "block"])
    true = lambda name: F.when(F.col("inside"), F.col(f"q_{name}")).otherwise(F.col(f"r_{name}"))
    start = F.coalesce(F.when(true("start") >= 0, true("start") + F.col("offset")), F.col("start_before"))
    placed = both.select(
        (F.col("base") + start).alias("row_order"), (F.col("base") + F.col("offset") + F.col("at")).alias("place"),
        (start == 0).alias("first"), F.col("value").cast("string").alias("value"), (true("in") | true("out")).alias("part"), "crlf",
    )
    whole = placed.filter(~F.col("part")).select("row_order", F.col("value").alias("record"), "first", "crlf")
    parts = placed.filter("part").groupBy("row_order", "first", "crlf").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("lines"))
    joined = F.array_join("lines.value", "\n")
    joined = F.when(F.col("crlf"), F.replace(joined, F.lit("\r\n"), F.lit("\n"))).otherwise(joined)
    over = parts.select("row_order", joined.alias("record"), "first", "crlf")
    cut = F.when(F.col("crlf") & F.endswith("record", F.lit("\r")), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    return whole.unionByName(over).withColumn("record", cut).filter(F.col("record") != "").drop("crlf")


def _replaced(text: Column | str, pairs: Sequence[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def scan_quoted_csv(spark: SparkSession, path: str, empty_texts: bool = False) -> tuple[DataFrame, list[str]]:
    """The rows as text columns c0, c1, ... with their `row_order`, and the header that all files share.

    A field of two quotes is null like an absent one, or an empty text if `empty_texts`.
    """
    records = archive_records(spark, path)
    headers = [r[0] for r in records.filter("first").select("record").distinct().limit(2).collect()]
    if not headers:
        raise SourceError(f"no header in {path}")
    named = [next(csv.reader([h.removeprefix("﻿")])) for h in headers]
    if len(named) > 1 and named[0] != named[1]:
        raise SourceError(f"files under {path} have different headers: {headers}")
    columns = [f"c{k}" for k in range(len(named[0]))]
    fields = ", ".join(f"{c} string" for c in columns)
    hidden = F.contains("record", F.lit("\uffff"))
    text = F.when(hidden, _replaced("record", HIDDEN)).otherwise(F.col("record"))
    parsed = F.from_csv(text, fields, RULES | {"nullValue": NOTHING} if empty_texts else RULES)
    rows = records.filter(~F.col("first")).select("row_order", "record", parsed.alias("_row"))
    field = lambda c: F.col(f"_row.{c}")
    if empty_texts:
        # A field that reads as NOTHING itself came out null; the plain rules keep it.
        plain = F.from_csv(text, fields, RULES)
        field = lambda c: F.coalesce(f"_row.{c}", F.when(F.contains("record", F.lit(NOTHING)), plain[c]))
    shown = lambda c: F.when(hidden, _replaced(field(c), [(new, old) for old, new in reversed(HIDDEN)])).otherwise(field(c))
    return computed_once(rows.select("row_order", *[shown(c).alias(c) for c in columns]), columns), named[0]
