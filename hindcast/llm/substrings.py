"""Removal of repeated substrings by a hash-compared suffix sort.

Every byte is removed that a string of LENGTH bytes covers which also starts
somewhere else, in the same text or another. Equal strings are found by
sorting suffixes; two suffixes are compared by prefix polynomial hashes, with a
binary search for their common extension, inside a merge sort, and what the sort
calls equal is compared byte by byte.

Not all suffixes are sorted. A string of LENGTH bytes contains LENGTH - SEED + 1
seeds of SEED bytes; the one with the least hash is its anchor, so equal strings
have equal anchors at equal places, and consecutive strings share one: they
are a run. That gives three steps, each dealt by a hash:

1. Runs. For each run the hash of its seed and that of all its bytes go through
   a shuffle. Runs that are equal altogether repeat each other; their strings are
   done (this covers the inside of long repeats).
2. Suffixes. Runs whose seed also stands in a different run may share some of
   their strings (this is where a repeat begins or ends). Their bytes are
   grouped by seed, and the strings of a group are sorted as above.
3. Texts. Covered spans are joined with the texts, merged and cut out.

A seed with more than HOT_RUNS different runs (a passage in very many texts) is
split: each of its runs is cut into blocks of strings, and a block goes by the
hash of the bytes that all its strings share. Where these are in more than HOT_RUNS
blocks too (at the edges of the passage), each string goes by itself, by two hashes
of all its bytes: equal ones of a task are compared there by bytes and one of them
goes on. Runs that are alike in a task are sent once. A table of bits of fixed size tells in the second reading which
seeds are meant; a wrong hit only adds a run to sort.

Nulls and edges: null texts are empty; texts shorter than LENGTH keep all their
bytes; repeated rows are different texts, so they remove each other; matches
never cross texts. Equality of whole runs rests on a 64-bit hash of all their bytes
that is no polynomial, and on the hash of their seed. Texts must be read from files, so that rows are numbered alike in each
reading.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import in_arrow, mix64, numbered, raw, remembered, signed, slices, table, text_array
from hindcast.session import stage

LENGTH = 200
SEED = 64
PIECE_BYTES = 2_000_000
FLUSH_RUNS = 1_000_000
SORT_BYTES = 3_000_000
SEED_BITS = 27
HOT_BITS = 22
HOT_RUNS = 8192
BLOCK = 16
SEEN_STRINGS = 100_000
TO_SORT = "key long, _row long, place long, before long, n long, bytes binary"
PLACE = np.uint64((1 << 24) - 1)
BASES = (0x9E6C63D0676A9A99, 0xD1342543DE82EF95)


@remembered(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** k and its inverse ** k, modulo 2 ** 64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        power = np.full(n, b, np.uint64)
        power[0] = 1
        out.append(np.cumprod(power, dtype=np.uint64))
    return out[0], out[1]


class Prefixes:
    """Prefix polynomial hashes of some bytes; the hash of any part of them takes a subtraction and a product."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        size = 1 << max(12, int(len(data)).bit_length())
        powers, self.inverse = _powers(base, size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=self.sums[1:])

    def part(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.inverse[start]


class Runs:
    """Strings of `length` bytes of a piece that share an anchor: first and last start, anchor, seed hash, hash of all bytes."""

    def __init__(self, data: np.ndarray, valid: np.ndarray, length: int, seed: int):
        """valid: for each start, whether the string lies in one text."""
        self.first = self.last = self.anchor = np.zeros(0, np.int64)
        self.seed = self.whole = np.zeros(0, np.uint64)
        n = len(data) - length + 1
        if n <= 0 or not valid.any():
            return
        self.prefixes = Prefixes(data)
        at = np.arange(len(data) - seed + 1)
        grams = mix64(self.prefixes.part(at, seed))
        low = (grams & ~PLACE) | at.astype(np.uint64)
        width, span = length - seed + 1, 1
        while span < width:
            step = min(span, width - span)
            low = np.minimum(low[: len(low) - step], low[step:])
            span += step
        anchor = (low & PLACE).astype(np.int64)[:n]
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
        ends = valid.copy()
        ends[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
        self.first, self.last = np.flatnonzero(new), np.flatnonzero(ends)
        self.anchor = anchor[self.first]
        self.seed = grams[self.anchor] & ~np.uint64(1)
        size = self.last - self.first
        shape = ((self.anchor - self.first) * 256 + size).astype(np.uint64)
        # Not a polynomial: texts can be made whose polynomial hashes agree for every odd base.
        raw_ = data.tobytes()
        spans = zip(self.first.tolist(), (self.last + length).tolist(), strict=True)
        digests = np.fromiter((xxhash.xxh3_64_intdigest(raw_[a:b]) for a, b in spans), np.uint64, len(self.first))
        self.whole = mix64(digests ^ mix64(shape))


def pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, valid starts, row of each byte, its place in the text). Long texts come in parts that overlap by length - 1."""
    for batch in slices(batches, "text", PIECE_BYTES):
        data, ends = raw(text_array(batch.column("text")))
        rows = batch.column("_row").to_numpy()
        if len(data) <= 2 * PIECE_BYTES:
            size = np.diff(ends)
            place = np.arange(len(data)) - np.repeat(ends[:-1], size)
            if len(data) >= length:
                left = np.repeat(ends[1:], size)[: len(data) - length + 1] - np.arange(len(data) - length + 1)
                yield data, left >= length, np.repeat(rows, size), place
        else:
            for at in range(0, len(data) - length + 1, PIECE_BYTES):
                part = data[at : at + PIECE_BYTES + length - 1]
                yield part, np.ones(len(part) - length + 1, bool), np.full(len(part), rows[0]), at + np.arange(len(part))


def _alike(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by both, and the size of the group of equals that each (in that order) is in; negative for all but a group's first."""
    order = np.lexsort((second, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    sizes = np.diff(np.append(np.flatnonzero(new), len(order)))
    times = np.repeat(sizes, sizes)
    return order, np.where(new, times, -times)


def equal_runs(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """Written table of two kinds of rows: (_row, place) of a run that some other run equals, and (key) once for each different run."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            key, whole, row, place = (np.concatenate(x) for x in zip(*kept, strict=True))
            order, times = _alike(key, whole)
            # Alike in the task: done, but the first of them still asks for the others' sake.
            done = order[np.abs(times) > 1]
            asks = order[times > 0]
            columns = (np.concatenate((key[done] | np.uint64(1), key[asks])), *(np.concatenate((x[done], x[asks])) for x in (whole, row, place)))
            return pa.RecordBatch.from_arrays([pa.array(signed(x)) for x in columns], names=["key", "whole", "_row", "place"])

        for data, valid, rows, places in pieces(batches, length):
            runs = Runs(data, valid, length, seed)
            kept.append([runs.seed, runs.whole, rows[runs.first], places[runs.first] * 256 + (runs.last - runs.first)])
            waiting += len(runs.first)
            if waiting > FLUSH_RUNS:
                yield flush()
                kept, waiting = [], 0
        if waiting:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking = []
        names = ["key", "_row", "place"]
        for batch in batches:
            key, whole, row, place = (batch.column(c).to_numpy() for c in ("key", "whole", "_row", "place"))
            done = (key & 1) == 1
            if done.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(int(done.sum()), pa.int64()), pa.array(row[done]), pa.array(place[done])], names=names)
            asking.append([x[~done] for x in (key, whole, row, place)])
        if asking:
            key, whole, row, place = (np.concatenate(x) for x in zip(*asking, strict=True))
            order, times = _alike(whole, key)
            again, once = order[np.abs(times) > 1], order[times > 0]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(again), pa.int64()), pa.array(row[again]), pa.array(place[again])], names=names)
            empty = pa.nulls(len(once), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key[once]), empty, empty], names=names)

    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, F.xxhash64("_row", "place")).otherwise(F.xxhash64("whole"))
    sent = texts.transform(in_arrow, send, "key long, whole long, _row long, place long").repartition(partitions, dealt)
    return stage(sent.transform(in_arrow, meet, "key long, _row long, place long"), "runs")


def _bit_table(keys: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value of the keys' hash; at most 2 ** bits / 64 rows reach the driver."""
    place = F.shiftrightunsigned("key", 1).bitwiseAND(F.lit((1 << bits) - 1))
    marked = keys.select(F.shiftright(place, 6).alias("word"), place.alias("place"))
    words = marked.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toPandas()
    table = np.zeros((1 << bits) // 64, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return table.view(np.uint64)


def _in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys >> np.uint64(1)) & np.uint64(len(table) * 64 - 1)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def common_extension(prefixes: Prefixes, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """How many bytes the suffixes at a and b share, up to length: a binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), length, np.int64)
    whole = prefixes.part(a, length) == prefixes.part(b, length)
    low[whole] = length
    open_ = np.flatnonzero(~whole)
    for _ in range(int(length).bit_length()):
        x, y, l, h = a[open_], b[open_], low[open_], high[open_]
        middle = (l + h + 1) // 2
        same = prefixes.part(x, middle) == prefixes.part(y, middle)
        low[open_], high[open_] = np.where(same, middle, l), np.where(same, h, middle - 1)
    return low


def suffix_sort(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, length: int) -> np.ndarray:
    """Order of the suffixes by group and then by their first `length` bytes.

    A bottom-up merge sort of all groups at once: in each round an element finds
    its rank in the neighbouring sorted stretch by binary search.
    """
    prefixes = Prefixes(data)
    order = np.argsort(groups, kind="stable")
    begin = np.flatnonzero(np.diff(groups[order], prepend=-1))
    size = np.diff(np.append(begin, len(order)))
    base = np.repeat(begin, size)
    total = np.repeat(size, size)
    inside = np.arange(len(order)) - base
    width = 1
    while width < size.max(initial=0):
        stretch = inside // width
        other = (stretch ^ 1) * width
        count = np.clip(total - other, 0, width)
        moving = np.flatnonzero((total > width) & (count > 0))
        own, left = order[moving], (stretch[moving] & 1) == 0
        from_ = base[moving] + other[moving]
        low, high = np.zeros(len(moving), np.int64), count[moving].copy()
        while True:
            at = np.flatnonzero(low < high)
            if not len(at):
                break
            middle = (low[at] + high[at]) // 2
            x, y = starts[own[at]], starts[order[from_[at] + middle]]
            shared = common_extension(prefixes, x, y, length)
            apart = shared < length
            less = np.zeros(len(at), bool)
            less[apart] = data[y[apart] + shared[apart]] < data[x[apart] + shared[apart]]
            # Equal elements of the left stretch stay before those of the right one.
            less |= ~apart & ~left[at]
            low[at], high[at] = np.where(less, middle + 1, low[at]), np.where(less, high[at], middle)
        place = base[moving] + np.minimum(stretch[moving] * width, other[moving]) + (inside[moving] - stretch[moving] * width) + low
        merged = order.copy()
        merged[place] = own
        order, width = merged, 2 * width
    return order


def repeated_starts(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, length: int) -> np.ndarray:
    """True for the starts whose string of `length` bytes another start of the group has too."""
    order = suffix_sort(data, starts, groups, length)
    a, b = starts[order[:-1]], starts[order[1:]]
    near = np.flatnonzero(groups[order[:-1]] == groups[order[1:]])
    prefixes = Prefixes(data)
    near = near[prefixes.part(a[near], length) == prefixes.part(b[near], length)]
    found = np.zeros(len(starts), bool)
    strings = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else None
    wrong = []
    for at in range(0, len(near), 20_000):
        part = near[at : at + 20_000]
        same = (strings[a[part]] == strings[b[part]]).all(1)
        found[order[part[same]]] = True
        found[order[part[same] + 1]] = True
        wrong.extend(groups[order[part[~same]]].tolist())
    for g in set(wrong):
        # Different strings with equal hashes: settle the group by its bytes.
        rows = np.flatnonzero(groups == g)
        own = [strings[s].tobytes() for s in starts[rows]]
        found[rows] = [own.count(x) > 1 for x in own]
    return found


def _cut_runs(texts: DataFrame, sent: Broadcast, length: int, seed: int, blocks: bool) -> DataFrame:
    """(key, _row, place, before, n, bytes) of runs whose seed is meant: whole ones of other than hot seeds, or the blocks of those of hot seeds."""
    names = ["key", "_row", "place", "before", "n", "bytes"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meant, hot = sent.value
        seen: set[tuple[int, int]] = set()
        for data, valid, rows, places in pieces(batches, length):
            runs = Runs(data, valid, length, seed)
            own = np.flatnonzero(_in_table(meant, runs.seed) & (_in_table(hot, runs.seed) == blocks)) if len(runs.first) else np.zeros(0, np.int64)
            if not len(own):
                continue
            key, first, last, anchor = runs.seed[own], runs.first[own], runs.last[own], runs.anchor[own]
            whole = runs.whole[own]
            new = np.ones(len(own), bool)
            for k, pair in enumerate(zip(key.tolist(), whole.tolist(), strict=True)):
                if pair in seen:
                    new[k] = False
                else:
                    seen.add(pair)
            if len(seen) > FLUSH_RUNS:
                seen.clear()
            key, first, last, anchor = key[new], first[new], last[new], anchor[new]
            if blocks:
                # Blocks of starts by their distance to the anchor, from that of `last` to that of `first`.
                near, far = (anchor - last) // BLOCK, (anchor - first) // BLOCK
                n = far - near + 1
                stops = np.cumsum(n)
                block = np.arange(int(stops[-1]) if len(stops) else 0) - np.repeat(stops - n, n) + np.repeat(near, n)
                key, first, last, anchor = (np.repeat(x, n) for x in (key, first, last, anchor))
                core = runs.prefixes.part(anchor - BLOCK * block, length - BLOCK + 1)
                key = mix64(core ^ mix64(key + block.astype(np.uint64))) & ~np.uint64(1)
                first, last = np.maximum(first, anchor - BLOCK * block - BLOCK + 1), np.minimum(last, anchor - BLOCK * block)
            view = data.tobytes()
            content = [view[a:b] for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]
            columns = [pa.array(signed(key))] + [pa.array(x) for x in (rows[first], places[first], anchor - first, last - first + 1)] + [pa.array(content, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.transform(in_arrow, send, TO_SORT)


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def _strings(batches: Iterator[pa.RecordBatch], crowded: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bytes, starts, key, row, place) of each string of the blocks in the table; the key comes from two hashes of the string."""
    for batch in slices(batches, "bytes", SORT_BYTES):
        own = _in_table(crowded, _unsigned(batch.column("key")))
        if not own.any():
            continue
        row, place, n = (batch.column(c).to_numpy()[own] for c in ("_row", "place", "n"))
        data, ends = raw(batch.column("bytes").filter(pa.array(own)))
        stops = np.cumsum(n)
        inside = np.arange(int(stops[-1])) - np.repeat(stops - n, n)
        starts = np.repeat(ends[:-1], n) + inside
        one, two = (Prefixes(data, base).part(starts, length) for base in BASES)
        yield data, starts, mix64(one ^ mix64(two)) & ~np.uint64(1), np.repeat(row, n), np.repeat(place, n) + inside


def _single_strings(blocks: DataFrame, crowded: np.ndarray, length: int) -> DataFrame:
    """Written table of the strings of crowded blocks that stand there twice.

    Strings that are equal in a task (by their bytes) are repeats: spans with a
    null key tell their places. One of them goes on to be compared with those of
    other tasks, so that no key has more rows than tasks have filled tables.
    """
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast(crowded)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, key, _, _ in _strings(batches, sent.value, length):
            keys, times = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(times.astype(np.int64))], names=["key", "n"])

    twice = blocks.transform(in_arrow, count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    repeated = spark.sparkContext.broadcast(_bit_table(twice, SEED_BITS))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By its bytes the place of a string that went on, or None once that is known to be repeated.
        seen: dict[bytes, tuple[int, int] | None] = {}
        for data, starts, key, row, place in _strings(batches, sent.value, length):
            meant = _in_table(repeated.value, key)
            if not meant.any():
                continue
            starts, key, row, place = (x[meant] for x in (starts, key, row, place))
            strings = np.lib.stride_tricks.sliding_window_view(data, length)
            _, first, which = np.unique(key, return_index=True, return_inverse=True)
            which = which.reshape(-1)
            same = np.concatenate([(strings[starts[k : k + 20_000]] == strings[starts[first[which[k : k + 20_000]]]]).all(1) for k in range(0, len(key), 20_000)])
            done = same & (np.bincount(which, same)[which] > 1)
            asks, late = [], []
            for k in np.concatenate((first, np.flatnonzero(~same))).tolist():
                string = data[starts[k] : starts[k] + length].tobytes()
                if string not in seen:
                    seen[string] = None if done[k] else (int(row[k]), int(place[k]))
                    asks.append(k)
                    continue
                done[k] = True
                if seen[string] is not None:
                    late.append(seen[string])
                    seen[string] = None
            if len(seen) > SEEN_STRINGS:
                seen.clear()
            # Neighbours are told as one span.
            at = np.flatnonzero(done)
            new = np.ones(len(at), bool)
            new[1:] = (row[at][1:] != row[at][:-1]) | (place[at][1:] != place[at][:-1] + 1)
            n = np.diff(np.append(np.flatnonzero(new), len(at)))
            late_row, late_place = np.array(late, np.int64).reshape(-1, 2).T
            rows, places = np.concatenate((row[at[new]], late_row)), np.concatenate((place[at[new]], late_place))
            n = np.concatenate((n, np.ones(len(late), np.int64)))
            nothing = [pa.nulls(len(n), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*nothing, pa.array(rows), pa.array(places), *nothing, pa.array(n), pa.nulls(len(n), pa.binary())], names=["key", "_row", "place", "before", "n", "bytes"]
            )
            zeros = np.zeros(len(asks), np.int64)
            content = pa.array([data[a : a + length].tobytes() for a in starts[asks].tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(key[asks])), pa.array(row[asks]), pa.array(place[asks]), pa.array(zeros), pa.array(zeros + 1), content],
                names=["key", "_row", "place", "before", "n", "bytes"],
            )

    return stage(blocks.transform(in_arrow, merge, TO_SORT), "strings")


def partial_spans(texts: DataFrame, runs: DataFrame, length: int, seed: int, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(_row, start, end) of spans covered by repeated strings of runs that aren't equal as a whole."""
    spark = texts.sparkSession
    times = runs.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    times = stage(times, "seeds")
    hot = _bit_table(times.filter(F.col("n") > hot_runs), HOT_BITS)
    sent = spark.sparkContext.broadcast((_bit_table(times, SEED_BITS), hot))
    names = ["key", "_row", "place", "before", "n", "bytes"]
    to_sort, done = _cut_runs(texts, sent, length, seed, False), None
    if hot.any():
        blocks = stage(_cut_runs(texts, sent, length, seed, True), "blocks")
        crowded = _bit_table(blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_runs), HOT_BITS)
        if crowded.any():
            strings = _single_strings(blocks, crowded, length)
            end = F.col("place") + F.col("n") - 1 + length
            done = strings.filter(F.col("key").isNull()).select("_row", F.col("place").alias("start"), end.alias("end"))
            dense = spark.sparkContext.broadcast(crowded)

            def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield batch.filter(pa.array(~_in_table(dense.value, _unsigned(batch.column("key")))))

            blocks = blocks.transform(in_arrow, others, TO_SORT).unionByName(strings.filter(F.col("key").isNotNull()))
        to_sort = to_sort.unionByName(blocks)

    def settle(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(tables).combine_chunks()
        key, row, place, before, n = (whole.column(c).to_numpy() for c in names[:5])
        # A key with one run has nothing to be compared with.
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        several = times[which.reshape(-1)] > 1
        if not several.any():
            return
        key, row, place, before, n = (x[several] for x in (key, row, place, before, n))
        content = whole.column("bytes").combine_chunks().filter(pa.array(several))
        content = content.chunk(0) if isinstance(content, pa.ChunkedArray) else content
        data, ends = raw(content)
        run = np.repeat(np.arange(len(n)), n)
        stops = np.cumsum(n)
        inside = np.arange(int(stops[-1])) - np.repeat(stops - n, n)
        starts = ends[:-1][run] + inside
        ids = np.unique(key, return_inverse=True)[1].reshape(-1)
        groups = ids[run] * 1024 + (before[run] - inside)
        groups = np.unique(groups, return_inverse=True)[1].reshape(-1)
        found = repeated_starts(data, starts, groups, length)
        new = found.copy()
        new[1:] &= ~found[:-1] | (run[1:] != run[:-1])
        last = found.copy()
        last[:-1] &= ~found[1:] | (run[1:] != run[:-1])
        a, b = np.flatnonzero(new), np.flatnonzero(last)
        begin = place[run[a]] + inside[a]
        yield pa.RecordBatch.from_arrays([pa.array(row[run[a]]), pa.array(begin), pa.array(place[run[b]] + inside[b] + length)], names=["_row", "start", "end"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by key; they are settled in parts that end with a key."""
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in slices(batches, "bytes", SORT_BYTES):
            keys = batch.column("key").to_numpy()
            if held >= SORT_BYTES:
                cut = int(np.searchsorted(keys, waiting[-1].column("key")[-1].as_py(), side="right"))
                waiting.append(batch.slice(0, cut))
                if cut < len(keys):
                    yield from settle(waiting)
                    waiting, held = [], 0
                batch = batch.slice(cut)
            if batch.num_rows:
                waiting.append(batch)
                held += batch.nbytes
        if waiting:
            yield from settle(waiting)

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = to_sort.repartition(partitions, "key").sortWithinPartitions("key")
    found = dealt.transform(in_arrow, compare, "_row long, start long, end long")
    return found if done is None else found.unionByName(done)


def repeated_spans(texts: DataFrame, length: int = LENGTH, seed: int = SEED, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Per row of texts (_row, text) with repeats: _row and its covered spans, in no order and perhaps overlapping."""
    if not 0 < seed <= length or length - seed > 255:
        raise ValueError("a string must be as long as its seed, and at most 255 bytes longer")
    runs = equal_runs(texts, length, seed)
    first = F.shiftright("place", 8)
    last = F.col("place").bitwiseAND(F.lit(255))
    whole = runs.filter(F.col("_row").isNotNull()).select("_row", first.alias("start"), (first + last + length).alias("end"))
    spans = whole.unionByName(partial_spans(texts, runs, length, seed, hot_runs))
    # Bounded by the length of a text.
    return spans.groupBy("_row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans; those that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    at = np.flatnonzero(new)
    return starts[at], ends[np.append(at[1:], len(starts)) - 1]


def remove_repeats(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, seed: int = SEED, hot_runs: int = HOT_RUNS
) -> DataFrame:
    """Per row: doc_id, kept (the remaining bytes), n_bytes, n_removed, starts and ends of the removed spans (bytes)."""
    rows = numbered(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "_row")
    spans = repeated_spans(rows.select("_row", "text"), length, seed, hot_runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = text_array(batch.column("text"))
            lists = batch.column("spans")
            kept, n_bytes, removed, starts, ends = [], [], [], [], []
            for k in range(batch.num_rows):
                data = texts[k].as_py().encode()
                a = b = np.zeros(0, np.int64)
                if lists[k].is_valid:
                    fields = lists[k].values
                    a, b = merged(fields.field("start").to_numpy(), fields.field("end").to_numpy())
                edges = [0, *np.stack([a, b], 1).reshape(-1).tolist(), len(data)]
                kept.append(b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                n_bytes.append(len(data))
                removed.append(len(data) - len(kept[-1]))
                starts.append(a)
                ends.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64())]
                + [pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)],
                names=["doc_id", "kept", "n_bytes", "n_removed", "starts", "ends"],
            )

    joined = rows.join(spans, "_row", "left").select("doc_id", "text", "spans")
    return joined.transform(in_arrow, run, "doc_id long, kept binary, n_bytes long, n_removed long, starts array<long>, ends array<long>")


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(table(spark, sf_dir, "documents")))
