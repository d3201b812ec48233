"""Byte-level BPE with a rank queue, and decoding.

Pieces (matches of the split pattern) become linked lists of tokens. Every
adjacent pair that some token spells stands, by its left position, in the bucket
of that token's rank; a bitmap over the ranks with a bitmap over its words, and
so on up to a single word, gives the lowest rank with a bucket by one
find-first-set a level. A bucket is taken as a whole, from left to right: an entry
whose pair is no longer of this rank is stale and skipped, the others are merged
(of overlapping ones every other) and their new pairs enter their buckets. Where a
merge of a piece uncovers a pair of lower rank, the rest of the piece's entries goes
back and the lower rank comes first, so the order is that of always merging
the leftmost pair of the lowest rank. The work follows the bytes and merges,
whatever the length of a piece.

Pieces that a task has not met yet share one queue: lists of different pieces
have no pair in common, so each is merged as if alone. A piece that is a token
is that token. Known pieces are kept in bounded number and given up with the task.

Texts are encoded where they stand, nothing is shuffled; texts wait as numbers of their
pieces, and a long text is split in blocks, so memory follows the bounds below and
the longest single piece. A null
text is empty: no ids, and the hashes of no bytes. Rows that repeat are encoded
alike; a null id is kept; empty tables give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm.common import in_arrow, remembered, slices, table, text_array

RANKS = "byte_bpe_50k.tiktoken"
KNOWN_PIECES = 200_000
BLOCK_PIECES = 200_000
MERGE_BYTES = 4_000_000
FRESH_PIECES = 150_000
WAITING_PIECES = 4_000_000
WORD_BITS = 64


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class RankQueue:
    """Buckets of positions by rank, and bitmaps that find the lowest rank in use."""

    def __init__(self, n_ranks: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.levels: list[list[int]] = []
        n = n_ranks
        while True:
            n = -(-n // WORD_BITS) or 1
            self.levels.append([0] * n)
            if n == 1:
                break

    def put(self, rank: int, positions: np.ndarray) -> None:
        """More positions of a rank."""
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        for words in self.levels:
            at = rank // WORD_BITS
            had = words[at]
            words[at] = had | 1 << rank % WORD_BITS
            if had:
                return
            rank = at

    def put_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Every position into the bucket of its rank."""
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(ranks)]
        for rank, a, b in zip(ranks[bounds[:-1]].tolist(), bounds[:-1], bounds[1:], strict=True):
            self.put(rank, positions[a:b])

    def lowest(self) -> int:
        """The lowest rank with a bucket, -1 if there is none."""
        if not self.levels[-1][0]:
            return -1
        at = 0
        for words in reversed(self.levels):
            word = words[at]
            at = at * WORD_BITS + (word & -word).bit_length() - 1
        return at

    def take(self, rank: int) -> np.ndarray:
        """The rank's positions from left to right, each once; it has no bucket afterwards."""
        parts = self.buckets.pop(rank)
        for words in self.levels:
            at = rank // WORD_BITS
            words[at] &= ~(1 << rank % WORD_BITS)
            if words[at]:
                break
            rank = at
        found = np.sort(np.concatenate(parts) if len(parts) > 1 else parts[0])
        return found[np.append(True, found[1:] != found[:-1])]


class Merger:
    """Encodes and decodes with one file of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, known: int = KNOWN_PIECES):
        import regex

        self.ranks, self.pattern, self.limit = ranks, regex.compile(pattern), known
        self.spelt = {i: t for t, i in ranks.items()}
        self.base = max(self.spelt) + 1
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # Every way to put a token together from two.
        pairs = {}
        for t, i in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        # Tokens that can uncover a pair of lower rank than their own.
        self.uncovers = np.zeros(self.base, bool)
        for side in (self.keys // self.base, self.keys % self.base):
            self.uncovers[side[self.merged < side]] = True
        self.codes, self.spans = _Codes(), _Spans(np.uint32)
        self.token_bytes = _Spans(np.uint8)
        spelt = [self.spelt.get(i, b"") for i in range(self.base)]
        self.token_bytes.add(np.fromiter(map(len, spelt), np.int64, self.base), np.frombuffer(b"".join(spelt), np.uint8))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that two tokens spell, -1 if there is none."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int64)
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian 32-bit numbers. No piece is empty."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stops = np.cumsum(sizes)
        starts = stops - sizes
        piece = np.repeat(np.arange(len(pieces)), sizes)
        token = self.bytes[data]
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[stops - 1], before[starts] = -1, -1
        rank_at = np.full(n, -1, np.int64)
        if n > 1:
            rank_at[:-1] = self.rank_of(token[:-1], token[1:])
        rank_at[stops - 1] = -1
        queue = RankQueue(self.base)
        paired = np.flatnonzero(rank_at >= 0)
        queue.put_all(rank_at[paired], paired)
        while (rank := queue.lowest()) >= 0:
            p = queue.take(rank)
            p = p[rank_at[p] == rank]  # the others are stale
            if not len(p):
                continue
            listed = p
            if len(p) > 1:
                # Of pairs that overlap, every other one from the left.
                chained = np.append(False, following[p[:-1]] == p[1:])
                if chained.any():
                    at = np.arange(len(p))
                    p = p[(at - np.maximum.accumulate(np.where(chained, 0, at))) % 2 == 0]
            gone = following[p]
            after = following[gone]
            if self.uncovers[rank]:
                p, gone, after = self._upto_lower(rank, listed, p, gone, after, token, before, piece, queue)
            token[p], token[gone], rank_at[gone] = rank, -1, -1
            following[p] = after
            on = after >= 0
            before[after[on]] = p[on]
            rank_at[p] = -1
            right, right_after = p[on], after[on]
            left = before[p]
            left = left[left >= 0]
            at = np.concatenate((right, left))
            new = self.rank_of(token[at], np.concatenate((token[right_after], token[following[left]])))
            rank_at[at] = new
            some = new >= 0
            queue.put_all(new[some], at[some])
        live = token >= 0
        upto = np.concatenate(([0], np.cumsum(live)))[np.concatenate(([0], stops))].tolist()
        whole = token[live].astype("<u4").tobytes()
        return [whole[4 * a : 4 * b] for a, b in zip(upto[:-1], upto[1:], strict=True)]

    def _upto_lower(self, rank, listed, p, gone, after, token, before, piece, queue) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The merges up to the first in each piece that uncovers a lower rank; the rest go back into the bucket."""
        # One after the other: the left neighbour may be merged already, the right one isn't yet.
        right = np.where(after >= 0, self.rank_of(np.full(len(p), rank), token[after]), -1)
        left = before[p]
        merged_left = np.append(False, gone[:-1] == left[1:])
        left_token = np.where(merged_left, rank, token[left])
        left = np.where(left >= 0, self.rank_of(left_token, np.full(len(p), rank)), -1)
        lower = ((right >= 0) & (right < rank)) | ((left >= 0) & (left < rank))
        if not lower.any():
            return p, gone, after
        # Merges of the piece before this one that uncover something.
        own = piece[p]
        seen = np.cumsum(lower) - lower
        first = np.append(True, own[1:] != own[:-1])
        ready = seen == np.maximum.accumulate(np.where(first, seen, 0))
        if not ready.all():
            # All entries of such a piece: one that overlaps a merge which waits may still be due.
            queue.put(rank, listed[np.isin(piece[listed], own[~ready])])
        return p[ready], gone[ready], after[ready]

    def settle(self) -> None:
        """Merge the pieces that have a code and no ids yet."""
        names = self.codes.fresh
        if not names:
            return
        ids: list[bytes] = []
        unknown = []
        for k, piece in enumerate(names):
            rank = self.ranks.get(piece)
            ids.append(struct.pack("<I", rank) if rank is not None else b"")
            if rank is None:
                unknown.append(k)
        start = 0
        while start < len(unknown):
            stop, size = start, 0
            while stop < len(unknown) and (stop == start or size + len(names[unknown[stop]]) <= MERGE_BYTES):
                size += len(names[unknown[stop]])
                stop += 1
            for k, found in zip(unknown[start:stop], self.merge([names[k] for k in unknown[start:stop]]), strict=True):
                ids[k] = found
            start = stop
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.spans.add(sizes, np.frombuffer(b"".join(ids), "<u4"))
        self.codes.fresh, self.codes.fresh_bytes = [], 0

    def forget(self) -> None:
        """Start anew where more pieces are known than are to be kept."""
        if len(self.codes) > self.limit:
            self.codes, self.spans = _Codes(), _Spans(np.uint32)

    def pieces(self, text: str) -> Iterator[np.ndarray]:
        """The codes of the text's pieces; a long text comes in portions."""
        # A piece has a character at least.
        short = len(text) <= BLOCK_PIECES
        for part in [self.pattern.findall(text)] if short else _cut((m.group() for m in self.pattern.finditer(text)), BLOCK_PIECES):
            yield np.fromiter(map(self.codes.__getitem__, part), np.int32, len(part))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        codes = [list(self.pieces(t)) for t in texts]
        self.settle()
        got = [[self.spans.of(c)[0] for c in portions] for portions in codes]
        self.forget()
        return [np.concatenate(g) if g else np.zeros(0, np.uint32) for g in got]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and how many each has."""
        return self.token_bytes.of(ids)


class _Codes(dict):
    """Numbers pieces as they are met."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []
        self.fresh_bytes = 0

    def __missing__(self, piece: str) -> int:
        code = self[piece] = len(self)
        raw = piece.encode()
        self.fresh.append(raw)
        self.fresh_bytes += len(raw)
        return code


class _Spans:
    """Lists of numbers by code, one behind the other."""

    def __init__(self, kind):
        self.flat = np.zeros(0, kind)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, sizes: np.ndarray, flat: np.ndarray) -> None:
        self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(sizes) - sizes))
        self.size = np.concatenate((self.size, sizes))
        self.flat = np.concatenate((self.flat, flat))

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of all codes joined, and the size of each."""
        n = self.size[codes]
        stops = np.cumsum(n)
        total = int(stops[-1]) if len(stops) else 0
        return self.flat[np.arange(total) + np.repeat(self.first[codes] - stops + n, n)], n


def _cut(items: Iterator[str], size: int) -> Iterator[list[str]]:
    while part := list(islice(items, size)):
        yield part


@remembered(maxsize=2)
def merger(path: str, pattern: str) -> Merger:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
    return Merger(ranks, pattern)


def encode_decode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ranks: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit numbers), decoded_sha256; with_ids: also ids and decoded."""
    file, split = ranks or default_ranks(), pattern or default_pattern()
    fields = [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")]
    fields += [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())] if with_ids else []
    out = T.StructType(fields)

    def digests(own: Merger, ids: pa.Array, held: list[list[np.ndarray]]) -> pa.RecordBatch:
        n, by_ids, by_bytes, whole = [], [], [], []
        for portions in held:
            count, a, b = 0, hashlib.sha256(), hashlib.sha256()
            kept: tuple[list[bytes], list[bytes]] = ([], [])
            for codes in portions:
                found, _ = own.spans.of(codes)
                raw, decoded = found.astype("<u4", copy=False).tobytes(), own.decode(found)[0].tobytes()
                count += len(found)
                a.update(raw)
                b.update(decoded)
                if with_ids:
                    kept[0].append(raw)
                    kept[1].append(decoded)
            n.append(count)
            by_ids.append(a.hexdigest())
            by_bytes.append(b.hexdigest())
            whole.append(kept)
        columns = [ids, pa.array(n, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_bytes, pa.string())]
        columns += [pa.array([b"".join(x[i]) for x in whole], pa.binary()) for i in (0, 1)] if with_ids else []
        return pa.RecordBatch.from_arrays(columns, names=out.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(file, split)
        # Texts wait as codes of their pieces until enough new pieces are there for one queue.
        waiting, size = [], 0

        def ready() -> Iterator[pa.RecordBatch]:
            own.settle()
            for ids, held in waiting:
                yield digests(own, ids, held)
            waiting.clear()
            own.forget()

        try:
            for batch in slices(batches, "text"):
                held = [list(own.pieces(text)) for text in text_array(batch.column("text")).to_pylist()]
                waiting.append((batch.column("doc_id").take(pa.array(np.arange(batch.num_rows))), held))
                size += sum(len(c) for portions in held for c in portions)
                if len(own.codes.fresh) >= FRESH_PIECES or own.codes.fresh_bytes >= MERGE_BYTES or size >= WAITING_PIECES:
                    yield from ready()
                    size = 0
            yield from ready()
        finally:
            own.limit, limit = 0, own.limit
            own.forget()
            own.limit = limit

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).transform(in_arrow, run, out)


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
