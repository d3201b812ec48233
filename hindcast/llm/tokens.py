"""Token files in directly addressable codes.

Each document's token ids, with an end id, are written in ascending id order of
the documents. A file is a table of segments; in a segment the ids are split
into chunks of CHUNK_BITS bits. Level 0 holds the low chunk of every id, level
1 the next chunk of those ids that have one, and so on. A bitmap per level tells
which entries go on, and a rank directory counts the set bits before each block
of RANK_BLOCK entries. So any one id is found by one look-up a level: read the
chunk, test the bit, and rank it to find the place in the next level; no
block is decoded for it.

Texts are range-partitioned by id once and encoded where they land; the files
are written by Spark (a task that is lost is redone and only committed output
counts). Only segment sizes travel to find where each document starts.

Encoding: white space parts words for the tokenizer, so every word is encoded
by itself. The different words of a block of texts of ASCII and Latin-1 letters,
digits and signs are split into pieces at once, by the kinds of their bytes; a
bounded memory of pieces spares most calls of the model's own merges. Words with
an apostrophe are split one by one, any others go through the whole tokenizer, with
a bounded memory of their own. All are held against whole-text encoding in the tests.

Order and nulls: null ids come first, rows with equal ids stand by the hash of
the text, equal rows are alike. A null text is empty and holds the end id only. No
rows give no files and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm.common import in_arrow, raw, remembered, slices, table, text_array, word_codes
from hindcast.session import new_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
CHUNK_BITS = 8
RANK_BLOCK = 512
SEGMENT_TOKENS = 1 << 20
KNOWN_WORDS = 400_000
KNOWN_PIECES = 300_000
#: Texts that are split at once: more of them share their words.
ENCODE_BYTES = 8_000_000

#: The split pattern whose pieces of words without an apostrophe are runs of bytes of one kind, digits alone.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIGN, LETTER, DIGIT, WORD_BY_WORD = range(4)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of every byte of UTF-8 its kind, and what it is in lower case, for ASCII and the Latin-1 letters (0xC3 and a byte below 0xC0)."""
    kind, low = np.full(256, WORD_BY_WORD, np.uint8), np.arange(256, dtype=np.uint8)
    kind[33:127] = SIGN
    kind[ord("'")] = WORD_BY_WORD
    kind[ord("0") : ord("9") + 1] = DIGIT
    for first in "aA":
        kind[ord(first) : ord(first) + 26] = LETTER
    kind[0xC3] = LETTER
    kind[0x80:0xC0] = LETTER
    low[ord("A") : ord("Z") + 1] += 32
    low[0x80:0x9F] += 32
    return kind, low


KIND, LOWER = _kinds()

LEVEL = "struct<chunks: binary, more: binary, ranks: binary, n: long>"
SCHEMA = f"part int, segment int, n_tokens long, n_docs long, doc_id array<long>, doc_tokens array<int>, levels array<{LEVEL}>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class WordEncoder:
    """Ids of words, with a bounded memory. One for each Python worker and tokenizer file."""

    #: Letters beyond ASCII that lower-case one to one and are composed already; other words take the long way.
    PLAIN = r"[!-~À-ÖØ-öø-ÿ]+"

    def __init__(self, path: str):
        import os

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain = regex.compile(self.PLAIN)
        # The file's own split pattern; it is read from there, so another vocabulary of this kind works alike.
        import json

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        split = [p["pattern"]["Regex"] for p in (said.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        kinds = [n["type"] for n in (said.get("normalizer") or {}).get("normalizers", [])]
        self.pieces = regex.compile(split[0]) if len(split) == 1 and kinds == ["NFC", "Replace", "Lowercase"] else None
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        # Byte-level vocabularies show the other bytes as the characters from 256 on.
        self.shown = {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(keep))}
        self.special = "<|"
        #: Whether words of plain letters, digits and signs can be split by their bytes.
        self.by_bytes = self.pieces is not None and split[0] == SPLIT
        # Ids as little-endian 32-bit numbers: a few dozen bytes a word.
        self.by_piece: dict[bytes, bytes] = {}
        self.by_word: dict[str, bytes] = {}

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces, all different."""
        known = self.by_piece
        out = list(map(known.get, pieces))
        new = [k for k, got in enumerate(out) if got is None]
        if len(known) + len(new) > KNOWN_PIECES:
            known.clear()
        tokenize = self.model.tokenize
        for k in new:
            piece = pieces[k]
            tokens = tokenize(piece.decode() if piece.isalnum() else piece.decode("latin-1").translate(self.shown))
            out[k] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        if len(new) <= KNOWN_PIECES:
            known.update((pieces[k], out[k]) for k in new)
        return out

    def word(self, word: str) -> bytes:
        if self.pieces is None or self.special in word or not self.plain.fullmatch(word):
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        low = word.lower()
        pieces = [p.encode() for p in self.pieces.findall(low)]
        different = list(dict.fromkeys(pieces))
        ids = dict(zip(different, self._pieces(different), strict=True))
        return b"".join([ids[p] for p in pieces])

    def _words(self, words: list[str]) -> pa.Array:
        """Ids of words one by one."""
        known, lists = self.by_word, []
        for w in words:
            got = known.get(w)
            if got is None:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                got = known[w] = self.word(w)
            lists.append(got)
        return pa.array(lists, pa.large_binary())

    def _split(self, data: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Ids of the words that the bytes hold between `ends`, none of which has a sign of `WORD_BY_WORD`."""
        low = LOWER[data]
        kind = KIND[low]
        opens = kind == DIGIT
        opens[1:] |= kind[1:] != kind[:-1]
        opens[ends[:-1]] = True
        starts = np.append(np.flatnonzero(opens), len(low))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(low)])
        coded = pieces.dictionary_encode()
        ids = pa.array(self._pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
        # Where each word begins among the ids.
        upto = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[np.searchsorted(starts, ends)]
        return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(upto), ids.buffers()[2]])

    def _distinct(self, words: pa.Array) -> tuple[pa.Array, np.ndarray | None]:
        """Ids of different words, and the place of each word's (none: in the order of the words)."""
        if not self.by_bytes or not len(words):
            return self._words(words.to_numpy(zero_copy_only=False).tolist()), None
        data, ends = raw(words)
        kind = KIND[data]
        apart = np.flatnonzero(kind == WORD_BY_WORD)
        # Signs outside of Latin-1's letters, and those two bytes that a special token begins with.
        signs = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        if not len(apart) + len(signs) + len(special):
            return self._split(data, ends), None
        alone = np.zeros(len(words), bool)
        alone[np.searchsorted(ends, np.concatenate((apart, signs, special)), side="right") - 1] = True
        here, there = words.filter(pa.array(~alone)), words.filter(pa.array(alone))
        ids = pa.concat_arrays([*([self._split(*raw(here))] if len(here) else []), self._words(there.to_numpy(zero_copy_only=False).tolist())])
        return ids, np.where(alone, len(here) + np.cumsum(alone) - 1, np.cumsum(~alone) - 1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has (without end ids)."""
        ends, codes, distinct = word_codes(texts)
        lists, places = self._distinct(distinct)
        # The ids of all words, one behind the other.
        placed = lists.take(pa.array(codes if places is None else places[codes]))
        upto, data = placed.buffers()[1:]
        upto = np.frombuffer(upto, np.int64, len(placed) + 1) // 4 if len(placed) else np.zeros(1, np.int64)
        ids = np.frombuffer(data, "<u4", int(upto[-1])) if upto[-1] else np.zeros(0, "<u4")
        return ids, np.diff(upto[ends])


@remembered(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_levels(ids: np.ndarray, bits: int = CHUNK_BITS) -> list[dict]:
    """The levels of a segment. Chunks are stored in the fewest whole bytes; every level has a bitmap and ranks."""
    kind = np.dtype(f"<u{max(1, (bits + 7) // 8)}") if bits <= 16 else np.dtype("<u4")
    levels, rest = [], ids.astype(np.uint32)
    while True:
        high = rest >> np.uint32(bits)
        more = high > 0
        blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK)) if len(more) else np.zeros(0, np.int64)
        ranks = np.cumsum(blocks) - blocks
        levels.append(
            {
                "chunks": (rest & np.uint32((1 << bits) - 1)).astype(kind).tobytes(),
                "more": np.packbits(more, bitorder="little").tobytes(),
                "ranks": ranks.astype("<u4").tobytes(),
                "n": len(rest),
            }
        )
        if not more.any():
            return levels
        rest = high[more]


class Segment:
    """Reads a segment: one id by its place, or all of them."""

    def __init__(self, levels: list[dict], bits: int = CHUNK_BITS):
        kind = np.dtype(f"<u{max(1, (bits + 7) // 8)}") if bits <= 16 else np.dtype("<u4")
        self.bits = bits
        self.levels = [(np.frombuffer(x["chunks"], kind), np.frombuffer(x["more"], np.uint8), np.frombuffer(x["ranks"], "<u4"), x["n"]) for x in levels]

    def __len__(self) -> int:
        return self.levels[0][3]

    def __getitem__(self, place: int) -> int:
        if not 0 <= place < len(self):
            raise IndexError(place)
        value, shift = 0, 0
        for chunks, more, ranks, _ in self.levels:
            value |= int(chunks[place]) << shift
            if not more[place >> 3] >> (place & 7) & 1:
                break
            block = place // RANK_BLOCK
            # Bits set in this block before the place: whole bytes, then the last byte's low bits.
            first = block * RANK_BLOCK // 8
            inside = int(np.bitwise_count(more[first : place >> 3]).sum()) + (int(more[place >> 3]) & ((1 << (place & 7)) - 1)).bit_count()
            place, shift = int(ranks[block]) + inside, shift + self.bits
        return value

    def all(self) -> np.ndarray:
        above = None
        for chunks, more, _, n in reversed(self.levels):
            ids = chunks.astype(np.uint32)
            if above is not None:
                ids[np.unpackbits(more, count=n, bitorder="little").astype(bool)] |= above << np.uint32(self.bits)
            above = ids
        return above


def write_tokens(
    docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, end_id: int = END_ID,
    partitions: int | None = None,
) -> None:
    """Encode every text and write the token table to `path`, in ascending order of the ids."""
    spark = docs.sparkSession
    file = tokenizer or default_tokenizer()
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = pa.list_(pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary()), ("n", pa.int64())]))

    def row(part: int, segment: int, ids: list[np.ndarray], keys: list, sizes: list[np.ndarray]) -> pa.RecordBatch:
        whole, counts = np.concatenate(ids), np.concatenate(sizes)
        columns = [
            pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(whole)], pa.int64()), pa.array([len(counts)], pa.int64()),
            pa.array([pa.concat_arrays(keys).to_pylist()], pa.list_(pa.int64())), pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([write_levels(whole)], level),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["part", "segment", "n_tokens", "n_docs", "doc_id", "doc_tokens", "levels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part = encoder(file), TaskContext.get().partitionId()
        segment, waiting, ids, keys, sizes = 0, 0, [], [], []
        for batch in slices(batches, "text", ENCODE_BYTES):
            got, n = words.encode(text_array(batch.column("text")))
            # Each text's end id goes behind its ids.
            own = np.insert(got, np.cumsum(n), end_id).astype(np.uint32)
            ids.append(own)
            sizes.append(n + 1)
            keys.append(batch.column("doc_id"))
            waiting += len(own)
            if waiting >= SEGMENT_TOKENS:
                yield row(part, segment, ids, keys, sizes)
                segment, waiting, ids, keys, sizes = segment + 1, 0, [], [], []
        if ids:
            yield row(part, segment, ids, keys, sizes)

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    ordered = narrow.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    ordered.transform(in_arrow, run, SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens and ids_crc32 (of the ids as little-endian 32-bit numbers)."""
    segments = spark.read.schema(SCHEMA).parquet(path)
    # One row for each segment of about SEGMENT_TOKENS ids; only sizes are summed here.
    sizes = segments.select("part", "segment", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_tokens").over(before), F.lit(0)).alias("_part_start"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_in_part", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "segment", (F.col("_part_start") + F.col("_in_part")).alias("first"))
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")] + [T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                levels = batch.column("levels")[k].as_py()
                ids = Segment(levels).all().astype("<u4")
                n = batch.column("doc_tokens")[k].values.to_numpy().astype(np.int64)
                stops = np.cumsum(n)
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((stops - n).tolist(), stops.tolist(), strict=True)]
                same = [pa.array(np.full(len(n), batch.column(c)[k].as_py(), np.int32)) for c in ("part", "segment")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[k].values, pa.array(stops - n), pa.array(n), pa.array(crc, pa.int64()), *same], names=out.fieldNames()
                )

    local = segments.select("part", "segment", "doc_id", "doc_tokens", "levels").transform(in_arrow, run, out)
    return local.join(starts, ["part", "segment"]).select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def tokens_of(spark: SparkSession, path: str, part: int, segment: int) -> Segment:
    """One segment for random access: tokens_of(...)[place]."""
    found = spark.read.schema(SCHEMA).parquet(path).filter((F.col("part") == part) & (F.col("segment") == segment)).select("levels").first()
    return Segment([x.asDict() for x in found[0]])


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)
