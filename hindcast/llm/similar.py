"""N-gram Jaccard join with parity sketches.

A document is the set of its distinct 5-word shingles. Two documents link when
their sets' intersection is at least 75% of their union; then the symmetric
difference D is at most a seventh of both sizes together.

Sketches. The shingles of a set are XORed into the blocks of a bit sketch, each
shingle into one block, so every element of the symmetric difference spoils one
block at most: the number of blocks in which two sketches differ bounds D from below.
A second sketch of SKETCH_BITS bits, in which a shingle flips one bit, gives the
same bound by its Hamming distance and sorts candidates out before texts are
compared. It says little of large sets, as it fills up; so what it leaves is sorted
out by a third one, whose bits grow with the set (WIDE or more a shingle). Its sizes
are powers of two, so the longer one of a pair folds to the shorter one's size.

Pigeonhole. Sizes fall in bands of factor 2 (a set also joins the band below if
a partner may lie there), and a band fixes the number of blocks. Linked sets
differ in D blocks at most, so if both name their D + 1 first blocks in any
common order, they name one in common. The order is rarest first, by a table
of frequent shingles over all documents: blocks made of passages that very many
documents share are not named as long as others are left. (A set must have more
blocks than D: up to 31 shingles they have a block each, beyond that the chance
of failing is under 1e-18 a document.)

Groups. Documents with equal sets are one node, so groups of copies never grow.
Documents that name the same block are candidates. First every node is compared
with the smallest nodes it meets, which most of a group have in common; verified
links make components. Then only
candidates of different components meet. Blocks named by the very same nodes count
once; sizes, sketches and whether the two met at a smaller key already are conditions
of the join, so only what texts must settle leaves it, nearly always once. A block named
by very many nodes is dealt in parts of bounded size, each part against each.
So all candidate pairs are either compared or in one component already, and no task
holds or emits a group's pairs. In each task a named block is passed on once, whatever
the number of its nodes, so a very common block doesn't fill one task.

Nulls and edges: a text without words (or null) has no shingles and links with
nothing; with fewer words than a shingle the whole sequence is one. Rows with
equal ids each count. Set identity and shingles rest on 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import GOLDEN, hash_strings, in_arrow, mix64, numbered, owners, signed, slices, table, text_array, unused, word_codes
from hindcast.llm.components import components
from hindcast.operators.scale import small
from hindcast.session import stage

WIDTH = 5
SKETCH_BITS = 512
SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]
#: Bits a shingle that a wide sketch has at least; sets for which SKETCH_BITS are as many have none.
WIDE = 2
COUNT_BITS = 20
#: Bits of a block's number: what is added to a band's own number, by the first band that it holds for; smaller sets have SMALL_BITS.
BLOCK_BITS = {5: 2, 7: 1, 9: 0}
SMALL_BITS = 40
KEY_BITS = 48
#: How many of the smallest nodes that it meets a node is compared with at first; what that leaves open is compared in full.
HUBS = 6
#: How many of a node's smallest open keys travel with it, to tell pairs that met already.
MET = 4
#: Nodes of one key that are compared in one task with as many others.
PART_NODES = 4096
FLUSH_ROWS = 700_000
#: A set names up to half as many blocks as it has shingles.
PARTITION_SHINGLES = 8_000_000
TEXT_FILTER_BITS = 24


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each text's set, and the sets: hashes in ascending order."""
    ends, codes, distinct = word_codes(pc.ascii_lower(texts))
    n = np.diff(ends)
    by_word = hash_strings(distinct)
    hashes = by_word[codes] if len(codes) else np.zeros(0, np.uint64)
    text = owners(ends)
    size = np.minimum(n, width)[text]
    first = np.arange(len(codes))
    starts = first + size <= ends[1:][text]
    short = n[text] < width
    starts &= ~short | (first == ends[:-1][text])
    at, size, text = first[starts], size[starts], text[starts]
    value = size.astype(np.uint64)
    for k in range(width):
        inside = size > k
        following = (value ^ hashes[np.where(inside, at + k, 0)]) * GOLDEN
        value = np.where(inside, following ^ (following >> np.uint64(31)), value)
    value = mix64(value)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return np.searchsorted(text, np.arange(len(texts) + 1)), value


def set_ids(ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash of each set (of an empty one: of nothing)."""
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(values ^ GOLDEN), dtype=np.uint64)))
    return mix64((upto[ends[1:]] - upto[ends[:-1]]) ^ np.diff(ends).astype(np.uint64))


def bit_sketches(ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """[set, 64-bit word]: a shingle flips one of SKETCH_BITS bits."""
    n = len(ends) - 1
    bit = (values >> np.uint64(8)) % np.uint64(SKETCH_BITS)
    times = np.bincount(owners(ends) * SKETCH_BITS + bit.astype(np.int64), minlength=n * SKETCH_BITS)
    return np.packbits((times & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1, bitorder="little").view(np.uint64)


def wide_sketches(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """A shingle flips one of the set's bits, whose number is a power of two. Empty where SKETCH_BITS suffice."""
    n = np.diff(ends)
    bits = np.int64(1) << np.ceil(np.log2(np.maximum(WIDE * n, 1))).astype(np.int64)
    bits[bits <= SKETCH_BITS] = 0
    start = np.concatenate(([0], np.cumsum(bits // 8)))
    of = owners(ends)
    taken = bits[of] > 0
    of, bit = of[taken], values[taken]
    bit = (bit & (bits[of] - 1).astype(np.uint64)).astype(np.int64)
    out = np.zeros(start[-1], np.uint8)
    np.bitwise_xor.at(out, start[of] + (bit >> 3), np.left_shift(1, bit & 7).astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(start.astype(np.int32)), pa.py_buffer(out)])


def apart_in(a: bytes, b: bytes) -> int:
    """In how many bits two wide sketches differ, at the shorter one's size; an empty one says nothing."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def describe(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, np.ndarray]:
    """Per row doc_id, node, n, its sketches and a hash of its text; and by the low bits of a shingle's hash how frequent it is (log 2).

    The frequencies are sums over all documents of what stands out in a task; a
    table of fixed size.
    """
    schema = f"doc_id long, node long, n long, {', '.join(f'{s} long' for s in SKETCH)}, wide binary, t long, times long"
    buckets = 1 << COUNT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(buckets, np.int64)
        names = ["doc_id", "node", "n", *SKETCH, "wide", "t", "times"]
        for batch in slices(batches, "text"):
            ends, values = shingle_sets(text_array(batch.column("text")))
            times += np.bincount((values & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
            words = bit_sketches(ends, values)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(signed(set_ids(ends, values))), pa.array(np.diff(ends))]
                + [pa.array(signed(words[:, k])) for k in range(len(SKETCH))]
                + [wide_sketches(ends, values), batch.column("t"), pa.nulls(batch.num_rows, pa.int64())],
                names=names,
            )
        heavy = np.flatnonzero(times >= 8 + 2 * times.mean())
        empty = pa.nulls(len(heavy), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [empty, pa.array(heavy), *[empty] * (1 + len(SKETCH)), pa.nulls(len(heavy), pa.binary()), empty, pa.array(times[heavy])], names=names
        )

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("t"))
    both = stage(narrow.transform(in_arrow, run, schema), "sets")
    counts = both.filter(F.col("times").isNotNull()).groupBy("node").agg(F.sum("times").alias("times")).toPandas()
    level = np.zeros(buckets, np.uint8)
    level[counts["node"].to_numpy(np.int64)] = np.log2(counts["times"].to_numpy(float)).astype(np.uint8)
    return both.filter(F.col("times").isNull()).drop("times"), level


def named_blocks(ends: np.ndarray, values: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) for the blocks that each set names, in its own band and, where a partner may be there, the one below."""
    n = np.diff(ends)
    band = np.frexp(np.maximum(n, 1))[1] - 1
    sets, keys = [], []
    rare = level[(values & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)]
    spread = mix64(values)
    of = owners(ends)
    for below in (0, 1):
        home = band - below
        takes = (n > 0) & (home >= 0)
        if below:
            # A partner of three quarters of the size lies under the band.
            takes &= (3 * n + 3) // 4 < (1 << band)
        differ = (n + (1 << band) - 1) // 7 if below else n // 3
        for b in np.unique(home[takes]):
            mine = takes & (home == b)
            rows = np.flatnonzero(mine[of])
            added = [more for first, more in BLOCK_BITS.items() if b >= first]
            bits = int(b) + added[-1] if added else SMALL_BITS
            block = values[rows] >> np.uint64(64 - bits)
            text = of[rows]
            new = np.ones(len(rows), bool)
            new[1:] = (block[1:] != block[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(new)
            parity = np.bitwise_xor.reduceat(spread[rows], first)
            low = np.minimum.reduceat(rare[rows], first)
            text, block = text[first], block[first]
            key = mix64(parity ^ mix64(block * np.uint64(64) + np.uint64(int(b))))
            order = np.lexsort((key, low, text))
            text, key = text[order], key[order]
            start = np.searchsorted(text, np.arange(len(n)))
            place = np.arange(len(text)) - start[text]
            named = place <= differ[text]
            sets.append(text[named])
            keys.append(key[named])
    if not sets:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(sets), np.concatenate(keys)


def _stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (key, node), the smallest node of each key at each row, and where a key begins."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[new], nodes[new]
    begins = np.ones(len(keys), bool)
    begins[1:] = keys[1:] != keys[:-1]
    return keys, nodes, begins


def _pack(part: int, met: bool, keys: np.ndarray, nodes: np.ndarray) -> tuple:
    """One row for many (key, node) of a task: sorted keys as differences, nodes by their place in a list."""
    steps = np.diff(keys, prepend=np.uint64(0))
    base = int(steps[0])
    steps[0] = 0
    narrow = bool((steps < 1 << 32).all())
    distinct, place = np.unique(nodes, return_inverse=True)
    kind = np.uint16 if len(distinct) < 1 << 16 else np.uint32
    return part, met, base, narrow, steps.astype(np.uint32 if narrow else np.uint64).tobytes(), distinct.tobytes(), place.reshape(-1).astype(kind).tobytes()


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    steps = np.frombuffer(row["steps"], np.uint32 if row["narrow"] else np.uint64)
    distinct = np.frombuffer(row["nodes"], np.uint64)
    place = np.frombuffer(row["places"], np.uint16 if len(distinct) < 1 << 16 else np.uint32)
    return np.cumsum(steps, dtype=np.uint64) + np.uint64(row["base"]), distinct[place]


def shared_blocks(docs: DataFrame, text: str, level: np.ndarray, shingles: int = 0) -> DataFrame:
    """(key, node) for each key that two nodes or more name.

    A task packs what it sends to a partition into a few rows. A key that several
    of its nodes share is met already: its rows need no partner any more and are
    dealt anywhere (`met`), and one row of it goes to the key's own partition. The
    number of partitions grows with the shingles of all sets, so that what a task
    gathers does not.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(level)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingles // PARTITION_SHINGLES))
    names = ["part", "met", "base", "narrow", "steps", "nodes", "places"]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        seen: set[int] = set()
        keys, nodes, waiting = [], [], 0

        def flush() -> pa.RecordBatch:
            k, v, begins = _stars(np.concatenate(keys) >> np.uint64(64 - KEY_BITS), np.concatenate(nodes))
            alone = begins.copy()
            alone[:-1] &= begins[1:]
            rows = []
            own_k, own_v = k[begins], v[begins]
            # Keys are hashes, so equal ranges of them are equal shares.
            edges = [(p << KEY_BITS) // partitions for p in range(1, partitions)]
            cuts = np.searchsorted(own_k, np.array(edges, np.uint64))
            for p, (a, b) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(own_k)], strict=True)):
                if b > a:
                    rows.append(_pack(p, False, own_k[a:b], own_v[a:b]))
            met_k, met_v = k[~alone], v[~alone]
            for at in range(0, len(met_k), 100_000):
                part = (task + at // 100_000) % partitions
                rows.append(_pack(part, True, met_k[at : at + 100_000], met_v[at : at + 100_000]))
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema(
                [("part", pa.int32()), ("met", pa.bool_()), ("base", pa.int64()), ("narrow", pa.bool_())] + [(c, pa.binary()) for c in names[4:]]
            ))

        for batch in slices(batches, text):
            ends, values = shingle_sets(text_array(batch.column(text)))
            ids = set_ids(ends, values)
            new = []
            for k, i in enumerate(ids.tolist()):
                if i not in seen:
                    seen.add(i)
                    new.append(k)
            if not new:
                continue
            part = np.zeros(len(ids), bool)
            part[new] = True
            which, key = named_blocks(np.concatenate(([0], np.cumsum(np.diff(ends)[part]))), values[np.repeat(part, np.diff(ends))], sent.value)
            keys.append(key)
            nodes.append(ids[part][which])
            waiting += len(key)
            if waiting > FLUSH_ROWS:
                yield flush()
                keys, nodes, waiting = [], [], 0
        if waiting:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes = [], []
        out = ["key", "node"]
        for batch in batches:
            for row in batch.to_pylist():
                k, v = _unpack(row)
                if row["met"]:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(k)), pa.array(signed(v))], names=out)
                else:
                    keys.append(k)
                    nodes.append(v)
        if keys:
            k, v, begins = _stars(np.concatenate(keys), np.concatenate(nodes))
            alone = begins.copy()
            alone[:-1] &= begins[1:]
            yield pa.RecordBatch.from_arrays([pa.array(signed(k[~alone])), pa.array(signed(v[~alone]))], names=out)

    packed = docs.select(text).transform(in_arrow, name, "part int, met boolean, base long, narrow boolean, steps binary, nodes binary, places binary")
    return stage(packed.repartitionById(partitions, "part").transform(in_arrow, meet, "key long, node long"), "blocks")


def _may_link(a: str, b: str) -> Column:
    """What sizes and bit sketches allow: sizes within three quarters, and 7 * Hamming distance <= both sizes together."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    distance = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH), F.lit(0))
    return (4 * x >= 3 * y) & (4 * y >= 3 * x) & (7 * distance <= x + y)


def sketched(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) that wide sketches allow: 7 * Hamming distance <= both sizes together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = batch.column("_x").to_numpy() + batch.column("_y").to_numpy()
            both = zip(batch.column("_a"), batch.column("_b"), strict=True)
            near = [7 * apart_in(a.as_py(), b.as_py()) <= m for (a, b), m in zip(both, most.tolist(), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    # Equal sets have equal sketches.
    known = rows.join(ends, "node", "left_semi").groupBy("node").agg(F.max("n").alias("n"), F.max("wide").alias("wide"))
    known = stage(known, "wide")
    a = known.select(F.col("node").alias("u"), F.col("n").alias("_x"), F.col("wide").alias("_a"))
    b = known.select(F.col("node").alias("v"), F.col("n").alias("_y"), F.col("wide").alias("_b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "_x", "_y", "_a", "_b").transform(in_arrow, run, "u long, v long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose sets link. texts: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_a"):
            n = batch.num_rows
            # The two texts of pair k are texts k and n + k; a node's text is cut into shingles once.
            nodes = np.concatenate([batch.column(c).to_numpy() for c in ("u", "v")])
            _, first, place = np.unique(nodes, return_index=True, return_inverse=True)
            both = pa.concat_arrays([text_array(batch.column("_a")), text_array(batch.column("_b"))])
            at, sets = shingle_sets(both.take(pa.array(first)))
            length = np.diff(at)[place]
            ends = np.concatenate(([0], np.cumsum(length)))
            values = sets[np.arange(ends[-1]) + np.repeat(at[:-1][place] - ends[:-1], length)]
            pair = owners(ends) % n
            order = np.lexsort((values, pair))
            values, pair = values[order], pair[order]
            twice = (values[1:] == values[:-1]) & (pair[1:] == pair[:-1])
            both = np.bincount(pair[1:][twice], minlength=n)
            size = np.diff(ends)
            union = size[:n] + size[n:] - both
            yield batch.select(["u", "v"]).filter(pa.array(100 * both >= 75 * union))

    a = texts.select(F.col("node").alias("u"), F.col("text").alias("_a"))
    b = texts.select(F.col("node").alias("v"), F.col("text").alias("_b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "_a", "_b").transform(in_arrow, run, "u long, v long")


def compared(docs: DataFrame, text: str, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The linked ones of the pairs (u, v): first by sizes and bit sketches, then by their texts."""
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    known = rows.filter("n > 0").join(ends, "node", "left_semi").dropDuplicates(["node"]).select("node", "n", *SKETCH)
    u, v = known.alias("a"), known.alias("b")
    likely = pairs.join(u, F.col("u") == F.col("a.node")).join(v, F.col("v") == F.col("b.node")).filter(_may_link("a", "b")).select("u", "v")
    likely = stage(likely, "likely")
    return settled(docs, text, rows, likely)


def settled(docs: DataFrame, text: str, rows: DataFrame, likely: DataFrame) -> DataFrame:
    """The linked ones of the pairs (u, v) by their texts, where wide sketches allow it."""
    likely = stage(sketched(likely, rows), "likely")
    nodes = likely.select(F.col("u").alias("node")).unionByName(likely.select(F.col("v").alias("node"))).distinct()
    return stage(verified(likely, texts_of(docs, text, rows, nodes)), "verified")


def texts_of(docs: DataFrame, text: str, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text for each of the nodes. Documents pass a bit table of fixed size before they are shuffled."""
    low = (1 << TEXT_FILTER_BITS) - 1
    # Equal sets may have different texts; any of them will do.
    wanted = stage(rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("t").alias("t")), "wanted")
    place = F.col("t").bitwiseAND(F.lit(low))
    # At most 2 ** TEXT_FILTER_BITS / 64 rows.
    marks = wanted.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast((t & {low}) % 64 as int))")).alias("bits")
    ).toPandas()
    bits = np.zeros((low + 1) // 64, np.int64)
    bits[marks["word"].to_numpy(np.int64)] = marks["bits"].to_numpy(np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            at = batch.column("t").to_numpy().view(np.uint64)
            place = at & np.uint64(low)
            marked = (sent.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)
            rows = []
            for k in np.flatnonzero(marked).tolist():
                i = int(at[k])
                if i not in seen:
                    seen.add(i)
                    rows.append(k)
            yield batch.take(pa.array(rows, pa.int64()))

    found = docs.select(F.xxhash64(text).alias("t"), F.col(text).alias("text")).transform(in_arrow, run, "t long, text string")
    return stage(found.join(wanted, "t").groupBy("node").agg(F.min("text").alias("text")), "texts")


def apart(blocks: DataFrame, label: DataFrame, rows: DataFrame, part_nodes: int = PART_NODES) -> DataFrame:
    """Pairs (u, v) of different components that share a key and may link by sizes and sketches."""
    tagged = blocks.join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    # What stands for a key's list of nodes: sums of the halves of two hashes.
    hashes = [F.xxhash64("node"), F.xxhash64("node", F.lit(1))]
    halves = [h for x in hashes for h in (x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32))]
    lists = tagged.groupBy("key").agg(
        F.min("component").alias("_x"), F.max("component").alias("_y"), F.count(F.lit(1)).alias("_n"),
        *[F.sum(h).alias(f"_h{k}") for k, h in enumerate(halves)],
    ).filter("_x <> _y")
    keys = lists.groupBy("_n", *[f"_h{k}" for k in range(len(halves))]).agg(F.min("key").alias("key"))
    parts = F.ceil(F.col("_n") / part_nodes).cast("int").alias("parts")
    open_rows = stage(tagged.join(keys.select("key", parts), "key"), "open")
    met = open_rows.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, MET).alias("_met"))
    about = rows.filter("n > 0").groupBy("node").agg(*[F.max(c).alias(c) for c in ("n", *SKETCH)])
    # Fewer than MET keys: the last one is repeated.
    first = [F.coalesce(F.get("_met", F.lit(k)), F.element_at("_met", -1)).alias(f"m{k}") for k in range(MET)]
    about = met.join(about, "node").select("node", "n", *SKETCH, *first)
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    slots = F.expr("transform(sequence(0, parts - 1), p -> greatest(p, own) * parts + least(p, own))")
    dealt = (
        open_rows.join(about, "node")
        .withColumn("own", own)
        .withColumn("slot", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(slots)))
        .withColumn("alone", F.col("slot") == F.col("own") * (F.col("parts") + 1))
        .drop("parts")
    )
    dealt = stage(dealt, "dealt")
    met_before = F.lit(False)
    for i in range(MET):
        for j in range(MET):
            met_before |= (F.col(f"a.m{i}") == F.col(f"b.m{j}")) & (F.col(f"a.m{i}") < F.col("a.key"))
    meet = (
        (F.col("a.key") == F.col("b.key")) & (F.col("a.slot") == F.col("b.slot")) & (F.col("a.component") < F.col("b.component"))
        # Two of one part meet in that part's own slot only. Both sides read the same columns, so one exchange serves both.
        & ((F.col("a.alone") & F.col("b.alone")) | (F.col("a.own") != F.col("b.own")))
        & _may_link("a", "b") & ~met_before
    )
    return dealt.alias("a").join(dealt.alias("b"), meet).select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")).distinct()


def links(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Per row doc_id, node and n; and (node, component) of the linked nodes.

    node stands for a set of shingles; documents with equal sets share it.
    """
    rows, level = describe(docs, text, doc_id)
    blocks = shared_blocks(docs, text, level, rows.agg(F.sum("n")).first()[0] or 0)
    # Every node with the smallest nodes of the blocks that it names.
    least = blocks.groupBy("key").agg(F.min("node").alias("v"))
    # A set of hubs is as long as a node's list of blocks at most.
    hubs = blocks.join(least, "key").filter("node <> v").groupBy(F.col("node").alias("u")).agg(F.collect_set("v").alias("_hubs"))
    first = stage(hubs.select("u", F.explode(F.slice(F.array_sort("_hubs"), 1, HUBS)).alias("v")), "pairs")
    found = compared(docs, text, rows, first)
    label = stage(components(found), "components")
    # Candidates that are in different components still.
    more = stage(apart(blocks, label, rows).join(first, ["u", "v"], "left_anti"), "pairs")
    if not more.isEmpty():
        also = settled(docs, text, rows, more)
        if not also.isEmpty():
            label = stage(components(found.unionByName(also)), "components")
    return rows.select("doc_id", "node", "n"), label


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, label = links(docs)
    tagged = rows.join(label, "node", "left").withColumn("_c", F.coalesce("component", "node"))
    least = tagged.filter("n > 0").groupBy("_c").agg(F.min("doc_id").alias("_least"))
    joined = tagged.join(least, "_c", "left")
    component = F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Of each group of linked documents the one with the smallest id (null last), columns unchanged.

    Rows are told apart by their place in the files (`numbered`).
    """
    row = unused("_row", docs.columns)
    placed = numbered(docs, row)
    rows, label = links(placed, text, row)
    ids = placed.select(F.col(row).alias("_r"), F.col(doc_id).alias("_id"))
    grouped = rows.filter("n > 0").join(label, "node", "left").select(F.col("doc_id").alias("_r"), F.coalesce("component", "node").alias("_c"))
    order = F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("y"), F.col("_r").alias("z"))
    grouped = grouped.join(ids, "_r").select("_r", "_c", order.alias("_order"))
    best = grouped.groupBy("_c").agg(F.min("_order").alias("_best"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    leave = stage(grouped.join(best, "_c").filter(F.col("_r") != F.col("_best.z")).select(F.col("_r").alias(row)), "repeats")
    return placed.join(small(leave, leave.count()), row, "left_anti").select(*docs.columns)
