"""Vector codes: product quantization whose nearest entries are found in a GNAT.

A vector of integers floor(SCALE * x) is cut into PARTS equal parts, and each part
is coded by the nearest entry of its position's codebook. The entries of a
codebook stand in a geometric near-neighbour access tree: a node holds split
points, every other entry of the node goes to its nearest split point, and for each
pair (split point, child) the node keeps the range of distances from the split
point to the child's entries. A query measures its distance to the split points;
where, for any split point, the ball of the best distance so far lies wholly
outside the range, the child's whole subtree is left out. Ranges are rounded
outwards and a subtree goes only if it is strictly farther, so an entry at an equal
distance is always met; distances are compared as exact integers, ties by the
lower index. A batch of queries walks the tree together, each node with the queries
that still need it.

A round sums the parts of every entry in the tasks and by (part, entry, position)
in Spark; only these sums, bounded by the codebooks, reach the driver. Every
round reads the vectors again, so nothing has to be held.

Defined results: rows whose vector is null, or holds null or non-finite
components, are left out; so are vectors of another length than `dims`, by
default the most frequent length that is a positive multiple of the parts (ties:
the longer). Fewer rows than entries give fewer entries. Rows with equal ids
stand by their vectors at the start; null ids come last. Components of any
finite size are coded exactly: batches whose squares could leave 64 bits are
computed in unbounded integers, and an error that no long can hold is null.
Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm.common import in_arrow, table
from hindcast.operators.scale import bounded
from hindcast.session import stage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
DEGREE = 6
LEAF = 8
#: Squares of this many bits are still summed in 64-bit integers.
SAFE_BITS = 62
LIMB_BITS = 40
SLACK = 2.0**-50


def integers(flat: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), as 64-bit integers if all are small, else as Python's."""
    x = flat.astype(np.float64)
    if not len(x) or np.abs(x).max() < 2**40:
        return np.floor(x * scale).astype(np.int64)
    return np.array([int(v) * scale if abs(v) >= 2**53 else math.floor(v * scale) for v in x.tolist()], object)


def fits(points: np.ndarray, limit: int) -> bool:
    """Squared distances, over all parts, of components up to `limit` stay within 64 bits."""
    return points * (2 * limit) ** 2 < 1 << SAFE_BITS


def root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


class Gnat:
    """Exact nearest entry of each query; points: (entries, width) integers."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, leaf: int = LEAF):
        self.points, self.degree, self.leaf = points, degree, leaf
        self.visited = 0  # distances measured, for tests and figures
        self.top = self._node(np.arange(len(points)))

    def _squares(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        gap = a[:, None, :] - b[None, :, :]
        return (gap * gap).sum(axis=2)

    def _node(self, members: np.ndarray) -> tuple:
        """(split points, children, low, high); a leaf has split points alone."""
        if len(members) <= self.leaf:
            return members, [], None, None
        # Split points far from each other: each next one is the farthest from those chosen.
        chosen = [0]
        nearest = self._squares(self.points[members], self.points[members[:1]])[:, 0]
        while len(chosen) < self.degree:
            chosen.append(int(np.argmax(nearest)))
            nearest = np.minimum(nearest, self._squares(self.points[members], self.points[members[chosen[-1:]]])[:, 0])
            if not (nearest > 0).any():
                break
        chosen = sorted(set(chosen))
        splits, rest = members[chosen], np.delete(members, chosen)
        squares = self._squares(self.points[rest], self.points[splits])
        owner = np.array([int(np.argmin(row)) for row in squares], np.int64)
        children, low, high = [], [], []
        for j in range(len(splits)):
            own = owner == j
            if own.any():
                reach = root(squares[own])
                low.append(reach.min(axis=0) * (1 - SLACK))
                high.append(reach.max(axis=0) * (1 + SLACK))
                children.append(self._node(rest[own]))
        return splits, children, np.array(low), np.array(high)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry, the lowest of equals, and its squared distance."""
        index = np.full(len(queries), -1, np.int64)
        best = np.zeros(len(queries), queries.dtype if queries.dtype == object else np.int64)
        self._walk(self.top, queries, np.arange(len(queries)), index, best)
        return index, best

    def _walk(self, node: tuple, queries: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        splits, children, low, high = node
        squares = self._squares(queries[rows], self.points[splits])
        self.visited += squares.size
        # Split points stand in ascending order: the first of equal minima is the lowest index.
        at = np.argmin(squares, axis=1) if squares.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in squares], np.int64)
        found, square = splits[at], squares[np.arange(len(rows)), at]
        better = (index[rows] < 0) | (square < best[rows]) | ((square == best[rows]) & (found < index[rows]))
        better = better.astype(bool)
        index[rows[better]], best[rows[better]] = found[better], square[better]
        if not children:
            return
        away = root(squares)
        near, far = away * (1 - SLACK), away * (1 + SLACK)
        for j, child in enumerate(children):
            radius = root(best[rows])[:, None] * (1 + SLACK)
            out = (near > (high[j] + radius) * (1 + SLACK)) | ((far + radius) * (1 + SLACK) < low[j])
            needed = rows[~out.any(axis=1)]
            if len(needed):
                self._walk(child, queries, needed, index, best)


def limbs(value: int) -> list[int]:
    """A whole number in base 2^LIMB_BITS, lowest first, each with the number's sign."""
    sign, rest, out = (-1 if value < 0 else 1), abs(value), []
    while rest:
        out.append(sign * (rest & (1 << LIMB_BITS) - 1))
        rest >>= LIMB_BITS
    return out


def codable(vector: Column, dims: int | None = None) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & (F.size(vector) == dims if dims else F.size(vector) > 0), F.lit(False))


def frequent_length(vectors: DataFrame, vector: str, parts: int) -> int | None:
    """The most frequent length that can be cut into the parts."""
    size = F.size(vector)
    lengths = vectors.filter(codable(F.col(vector)) & (size % parts == 0)).groupBy(size.alias("dims")).count()
    first = lengths.orderBy(F.desc("count"), F.desc("dims")).first()
    return None if first is None else first["dims"]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = integers(column.flatten().to_numpy(zero_copy_only=False))
    return flat.reshape(len(column), dims)


class Codebooks:
    """One array of (entries, width) integers for each part position."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books
        self.width = books[0].shape[1]
        self.limit = max(int(np.abs(b).max()) if b.size else 0 for b in books)

    @classmethod
    def first(cls, rows: np.ndarray, parts: int) -> Codebooks:
        return cls(np.split(rows, parts, axis=1))

    def trees(self) -> list[Gnat]:
        return [Gnat(b) for b in self.books]

    def wide(self) -> Codebooks:
        return Codebooks([b.astype(object) for b in self.books])

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()

    def moved(self, sums: dict[tuple[int, int, int], int]) -> Codebooks:
        """Each used entry at the mean of its parts, rounded down; position -1 holds the counts."""
        books = []
        for p, book in enumerate(self.books):
            entries = book.tolist()
            for e, entry in enumerate(entries):
                n = sums.get((p, e, -1), 0)
                if n:
                    entries[e] = [sums.get((p, e, w), 0) // n for w in range(len(entry))]
            large = any(abs(v) >= 1 << 62 for entry in entries for v in entry)
            books.append(np.array(entries, object if large else np.int64).reshape(book.shape))
        return Codebooks(books)


class Assigner:
    """Codes batches of vectors; made once in a task."""

    def __init__(self, books: Codebooks):
        self.books = books
        self.narrow = None if any(b.dtype == object for b in books.books) else books.trees()
        self.unbounded: list[Gnat] | None = None

    def __call__(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The parts (position, row, width), their entries and their squared distances."""
        n, width = len(vectors), self.books.width
        limit = max(self.books.limit, int(np.abs(vectors).max()) if vectors.size else 0)
        trees = self.narrow
        if trees is None or vectors.dtype == object or not fits(len(self.books.books) * width, limit):
            vectors = vectors.astype(object)
            self.unbounded = self.unbounded or self.books.wide().trees()
            trees = self.unbounded
        parts = vectors.reshape(n, len(trees), width).transpose(1, 0, 2)
        got = [tree.nearest(part) for tree, part in zip(trees, parts, strict=True)]
        return parts, np.array([g[0] for g in got]), np.array([g[1] for g in got])


def entry_sums(vectors: DataFrame, vector: str, dims: int, books: Codebooks) -> dict[tuple[int, int, int], int]:
    """{(part, entry, position): sum of the parts that the entry is nearest to}; position -1: how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = Assigner(books)
        width = books.width
        counts = [np.zeros(len(b), np.int64) for b in books.books]
        totals = [np.zeros((len(b), width), object) for b in books.books]
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, entries, _ = assign(matrix(batch.column(0), dims))
            for p, (part, entry) in enumerate(zip(parts, entries, strict=True)):
                counts[p] += np.bincount(entry, minlength=len(counts[p]))
                own = np.zeros((len(counts[p]), width), part.dtype)
                np.add.at(own, entry, part)
                totals[p] = totals[p] + own
        rows = []
        for p, count in enumerate(counts):
            for e in np.flatnonzero(count).tolist():
                rows.append((p, e, -1, 0, int(count[e])))
                rows += [(p, e, w, k, v) for w in range(width) for k, v in enumerate(limbs(int(totals[p][e, w])))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["part", "entry", "position", "limb", "value"])

    sums = vectors.select(vector).transform(in_arrow, run, "part long, entry long, position long, limb long, value long")
    found: dict[tuple[int, int, int], int] = {}
    # One row for each number of the codebooks (and limb): bounded by their size.
    for r in sums.groupBy("part", "entry", "position", "limb").agg(F.sum("value").alias("value")).collect():
        key = (r["part"], r["entry"], r["position"])
        found[key] = found.get(key, 0) + (r["value"] << LIMB_BITS * r["limb"])
    return found


def coded(vectors: DataFrame, vector: str, vec_id: str, label: str, dims: int, books: Codebooks) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    digest = books.sha256()
    kinds = vectors.schema
    out = T.StructType([T.StructField("vec_id", kinds[vec_id].dataType), T.StructField("label", kinds[label].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = Assigner(books)
        for batch in batches:
            if not batch.num_rows:
                continue
            _, entries, squares = assign(matrix(batch.column(2), dims))
            codes = [bytes(row).hex() for row in entries.T.astype(np.uint8)]
            error = [e if e < 1 << 63 else None for e in squares.sum(axis=0).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=out.fieldNames())

    narrow = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    return narrow.transform(in_arrow, run, out).withColumn("codebooks_sha256", F.lit(digest))


def compress(
    vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, dims: int | None = None,
) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error, codebooks_sha256), and the codebooks. entries: 256 at most, two hex digits a code."""
    if not 0 < entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    narrow = vectors.select(vec_id, label, vector)
    dims = dims or frequent_length(narrow, vector, parts)
    kept = narrow.filter(codable(F.col(vector), dims))
    # At most `entries` rows.
    start = [r[0] for r in kept.orderBy(F.col(vec_id).asc_nulls_last(), vector).limit(entries).select(vector).collect()] if dims else []
    if not start:
        none = narrow.limit(0).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"))
        return none.select("*", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256")), None
    books = Codebooks.first(integers(np.array(start, np.float64).ravel()).reshape(len(start), dims), parts)
    for _ in range(rounds):
        books = books.moved(entry_sums(kept, vector, dims, books))
    return coded(kept, vector, vec_id, label, dims, books), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """label_error: the errors summed over equal labels (nulls together)."""
    codes = stage(codes, "codes")
    whole = F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error"))
    totals = codes.groupBy("label").agg(whole.alias("label_error")).withColumnRenamed("label", "_label")
    totals = bounded(totals, "label-errors")
    return codes.join(totals, codes["label"].eqNullSafe(totals["_label"])).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    return with_label_errors(compress(table(spark, sf_dir, "embeddings"))[0])
