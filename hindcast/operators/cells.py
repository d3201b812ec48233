"""Exact vector search by cells: blocks of rows with a centre and a radius.

The rows of a ticker are first cut into slabs in time order, each of a bounded
number of rows (a range that holds more is dealt again by a hash). A slab is one
task: its rows go to the nearest of a few centres, and a cell that is still
over `block_rows` is cut in time order. So a cell never holds more than
`block_rows` rows, whatever the ticker holds, and its rows are alike.

Neighbouring slabs make a tile of about `TILE_ROWS` rows. A task compares a tile of
events with a tile of points, so a row travels once for each tile of the other side
and not once for each cell; tiles whose points are all later than the events don't
meet. For unit vectors, no row of a block of events can be more similar to a row of a
cell than their centres and radii allow. Within a task every block of events meets its
best cell first. The least k-th score of its events is then what another cell's bound
has to reach; cells under it, and cells in which all points are later than all
events, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.operators.scale import bounded
from hindcast.session import stage

SLAB_BLOCKS = 32
#: Rows of a tile; a task holds two tiles and `SCORES` scores at a time.
TILE_ROWS = 32_768
SCORES = 4_000_000
MAX_TASKS = 4096
MAX_CENTRES = 64
CENTRE_ROUNDS = 2
CUTS = 999
#: Scores are rounded to 9 decimals; a bound may fall short by that and by rounding errors.
SLACK = 1e-8
ABOUT = "n long, centre array<double>, radius double, first_at timestamp_ntz, last_at timestamp_ntz"


def slabs(df: DataFrame, at: str, row: str, slab_rows: int) -> DataFrame:
    """Add `slab`, a number within the ticker; no slab holds much over `slab_rows` rows."""
    counted = bounded(df.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n")), "ticker-rows")
    largest = counted.agg(F.max("_n")).first()[0] or 0
    if largest <= slab_rows:
        return df.withColumn("slab", F.lit(0).cast("long"))
    clock = F.unix_micros(F.col(at).cast("timestamp"))
    # One sketch a ticker, from which its own cuts are read.
    grid = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    fine = df.groupBy("ticker").agg(F.percentile_approx(clock, grid, 10_000).alias("_grid"))
    parts = F.least(F.ceil(F.col("_n") / slab_rows), F.lit(CUTS + 1)).cast("int")
    place = lambda i: F.greatest(F.lit(1), F.round(i * (CUTS + 1) / parts).cast("int"))
    own = F.when(parts > 1, F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.element_at("_grid", F.least(F.lit(CUTS), place(i)))))
    cuts = bounded(counted.join(fine, "ticker").select("ticker", F.coalesce(own, F.array().cast("array<bigint>")).alias("_cuts")), "cuts")
    ranged = df.join(cuts, "ticker").withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= clock)).cast("long"))
    ranged = stage(ranged.drop("_cuts"), "ranges")
    # Instants that many rows share, and tickers with more slabs than cuts, leave large ranges: a hash deals them out.
    sizes = ranged.groupBy("ticker", "_range").agg(F.ceil(F.count(F.lit(1)) / slab_rows).alias("_m"))
    dealt = ranged.join(bounded(sizes, "range-rows"), ["ticker", "_range"])
    return dealt.withColumn("slab", F.col("_range") * (1 << 32) + F.pmod(F.xxhash64(row), F.col("_m"))).drop("_range", "_m")


def _centres(x: np.ndarray, n: int) -> np.ndarray:
    """For each row of `x` (unit vectors) the nearest of about `n` centres, spread out first and then moved."""
    chosen, gap = [0], 1 - x @ x[0]
    while len(chosen) < n and gap.max() > 1e-9:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, 1 - x @ x[chosen[-1]])
    centres = x[chosen]
    owner = np.argmax(x @ centres.T, axis=1)
    for _ in range(CENTRE_ROUNDS):
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
        owner = np.argmax(x @ centres.T, axis=1)
    return owner


def _cut(at: str, row: str, block_rows: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def kernel(slab: pd.DataFrame) -> pd.DataFrame:
        slab = slab.sort_values([at, row], ignore_index=True)
        x = np.stack(slab["vector"])
        owner = _centres(x, min(MAX_CENTRES, -(-2 * len(x) // block_rows))) if len(x) > block_rows else np.zeros(len(x), int)
        order = np.argsort(owner, kind="stable")
        first = np.searchsorted(owner[order], owner[order])
        key = owner[order] * len(x) + (np.arange(len(x)) - first) // block_rows
        cell = np.unique(key, return_inverse=True)[1]
        slab, x = slab.iloc[order].reset_index(drop=True), x[order]
        about: dict[str, list] = {c.split()[0]: [None] * len(x) for c in ABOUT.split(", ")}
        for start, stop in zip(starts := np.flatnonzero(np.diff(cell, prepend=-1)), [*starts[1:], len(x)], strict=True):
            centre = x[start:stop].mean(axis=0)
            about["n"][start] = int(stop - start)
            about["centre"][start] = centre.tolist()
            about["radius"][start] = float(np.linalg.norm(x[start:stop] - centre, axis=1).max())
            about["first_at"][start], about["last_at"][start] = slab[at].iloc[start], slab[at].iloc[stop - 1]
        slab["cell"] = cell.astype(np.int64)
        return slab.assign(n=pd.array(about["n"], "Int64"), **{k: about[k] for k in about if k != "n"})

    return kernel


def cells(df: DataFrame, at: str, row: str, block_rows: int) -> DataFrame:
    """Rows with `slab` and `cell`; the first row of a cell tells its size, centre, radius and times."""
    cut = slabs(df, at, row, SLAB_BLOCKS * block_rows)
    schema = T.StructType([*cut.schema.fields, T.StructField("cell", T.LongType()), *T.StructType.fromDDL(ABOUT).fields])
    return stage(cut.groupBy("ticker", "slab").applyInPandas(_cut(at, row, block_rows), schema), "cells")


def about(rows: DataFrame, prefix: str) -> DataFrame:
    """One row for each cell: ticker, {prefix}slab, {prefix}cell and what is known of it."""
    names = ("slab", "cell", "n", "centre", "radius", "first_at", "last_at")
    return rows.filter(F.col("n").isNotNull()).select("ticker", *[F.col(c).alias(prefix + c) for c in names])


def tiles(rows: DataFrame, at: str) -> DataFrame:
    """A row for each slab with its tile: ticker, slab, tile, n_cells, first_at, last_at."""
    # Slabs are numbered in time order; a ticker has one row for each of its slabs.
    slab = rows.groupBy("ticker", "slab").agg(
        F.count(F.lit(1)).alias("_n"), F.count("n").alias("n_cells"), F.min(at).alias("first_at"), F.max(at).alias("last_at")
    )
    before = Window.partitionBy("ticker").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    return slab.withColumn("tile", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / TILE_ROWS)).drop("_n")


@dataclass
class _Side:
    """One tile as arrays, rows in the order given; `rows` of each cell, and its centre, radius and times."""

    frame: pd.DataFrame
    at: str

    def __post_init__(self) -> None:
        self.x = np.stack(self.frame["vector"])
        self.clock = self.frame[self.at].to_numpy()
        owner = self.frame.groupby(["slab", "cell"], sort=False).ngroup().to_numpy()
        order = np.argsort(owner, kind="stable")
        self.rows = np.split(order, np.flatnonzero(np.diff(owner[order])) + 1)
        self.cell = owner
        self.centre = np.stack([self.x[r].mean(axis=0) for r in self.rows])
        self.radius = np.array([np.linalg.norm(self.x[r] - c, axis=1).max() for r, c in zip(self.rows, self.centre, strict=True)])
        self.first = np.array([self.clock[r].min() for r in self.rows])
        self.last = np.array([self.clock[r].max() for r in self.rows])


def bounds(e: _Side, p: _Side) -> np.ndarray:
    """The greatest similarity that a row of each block of e and a row of each cell of p can have."""
    square = (e.centre**2).sum(1)[:, None] + (p.centre**2).sum(1)[None, :] - 2 * e.centre @ p.centre.T
    gap = np.maximum(0.0, np.sqrt(np.maximum(0.0, square)) - e.radius[:, None] - p.radius[None, :])
    return 1 - gap * gap / 2 + SLACK


@dataclass(frozen=True)
class Search:
    """The k best of what was compared, and how many pairs of blocks there were and were compared."""

    best: DataFrame
    every: int
    in_time: int
    compared: int


PAIR = ["ticker", "e_tile", "p_tile"]


def _meet(k: int, as_of: bool, kernel: Callable) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Compare two tiles: hits, and a row without an event that counts the pairs of blocks."""

    def parts(e: _Side, rows: np.ndarray, p: _Side, cols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        step = max(1, SCORES // max(1, len(cols)))
        ours = p.x[cols], p.clock[cols], p.frame["point_id"].to_numpy()[cols]
        for start in range(0, len(rows), step):
            some = rows[start : start + step]
            row, col, score = kernel.best(e.x[some], e.clock[some], e.frame["point_id"].to_numpy()[some], *ours)
            yield some[row], cols[col], score

    def meet(events: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        # Points by id: the smaller id wins a tie.
        e, p = _Side(events, "published_at"), _Side(points.sort_values("point_id", ignore_index=True), "available_at")
        bound, found, compared = bounds(e, p), [], 0
        late = p.first[None, :] > e.last[:, None] if as_of else np.zeros(bound.shape, bool)
        bound[late] = -np.inf
        for block, rows in enumerate(e.rows):
            home = int(np.argmax(bound[block]))
            if late[block, home]:
                continue
            first = list(parts(e, rows, p, np.sort(p.rows[home])))
            row, score = (np.concatenate([f[i] for f in first]) for i in (0, 2))
            # A block with an event that has fewer than k hits yet has no floor.
            full = len(row) == k * len(rows)
            open_ = ~late[block] & (bound[block] >= score.min() if full else True)
            open_[home] = True
            compared += int(open_.sum())
            found += first if open_.sum() == 1 else parts(e, rows, p, np.flatnonzero(open_[p.cell]))
        row, col, score = (np.concatenate([f[i] for f in found]) if found else np.array([], int) for i in range(3))
        hits = pd.DataFrame(
            {
                "event_id": events["event_id"].to_numpy()[row],
                "point_id": p.frame["point_id"].to_numpy()[col],
                "available_at": p.clock[col],
                "score": score.astype(float),
                "in_time": pd.array([None] * len(row), "Int64"),
                "compared": pd.array([None] * len(row), "Int64"),
            }
        )
        told = {"event_id": None, "point_id": None, "available_at": None, "score": None, "in_time": int((~late).sum()), "compared": compared}
        return pd.concat([hits.astype(object), pd.DataFrame([told], dtype=object)], ignore_index=True)

    return meet


def search(events: DataFrame, points: DataFrame, k: int, as_of: bool, block_rows: int, kernel: Callable, found: str) -> Search:
    """events(event_id, point_id, ticker, published_at, vector), points(point_id, ticker, available_at, vector), unit vectors.

    `kernel.best` finds the k best of some points for each of some events; hits have
    columns `found`.
    """
    left = cells(events, "published_at", "event_id", block_rows)
    right = cells(points, "available_at", "point_id", block_rows)
    # A row for each slab, and for each pair of tiles.
    e, p = bounded(tiles(left, "published_at"), "e-tiles"), bounded(tiles(right, "available_at"), "p-tiles")
    e_cells, p_cells = (d.groupBy("ticker").agg(F.sum("n_cells").alias(c)) for d, c in ((e, "_e"), (p, "_p")))
    every = e_cells.join(p_cells, "ticker").agg(F.sum(F.col("_e") * F.col("_p"))).first()[0] or 0
    e_tiles = e.groupBy("ticker", F.col("tile").alias("e_tile")).agg(F.max("last_at").alias("_last"))
    p_tiles = p.groupBy("ticker", F.col("tile").alias("p_tile")).agg(F.min("first_at").alias("_first"))
    meeting = e_tiles.join(p_tiles, "ticker")
    pairs = stage(meeting.filter(F.col("_first") <= F.col("_last") if as_of else F.lit(True)).select(*PAIR), "tile-pairs")
    tasks = max(1, min(2 * pairs.count(), MAX_TASKS))
    # Each row with all tiles that its own one meets; as many partitions as pairs, lest several big pairs wait in one task.
    e_meets = bounded(e.join(pairs.groupBy("ticker", F.col("e_tile").alias("tile")).agg(F.collect_list("p_tile").alias("_with")), ["ticker", "tile"]).select("ticker", "slab", F.col("tile").alias("e_tile"), "_with"), "e-meets")
    p_meets = bounded(p.join(pairs.groupBy("ticker", F.col("p_tile").alias("tile")).agg(F.collect_list("e_tile").alias("_with")), ["ticker", "tile"]).select("ticker", "slab", F.col("tile").alias("p_tile"), "_with"), "p-meets")
    ours = left.select("event_id", "point_id", "ticker", "slab", "cell", "published_at", "vector").join(e_meets, ["ticker", "slab"])
    theirs = right.select("point_id", "ticker", "slab", "cell", "available_at", "vector").join(p_meets, ["ticker", "slab"])
    ours = ours.withColumn("p_tile", F.explode("_with")).drop("_with").repartition(tasks, *PAIR)
    theirs = theirs.withColumn("e_tile", F.explode("_with")).drop("_with").repartition(tasks, *PAIR)
    both = ours.groupBy(*PAIR).cogroup(theirs.groupBy(*PAIR))
    met = stage(both.applyInPandas(_meet(k, as_of, kernel), f"{found}, in_time long, compared long"), "hits")
    counts = met.agg(F.sum("in_time"), F.sum("compared")).first()
    return Search(met.filter(F.col("compared").isNull()).drop("in_time", "compared"), every, counts[0] or 0, counts[1] or 0)
