"""Second-order boosted trees for a binary label.

Rows are reduced once to bins: a feature's cuts are given, or read from its
quantiles. A level of a tree is one aggregation: gradients and hessians of the
log loss are summed by (node, feature, bin), merged before the shuffle, and the
driver sees one row for each of those, never a row of the data. From the sums
follow the splits (gain with `reg_lambda` in each denominator) and the leaf
weights, -G / (H + lambda). A tree sees a share of the rows, by a hash of tree and
row, and a share of the features, drawn once for the whole tree.

The model is a list of splits; it scores as one column expression, without
Python. Margins of finished trees are kept with the rows and written anew every
few trees, so plans stay short and a lost executor repeats little.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.fixed_values import FEATURE_NAMES, FEATURE_SUBSAMPLE, ROW_SUBSAMPLE, SAMPLE_SEED
from hindcast.session import stage

MAX_BINS = 64
REG_LAMBDA = 1.0
MIN_CHILD_WEIGHT = 1.0
TREES_A_STAGE = 8
#: Gains that agree to this many places are equal: the earlier feature, then the lower cut wins.
GAIN_PLACES = 9


@dataclass
class Node:
    """An inner node sends `feature <= cut` to the left; a leaf has a weight."""

    weight: float = 0.0
    feature: str | None = None
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None


@dataclass
class Boosted:
    names: list[str]
    step_size: float
    cuts: dict[str, list[float]]
    trees: list[Node] = field(default_factory=list)
    base_margin: float = 0.0

    def head(self, rounds: int) -> Boosted:
        """The model after its first trees: trees are added one at a time."""
        return Boosted(self.names, self.step_size, self.cuts, self.trees[:rounds], self.base_margin)

    def margin(self) -> Column:
        return _margin(self.trees, self.step_size) + F.lit(self.base_margin)

    def score(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, saved: Mapping) -> Boosted:
        def node(d: Mapping | None) -> Node | None:
            return None if d is None else Node(d["weight"], d["feature"], d["cut"], node(d["left"]), node(d["right"]))

        return cls(list(saved["names"]), saved["step_size"], dict(saved["cuts"]), [node(t) for t in saved["trees"]], saved["base_margin"])


def _value(node: Node) -> Column:
    if node.feature is None:
        return F.lit(node.weight)
    return F.when(F.col(node.feature) <= node.cut, _value(node.left)).otherwise(_value(node.right))


def _margin(trees: Sequence[Node], step_size: float) -> Column:
    total = F.lit(0.0)
    for tree in trees:
        total = total + F.lit(step_size) * _value(tree)
    return total


def quantile_cuts(rows: DataFrame, names: Sequence[str], bins: int = MAX_BINS) -> dict[str, list[float]]:
    """At most `bins` - 1 cuts a feature, none at its greatest value."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(n).cast("double"), shares, 10_000).alias(f"q{i}") for i, n in enumerate(names)], *[F.max(n).alias(f"m{i}") for i, n in enumerate(names)]).first()
    return {n: sorted({float(c) for c in found[f"q{i}"] or [] if c < found[f"m{i}"]}) for i, n in enumerate(names)}


def columns_of(tree: int, names: Sequence[str], share: float, seed: int) -> list[str]:
    """The features that a tree may split on: a share of them, one at least, in contract order."""
    n = max(1, int(share * len(names)))
    drawn = sorted(names, key=lambda c: hashlib.sha256(f"{seed}:{tree}:{c}".encode()).hexdigest())[:n]
    return [c for c in names if c in drawn]


def in_sample(tree: int, row: str, share: float, seed: int) -> Column:
    """A hash of the row and the tree, so that a retried task samples alike."""
    if share >= 1:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.col(row).cast("string"), F.lit(f"{seed}:{tree}")), F.lit(1_000_000)) < int(share * 1_000_000)


def _bin(name: str, cuts: Sequence[float]) -> Column:
    """How many cuts are below the value."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(name)))


def _histograms(rows: DataFrame, names: Sequence[str], cuts: Mapping[str, Sequence[float]]) -> dict[int, dict[str, dict[int, tuple[float, float]]]]:
    """{node: {feature: {bin: (G, H)}}} of rows(node, g, h, bins of the features)."""
    known = [n for n in names if cuts[n]]
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"bin_{n}").alias("bin")) for n in known], F.struct(F.lit("").alias("feature"), F.lit(0).alias("bin")))
    sums = rows.select("node", "g", "h", F.explode(pairs).alias("p")).groupBy("node", "p.feature", "p.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    found: dict = {}
    # A row for each node, feature and bin: bounded by the tree's shape.
    for r in sums.collect():
        found.setdefault(r["node"], {}).setdefault(r["feature"], {})[r["bin"]] = (r["g"], r["h"])
    return found


def _best_split(sums: Mapping[str, Mapping[int, tuple[float, float]]], names: Sequence[str], cuts, reg_lambda: float, min_child: float):
    """(feature, bin, left G, left H) of the split with the greatest gain, or None."""
    whole_g, whole_h = sums[""][0]
    score = lambda g, h: g * g / (h + reg_lambda)
    best, most = None, 0.0
    for name in names:
        g = h = 0.0
        for b in range(len(cuts[name])):
            more = sums.get(name, {}).get(b, (0.0, 0.0))
            g, h = g + more[0], h + more[1]
            if h < min_child or whole_h - h < min_child:
                continue
            gain = round(score(g, h) + score(whole_g - g, whole_h - h) - score(whole_g, whole_h), GAIN_PLACES)
            if gain > most:
                best, most = (name, b, g, h), gain
    return best


def _grow(rows: DataFrame, names: Sequence[str], cuts, depth: int, reg_lambda: float, min_child: float) -> Node:
    """One tree, level by level. rows: g, h and the bins."""
    top = Node()
    level = {1: top}
    place = F.lit(1)
    for d in range(max(depth, 1)):
        sums = _histograms(rows.withColumn("node", place), names if depth else [], cuts)
        following: dict[int, Node] = {}
        for number, node in level.items():
            if number not in sums:
                continue
            g, h = sums[number][""][0]
            node.weight = -g / (h + reg_lambda)
            found = _best_split(sums[number], names, cuts, reg_lambda, min_child) if depth else None
            if found is None:
                continue
            name, b, left_g, left_h = found
            node.feature, node.cut = name, cuts[name][b]
            # The children's sums are known from the parent's; the next level only sees those that may split again.
            node.left, node.right = Node(-left_g / (left_h + reg_lambda)), Node(-(g - left_g) / (h - left_h + reg_lambda))
            following |= {2 * number: node.left, 2 * number + 1: node.right}
            place = F.when(place == number, F.when(F.col(f"bin_{name}") <= b, 2 * number).otherwise(2 * number + 1)).otherwise(place)
        level = following
        if not level:
            break
    return top


def fit_boosted(
    train: DataFrame, max_depth: int, step_size: float, rounds: int, names: Sequence[str] = FEATURE_NAMES, row: str = "event_id",
    row_share: float = ROW_SUBSAMPLE, feature_share: float = FEATURE_SUBSAMPLE, reg_lambda: float = REG_LAMBDA, min_child: float = MIN_CHILD_WEIGHT,
    cuts: Mapping[str, Sequence[float]] | None = None, seed: int = SAMPLE_SEED,
) -> Boosted:
    """`train` has the features, `label` (0 or 1), `weight` and a row id. A null or NaN feature is an error."""
    names = list(names)
    narrow = train.select(F.col(row).alias("row"), "label", "weight", *[F.col(n).cast("double").alias(n) for n in names])
    narrow = stage(narrow, "boost-rows")
    bad = narrow.filter(F.greatest(*[(F.col(n).isNull() | F.isnan(n)).cast("int") for n in names], F.lit(0)) == 1).first()
    if bad is not None:
        raise ValueError(f"row {bad['row']!r} has a null or NaN feature")
    cuts = {n: sorted(float(c) for c in cuts[n]) for n in names} if cuts is not None else quantile_cuts(narrow, names)
    bins = [_bin(n, cuts[n]).alias(f"bin_{n}") for n in names]
    kept = stage(narrow.select("row", "label", "weight", *names, *bins, F.lit(0.0).alias("margin")), "boost-bins")
    model = Boosted(names, step_size, cuts)
    done = 0
    for tree in range(rounds):
        if tree - done >= TREES_A_STAGE:
            kept = stage(kept.withColumn("margin", F.col("margin") + _margin(model.trees[done:tree], step_size)), "boost-margins")
            done = tree
        p = 1 / (1 + F.exp(-(F.col("margin") + _margin(model.trees[done:tree], step_size))))
        seen = kept.filter(in_sample(tree, "row", row_share, seed)).withColumn("p", p)
        seen = seen.withColumns({"g": F.col("weight") * (F.col("p") - F.col("label")), "h": F.col("weight") * F.col("p") * (1 - F.col("p"))})
        model.trees.append(_grow(seen, columns_of(tree, names, feature_share, seed), cuts, max_depth, reg_lambda, min_child))
    return model


def score_boosted(model: Boosted, df: DataFrame, out: str = "score") -> DataFrame:
    return df.withColumn(out, model.score())


def log_losses(model: Boosted, rows: DataFrame, rounds: Sequence[int]) -> dict[int, float]:
    """Mean log loss on the rows of the model's first trees, for each number of rounds, from one pass."""
    near = lambda p: F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    loss = lambda p: -F.avg(F.when(F.col("label") == 1, F.log(near(p))).otherwise(F.log(near(1 - p))))
    found = rows.agg(*[loss(model.head(r).score()).alias(f"r{r}") for r in rounds]).first()
    return {r: found[f"r{r}"] if found[f"r{r}"] is not None else math.nan for r in rounds}
