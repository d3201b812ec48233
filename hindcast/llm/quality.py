"""Quality rules as a learned decision list.

Statistics of each text are computed once in Arrow batches. Sequential covering
then learns an ordered list of rules from labelled statistics: a rule is a
conjunction of thresholds, grown on one part of the labelled rows by information
gain and pruned on the rest; rows that it covers are set aside and the next rule
is learned, until no rule holds up on the pruning part. The list is applied as
one conditional Spark expression, so it can be read and shipped as text.

The list is learned from at most `max_rows` labelled rows (those with the
smallest hash of the id); every statistic covers the whole text and every row is
judged. Nulls: a null text has no words and all counts 0, so it fails the base
rules. Rows with null labels or ids don't take part in learning. Without labels
of both kinds the list is empty and the base rules decide alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm.common import in_arrow, owners, per_text, raw, slices, table, text_array, unused, with_columns, word_codes

MAX_ROWS = 20_000
MAX_RULES = 12
MAX_CONDITIONS = 3
MIN_PRECISION = 0.8
WINDOW = 8
BASE = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = ("n_words", *BASE, "n_lines", "n_upper", "n_lower", "n_digits", "n_marks")
#: What rules may test, as shares or means; each from counts of the text alone.
FEATURES = {
    "symbol_share": ("n_symbols", "n_words"),
    "mark_share": ("n_marks", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "letter_share": ("n_lower", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "word_length": ("word_chars", "n_words"),
    "line_words": ("n_words", "n_lines"),
}

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


def _flags(of: bytes) -> np.ndarray:
    flags = np.zeros(256, np.int64)
    flags[list(of)] = 1
    return flags


IS_SYMBOL = _flags(SYMBOLS)
IS_MARK = _flags(b"!?;:=~^_{}[]\\/@+")
IS_UPPER = _flags(bytes(range(65, 91)))
#: Small letters; what lies beyond ASCII counts as one of them.
IS_LOWER = _flags(bytes(range(97, 123)) + bytes(range(0xC0, 256)))
IS_DIGIT = _flags(bytes(range(48, 58)))
#: Bytes that begin a code point and aren't white space.
IS_CHAR = np.ones(256, np.int64) - _flags(SPACES) - _flags(bytes(range(0x80, 0xC0)))


def repeated_windows(codes: np.ndarray, ends: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """True at words in a window of `width` words that the same text holds twice or more.

    Windows get exact numbers by doubling: a number for each pair of
    neighbouring numbers, so no two different windows are taken for equal.
    """
    n = len(codes)
    marked = np.zeros(n, bool)
    if n < width:
        return marked
    text = owners(ends)
    number, span = codes, 1
    while span < width:
        step = min(span, width - span)
        pair = number[: len(number) - step] * (int(number.max()) + 1) + number[step:]
        number = np.unique(pair, return_inverse=True)[1].reshape(-1)
        span += step
    inside = text[: len(number)] == text[width - 1 :]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return marked
    key = text[starts] * (int(number.max()) + 1) + number[starts]
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = starts[times[which.reshape(-1)] > 1]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + width, -1)
    return np.cumsum(edges[:-1]) > 0


def duplicate_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier one of the text."""
    lists = pc.split_pattern(texts, "\n")
    flat = lists.flatten()
    ends = lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    filled = pc.greater(pc.binary_length(pc.ascii_trim(flat, " \t\n\x0b\x0c\r")), 0).to_numpy(zero_copy_only=False)
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = owners(ends)
    key = (text * (int(codes.max(initial=0)) + 1) + codes)[filled]
    n_lines = per_text(filled.astype(np.int64), ends)
    first = np.unique(key, return_index=True)[1]
    distinct = np.bincount(text[filled][first], minlength=len(texts)) if len(key) else np.zeros(len(texts), np.int64)
    return n_lines, n_lines - distinct


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS for each text of the array (no nulls)."""
    data, at = raw(texts)
    ends, codes, _ = word_codes(texts)
    n_lines, n_dup = duplicate_lines(texts)
    kinds = {"word_chars": IS_CHAR, "n_symbols": IS_SYMBOL, "n_upper": IS_UPPER, "n_lower": IS_LOWER, "n_digits": IS_DIGIT, "n_marks": IS_MARK}
    return {
        "n_words": np.diff(ends),
        "n_dup_lines": n_dup,
        "n_repeat_words": per_text(repeated_windows(codes, ends).astype(np.int64), ends),
        "n_lines": n_lines,
    } | {name: per_text(flags[data], at) for name, flags in kinds.items()}


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with a long column for each of COUNTS (names with the prefix)."""
    schema = T.StructType([*docs.schema.fields, *[T.StructField(prefix + c, T.LongType()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            counts = text_counts(text_array(batch.column(text)))
            yield with_columns(batch, **{prefix + c: counts[c] for c in COUNTS})

    return docs.transform(in_arrow, run, schema)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return rows[self.feature] > self.value if self.above else rows[self.feature] <= self.value


@dataclass(frozen=True)
class Rule:
    """Rows for which all conditions hold are rejected."""

    conditions: tuple[Condition, ...]

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        covered = np.ones(len(next(iter(rows.values()))), bool)
        for c in self.conditions:
            covered &= c.holds(rows)
        return covered

    def __str__(self) -> str:
        return "reject if " + " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.value:.6g}" for c in self.conditions)


def _best_condition(rows: dict[str, np.ndarray], bad: np.ndarray, alive: np.ndarray) -> tuple[Condition | None, np.ndarray]:
    """The threshold with the largest gain for rejecting, among the rows that the rule still covers."""
    p0, n0 = int(bad[alive].sum()), int((~bad[alive]).sum())
    before = math.log2(p0 / (p0 + n0))
    best, gain = None, 1e-9
    for name, values in rows.items():
        x = values[alive]
        order = np.argsort(x, kind="stable")
        x, b = x[order], bad[alive][order]
        cut = np.flatnonzero(np.diff(x) > 0)
        if not len(cut):
            continue
        p, n = np.cumsum(b)[cut], np.cumsum(~b)[cut]
        for above, pos, neg in ((False, p, n), (True, p0 - p, n0 - n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gains = np.where(pos > 0, pos * (np.log2(pos / (pos + neg)) - before), -np.inf)
            k = int(np.argmax(gains))
            if gains[k] > gain:
                gain, best = float(gains[k]), Condition(name, above, float((x[cut[k]] + x[cut[k] + 1]) / 2))
    return best, alive & best.holds(rows) if best else alive


def learn_list(
    rows: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS,
    min_precision: float = MIN_PRECISION,
) -> list[Rule]:
    """Sequential covering: grow on two rows of three, prune on the third, remove what is covered, go on."""
    bad = bad.astype(bool)
    grows = np.arange(len(bad)) % 3 != 2
    left = np.ones(len(bad), bool)
    found: list[Rule] = []
    while len(found) < max_rules and (bad & left & grows).any() and (bad & left & ~grows).any():
        alive, conditions = left & grows, []
        while len(conditions) < max_conditions and (~bad & alive).any():
            condition, alive = _best_condition(rows, bad, alive)
            if condition is None:
                break
            conditions.append(condition)
        if not conditions:
            break

        def worth(rule: Rule) -> float:
            covered = rule.holds(rows) & left & ~grows  # noqa: B023
            p = int((covered & bad).sum())
            n = int(covered.sum()) - p
            return (p - n) / (p + n) if p + n else -1.0

        heads = [Rule(tuple(conditions[:k])) for k in range(1, len(conditions) + 1)]
        best = max(heads, key=worth)  # the shortest of equals
        if worth(best) < 2 * min_precision - 1:
            break
        found.append(best)
        left &= ~best.holds(rows)
    return found


def feature(name: str, prefix: str = "") -> Column:
    over, under = (F.col(prefix + c).cast("double") for c in FEATURES[name])
    return F.when(under > 0, over / under).otherwise(F.lit(0.0))


def features(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out = {}
    for name, (over, under) in FEATURES.items():
        below = counts[under].astype(float)
        out[name] = np.divide(counts[over], below, out=np.zeros(len(below)), where=below > 0)
    return out


def rejects(rules: Sequence[Rule], prefix: str = "") -> Column:
    """The number (from 1) of the first rule that rejects the row, else 0, as an ordered conditional expression."""
    chain = None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for c in rule.conditions:
            x = feature(c.feature, prefix)
            test = test & ((x > c.value) if c.above else (x <= c.value))
        chain = F.when(test, F.lit(k)) if chain is None else chain.when(test, F.lit(k))
    return F.lit(0) if chain is None else chain.otherwise(F.lit(0))


def base_failed(prefix: str = "") -> Column:
    return (F.col(f"{prefix}n_words") < 20) | (100 * F.col(f"{prefix}n_repeat_words") > 30 * F.col(f"{prefix}n_words"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> list[Rule]:
    """Learn the list from at most max_rows labelled documents (label 0: to reject)."""
    order = F.xxhash64("doc_id")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_label"))
    known = known.orderBy(order, "doc_id").limit(max_rows)
    # Bounded by max_rows, so the ids can go to all tasks.
    some = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(known), "doc_id")
    got = with_counts(some).drop("text").orderBy(order, "doc_id", *COUNTS).limit(max_rows).toPandas()
    counts = {c: got[c].to_numpy() for c in COUNTS}
    return learn_list(features(counts), got["_label"].to_numpy() == 0)


def judged(docs: DataFrame, rules: Sequence[Rule], text: str = "text", prefix: str = "") -> DataFrame:
    """docs with COUNTS and base_failed, rule (first that rejects, 0 for none) and kept."""
    counted = with_counts(docs, text, prefix)
    failed, rule = f"{prefix}base_failed", f"{prefix}rule"
    return (
        counted.withColumn(failed, base_failed(prefix))
        .withColumn(rule, rejects(rules, prefix))
        .withColumn(f"{prefix}kept", ~F.col(failed) & (F.col(rule) == 0))
    )


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the base rules and the learned list keep, with the columns of docs."""
    rules = fit(docs, labels, text)
    prefix = unused("_q_n_words", docs.columns).removesuffix("n_words")
    return judged(docs, rules, text, prefix).filter(F.col(f"{prefix}kept")).select(*docs.columns)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judged(docs, rules).select("doc_id", "n_words", *BASE, "base_failed", "kept", "rule")
