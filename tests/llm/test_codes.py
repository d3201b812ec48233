import hashlib
import math
import random

import numpy as np
import pytest

from hindcast.llm.codes import Gnat, compress, integers, limbs, with_label_errors

ROWS = "vec_id long, embedding array<float>, label int, code string, error int"


def scan(points, queries):
    """The nearest entry by looking at all, in Python's integers."""
    out = []
    for q in queries:
        all_ = [sum((int(a) - int(b)) ** 2 for a, b in zip(q, p, strict=True)) for p in points]
        out.append((min(range(len(all_)), key=lambda i: (all_[i], i)), min(all_)))
    return out


@pytest.mark.parametrize("spread", [2, 30, 400])
@pytest.mark.parametrize("n", [1, 5, 9, 64, 200])
def test_tree_finds_the_nearest_and_the_lowest_of_equals(n, spread):
    rng = np.random.default_rng(n * spread)
    points = rng.integers(-spread, spread + 1, (n, 4))
    queries = np.concatenate([rng.integers(-2 * spread, 2 * spread + 1, (300, 4)), points])
    for kind in (np.int64, object):
        index, square = Gnat(points.astype(kind)).nearest(queries.astype(kind))
        assert list(zip(index.tolist(), square.tolist(), strict=True)) == scan(points, queries)


def test_tree_skips_subtrees():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (8, 4))
    points = np.concatenate([c + rng.integers(-20, 20, (32, 4)) for c in centres])
    tree = Gnat(points)
    queries = points + rng.integers(-9, 10, points.shape)
    index, _ = tree.nearest(queries)
    assert index.tolist() == [i for i, _ in scan(points, queries)]
    assert tree.visited < len(queries) * len(points) / 2


def test_equal_points_and_huge_ones():
    points = np.array([[7, 7]] * 40 + [[10**40, -(10**40)]] * 3 + [[8, 7]], object)
    index, square = Gnat(points).nearest(np.array([[7, 7], [10**40 + 1, -(10**40)], [8, 7]], object))
    assert index.tolist() == [0, 40, 43] and square.tolist() == [0, 1, 0]
    for v in (0, 1, -1, 10**45, -(10**45)):
        assert sum(x << 40 * k for k, x in enumerate(limbs(v))) == v
    assert integers(np.array([0.5, -0.001, 3e38], np.float32)).tolist() == [128, -1, int(np.float32(3e38)) * 256]


def brute(rows, dims, parts=16, entries=64, rounds=2):
    """The contract, row by row."""
    fine = [r for r in rows if r[1] is not None and len(r[1]) == dims and all(x is not None and math.isfinite(x) for x in r[1])]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(256 * float(np.float32(x))) for x in r[1]] for r in fine]
    w = dims // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            near = [i for i, _ in scan(books[p], [v[p] for v in cut])]
            for e in range(len(books[p])):
                own = [v[p] for v, i in zip(cut, near, strict=True) if i == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [scan(books[p], [v[p] for v in cut]) for p in range(parts)]
    codes = ["".join(f"{found[p][k][0]:02x}" for p in range(parts)) for k in range(len(cut))]
    errors = [sum(found[p][k][1] for p in range(parts)) for k in range(len(cut))]
    of_label = {}
    for r, e in zip(fine, errors, strict=True):
        of_label[r[2]] = of_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    long = lambda x: x if x < 1 << 63 else None
    return sorted((str(r[0]), c, long(e), long(of_label[r[2]]), digest) for r, c, e in zip(fine, codes, errors, strict=True))


def vectors(seed, n, dims=32):
    rng = random.Random(seed)
    rows = [(1000 - k, [round(rng.gauss(k % 3, 1), 3) for _ in range(dims)], rng.choice([0, 1, 1, 1, None])) for k in range(n)]
    rows += [(2, None, 1), (3, [None] * dims, 1), (4, [float("nan")] * dims, 0), (5, [1.0] * (dims - 1) + [float("-inf")], 0), (6, [], 1), (7, [1.0] * 48, 1)]
    return rows + [(None, [0.5] * dims, 2), rows[0], rows[0], (999, rows[0][1], 1), (8, [-0.001] * dims, None)]


@pytest.mark.parametrize("n", [3, 150])
def test_codes(spark, n):
    rows = vectors(n, n)
    got = with_label_errors(compress(spark.createDataFrame([(i, v, c, "x", 9) for i, v, c in rows], ROWS).repartition(3))[0])
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == brute(rows, 32)


def test_components_of_any_size(spark):
    rows = [(k, [float(10 ** (k % 39)) * (-1) ** j + j for j in range(16)], k % 2) for k in range(80)]
    got = with_label_errors(compress(spark.createDataFrame([(i, v, c, "x", 9) for i, v, c in rows], ROWS))[0])
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == brute([(i, np.array(v, np.float32).tolist(), c) for i, v, c in rows], 16)


def test_empty(spark):
    for rows in ([], [(1, None, 1, "", 0), (2, [1.0], 1, "", 0)]):
        got = with_label_errors(compress(spark.createDataFrame(rows, ROWS))[0])
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 0
