import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from hindcast.llm import substrings
from hindcast.llm.substrings import Prefixes, Runs, common_extension, digest, pieces, remove_repeats, repeated_starts, suffix_sort


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    times = {}
    for b in data:
        for j in range(len(b) - length + 1):
            times[b[j : j + length]] = times.get(b[j : j + length], 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if times[b[j : j + length]] > 1:
                gone[j : j + length] = True
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    letters = "abcdefghé日"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    common = make(40)
    out = [make(rng.randint(0, 120)) for _ in range(25)]
    for _ in range(25):
        a = rng.choice(out)
        cut = rng.randint(0, len(a))
        out.append(rng.choice([a, a[cut:] + make(10), make(7) + a[:cut], make(9) + common + make(9), common[5:] + a, a[:cut] + "x" + a[cut:]]))
    return out + [None, "", "ab" * 60, "a" * 70, "aaaa" + common + common, out[3], out[3]]


def answer(spark, rows, tmp_path, **options):
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3).write.parquet(path)
    got = digest(remove_repeats(spark.read.parquet(path), **options)).orderBy("doc_id").collect()
    return [tuple(r)[1:] for r in got]


@pytest.mark.parametrize(("seed", "hot"), [(1, 8192), (2, 1)])
def test_against_all_strings(spark, tmp_path, seed, hot):
    rows = texts(seed)
    assert answer(spark, rows, tmp_path, length=24, seed=8, hot_runs=hot) == brute(rows, 24)


def test_default_length_and_parts_of_long_texts(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghijklmnop ") for _ in range(9000))
    rows = [long, long[100:4000], "x" + long[5000:5300] + "y", long[:150], long[-199:], "z" * 450, None]
    assert answer(spark, rows, tmp_path) == brute(rows, 200)
    monkeypatch.setattr(substrings, "PIECE_BYTES", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([long])], names=["_row", "text"])
    starts = [int(s) for _, valid, _, place in pieces(iter([batch]), 200) for s in place[: len(valid)]]
    assert sorted(starts) == list(range(len(long) - 199))


def test_no_key_holds_the_edge_of_a_passage_in_very_many_texts(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage = make(150)
    rows = [make(rng.randint(20, 60)) + passage + make(rng.randint(20, 60)) for _ in range(90)] + [None, passage[20:90], make(30)]
    dealt = []
    frame = type(spark.range(0))
    sort = frame.sortWithinPartitions
    monkeypatch.setattr(frame, "sortWithinPartitions", lambda self, *a: dealt.append(self) or sort(self, *a))
    got = answer(spark, rows, tmp_path, length=24, seed=8, hot_runs=8)
    assert got == brute(rows, 24)
    assert dealt[0].groupBy("key").count().agg({"count": "max"}).first()[0] <= 8
    monkeypatch.setattr(substrings, "SEEN_STRINGS", 5)
    assert answer(spark, rows, tmp_path / "again", length=24, seed=8, hot_runs=8) == got


def test_suffix_sort_and_extension():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 3000).astype(np.uint8)
    starts = rng.permutation(2900)[:1200]
    groups = rng.integers(0, 9, 1200)
    whole = data.tobytes()
    order = suffix_sort(data, starts, groups, 40)
    keys = [(int(groups[k]), whole[starts[k] : starts[k] + 40]) for k in order]
    assert keys == sorted(keys)
    a, b = rng.integers(0, 2900, 300), rng.integers(0, 2900, 300)
    for x, y, n in zip(a, b, common_extension(Prefixes(data), a, b, 40), strict=True):
        same = 0
        while same < 40 and whole[x + same] == whole[y + same]:
            same += 1
        assert n == same


def test_collisions_are_found_by_the_bytes(monkeypatch):
    data = np.frombuffer(b"abcdabcexyzwabcd", np.uint8)
    starts, groups = np.array([0, 4, 8, 12]), np.zeros(4, np.int64)
    monkeypatch.setattr(Prefixes, "part", lambda self, start, size: np.zeros(len(start), np.uint64))
    assert repeated_starts(data, starts, groups, 4).tolist() == [True, False, False, True]


def test_spans_are_in_bytes_and_extra_columns_do_no_harm(spark, tmp_path):
    rows = [(1, "é" * 20, "k", 1), (None, "é" * 20, "k", 2)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, key string, _row long").write.parquet(path)
    got = remove_repeats(spark.read.parquet(path), length=30, seed=10).collect()
    assert {(r["doc_id"], tuple(r["starts"]), tuple(r["ends"]), bytes(r["kept"])) for r in got} == {(1, (0,), (40,), b""), (None, (0,), (40,), b"")}


def test_empty(spark, tmp_path):
    assert answer(spark, [], tmp_path) == []
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), length=10, seed=20)


def colliding():
    """Two texts of 320 bytes without a common string of 200, whose polynomial hashes modulo 2 ** 64 agree for the bases in use."""
    product = np.array([1], object)
    for power, times in ((1, 3), (2, 2), (4, 2), (8, 2), (16, 2), (32, 2), (192, 1)):
        factor = np.zeros(power + 1, object)
        factor[0], factor[-1] = -1, 1
        for _ in range(times):
            product = np.convolve(product, factor)
    # The product's coefficients are the differences of the bytes; the middle 64 are equal, and are to be the anchor of all strings.
    rng = np.random.default_rng(1)
    every = np.ones(121, bool)
    while True:
        a = rng.integers(76, 83, len(product)) + (product // 2).astype(np.int64)
        b = a - product.astype(np.int64)
        if all(len(Runs(x.astype(np.uint8), every, 200, 64).first) == 1 for x in (a, b)):
            return a.astype(np.uint8).tobytes().decode(), b.astype(np.uint8).tobytes().decode()


def test_texts_whose_polynomial_hashes_agree_are_kept(spark, tmp_path):
    a, b = colliding()
    assert len(a) == len(b) == 320 and max(a + b) < "~"
    size, at = np.array([320]), np.array([0])
    one, two = (Prefixes(np.frombuffer(t.encode(), np.uint8)).part(at, size) for t in (a, b))
    assert one == two
    rows = [a, b]
    assert answer(spark, rows, tmp_path) == brute(rows, 200)
    assert [r[1] for r in brute(rows, 200)] == [0, 0]


def test_other_splits_between_scans(spark, tmp_path, monkeypatch):
    """An executor lost or gained between scans changes how files are split: the same rows."""
    rows = texts(5) * 3
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3).write.option("parquet.block.size", 1024).parquet(path)
    kept = substrings.equal_runs

    def then_split(*args):
        runs = kept(*args)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        return runs

    monkeypatch.setattr(substrings, "equal_runs", then_split)
    try:
        got = digest(remove_repeats(spark.read.parquet(path), length=24, seed=8)).orderBy("doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [tuple(r)[1:] for r in got] == brute(rows, 24)
