import random

import numpy as np
import pyarrow as pa
import pytest
from corpus import edited, near_copies, sentence, vocabulary

from hindcast.llm import similar
from hindcast.llm.components import components
from hindcast.llm.similar import bit_sketches, keep_one, links, op2_jaccard_join, shingle_sets


def shingles(text):
    for a, b in zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", strict=True):
        text = (text or "").replace(a, b)
    w = text.encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows))


def answer(spark, rows, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    got = op2_jaccard_join(spark, str(tmp_path)).collect()
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, tmp_path, seed):
    rows = near_copies(seed)
    assert answer(spark, rows, tmp_path) == brute(rows)


def test_sizes_at_the_limit_and_chains(spark, tmp_path):
    rng = random.Random(5)
    words = vocabulary(rng, 3000, "abcdefghijklmnop")
    rows, k = [], 0
    for n in (5, 6, 7, 8, 9, 11, 12, 35, 36, 64, 90, 130, 260):
        text = sentence(rng, n, words).split()
        # Cuts and additions around three quarters, across the bands of sizes.
        for part in (text, text[: 3 * n // 4], text[: 3 * n // 4 + 2], text + text[::-1][: n // 3], text[n // 8 :]):
            rows.append((k, " ".join(part)))
            k += 1
    chain = sentence(rng, 120, words)
    for _ in range(12):
        rows.append((k, chain))
        chain = edited(rng, chain, 0.02, words)
        k += 1
    assert answer(spark, rows, tmp_path) == brute(rows)


def test_a_passage_in_all_texts(spark, tmp_path):
    rng = random.Random(9)
    words = vocabulary(rng, 2000, "abcdefghijklmnop")
    passage = sentence(rng, 40, words)
    rows = [(k, sentence(rng, 12, words) + " " + passage + " " + sentence(rng, 12, words)) for k in range(150)]
    rows += [(k + 200, edited(rng, rows[0][1], 0.01, words)) for k in range(60)]
    assert answer(spark, rows, tmp_path) == brute(rows)


def test_sketches_bound_the_difference():
    rng = random.Random(3)
    words = vocabulary(rng, 300)
    texts = [sentence(rng, 80, words)]
    texts += [edited(rng, texts[0], 0.1, words) for _ in range(30)]
    ends, values = shingle_sets(pa.array(texts))
    sets = [set(values[ends[k] : ends[k + 1]].tolist()) for k in range(len(texts))]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    bits = bit_sketches(ends, values)
    for a in range(len(texts)):
        for b in range(a):
            assert np.bitwise_count(bits[a] ^ bits[b]).sum() <= len(sets[a] ^ sets[b])


def test_only_candidates_of_other_components_are_compared_twice(spark, tmp_path, monkeypatch):
    """Links that the first comparison can't see are found in the second."""
    rows = near_copies(4)
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    calls = []
    kept = similar.verified
    monkeypatch.setattr(similar, "verified", lambda pairs, texts: calls.append(pairs.count()) or kept(pairs, texts))
    links(spark.read.parquet(path))
    assert len(calls) in (1, 2) and calls[0] > 0


def test_keep_one(spark, tmp_path):
    rows = near_copies(2) + [(None, "zz yy xx ww vv uu"), (None, "zz yy xx ww vv uu"), (99, "zz yy xx ww vv uu")]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(i, t, k, "n") for k, (i, t) in enumerate(rows)], "doc_id long, text string, _row long, node string").write.parquet(path)
    kept = keep_one(spark.read.parquet(path))
    assert kept.columns == ["doc_id", "text", "_row", "node"]
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    expected = {c for i, n, c in brute([(10**6 if i is None else i, t) for i, t in rows]) if n}
    assert sorted(i for i, t in got if shingles(t)) == sorted(expected)
    # Texts without words are in no group.
    assert len([1 for i, t in got if not shingles(t)]) == len([1 for i, t in rows if not shingles(t)])


def test_components(spark):
    pairs = [(k, k + 1) for k in range(1, 30)] + [(100, 101), (101, 102), (100, 102), (7, 7), (50, 60), (60, 50)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "u long, v long")).collect()))
    assert got == {**{k: 1 for k in range(1, 31)}, 100: 100, 101: 100, 102: 100, 50: 50, 60: 50}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty(spark, tmp_path):
    assert answer(spark, [], tmp_path) == []


@pytest.mark.parametrize("part_nodes", [3, 4096])
def test_pairs_of_different_components_against_all_pairs(spark, part_nodes):
    """Keys with equal lists, repeated rows, hot keys in parts: the same pairs as meeting at every key."""
    rng = np.random.default_rng(part_nodes)
    n = 40
    size = rng.integers(5, 40, n)
    sketch = rng.integers(0, 8, (n, len(similar.SKETCH)))
    lists = [rng.choice(n, int(k), replace=False) for k in rng.integers(1, 25, 30)]
    lists += lists[:10] + [np.arange(n)]
    blocks = [(100 + k, int(i)) for k, nodes in enumerate(lists) for i in nodes] + [(100, int(i)) for i in lists[0]]
    label = {i: i % 9 for i in range(n) if i % 3}
    rows = [(i, i, int(size[i]), *map(int, sketch[i])) for i in range(n)]
    got = similar.apart(
        spark.createDataFrame(blocks, "key long, node long"),
        spark.createDataFrame(list(label.items()), "node long, component long"),
        spark.createDataFrame(rows, ["doc_id", "node", "n", *similar.SKETCH]),
        part_nodes,
    )
    expected = set()
    for nodes in lists:
        for u in nodes.tolist():
            for v in nodes.tolist():
                sized = 4 * size[u] >= 3 * size[v] and 4 * size[v] >= 3 * size[u]
                near = 7 * np.bitwise_count(sketch[u] ^ sketch[v]).sum() <= size[u] + size[v]
                if u > v and label.get(u, u) != label.get(v, v) and sized and near:
                    expected.add((u, v))
    assert expected and sorted(map(tuple, got.collect())) == sorted(expected)


def test_wide_sketches_bound_the_difference_of_large_sets():
    rng = random.Random(6)
    words = vocabulary(rng, 4000)
    texts = [sentence(rng, 2600, words)]
    texts += [edited(rng, texts[0], share, words) for share in (0.002, 0.02, 0.1)]
    texts += [" ".join(texts[0].split()[:1990]), sentence(rng, 100, words), ""]
    ends, values = shingle_sets(pa.array(texts))
    sets = [set(values[ends[k] : ends[k + 1]].tolist()) for k in range(len(texts))]
    wide = similar.wide_sketches(ends, values).to_pylist()
    assert [len(w) * 8 for w in wide] == [8192] * 4 + [4096, 0, 0]
    # A folded sketch is the sketch of the same set at the smaller size.
    low = values[ends[4] : ends[5]] & np.uint64(2047)
    assert similar.apart_in(wide[4], np.packbits(np.bincount(low.astype(int), minlength=2048) & 1, bitorder="little").tobytes()) == 0
    for a in range(5):
        for b in range(5):
            assert similar.apart_in(wide[a], wide[b]) <= len(sets[a] ^ sets[b])
    assert similar.apart_in(wide[0], wide[5]) <= 4096 and similar.apart_in(wide[5], wide[6]) == 0


def test_texts_of_large_sets_that_differ_are_not_compared(spark, tmp_path, monkeypatch):
    """Sketches of fixed size leave large sets to their texts, of which each pair moves one."""
    rng = random.Random(8)
    words = vocabulary(rng, 4000)
    base = sentence(rng, 2600, words)
    rows = [(0, base), (1, edited(rng, base, 0.005, words)), (2, edited(rng, base, 0.12, words))]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    found, _ = similar.describe(docs, "text", "doc_id")
    node = {r["doc_id"]: r["node"] for r in found.collect()}
    pairs = spark.createDataFrame([(node[0], node[1]), (node[0], node[2]), (node[1], node[2])], "u long, v long")
    calls = []
    kept = similar.verified
    monkeypatch.setattr(similar, "verified", lambda pairs, texts: calls.append(pairs.count()) or kept(pairs, texts))
    got = [tuple(r) for r in similar.compared(docs, "text", found, pairs).collect()]
    assert got == [(node[0], node[1])] and calls == [1]
