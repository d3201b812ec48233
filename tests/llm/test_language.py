import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from corpus import sentence, vocabulary

from hindcast.llm.language import LEAD, ORDER, code_lengths, identify, learn

SCHEMA = "doc_id long, text string, lang string, score string"


def documents():
    rng = random.Random(2)
    a, b = vocabulary(rng, 60, "abcdé"), vocabulary(rng, 60, "defgß")
    rows = []
    for k in range(80):
        rows.append((k, sentence(rng, rng.randint(3, 40), (a, b)[k % 2]), ("aa", "bb")[k % 2], "x"))
    return rows + [(90, None, "aa", "x"), (91, "abc", None, "x"), (None, "abcd abcd", "aa", "x"), (3, rows[3][1], "bb", "x")]


def code_length(counts, data):
    """Method C with exclusion, byte by byte."""
    bits = 0.0
    for k in range(ORDER, len(data)):
        excluded, p = set(), 1.0
        for size in range(ORDER, -1, -1):
            seen = {b: n for b, n in counts[data[k - size : k]].items() if b not in excluded}
            if not seen:
                continue
            total = sum(seen.values())
            whole = total + (len(seen) if len(excluded) + len(seen) < 256 else 0)
            if data[k] in seen:
                p *= seen[data[k]] / whole
                break
            p *= len(seen) / whole
            excluded |= set(seen)
        else:
            p /= 256 - len(excluded)
        bits -= math.log2(p)
    return bits


def test_code_lengths_are_exact(spark):
    rows = documents()
    trees = learn(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert trees.langs == ["aa", "bb"]
    asked = ["abcd dcba", "gfed", "", "é", "zz top 日本", rows[0][1]]
    got = code_lengths(trees, pa.array(asked))
    for which, lang in enumerate(trees.langs):
        counts = defaultdict(Counter)
        for _, t, name, _ in rows:
            if t is not None and name == lang:
                data = LEAD + t.encode()
                for k in range(ORDER, len(data)):
                    for size in range(ORDER + 1):
                        counts[data[k - size : k]][data[k]] += 1
        for k, t in enumerate(asked):
            assert got[k, which] == pytest.approx(code_length(counts, LEAD + t.encode()), rel=1e-4, abs=1e-3)
    _, cost = trees.tables()
    for which in range(2):
        assert np.exp2(-cost[:, which].astype(float)).reshape(-1, 256).sum(1) == pytest.approx(1, abs=1e-3)


def test_fewer_contexts_still_give_probabilities(spark):
    trees = learn(spark.createDataFrame(documents(), SCHEMA), max_contexts=5)
    _, cost = trees.tables()
    assert np.exp2(-cost[:, 0].astype(float)).reshape(-1, 256).sum(1) == pytest.approx(1, abs=1e-3)
    assert all(len(c) <= 5 for c in trees.contexts)


def test_predictions(spark):
    rows = documents()
    trees = learn(spark.createDataFrame(rows, SCHEMA))
    docs = [(r[0], r[1], "k") for r in rows] + [(200, "123 !?", "k"), (201, "", "k")]
    out = identify(spark.createDataFrame(docs, "doc_id long, text string, bits_ string"), trees).collect()
    assert [r["lang_pred"] for r in out[:80]] == [r[2] for r in rows[:80]]
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}
    assert by_id[90] == by_id[200] == by_id[201] == ("und", 0.0) and by_id[91][0] == "aa"
    assert all(0 <= r["score"] <= 1 for r in out)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None, "x"), (2, None, "aa", "x")], SCHEMA)
    got = identify(docs.select("doc_id", "text"), learn(docs)).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert identify(docs.limit(0).select("doc_id", "text"), learn(docs.limit(0))).count() == 0
