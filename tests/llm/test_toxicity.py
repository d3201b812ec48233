import random

import numpy as np
import pyarrow as pa
from corpus import sentence, vocabulary

from hindcast.llm.toxicity import IDENTITY_TERMS, features_of, fit_logistic, identity_swaps, learn, score, text_features


def test_features():
    assert features_of("(Idiots!!") == ("idiots", "idio*", "idiot*")
    assert features_of("%%%") == () and features_of("") == ()
    who, what, names = text_features(pa.array(["a b a", "", "B"]))
    assert [(int(t), names[f]) for t, f in zip(who, what, strict=True)] == [(0, "a"), (0, "b"), (2, "b")]


def test_swaps():
    terms = (("men", "women"), ("x", "y", "z"))
    assert identity_swaps("Men talk. Of X, and men?", terms) == [("men", "women"), ("x", "y"), ("x", "z"), ("men", "women")]
    assert identity_swaps("", terms) == []


def test_penalty_evens_out_group_terms():
    """Feature 1 (a group) goes along with the label, feature 2 is its counterpart."""
    rng = np.random.default_rng(0)
    label = (np.arange(400) % 2).astype(float)
    text, feature = [], []
    for k in range(400):
        text += [k] * 2
        feature += [0 if rng.random() < 0.7 * label[k] + 0.1 else 3, 1 if rng.random() < 0.2 + 0.6 * label[k] else 2]
    swaps = [np.array([0, 0]), np.array([1, 2]), np.array([-1.0, 1.0])]
    free, _ = fit_logistic(np.array(text), np.array(feature), label, 4, swaps, np.array([1.0]), swap_penalty=0.0)
    tied, _ = fit_logistic(np.array(text), np.array(feature), label, 4, swaps, np.array([1.0]), swap_penalty=50.0)
    assert abs(free[1] - free[2]) > 1 and abs(tied[1] - tied[2]) < 0.1
    assert tied[0] > 0.5


def test_learned_scores(spark):
    rng = random.Random(6)
    words = vocabulary(rng, 800)
    rows, labels = [], []
    for k in range(900):
        text = sentence(rng, rng.randint(5, 80), words).split()
        bad = k % 4 == 0
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["idiot,", "Morons", "moron"])
        # The group is named more often in bad texts of the sample.
        if rng.random() < (0.5 if bad else 0.05):
            text.append("women")
        rows.append((k, " ".join(text), 0.5, "x"))
        labels.append((k, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra double, y string")
    model = learn(docs, spark.createDataFrame(labels + [(None, 1), (1, None)], "doc_id long, toxic int"))
    asked = [(1, "you moron"), (2, "the women talk"), (3, "the men talk"), (4, None), (5, ""), (5, "calm words"), (6, "calm " * 5000 + "idiot"), (None, "moron")]
    out = score(spark.createDataFrame([(i, t, "z") for i, t in asked], "doc_id long, text string, predicted_before string"), model).collect()
    assert [r["predicted"] for r in out] == [1, 0, 0, 0, 0, 0, 1, 1]
    assert all(0 <= r["score"] <= 1 for r in out)
    assert abs(out[1]["score"] - out[2]["score"]) < 0.15
    assert any("women" in g for g in IDENTITY_TERMS)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in score(docs, learn(docs, none)).collect()] == [0, 0]
    assert score(docs.limit(0), learn(docs.limit(0), none)).count() == 0
