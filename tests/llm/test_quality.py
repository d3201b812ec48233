import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from corpus import sentence, vocabulary
from pyspark.sql import functions as F

from hindcast.llm import quality
from hindcast.llm.quality import Condition, Rule, features, fit, judged, keep_good, learn_list, rejects, text_counts, with_counts

WORD = r"[^\x20\x09-\x0D]+"


def counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    seen, dup = set(), 0
    lines = [line for line in text.split("\n") if re.search(WORD, line)]
    for line in lines:
        dup += line in seen
        seen.add(line)
    times = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {k for i in range(len(words) - 7) if times[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup, "n_repeat_words": len(again), "n_lines": len(lines), "n_upper": len(re.findall("[A-Z]", text)),
    }


def texts():
    rng = random.Random(1)
    words = vocabulary(rng, 30) + ["é", "|", "%%%", "日本", "A"]
    out = [sentence(rng, rng.randint(0, 60), words) for _ in range(40)]
    out += ["\n".join(rng.choice(["a b", "c", " ", "", "a b ", "a b"]) for _ in range(12)) for _ in range(10)]
    return out + ["", "\n\n", "w " * 500, (sentence(rng, 9, words) + "\n") * 3, "x\x0by\x1cz\x85w", "a\r\nb\r\na\r\n", "12345678 " * 8]


def test_counts_against_brute_force():
    rows = texts()
    got = text_counts(pa.array(rows))
    for k, t in enumerate(rows):
        want = counts(t)
        assert {c: int(got[c][k]) for c in want} == want, t


def corpus(spark, n=600):
    rng = random.Random(2)
    words = vocabulary(rng, 3000)
    rows = []
    for k in range(n):
        text = sentence(rng, rng.randint(30, 90), words)
        if k % 5 == 0:
            text = " ".join(w + "%%%" for w in text.split())
        if k % 7 == 0:
            text = text.upper()
        rows.append((k, text, 9, "extra"))
    labels = [(k, int(k % 5 != 0 and k % 7 != 0)) for k in range(n)] + [(None, 0), (1, None), (10**9, 1)]
    odd = [(n, None, 1, None), (n + 1, "", 1, None), (n + 2, "w " * 100, 1, None), (n + 3, "few words", 1, None), (None, rows[1][1], 1, None)]
    return spark.createDataFrame(rows + odd, "doc_id long, text string, n_words long, rule string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_learned_list_keeps_good_documents(spark):
    docs, labels = corpus(spark)
    rules = fit(docs, labels)
    assert 1 <= len(rules) <= quality.MAX_RULES and all(str(r).startswith("reject if ") for r in rules)
    got = keep_good(docs, labels)
    assert got.columns == docs.columns
    ids = {r["doc_id"] for r in got.collect()}
    assert ids == {k for k in range(600) if k % 5 and k % 7} | {None}
    few = judged(docs.select("doc_id", "text"), [])
    assert {r["doc_id"] for r in few.filter("base_failed").collect()} == {600, 601, 602, 603}


def test_expression_equals_the_list(spark):
    rules = [Rule((Condition("symbol_share", True, 0.1), Condition("word_length", True, 3.0))), Rule((Condition("upper_share", True, 0.01),))]
    docs = spark.createDataFrame([(t,) for t in texts()], "text string")
    got = with_counts(docs).withColumn("_r", rejects(rules)).toPandas()
    rows = features({c: got[c].to_numpy() for c in quality.COUNTS})
    first = np.where(rules[0].holds(rows), 1, np.where(rules[1].holds(rows), 2, 0))
    assert got["_r"].tolist() == first.tolist() and set(first) == {0, 1, 2}


def test_covering():
    rng = np.random.default_rng(0)
    rows = {"a": rng.random(900), "b": rng.random(900), "noise": rng.random(900)}
    bad = (rows["a"] > 0.8) | ((rows["b"] <= 0.2) & (rows["a"] <= 0.3))
    rules = learn_list(rows, bad)
    covered = np.zeros(900, bool)
    for r in rules:
        covered |= r.holds(rows)
    assert (covered != bad).mean() < 0.02
    assert learn_list(rows, np.zeros(900, bool)) == [] and learn_list({"a": np.zeros(0)}, np.zeros(0, bool)) == []
    # Labels that nothing explains give no rule that is no better than chance.
    chance = rng.random(900) < 0.5
    assert all(chance[r.holds(rows)].mean() > chance.mean() for r in learn_list(rows, chance))


def test_without_labels_or_rows(spark):
    docs, labels = corpus(spark, 40)
    assert fit(docs, labels.limit(0)) == []
    empty = docs.limit(0)
    assert keep_good(empty, labels).count() == 0
    assert keep_good(docs, labels.limit(0)).filter(F.col("doc_id") >= 40).count() == 0
