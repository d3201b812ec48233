import math
import re
from itertools import permutations

import pytest

from hindcast.llm.interaction import audit, flagged, mask_cells, prefixes

DOCS = "doc_id long, text string, source string, mask string, part int"
LABELS = "doc_id long, quality int, toxic int, text string"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def masks(rows):
    out = []
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        out.append((i, source or "", {c for c in failed if failed[c]}))
    return out


def brute(rows, labels):
    docs = masks(rows)
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    out = {}
    for part in {p for _, p, _ in docs}:
        mine = [(i, f) for i, p, f in docs if p == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                now = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                failing = sum(c in f for _, f in mine)
                sums[c] += len(now)
                out[part, "".join(order), step] = [
                    len(left), len(now), failing - len(now), sum(f == {c} for _, f in mine), sum(i in good for i, _ in now), sum(i in toxic for i, _ in now),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(sums[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def corpus():
    plain = " ".join(f"word{k}" for k in range(210))
    few = "a b " * 150
    rows = [(1, plain, "x"), (2, plain, "y"), (3, plain + " #", "x"), (4, few, "x"), (5, few, None), (6, few, ""), (7, None, "x"), (8, "", "y"), (9, " \t", "y")]
    rows += [(10, "SHOUT & " * 300, "x"), (11, "SHOUT & " * 300, "z"), (11, "SHOUT & " * 300, "z"), (None, plain, "x"), (None, plain, "x"), (12, plain.replace("word", "Word "), "é")]
    rows += [(20, "Ab", "x"), (21, "é" * 49 + "A", "x"), (22, "é" * 50 + "A", "x"), (23, "w\x0bw\x0cw\x1cw", "x"), (24, " ".join(["p", "q"] * 2 + ["r"]), "x"), (0, plain, "last")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, None, 1), (10, 0, 1), (11, 1, None), (None, 1, 1), (99, 1, 1), (20, 1, 1)]
    return rows, labels


def test_audit(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], DOCS).repartition(4)
    got = audit(flagged(docs, spark.createDataFrame([(*r, "clash") for r in labels], LABELS)))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)


@pytest.mark.parametrize("letters", ["A", "XYZ"])
def test_prefixes_of_any_letters(spark, letters):
    cells = spark.createDataFrame([("p", m, m % 3, m % 2) for m in range(1 << len(letters))] * 2, "part string, mask int, good int, toxic int")
    walk = prefixes(mask_cells(cells), letters).collect()
    n = len(letters)
    assert sorted(r["filter_order"] for r in walk) == sorted("".join(p) for k in range(1, n + 1) for p in permutations(letters, k))
    assert len(walk) == sum(math.perm(n, k) for k in range(1, n + 1))
    for r in walk:
        assert r["kept"] == 2 * 2 ** (n - r["step"]) and r["removed"] == r["kept"] and r["removed"] + r["redundant"] == 2 * 2 ** (n - 1)


def test_the_plan_has_no_cross_join(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], DOCS)
    plan = audit(flagged(docs, spark.createDataFrame([(*r, "clash") for r in labels], LABELS)))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit(flagged(docs, labels)).columns == COLUMNS and audit(flagged(docs, labels)).count() == 0
    one = spark.createDataFrame([(1, None, None, "", 0)], DOCS)
    assert audit(flagged(one, labels)).count() == 600
