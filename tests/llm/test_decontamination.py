import itertools
import random

import pyarrow as pa
from corpus import edited, sentence, vocabulary

from hindcast.llm import decontamination
from hindcast.llm.decontamination import contaminated, find, Index, keep_clean, MASKS, MIN_OVERLAP, PENALTY


def tables(spark):
    rng = random.Random(4)
    words = vocabulary(rng, 5000, "abcdefghijklmnop")
    items = [(k, sentence(rng, rng.randint(14, 60), words)) for k in range(30)]
    items += [(30, "only three words"), (31, None), (32, ""), (33, "?!"), (34, items[0][1])]
    docs, truth = [], set()
    for k in range(90):
        text = sentence(rng, rng.randint(20, 120), words)
        if k % 3 == 0:
            j = k % 30
            planted = items[j][1]
            if k % 2:
                # One word in nine is replaced.
                planted = " ".join(rng.choice(words) if n % 9 == 4 else w for n, w in enumerate(planted.split(" ")))
            if k % 4 == 0:
                planted = planted.upper().replace(" ", ", ") + "."
            text = text + "\n" + planted + " " + sentence(rng, 9, words)
            truth.add((k, j))
            if j == 0:
                truth.add((k, 34))
        docs.append((k, text, "x"))
    docs += [(100, None, "x"), (101, "", "x"), (102, "so Only three words here", "x"), (103, "only three other words", "x"), (None, items[3][1], "x")]
    docs += [docs[0]]
    truth |= {(102, 30), (None, 3)}
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"), truth


def test_planted_items_are_found_and_nothing_else(spark):
    docs, items, truth = tables(spark)
    rows = contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == truth
    assert len(rows) == len(truth) + 2  # the repeated row has both of its items again
    clean = keep_clean(docs, items)
    assert clean.columns == docs.columns
    bad = {d for d, _ in truth}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(r["doc_id"]) for r in docs.collect() if r["doc_id"] not in bad)


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    docs, items, truth = tables(spark)
    kept = decontamination.indexes
    monkeypatch.setattr(decontamination, "indexes", lambda b: kept(b, block_words=200))
    assert len(list(decontamination.indexes(items))) > 2
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()} == truth
    assert keep_clean(docs, items).count() == docs.count() - len({d for d, _ in truth}) - 1


def test_stretches_against_brute_force():
    rng = random.Random(8)
    words = vocabulary(rng, 200)
    items = [sentence(rng, 25, words) for _ in range(6)]
    texts = [sentence(rng, 5, words) + " " + edited(rng, rng.choice(items), 0.12, words) + " " + sentence(rng, 5, words) for _ in range(60)]
    index = Index.of(pa.array(range(6)).to_numpy(), pa.array(items), MASKS)
    got = find(pa.array(texts), index, 10, 4)
    for text, item, doc_start, item_start, span, same in zip(*got.values(), strict=True):
        d, i = texts[text].split(), items[item].split()
        equal = [d[doc_start + k] == i[item_start + k] for k in range(span)]
        assert sum(equal) == same >= 10 and equal[0] and equal[-1]
        shift, best = doc_start - item_start, 0
        for a in range(len(i)):
            score = 0
            for b in range(a, len(i)):
                if 0 <= b + shift < len(d):
                    score += 1 if d[b + shift] == i[b] else -4
                    best = max(best, score)
        assert best == same - 4 * (span - same)


def missed(masks, need=MIN_OVERLAP, penalty=PENALTY):
    """The shortest pattern of at least `need` equal words that gains from both ends on and is hit by no mask, or None.

    A least such pattern (none shorter within it) is two parts of under `need` equal words with only smaller ones
    between, so its gain stays under 2 * need; that bounds the states: last words, gain, highest gain, equal words.
    """
    full = (1 << max(map(len, masks))) - 1
    codes = [int(m, 2) for m in masks]
    states = {(0, 0, 0, 0): ""}
    waiting = list(states)
    for state in waiting:
        last, gain, high, equal = state
        for bit in (1, 0):
            now = gain + 1 if bit else gain - penalty
            recent = (last << 1 | bit) & full
            if 0 < now < 2 * need and not any(recent & m == m for m in codes):
                new = (recent, now, max(high, now), min(need, equal + bit))
                if bit and now > high and equal + bit >= need:
                    return states[state] + "1"
                if new not in states:
                    states[new] = states[state] + str(bit)
                    waiting.append(new)
    return None


def equal_words(same, penalty=PENALTY):
    """Equal words of the best stretch: the first to end, and then the shortest."""
    ends = [(sum(1 if x else -penalty for x in same[a:b]), -b, a) for a, b in itertools.combinations(range(len(same) + 1), 2)]
    _, b, a = max(ends)
    return sum(same[a:-b])


def test_masks_miss_no_stretch():
    assert missed(("11101011", "110111011", "10110111", "1110010100111")) == "111110011111"
    assert missed(MASKS) is None


def test_find_against_brute_force_on_patterns():
    patterns = ["".join(p) for n in range(10, 14) for p in itertools.product("01", repeat=n) if p.count("1") == 10]
    patterns += [("1" * run + "00") * 4 + "1" * last for run in (3, 4, 5, 6, 7) for last in (0, run)]
    rng = random.Random(6)
    patterns += ["".join("0" if rng.random() < rate else "1" for _ in range(15)) for rate in (0.1, 0.15, 0.2) for _ in range(1000)]
    wanted, items, texts = set(), [], []
    for k, pattern in enumerate(patterns):
        same = [c == "1" for c in pattern]
        items.append(" ".join(f"i{k}w{j}" for j in range(len(same))))
        texts.append("before " + " ".join(f"i{k}w{j}" if x else f"x{k}w{j}" for j, x in enumerate(same)) + " after")
        if equal_words(same) >= 10:
            wanted.add((k, k))
    index = Index.of(pa.array(range(len(items))).to_numpy(), pa.array(items), MASKS)
    got = find(pa.array(texts), index)
    assert set(zip(got["text"].tolist(), got["item"].tolist(), strict=True)) == wanted


def test_empty(spark):
    docs, items, _ = tables(spark)
    assert contaminated(docs.limit(0), items).count() == 0
    assert contaminated(docs, items.limit(0)).count() == 0
    assert keep_clean(docs, items.limit(0)).count() == docs.count()
