import hashlib
import random
import sys

import numpy as np
import pytest

from hindcast.llm import merges
from hindcast.llm.merges import Merger, RankQueue, default_pattern, default_ranks, encode_decode, merger

tiktoken = pytest.importorskip("tiktoken")
ALPHABETS = ["ab", "abcde", "aeiounrst", "thein ", "!?.-=*", "éüßa", "日本語", "  \n\ta", "a1 '"]
TEXTS = [
    None, "", " ", "  \n ", "It's they'LL can't 12345''s", "<|endoftext|> x", "a" * 5000, "ab " * 3000, "日本語 ß ÿ × \x00 \x7f é \U0001f600\U0001f600",
    "naïve\tA\x0bB\x0c\r\nC $$$ %%% a.b", "\x1c\x85  x", "zq" * 2000 + " " * 300,
]


@pytest.fixture(scope="module")
def own():
    return merger(default_ranks(), default_pattern())


@pytest.fixture(scope="module")
def known(own):
    return tiktoken.Encoding("own", pat_str=default_pattern(), mergeable_ranks=own.ranks, special_tokens={})


def ids(own, text):
    return own.encode([text])[0].tolist()


def samples(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(rng.choice(ALPHABETS) if k % 5 == 0 else ALPHABETS[k % 9]) for _ in range(rng.choice([1, 7, 40, 250, 900]))) for k in range(n)]


def test_ids_are_those_of_the_library(own, known, monkeypatch):
    for text in [t or "" for t in TEXTS] + samples(1, 400):
        got = own.encode([text])[0]
        assert got.tolist() == known.encode_ordinary(text)
        assert own.decode(got)[0].tobytes().decode() == text
    # Many texts at once, in small blocks and with a small memory.
    texts = samples(2, 50)
    want = [known.encode_ordinary(t) for t in texts]
    for block, merge, limit in ((10**6, 10**6, 10**6), (30, 10, 10), (1, 1, 0)):
        monkeypatch.setattr(merges, "BLOCK_PIECES", block)
        monkeypatch.setattr(merges, "MERGE_BYTES", merge)
        monkeypatch.setattr(own, "limit", limit)
        assert [g.tolist() for g in own.encode(texts)] == want
        assert len(own.codes) <= limit


def test_split_of_every_character(own, known):
    signs = [chr(c) for c in range(0, 0x30000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(signs), 5000):
        text = "".join(f"a{c}b {c}{c}1" for c in signs[a : a + 5000])
        assert ids(own, text) == known.encode_ordinary(text)


def by_definition(ranks, piece):
    """Merge the leftmost pair of the lowest rank, again and again."""
    parts = [bytes([b]) for b in piece]
    while True:
        at = min((ranks[parts[k] + parts[k + 1]], k) if parts[k] + parts[k + 1] in ranks else (sys.maxsize, k) for k in range(len(parts) - 1)) if len(parts) > 1 else (sys.maxsize, 0)
        if at[0] == sys.maxsize:
            return [ranks[p] for p in parts]
        parts[at[1] : at[1] + 2] = [parts[at[1]] + parts[at[1] + 1]]


def test_a_lower_rank_that_appears_comes_first():
    """Ranks in any order, so that merges uncover pairs of lower rank."""
    rng = random.Random(7)
    for trial in range(60):
        tokens = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))) for _ in range(60)}
        names = [bytes([b]) for b in range(256)] + sorted(tokens, key=lambda t: rng.random())
        rng.shuffle(names)
        ranks = {t: i for i, t in enumerate(names)}
        m = Merger(ranks, r"[\s\S]+")
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 60))) for _ in range(30)]
        assert [np.frombuffer(x, "<u4").tolist() for x in m.merge(pieces)] == [by_definition(ranks, p) for p in pieces]


def test_queue():
    rng = random.Random(3)
    for n in (1, 64, 65, 5000, 300_000):
        queue, model = RankQueue(n), {}
        for _ in range(300):
            rank = rng.randrange(n)
            if rank not in model:
                model[rank] = sorted(rng.sample(range(9), 3))
                queue.put(rank, np.array(model[rank]))
            if rng.random() < 0.4:
                low = min(model)
                assert queue.lowest() == low and queue.take(low).tolist() == model.pop(low)
        while model:
            assert queue.take(queue.lowest()).tolist() == model.pop(min(model))
        assert queue.lowest() == -1
    queue.put_all(np.array([7, 3, 7, 3]), np.array([5, 1, 2, 1]))
    queue.put(7, np.array([2, 9]))
    assert queue.lowest() == 3 and queue.take(3).tolist() == [1]
    assert queue.take(7).tolist() == [2, 5, 9]


def test_documents(spark, known):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS + samples(4, 30))] + [(None, "no id", "x"), (4, "repeat", "x"), (4, "repeat", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _ in rows:
        got = known.encode_ordinary(t or "")
        want.append((str(i), len(got), sha(np.array(got, "<u4").tobytes()), sha((t or "").encode())))
    got = encode_decode(docs)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(want)
    full = encode_decode(docs, with_ids=True).filter("doc_id = 4").collect()
    assert {r["decoded"].decode() for r in full} == {TEXTS[4], "repeat"}


def test_long_text_in_portions(own, known, monkeypatch):
    text = " ".join(samples(9, 40)) * 3
    monkeypatch.setattr(merges, "BLOCK_PIECES", 50)
    portions = list(own.pieces(text))
    assert len(portions) > 5 and max(map(len, portions)) <= 50
    assert ids(own, text) == known.encode_ordinary(text)


def test_empty(spark):
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
