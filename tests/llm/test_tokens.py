import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from corpus import near_copies
from pyspark.sql import functions as F

from hindcast.llm import tokens
from hindcast.llm.tokens import Segment, default_tokenizer, encoder, read_tokens, tokens_of, write_levels, write_tokens

TEXTS = [
    "", "  ", "It's they'll can't 12345 '' 's's ÀÉÎ ﬁ İstanbul ΣΑΣ Σ. é", "<|endoftext|> a<|startoftext|>b <|x|>", "x y　z \x1c \x85 don't!!",
    "日本語 ß ÿ × ÷ µ ª Å ﬀ \x00 \x7f ö é", "naïve\tA\x0bB\x0c\r\nC $$$ %%% a.b,c-d_e", "word " * 3000,
]


def whole(text):
    return encoder(default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_words_give_the_ids_of_whole_texts(monkeypatch):
    rng = random.Random(1)
    signs = "abcXYZ éÜß'’-. 0179\t\n#<|>日ñ́"
    rows = TEXTS + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    words = encoder(default_tokenizer())
    for _ in range(2):
        ids, n = words.encode(pa.array(rows))
        stops = np.cumsum(n)
        assert [ids[b - k : b].tolist() for b, k in zip(stops, n, strict=True)] == [whole(t)[:-1] for t in rows]
        monkeypatch.setattr(tokens, "KNOWN_WORDS", 5)
        monkeypatch.setattr(tokens, "KNOWN_PIECES", 5)


@pytest.mark.parametrize("bits", [3, 8, 12, 16])
def test_any_place_is_read_directly(bits):
    rng = np.random.default_rng(bits)
    for ids in (np.array([1]), rng.integers(0, 60000, 3000), np.array([0, 255, 256, 65535, 65536, 2**31, 2**32 - 1]), np.arange(1030) % 2 * 300):
        ids = ids.astype(np.uint32)
        segment = Segment(write_levels(ids, bits), bits)
        assert (segment.all() == ids).all() and [segment[k] for k in range(len(ids))] == ids.tolist()
        with pytest.raises(IndexError):
            segment[len(ids)]


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for i, t in order:
        ids = whole(t)
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files(spark, tmp_path, monkeypatch):
    rows = [r for r in near_copies(3) if r[0] not in (2, 7)] + [(200 + k, t) for k, t in enumerate(TEXTS)] + [(300, "same row")] * 3 + [(None, "no id")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, part string").repartition(5)
    path = str(tmp_path / "t")
    write_tokens(docs, path, partitions=4)
    got = sorted((tuple(r) for r in read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert got == brute(rows)
    # Any token of the files, by its place.
    every = [i for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for i in whole(r[1])]
    at = 0
    for part, segment, n in sorted(map(tuple, spark.read.parquet(path).select("part", "segment", "n_tokens").collect())):
        one = tokens_of(spark, path, part, segment)
        assert [one[k] for k in range(0, n, 97)] == every[at : at + n : 97]
        at += n
    assert at == len(every)


def test_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), path)
    assert read_tokens(spark, path).count() == 0
    assert read_tokens(spark, path).agg(F.sum("n_tokens")).first()[0] is None


def test_words_are_split_by_bytes_and_new_pieces_alone_reach_the_model(monkeypatch):
    words = tokens.WordEncoder(default_tokenizer())
    rng = random.Random(2)
    # Every letter, digit and sign of ASCII and Latin-1, alone and mixed, some of them words that are taken one by one.
    signs = [chr(c) for c in range(33, 256) if not 127 <= c < 161 and c != 173]
    rows = [" ".join(signs), "".join(signs), "A×B c÷d é×É Ø÷ø", "a<b |c <|d <b|> x<|endoftext|>y", "ab c3d 12ef, É! it's '' 9's"]
    rows += ["".join(rng.choice([*signs, " ", " ", "'", "日", "é", "é"]) for _ in range(60)) for _ in range(400)]
    asked, byword = [], []

    class Model:
        def tokenize(self, piece, real=words.model):
            asked.append(piece)
            return real.tokenize(piece)

    words.model, word = Model(), words.word
    monkeypatch.setattr(words, "word", lambda w: byword.append(w) or word(w))
    ids, n = words.encode(pa.array(rows))
    stops = np.cumsum(n)
    assert [ids[b - k : b].tolist() for b, k in zip(stops, n, strict=True)] == [whole(t)[:-1] for t in rows]
    assert len(asked) == len(set(asked))
    words.encode(pa.array(rows))
    assert len(asked) == len(set(asked))
    byword.clear()
    # Words of letters, digits and signs are never taken one by one, and cases and signs share their letters' piece.
    some = ["Straße straße, (STRASSE) ÀB12 àb--àb", "x" * 3000 + "É" * 50]
    asked.clear()
    ids, n = words.encode(pa.array(some))
    assert ids.tolist() == [i for t in some for i in whole(t)[:-1]] and not byword
    assert sorted(set(asked)) == sorted(asked)
    assert words.encode(pa.array([], pa.string()))[0].tolist() == [] and words.encode(pa.array(["", " "]))[1].tolist() == [0, 0]
