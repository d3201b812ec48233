"""The pipeline and the registered queries: stage by stage against plain versions, and SQL where there is some."""

import random
from collections import Counter

import pytest
from corpus import DOCS, edited, sentence, vocabulary
from test_quality import counts
from test_similar import brute as linked
from test_tokens import brute as token_rows

import corpus_pipeline
from hindcast.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    words = vocabulary(rng, 4000, "abcdefghijklmnop")
    items = [(k, sentence(rng, 25, words)) for k in range(5)]
    texts = []
    for k in range(120):
        text = sentence(rng, rng.randint(30, 90), words)
        if k % 6 == 1:
            text = " ".join(w + "%%%" for w in text.split())
        elif k % 6 == 2:
            text = edited(rng, texts[k - 2], 0.01, words)
        elif k % 12 == 3:
            text += " " + items[k % 5][1] + " " + sentence(rng, 9, words)
        texts.append(text)
    rows = [(k, t, "en", ["a", "a", "a", "b", None][k % 5], len(t)) for k, t in enumerate(texts)]
    rows += [(500, None, None, "a", None), (501, "", "en", "b", 0), (502, "too few words", "en", "b", 13), (503, texts[0], "en", None, 1)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, int(k % 6 != 1), 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, items


def test_stages(spark, folder, tmp_path):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name.replace(" ", "-")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        seen.append(sorted(map(tuple, docs.collect())))
    good = [r for r in rows if counts(r[1])["n_words"] >= 20 and "%%%" not in r[1]]
    assert seen[0] == sorted(good)
    first = {c for _, _, c in linked([r[:2] for r in good])}
    single = [r for r in good if r[0] in first]
    assert seen[1] == sorted(single) and len(single) < len(good)
    clean = [r for r in single if not any(t in r[1] for _, t in items)]
    assert seen[2] == sorted(clean) and len(clean) < len(single)
    mixed = Counter(seen[3])
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 3
    words = lambda rs: Counter({s: sum(len(r[1].split()) * n for r, n in rs.items() if r[3] == s) for s in ("a", "b", None)})
    have, got = words(Counter(clean)), words(mixed)
    assert all(got[s] <= 3 * have[s] for s in have) and abs(sum(got.values()) - sum(have.values())) <= 3 * 90
    assert sorted(seen[4], key=lambda r: r[1]) == token_rows([r[:2] for r in seen[3]])
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect())) == seen[4]


def test_run_on_empty_documents(spark, folder, tmp_path):
    path, _, _ = folder
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_over_whole_tables(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for t in ("documents", "conversations", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.execute(ORACLE[name]).df()
        assert sorted(want.columns) == sorted(got.columns)
        rows = lambda df: sorted(tuple(round(float(v), 6) if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
        assert rows(got) == rows(want)
    elif name not in ("op6_benchmark_decontamination",):
        table = {"op9": "pages", "op12": "embeddings"}.get(name.split("_")[0], "documents")
        assert len(got) == spark.read.parquet(f"{SF}/{table}.parquet").count()
