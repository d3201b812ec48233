from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.operators import cells, decisions, retrieval, scale

T0 = datetime(2024, 3, 12, 14, 30)


@pytest.fixture(scope="module")
def events(spark):
    rows = [("e1", "AAPL", "Apple up", T0), ("e2", "AAPL", "Apple down", T0 + timedelta(hours=1)), ("e3", "MSFT", "Soft", T0)]
    return spark.createDataFrame(rows, "event_id string, ticker string, headline string, published_at timestamp_ntz")


@pytest.fixture(scope="module")
def hits(spark):
    rows = [("e1", "leak", 0.99, T0 + timedelta(seconds=1)), ("e1", "edge", 0.5, T0), ("e1", "old", 0.7, T0 - timedelta(days=3))]
    rows += [("e2", f"d{i:03d}", (i % 10) / 10, T0 - timedelta(minutes=i)) for i in range(200)]
    return spark.createDataFrame(rows, "event_id string, document_id string, score double, available_at timestamp_ntz").withColumns(
        {"text": F.concat(F.lit("about "), "document_id"), "ticker": F.lit("AAPL"), "source": F.lit("fixture")}
    )


def ids(df, event):
    return [r.document_id for r in df.filter(F.col("event_id") == event).orderBy("rank").collect()]


def test_future_hit_never_survives(events, hits):
    top = retrieval.topk_hits(events, hits, 5)
    assert ids(top, "e1") == ["old", "edge"]
    assert ids(top, "e2") == ["d009", "d019", "d029", "d039", "d049"]


def test_salted_topk_is_the_same(events, hits):
    plain = retrieval.topk_hits(events, hits, 5)
    _, salted = retrieval.join_hits_asof(events, hits, min_hot_rows=50)
    assert salted
    cols = ("event_id", "document_id", "rank")
    hot = retrieval.topk_hits(events, hits, 5, min_hot_rows=50)
    assert sorted(map(tuple, hot.select(*cols).collect())) == sorted(map(tuple, plain.select(*cols).collect()))
    assert "_salt" not in hot.columns


def test_topk_is_limited_before_the_shuffle(events, hits):
    plan = scale.top_k(hits, ["event_id"], [F.desc("score")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_nested_filter_keeps_equality(spark):
    df = spark.createDataFrame([(T0, [("a", T0), ("b", T0 + timedelta(seconds=1))])], "p timestamp_ntz, hits array<struct<document_id: string, available_at: timestamp_ntz>>")
    kept = df.select(retrieval.filter_nested_as_of(F.col("hits"), F.col("p")).alias("h")).first().h
    assert [h.document_id for h in kept] == ["a"]


def test_prompt(events, hits):
    top = retrieval.topk_hits(events, hits, 2)
    rows = {r.event_id: r for r in retrieval.context_prompt(events, top, F.when(F.col("event_id") == "e3", "bad json")).collect()}
    assert rows["e1"].prompt == (
        "event_id: e1\nticker: AAPL\npublished_at: 2024-03-12T14:30:00+00:00\nheadline: Apple up\ncontext:\n"
        "- [old] score=0.700 available_at=2024-03-09T14:30:00+00:00 :: about old\n"
        "- [edge] score=0.500 available_at=2024-03-12T14:30:00+00:00 :: about edge\n"
    )
    assert rows["e3"].n_hits == 0
    assert "(no retrieval context after as-of filter)" in rows["e3"].prompt
    assert rows["e3"].prompt.endswith("\nPrevious output was invalid: bad json\nFix and return valid JSON only.\n")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        # Two thirds of the rows share one ticker; some vectors repeat exactly.
        v = rows[i - 7][4] if i % 20 == 9 else [float(x) for x in rng.normal(size=8)]
        rows.append((i, i, "HOT" if i % 3 else "B", T0 + timedelta(minutes=i), v))
    return rows


def brute(rows, k, include_self=True, overfetch=None):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, _, _, v in rows}
    out = set()
    for e, _, t, at, _ in rows:
        published = at + timedelta(hours=1)
        cand = [(-round(float(unit[e] @ unit[p]), 9), p, a) for p, _, u, a, _ in rows if u == t and (include_self or p != e)]
        if overfetch:
            cand = sorted(cand)[:overfetch]
        seen = sorted(c for c in cand if c[2] <= published)[:k]
        out |= {(e, p, n + 1) for n, (_, p, _) in enumerate(seen)}
    return out


def vector_frames(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, point_id long, ticker string, available_at timestamp_ntz, vector array<double>")
    events = df.withColumn("published_at", F.expr("available_at + INTERVAL 1 HOUR"))
    return events, df.drop("event_id")


@pytest.mark.parametrize("block_rows, include_self", [(1000, True), (32, True), (32, False)])
def test_vector_topk_equals_brute_force(spark, vectors, block_rows, include_self):
    events, points = vector_frames(spark, vectors)
    top = retrieval.vector_topk_join(events, points, 5, include_self=include_self, block_rows=block_rows)
    assert {(r.event_id, r.point_id, r.rank) for r in top.collect()} == brute(vectors, 5, include_self)


def clustered(spark, n, tickers=("HOT",), late=0):
    """Vectors in tight groups, in time order."""
    rng = np.random.default_rng(8)
    groups = rng.normal(size=(12, 16))
    rows = [(i, i, tickers[i % len(tickers)], T0 + timedelta(minutes=late * i), (groups[rng.integers(12)] + rng.normal(size=16) * 0.02).tolist()) for i in range(n)]
    return rows, vector_frames(spark, rows)


def searched(events, points, k, as_of, block_rows):
    e, p = (retrieval.split_vectors(d)[0] for d in (events.select("event_id", "point_id", "ticker", "published_at", "vector"), points))
    return cells.search(e, p, k, as_of, block_rows, retrieval._block_top(k, as_of, True), "event_id long, point_id long, available_at timestamp_ntz, score double")


def test_cells_that_cannot_hold_a_hit_are_skipped(spark):
    rows, (events, points) = clustered(spark, 900, ("HOT", "HOT", "B"))
    done = searched(events, points, 5, True, 40)
    assert done.every == done.in_time and done.compared < 0.5 * done.in_time
    top = scale.top_k(done.best, ["event_id"], [F.desc("score"), F.asc("point_id")], 5)
    assert {(r.event_id, r.point_id, r.rank) for r in top.collect()} == brute(rows, 5)


def test_later_cells_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(cells, "SLAB_BLOCKS", 2)
    rows, (events, points) = clustered(spark, 600, late=1)
    done = searched(events, points, 3, True, 16)
    assert done.in_time < 0.8 * done.every and done.compared < done.in_time
    top = scale.top_k(done.best, ["event_id"], [F.desc("score"), F.asc("point_id")], 3)
    assert {(r.event_id, r.point_id, r.rank) for r in top.collect()} == brute(rows, 3)


@pytest.mark.parametrize("as_of", [True, False])
def test_rows_travel_once_for_each_tile_of_the_other_side(spark, monkeypatch, as_of):
    rows, (events, points) = clustered(spark, 400, late=1)
    cut = cells.cells(retrieval.split_vectors(points)[0], "available_at", "point_id", 8)
    told = cells.tiles(cut, "available_at")
    assert told.agg(F.sum("n_cells")).first()[0] >= 50 and {r.tile for r in told.collect()} == {0}
    monkeypatch.setattr(cells, "TILE_ROWS", 100)
    monkeypatch.setattr(cells, "SLAB_BLOCKS", 4)
    done = searched(events, points, 3, as_of, 8)
    assert done.compared <= done.in_time <= done.every
    if as_of:
        top = scale.top_k(done.best, ["event_id"], [F.desc("score"), F.asc("point_id")], 3)
        assert {(r.event_id, r.point_id, r.rank) for r in top.collect()} == brute(rows, 3)


def test_block_rows_hold_for_a_ticker_with_very_many_blocks(spark):
    """10,000 blocks asked for, an instant that a third of the rows share."""
    df = spark.range(40_000).selectExpr(
        "id AS point_id", "'HOT' AS ticker", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(if(id % 3 = 0, 7, id) AS int), 0) AS available_at",
        "array(cos(id), sin(id)) AS vector",
    )
    cut = cells.slabs(df, "available_at", "point_id", cells.SLAB_BLOCKS * 4)
    assert cut.groupBy("slab").count().agg(F.max("count")).first()[0] < 3 * cells.SLAB_BLOCKS * 4
    rows = cells.cells(df, "available_at", "point_id", 4)
    sizes = rows.groupBy("slab", "cell").count()
    assert rows.count() == 40_000 and sizes.agg(F.max("count")).first()[0] <= 4
    told = cells.about(rows, "")
    assert told.count() == sizes.count() and told.agg(F.sum("n")).first()[0] == 40_000


def test_vectors_without_length_are_told_apart(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [3.0, 4.0])], "id int, vector array<double>")
    good, bad = retrieval.split_vectors(df)
    assert [list(r.vector) for r in good.collect()] == [[0.6, 0.8]] and bad.count() == 2


def test_overfetch_may_return_fewer(spark, vectors):
    events, points = vector_frames(spark, vectors)
    got = {(r.event_id, r.point_id, r.rank) for r in retrieval.overfetch_topk(events, points, 5, block_rows=32).collect()}
    expected = brute(vectors, 5, overfetch=15)
    assert got == expected and len(expected) < len(brute(vectors, 5))


def test_embed_unit_default_and_hook(spark):
    df = spark.createDataFrame([("a", "up up and away"), ("b", "UP, up and away!"), ("c", "down")], "id string, text string")
    rows = {r.id: np.array(r.vector) for r in retrieval.embed_unit(df).collect()}
    assert rows["a"].shape == (384,)
    assert np.linalg.norm(rows["a"]) == pytest.approx(1.0)
    assert rows["a"] @ rows["b"] == pytest.approx(1.0) and rows["a"] @ rows["c"] < 0.5

    def lengths(frames):
        for pdf in frames:
            yield pdf.assign(vector=[[float(len(t)), 0.0] for t in pdf["text"]])

    hooked = retrieval.embed_unit(df, encode_text=lengths).collect()
    assert all(list(r.vector) == [1.0, 0.0] for r in hooked)


def test_identity_is_stamped(spark):
    rows = [("e1", "AAPL", "e1", "AAPL"), ("e1", "AAPL", "x", "AAPL"), ("e1", "AAPL", "e1", "MSFT"), ("e1", "AAPL", None, None)]
    df = spark.createDataFrame(rows, "event_id string, ticker string, proposed_event_id string, proposed_ticker string")
    out = decisions.stamp_identity(df).collect()
    assert [r.identity_mismatch for r in out] == [False, True, True, True]
    assert {(r.event_id, r.ticker) for r in out} == {("e1", "AAPL")}


def test_skew_join_equals_plain_join(spark):
    many = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 50) END AS k")
    few = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "k string, v int")
    for how in ("inner", "left"):
        salted, used = scale.skew_join(many, few, ["k"], how, F.col("id"), min_rows=500, salts=8)
        assert used
        assert sorted(map(str, salted.select("id", "k", "v").collect())) == sorted(map(str, many.join(few, "k", how).select("id", "k", "v").collect()))
