"""The split archive reader against the engine's reader for whole files."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hindcast.catalog.oracle import ORACLE
from hindcast.catalog.queries import REGISTRY
from hindcast.operators import cleaning
from hindcast.sources import archive, files

ROWS = [
    '2020-01-01,AAPL,plain', '2020-01-02,AAPL,"two\nlines, ""quoted"""', '2020-01-03,MSFT,"a\n\n\nb"', '2020-01-04,"X","""\n"""', '', '2020-01-05,NVDA,"é\n,\n"',
    '2020-01-06,SPY,stray " quote', '2020-01-07,QQQ,"', '"', '2020-01-08,AAPL,"shut" then more, and more', '2020-01-09,A,"x""', '","y"', '2020-01-10,A,""', ',,', '"2020\n-01-11",A,z',
    '2020-01-12,A,"crlf\r\ninside"', '2020-01-13,A', '2020-01-14,A,b,c,d',
]


def engine(spark, path):
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    return [tuple(r) for r in rows.select("date", "stock", "headline").collect()]


def split_read(spark, path, size):
    """Rows and their numbers, with the file cut into ranges of `size` bytes (only there: staged tables are left alone)."""
    note = archive.noted_lines

    def cut(*given):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        try:
            return note(*given)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")

    archive.noted_lines = cut
    try:
        rows = files.scan_news_csv(spark, path).orderBy("row_order").collect()
    finally:
        archive.noted_lines = note
    return [(r.date, r.stock, r.headline) for r in rows], [r.row_order for r in rows]


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_equal_the_whole_read_wherever_files_are_cut(spark, folder, end):
    body = end.join(ROWS).replace("\r\r\n", "\r\n")
    path = put(folder, "a.csv", f"date,stock,headline{end}{body}{end}")
    want = engine(spark, path)
    orders = set()
    for size in (9, 40, 150, 10_000):
        got, order = split_read(spark, path, size)
        assert got == want, size
        orders.add(tuple(order))
    assert len(orders) == 1
    data = open(path, "rb").read()
    assert all(o == 0 or data[o - 1 : o] == b"\n" for o in orders.pop())


def test_random_quotes(spark, folder):
    rng = random.Random(4)
    text = "date,stock,headline\n" + "".join(rng.choice(['"', '"', ",", "\n", "a", "b", '""', ',"', '",', '"\n']) for _ in range(500))
    path = put(folder, "r.csv", text + '\n1,2,3\n')
    want = None
    try:
        want, order = split_read(spark, path, 10**6)
    except files.SourceError:
        path = put(folder, "s.csv", text + '"\n1,2,3\n')
        want, order = split_read(spark, path, 10**6)
    for size in (29, 100):
        assert split_read(spark, path, size) == (want, order)


def test_well_formed_random_rows_equal_the_whole_read(spark, folder):
    rng = random.Random(5)
    cell = lambda: '"' + "".join(rng.choice(["a", "\n", ",", '""', "é", " "]) for _ in range(rng.randint(1, 12))) + '"' if rng.random() < 0.6 else rng.choice(["x", "", "y z"])
    for k in range(3):
        put(folder, f"part-{k}.csv", "date,stock,headline\n" + "".join(f"{cell()},{cell()},{cell()}\n" for _ in range(200)))
    want = [r for k in range(3) for r in engine(spark, f"{folder}/part-{k}.csv")]
    want = [r for r in want if r != (None, None, None)] if (None, None, None) not in want else want
    for size in (200, 777):
        assert split_read(spark, folder, size)[0] == want


def test_a_file_is_read_by_several_tasks(spark, folder):
    path = put(folder, "a.csv", "date,stock,headline\n" + '2020-01-01,A,"x\ny"\n' * 2000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        lines = archive.noted_lines(spark, path)
        assert lines.select("block").distinct().count() > 5
        assert archive.settled_ranges(lines).filter("inside").count() > 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_numbers_do_not_move_with_the_parallelism(spark, folder):
    path = put(folder, "a.csv", "date,stock,headline\n" + "".join(f'2020-01-{1 + k % 28:02d},AAPL,"h{k % 70}\n!"\n' for k in range(900)))
    found = set()
    for n in (1, 3, 16):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        try:
            clean = cleaning.clean_archive(files.scan_news_csv(spark, path))
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(17 - n))
            found.add(tuple(sorted(r.row_order for r in clean.collect())))
        finally:
            spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(found) == 1 and len(found.pop()) == 140


def test_what_is_refused(spark, folder):
    open_ = put(folder, "open.csv", 'date,stock,headline\n1,A,b\n2,A,"never shut\n3,A,c\n')
    with pytest.raises(files.SourceError, match="byte 26"):
        files.scan_news_csv(spark, open_)
    with pytest.raises(files.SourceError, match="no header"):
        files.scan_news_csv(spark, put(folder, "none.csv", ""))
    os.makedirs(f"{folder}/two")
    put(folder, "two/a.csv", "date,stock,headline\n1,A,b\n")
    put(folder, "two/b.csv", "date,headline,stock\n1,A,b\n")
    with pytest.raises(files.SourceError, match="different headers"):
        files.scan_news_csv(spark, f"{folder}/two")
    assert files.scan_news_csv(spark, put(folder, "head.csv", "date,stock,headline")).count() == 0


def test_states_are_the_same_wherever_ranges_begin():
    """Every cut of a text into two and three ranges, composed as the window does it."""
    lines = "\n".join(ROWS).encode().split(b"\n")
    whole = archive._Range().note(pa.array(lines, pa.binary()))
    for a in range(1, len(lines)):
        for b in range(a, len(lines), 5):
            state, at, start = 0, 0, -1
            seen, starts = [], []
            for part in (lines[:a], lines[a:b], lines[b:]):
                if part:
                    noted = archive._Range().note(pa.array(part, pa.binary()))
                    own = noted[6 + state]
                    seen += noted[2 + state].tolist()
                    starts += [int(x) + at if x >= 0 else start for x in own]
                    at, start, state = at + int(noted[1].sum()), starts[-1], int(noted[4 + state][-1])
            assert seen == whole[2].tolist() and starts == whole[6].tolist()


def test_states():
    cases = {b"a,b": (0, 1), b'a,"b': (1, 0), b'"': (1, 0), b'""': (0, 1), b'"a""': (1, 0), b'x"y': (0, 0), b'a "b",c': (0, 0), b'","': (0, 1), b'"a"b,"c': (1, 1)}
    for line, (r, q) in cases.items():
        assert (archive.ends_inside(line, False), archive.ends_inside(line, True)) == (bool(r), bool(q)), line


def test_one_scan_and_no_sort_aggregate(spark, folder):
    path = put(folder, "a.csv", "date,stock,headline\n" + "2020-01-01,AAPL,h\n" * 20)
    plan = cleaning.clean_archive(files.scan_news_csv(spark, path)).select(F.col("row_order"), "ticker")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "mapInArrow" not in plan and "from_csv" not in plan


def test_nul_is_a_character_like_any_other(spark, folder):
    heads = ["\0", '\0"', '"\0', 'a\0"b', '\0\0"\0"', "\0\n", "\0,\0", "a\0"]
    path = put(folder, "a.csv", "date,stock,headline\n" + "".join('1,A,"{}"\n'.format(h.replace('"', '""')) for h in heads))
    for size in (9, 10_000):
        assert split_read(spark, path, size)[0] == [("1", "A", h) for h in heads]


def test_a_noncharacter_is_kept(spark, folder):
    heads = ["\uffff", "a\uffff", "\uffffa", "a\uffffb", "\x02\uffff\x02b", "\x02b", '"\uffff"', '"\n\uffff"']
    path = put(folder, "a.csv", "date,stock,headline\n" + "".join(f"1,A,{h}\n" for h in heads) + "2,\uffff\n\uffff,,b\n")
    want = [("1", "A", h.strip('"')) for h in heads] + [("2", "\uffff", None), ("\uffff", None, "b")]
    for how in ({}, {"empty_texts": True}):
        assert [tuple(r)[:3] for r in files.scan_news_csv(spark, path, **how).orderBy("row_order").collect()] == want


def test_empty_texts_are_told_from_nothing(spark, folder):
    path = put(folder, "a.csv", 'date,stock,headline\n1,A,""\n2,A,\n"","",""\n,,\n3,"","\n"\n4,,\x01\n5,"",\x01\n6,\x01,""\n7,A\n')
    read = lambda **how: [tuple(r)[:3] for r in files.scan_news_csv(spark, path, **how).orderBy("row_order").collect()]
    assert read(empty_texts=True) == [
        ("1", "A", ""), ("2", "A", None), ("", "", ""), (None, None, None), ("3", "", "\n"), ("4", None, "\x01"), ("5", "", "\x01"), ("6", "\x01", ""), ("7", "A", None),
    ]
    assert read() == engine(spark, path)


def test_query_keeps_odd_texts(spark, folder):
    """The registered query against its SQL over texts that a text file can hold only with care."""
    duckdb = pytest.importorskip("duckdb")
    texts = ["", None, " ", '""', "\0", '\0"', "a\0", "\0\n", "\r", "a\r\nb", "x\r", '"\r\n"', "\x01", "\ufeff", "\uffff", "a\uffffb", "\\", '\\"', ",", '",\n"', "\n", "tail ", "\ttab"]
    rows = [(k, t, "en", f"src{14 + k % 2}", None if t is None else len(t)) for k, t in enumerate(texts * 3, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT row_hash, rows FROM ({ORACLE['scan_news_csv']})").fetchall()
    got = REGISTRY["scan_news_csv"](spark, folder).select("row_hash", "rows").collect()
    assert sorted(map(tuple, got)) == sorted(want)
