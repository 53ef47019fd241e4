"""Splittable scan of CSV files with line breaks inside fields, against the whole-file reader."""

import os
import random

import pytest

from tillroll.model import TABLES
from tillroll.sources.csvsplit import block_table, csv_records, read_csv
from tillroll.sources.landing import CSV_OPTIONS, land_csv

SCHEMA = TABLES["order_reviews"].file_schema
HEADER = ",".join(SCHEMA.names)


def _field(rng, end):
    kind = rng.randrange(8)
    if kind == 0:
        return ""
    if kind == 1:
        return '""'
    if kind == 2:
        return "plain words"
    text = "".join(rng.choice(["a", "é", ",", '""', "\n", "\r\n", end, end * 2, " ", "word"]) for _ in range(rng.randint(1, 30)))
    return f'"{text}"'


def _file(folder, name, seed, rows, end="\n", last=True, blank=0.0):
    rng = random.Random(seed)
    out = [HEADER]
    for i in range(rows):
        out.append(f"{name}{i},o{i},{rng.randint(1, 5)},{_field(rng, end)},{_field(rng, end)},2018-01-01 10:00:00,"
                   + rng.choice(["", "2018-01-02 11:30:00.5"]))
        if rng.random() < blank:
            out.append("")
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(end.join(out) + (end if last else ""))
    return path


def _whole(spark, path):
    return spark.read.schema(SCHEMA).options(**CSV_OPTIONS).csv(path)


@pytest.fixture()
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "10b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed,end,last,blank", [(1, "\n", True, 0), (2, "\r\n", True, 0), (3, "\n", False, .2), (4, "\r\n", False, .2)])
def test_equals_the_whole_file_reader(spark, tmpdir_fresh, small_blocks, seed, end, last, blank):
    path = _file(tmpdir_fresh, "a.csv", seed, 120, end, last, blank)
    got = read_csv(spark, path, SCHEMA, CSV_OPTIONS)
    blocks = block_table(spark, path)
    assert blocks.count() > 20 and blocks.where("open").count() > 3           # records run over block ends
    want = [tuple(r) for r in _whole(spark, path).collect()]
    rows = sorted(tuple(r)[1:] for r in got.collect())
    if end == "\r\n":      # the whole-file reader turns CRLF inside quotes to LF, but only in files whose lines end so
        assert any("\r\n" in v for r in rows for v in r if isinstance(v, str))
        rows = [tuple(v.replace(end, "\n") if isinstance(v, str) else v for v in r) for r in rows]
    assert [r[1:] for r in rows] == want                                      # in file order
    assert [r[0] for r in rows] == list(range(len(want)))                     # numbers are dense


def test_one_file_is_read_by_many_tasks(spark, tmpdir_fresh, small_blocks):
    path = _file(tmpdir_fresh, "a.csv", 5, 300)
    assert csv_records(spark, path).rdd.getNumPartitions() > 20


def test_a_record_longer_than_many_blocks(spark, tmpdir_fresh, small_blocks):
    path = os.path.join(tmpdir_fresh, "a.csv")
    long = "\n".join(["x" * 50, "", 'say ""no""', "\r"] * 200)
    with open(path, "w", newline="") as f:
        f.write(f'{HEADER}\nr0,o0,5,,"{long}",2018-01-01 10:00:00,\nr1,o1,4,"",,2018-01-01 10:00:00,\n')
    rows = sorted(read_csv(spark, path, SCHEMA, CSV_OPTIONS).collect(), key=lambda r: r._number)
    assert [r.review_id for r in rows] == ["r0", "r1"]
    assert rows[0].review_comment_message == long.replace('""', '"')
    assert rows[1].review_comment_title == "" and rows[1].review_comment_message is None


def test_header_over_lines_and_files_without_records(spark, tmpdir_fresh):
    for name, text in {"a.csv": "", "b.csv": HEADER, "c.csv": HEADER + "\n", "d.csv": "\n\n",
                       "e.csv": '"review\nid",' + HEADER.partition(",")[2] + "\nr,o,1,,,,\n", "f.csv": "\n" + HEADER + "\n\nq,o,2,,,,"}.items():
        with open(os.path.join(tmpdir_fresh, name), "w", newline="") as f:
            f.write(text)
    rows = read_csv(spark, tmpdir_fresh, SCHEMA, CSV_OPTIONS).collect()
    assert sorted((r.review_id, r._number) for r in rows) == [("q", 0), ("r", 0)]


@pytest.mark.parametrize("line", ['r,o,1,5" pipe,,,', 'r,o,1,"a"b,,,', 'r,o,1,"never closed,,,', "r,o,one,,,,", 'r,o,1,a "b" c,,,'])
def test_malformed_records_fail(spark, tmpdir_fresh, line):
    path = os.path.join(tmpdir_fresh, "a.csv")
    with open(path, "w", newline="") as f:
        f.write(f"{HEADER}\nr,o,1,,,,\n{line}\n")
    with pytest.raises(Exception):
        read_csv(spark, path, SCHEMA, CSV_OPTIONS).collect()


def test_landing_uses_it(spark, tmpdir_fresh, small_blocks):
    _file(tmpdir_fresh, "b.csv", 6, 60)
    _file(tmpdir_fresh, "a.csv", 7, 30)
    df = land_csv(spark, tmpdir_fresh, "order_reviews")
    assert df.rdd.getNumPartitions() > 10
    rows = df.orderBy("review_sk").collect()
    assert [r.review_sk for r in rows] == list(range(1, 91))
    assert [r.review_id for r in rows] == [f"a.csv{i}" for i in range(30)] + [f"b.csv{i}" for i in range(60)]
