"""CSV files read in many splits, against Python's csv module."""

import csv
import io
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sendero.sources import split_csv as S
from sendero.sources.csv import read_profiles_csv
from sendero.sources.schemas import PROFILE_COLUMNS

CELLS = ["", "a", "año", '"', '""', "x\ny", "x\r\ny", ",", 'say "hi"', "line\n\n,\"\nend", " pad ", "long " * 40, "\n" * 30, '"\n"']


@pytest.fixture()
def small_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "211b")
    yield
    spark.conf.set(name, before)


def _write(path, text):
    with open(path, "wb") as f:
        f.write(text.encode("latin-1"))


def _csv(rows, end):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def _parsed(records):
    return [next(csv.reader(io.StringIO(r, newline=""))) for r in records]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("limit", [S.BROADCAST_SPLITS, 0])
def test_records_in_many_splits(spark, tmpdir_path, small_splits, end, limit):
    rng = random.Random(7)
    files = {}
    for n in range(2):
        rows = [["id", "x", "y"]] + [[str(i), rng.choice(CELLS), rng.choice(CELLS)] for i in range(50)]
        files[n] = rows
        _write(os.path.join(tmpdir_path, f"f{n}.csv"), _csv(rows, end))
    assert S._lines(spark, tmpdir_path).rdd.getNumPartitions() > 8
    got = S.csv_records(spark, tmpdir_path, broadcast_splits=limit).orderBy("row_order").collect()
    assert _parsed(r["record"] for r in got) == files[0] + files[1]
    assert [i for i, r in enumerate(got) if r["first"]] == [0, len(files[0])]


def test_stray_quotes_and_an_open_end(spark, tmpdir_path, small_splits):
    text = 'id,x\n1,5" pipe\n2,"a"b"c\n' + "3,d\n" * 60 + '4,"never closed\n' + "5,e\n" * 60
    _write(os.path.join(tmpdir_path, "f.csv"), text)
    got = S.csv_records(spark, tmpdir_path).orderBy("row_order").collect()
    assert _parsed(r["record"] for r in got) == [[c.rstrip("\n") for c in r] for r in csv.reader(io.StringIO(text, newline=""))]


def test_profiles_of_one_file_in_many_splits(spark, tmpdir_path, small_splits):
    rng = random.Random(3)
    rows = [[str(i)] + [rng.choice(CELLS) for _ in PROFILE_COLUMNS[1:]] for i in range(12)]
    path = os.path.join(tmpdir_path, "p.csv")
    _write(path, _csv([[f" {c} " for c in PROFILE_COLUMNS]] + rows, "\n"))
    out = read_profiles_csv(spark, path)
    got = [list(r)[:-1] for r in out.orderBy(F.col(out.columns[-1])).collect()]
    assert got == [[c or None for c in r] for r in rows]


def test_empty_and_header_only(spark, tmpdir_path):
    _write(os.path.join(tmpdir_path, "e.csv"), "")
    assert S.csv_records(spark, os.path.join(tmpdir_path, "e.csv")).collect() == []
    path = os.path.join(tmpdir_path, "h.csv")
    _write(path, "id_usuario,nombre\n")
    assert read_profiles_csv(spark, path).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='a",', max_size=8), min_size=1, max_size=5))
def test_states_follow_the_csv_module(lines):
    """A line ends inside a cell exactly if the reader wants another one."""
    inside = False
    for i, line in enumerate(lines):
        inside = S.after(line.encode(), inside)
        with_more = list(csv.reader([x + "\n" for x in lines[:i + 1]] + ["zz\n"]))
        assert inside == (with_more[-1] != ["zz"])
