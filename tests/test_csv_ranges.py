"""CSV read in ranges against Spark's reader of whole files."""

import os
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tetrad.sources import csvranges
from tetrad.sources.posts import CORRUPT, CSV_SCHEMA, read_posts_csv


@pytest.fixture()
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def whole(spark, path):
    return spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"', schema=CSV_SCHEMA,
                          columnNameOfCorruptRecord=CORRUPT, enforceSchema=True)


def rows(df):
    return sorted((tuple((x or "").rstrip("\r\n") if x is not None else None for x in r) for r in df.collect()), key=str)


def write(path, *files):
    os.makedirs(path)
    for k, text in enumerate(files):
        with open(f"{path}/{k}.csv", "w", newline="") as f:
            f.write(text)


def field(rng):
    text = "".join(rng.choices(["a", "bc ", "\n", '"', ",", "é", " "], k=rng.randint(0, 12)))
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in '",\n') or rng.random() < 0.3 else text


def test_equal_to_the_whole_file_reader(spark, tmp_dir, small_ranges):
    rng = random.Random(7)
    files = []
    for _ in range(3):
        body = [f"{field(rng)},{field(rng)}" for _ in range(60)]
        body[10:10] = ["", "one field", "a,b,c", '"' + "long\n" * 60 + '",x', ""]
        files.append("posts,type\n" + "\n".join(body) + rng.choice(["", "\n"]))
    write(tmp_dir, *files)
    got = csvranges.read_csv(spark, tmp_dir, CSV_SCHEMA, CORRUPT)
    assert got.rdd.getNumPartitions() > 10
    assert rows(got) == rows(whole(spark, tmp_dir))


def test_header_of_many_lines(spark, tmp_dir, small_ranges):
    write(tmp_dir, '"posts\n' + "and more\n" * 20 + '",type\nx,INTJ\n', "posts,type\n", "")
    assert rows(csvranges.read_csv(spark, tmp_dir, CSV_SCHEMA, CORRUPT)) == [("x", "INTJ", None)]


def test_ids_do_not_depend_on_ranges(spark, tmp_dir):
    write(tmp_dir, "posts,type\n" + "\n".join(f'"post {i % 40},\n""text""",INTJ' for i in range(60)))
    want = rows(read_posts_csv(spark, tmp_dir))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        assert rows(read_posts_csv(spark, tmp_dir)) == want and len({r[0] for r in want}) == 60
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@given(st.lists(st.text(alphabet='a",x', max_size=8), min_size=1, max_size=6), st.integers(0, 5))
def test_state_of_a_range_is_that_of_its_lines(lines, cut):
    lines = [x.encode() for x in lines]

    def after(some, is_open):
        for x in some:
            is_open = csvranges.open_after(x, is_open)
        return is_open
    assert after(lines, False) == after(lines[cut:], after(lines[:cut], False))


@pytest.mark.parametrize("line, is_open, after", [(b"", False, False), (b"", True, True), (b'"a', False, True), (b'a"b', False, False),
                                                  (b'"a""', False, True), (b'"a"""', False, False), (b'x,"', False, True),
                                                  (b'"a"b"c,d', False, False), (b'",', True, False), (b'","', True, True)])
def test_state_after_a_line(line, is_open, after):
    assert csvranges.open_after(line, is_open) is after
