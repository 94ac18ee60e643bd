"""CSV files read in pieces against Spark's own reader, which takes a file in one task."""

import random

import pytest

from civictopics.sources import proposals as ps
from civictopics.sources.csv_records import read_records, records

BODY = ('row_id,proposal_text,extra\n1,"a\nb ""q""\n\n x",y\n2,,""\n\n3," ",z\n4,"é,\n""\n""",\n5,plain,"""start"\n'
        '6,"x\n\n\n\n\n\n\n",end')


def own_reader(spark, path):
    rows = spark.read.csv(str(path), header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8").collect()
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture
def cut_at(spark):
    """Splits files into ranges of so many bytes."""
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.unset("spark.sql.files.openCostInBytes")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text", [BODY, BODY + "\n", BODY.replace("\n", "\r\n"), "﻿" + BODY], ids=["lf", "end", "crlf", "bom"])
def test_same_rows_at_every_cut(spark, tmp_path, cut_at, text):
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode())
    want = own_reader(spark, path)
    for size in (61, 17):
        cut_at(size)
        assert sorted(map(tuple, read_records(spark, str(path)).collect()), key=repr) == want, size


def test_many_files_with_long_records(spark, tmp_path, cut_at):
    draw = random.Random(2)
    for k in range(3):
        rows = []
        for i in range(40):
            text = "".join(draw.choice(['a', 'é', '""', '\n', ',', ' ', 'b']) for _ in range(draw.choice([0, 3, 30, 400])))
            rows.append(f'{k * 100 + i},"{text}",{draw.choice(["", "x"])}')
        (tmp_path / f"part-{k}.csv").write_bytes(("row_id,proposal_text,extra\n" + "\n".join(rows)).encode())
    want = own_reader(spark, tmp_path)
    assert len(want) == 120
    for size in (997, 300):
        cut_at(size)
        assert sorted(map(tuple, read_records(spark, str(tmp_path)).collect()), key=repr) == want, size
    assert records(spark, str(tmp_path)).select("file", "block").distinct().count() > 10


def test_header_alone_and_lenient_reading(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("row_id,proposal_text\n")
    assert read_records(spark, str(tmp_path / "empty.csv")).collect() == []
    (tmp_path / "odd.csv").write_text('row_id,proposal_text\n1,5" wide\n2,ok\n')
    assert [tuple(r) for r in ps.read_proposals(spark, str(tmp_path / "odd.csv"), strict=False).collect()] == [(1, '5" wide'), (2, "ok")]
