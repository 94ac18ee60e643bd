import pandas as pd
import pytest

from civictopics.sources import proposals as ps


def test_reads_quotes_lines_and_mark(spark, tmp_path):
    path = tmp_path / "test.csv"
    path.write_bytes(
        "﻿row_id,proposal_text\n1,\"diz \"\"sim\"\"\nem duas linhas\"\n2,\n3,\"  \"\n".encode()
    )
    rows = ps.read_proposals(spark, str(path)).orderBy("row_id").collect()
    assert [tuple(r) for r in rows] == [(1, 'diz "sim"\nem duas linhas'), (2, None), (3, "  ")]


@pytest.mark.parametrize("bom", [False, True])
def test_csv_round_trip(spark, tmp_path, bom):
    rows = [(1, 'a, "b"\nc\\'), (2, None), (3, "é;ç")]
    df = spark.createDataFrame(rows, ps.PROPOSALS)
    ps.write_csv(df, str(tmp_path / "out"), bom=bom)
    back = ps.read_proposals(spark, str(tmp_path / "out")).orderBy("row_id").collect()
    assert [tuple(r) for r in back] == rows
    part = next((tmp_path / "out").glob("part-*.csv")).read_bytes()
    assert part.startswith("﻿".encode()) == bom


def test_results_open_in_a_portuguese_spreadsheet(spark, tmp_path):
    df = spark.createDataFrame([("m", 0.5, 3), ("n", 0.00001, 4), ("o", None, 5), ("p", 12345678.5, 6), ("q", -0.0005, 7), ("r", -2e9, 8)], "model string, nc double, n long")
    ps.write_results(df.coalesce(1), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*.csv"))
    assert part.read_text().splitlines()[:2] == ["model;nc;n", "m;0,5;3"]
    assert [line.split(";")[1] for line in part.read_text().splitlines()[4:]] == ["12345678,5", "-0,0005", "-2000000000,0"]
    back = pd.read_csv(part, sep=";", decimal=",")
    assert back["nc"][1] == pytest.approx(1e-5) and pd.isna(back["nc"][2])


def test_columns_are_taken_by_name(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text("proposal_text,VCGE_N1,row_id\num texto,Saúde,7\n", encoding="utf-8")
    assert [tuple(r) for r in ps.read_proposals(spark, str(path)).collect()] == [(7, "um texto")]
    with pytest.raises(ValueError, match="VCGE_N2"):
        ps.read_proposals(spark, str(path), ps.LABELLED_PROPOSALS)
