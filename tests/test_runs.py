import csv
import random

import pandas as pd
import pytest

from civictopics.operators import labelling as la
from civictopics.plans import grid as gr
from civictopics.plans import model as mo
from civictopics.plans import runs
from civictopics.sources import proposals as ps
from civictopics.sources import taxonomy as ta

GROUPS = {
    "Saúde": "hospital médico posto vacina enfermeiro leito remédio consulta",
    "Educação": "professor aluno escola creche merenda ensino aula livro",
    "Transportes": "asfalto buraco calçada semáforo trânsito ônibus ciclovia avenida",
}


def write(path, seed, labelled):
    rng, n = random.Random(seed), 0
    with open(path, "w", encoding="utf-8", newline="") as out:
        rows = csv.writer(out)
        rows.writerow(["id", "proposal_text"] + (["VCGE_N1", "VCGE_N2"] if labelled else []))
        for label, words in GROUPS.items():
            for _ in range(45):
                n += 1
                text = " ".join(rng.choices(words.split(), k=12)) + f"\n{label.lower()}"
                rows.writerow([f"p{n}", text] + ([label if n % 9 else "", ""] if labelled else []))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    write(folder / "training.csv", 1, False)
    write(folder / "test.csv", 2, True)
    return folder


def parts(path):
    return pd.concat(pd.read_csv(p) for p in path.glob("part-*.csv"))


def test_evaluation_run(spark, files, tmp_path):
    settings = mo.Settings(dim=64, k=3, nr_topics=70)
    internal, external = runs.evaluation_run(
        spark, str(files / "training.csv"), str(files / "test.csv"),
        str(tmp_path / "info"), str(tmp_path / "results"), settings,
    )
    scores = external.first()
    assert scores.ari > 0.9 and scores.n_rows == 135 and scores.n_scored <= 120
    inner = internal.first()
    assert inner.ws == pytest.approx(0.8 * inner.nc + 0.2 * inner.nd) and inner.nd == 1.0
    written = parts(tmp_path / "results")
    assert list(written.columns) == ["original_text", "VCGE_N1", "VCGE_N2", "topic", "probability"]
    assert len(written) == 135
    assert {"topic", "cnt", "name", "representation", "representative_docs"} == set(parts(tmp_path / "info"))


def test_tuning_run(spark, files, tmp_path, monkeypatch):
    monkeypatch.setattr(gr, "PHASE_2_TOPICS", (3, None))
    monkeypatch.setattr(gr, "PHASE_2_SIZES", (10,))
    board = runs.tuning_run(
        spark, str(files / "training.csv"), str(tmp_path / "p2"), {"hash": 64}, 2, 1, k=3
    ).collect()
    assert [r.ws for r in board] == sorted((r.ws for r in board), reverse=True)
    written = pd.concat(
        pd.read_csv(p, sep=";", decimal=",") for p in (tmp_path / "p2").glob("part-*.csv")
    )
    assert list(written.columns) == [
        "n_gram_range", "nr_topics", "min_topic_size", "num_topics_found", "NC", "ND", "WC", "WD",
        "Weighted Score", "valid_iters",
    ]
    assert set(written["nr_topics"].astype(str)) == {"3", "auto"}
    assert set(written["n_gram_range"]) == {"(1, 1)"}


def test_labelling_run(spark, files, tmp_path):
    audit = runs.labelling_run(
        spark, str(files / "test.csv"), str(tmp_path / "out"), ta.taxonomy(spark)
    ).collect()
    assert {r.n1: r.cnt for r in audit if r.n1} and sum(r.cnt for r in audit) == 135
    rows = ps.read_proposals(spark, str(tmp_path / "out"), schema=None)
    assert rows.columns == ["id", "proposal_text", "VCGE_N1", "VCGE_N2"]
    right = rows.filter("proposal_text like '%' || lower(VCGE_N1)").count()
    assert right == 135
    assert rows.filter("VCGE_N1 = 'Saúde'").select("VCGE_N2").distinct().count() >= 1
    assert la.NO_CHILDREN == "Sem subcategoria"


def test_grids_have_the_stated_sizes(spark):
    first = gr.parameter_grid(spark, list("abcdef"), gr.PHASE_1_TOPICS, iterations=gr.ITERATIONS)
    second = gr.parameter_grid(spark, ["a"], gr.PHASE_2_TOPICS, gr.PHASE_2_SIZES, gr.ITERATIONS)
    assert (first.count(), second.count()) == (480, 360)
    assert gr.append_runs(first.select("config_id"), second).count() == 840
