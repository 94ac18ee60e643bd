"""The three complete runs, from CSV files to result files: tuning, evaluation, labelling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civictopics.operators import coherence, labelling
from civictopics.operators.prepare import clean_and_prepare, with_model_tokens
from civictopics.plans import evaluation, grid, model
from civictopics.sources import proposals as ps
from civictopics.storage import cut

TEXT = "proposal_text"
LABELS = ("VCGE_N1", "VCGE_N2")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    return ps.with_row_ids(ps.read_proposals(spark, path, schema=None))


def _scored(rows: DataFrame, words: DataFrame, min_words: int) -> DataFrame:
    return coherence.internal_scores(rows, words, min_words=min_words)


def tuning_run(
    spark: SparkSession,
    train: str,
    out: str,
    models: Mapping[str, int],
    phase: int = 1,
    iterations: int = grid.ITERATIONS,
    **settings,
) -> DataFrame:
    """Fit and score the grid of ``phase`` on the texts of ``train``; the best comes first.

    ``models`` maps a model name to its vector length.  The result file has ``;`` between columns
    and decimal commas.  Topics of one word count in phase 2 only.
    """
    docs = with_model_tokens(clean_and_prepare(_numbered(spark, train), TEXT))
    if phase == 1:
        runs = grid.parameter_grid(
            spark, list(models), grid.PHASE_1_TOPICS, iterations=iterations
        )
    else:
        runs = grid.parameter_grid(
            spark, list(models), grid.PHASE_2_TOPICS, grid.PHASE_2_SIZES, iterations
        )
    scores = grid.run_grid(docs, runs, models, min_words=2 if phase == 1 else 1, **settings)
    config = ["config_id", "model", "n_gram_range", "nr_topics", "min_topic_size"]
    summary = cut(grid.summarise(scores, config), "summary")
    ps.write_results(grid.result_table(summary, phase), out)
    return grid.leaderboard(summary, ["config_id"])


def evaluation_run(
    spark: SparkSession,
    train: str,
    test: str,
    info_out: str,
    results_out: str,
    settings: model.Settings = model.FINAL,
    seed_words: DataFrame | None = None,
    seed_topics: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Fit on ``train``, assign ``test`` and score against its labels.

    Returns the internal and the external scores.  With seed tables the model is guided.
    """
    fitted = model.fit_topics(
        clean_and_prepare(_numbered(spark, train), TEXT), settings, seed_words, seed_topics
    )
    lists = ("representation", "representative_docs")
    ps.write_csv(
        fitted.info.withColumns({c: F.to_json(c) for c in lists}), info_out
    )
    source = _numbered(spark, test)
    predicted = model.transform(fitted, clean_and_prepare(source, TEXT))
    aligned = cut(evaluation.align_predictions(source, predicted, LABELS), "aligned")
    ps.write_csv(aligned.drop("row_id"), results_out)
    internal = _scored(fitted.assigned, fitted.words, 1)
    return internal, evaluation.external_scores(aligned, LABELS[0])


def labelling_run(
    spark: SparkSession,
    path: str,
    out: str,
    tax: DataFrame,
    respond: labelling.Responder = labelling.overlap_responses,
    **limits,
) -> DataFrame:
    """Label the texts of ``path`` and write all their columns with the labels.

    Returns the label distribution.
    """
    source = _numbered(spark, path)
    columns = [c for c in source.columns if c not in ("row_id", *LABELS)]
    labels = cut(
        labelling.classify(source, tax, respond, TEXT, keep=columns, **limits), "labelled"
    )
    named = labels.select(*columns, F.col("n1").alias(LABELS[0]), F.col("n2").alias(LABELS[1]))
    ps.write_csv(named, out, bom=True)
    return labelling.label_distribution(labels)
