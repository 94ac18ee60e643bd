"""Evaluation against gold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civictopics.operators import agreement as ag


def align_predictions(
    source: DataFrame, predicted: DataFrame, columns: tuple[str, ...] = ("VCGE_N1", "VCGE_N2")
) -> DataFrame:
    """``(row_id, original_text, columns..., topic, probability)``.

    Labels of ``source (row_id, columns...)`` for exactly the rows that were predicted.  Only the
    label columns of ``source`` are read and moved.
    """
    gold = source.select("row_id", *columns)
    return predicted.join(gold, "row_id").select(
        "row_id", "original_text", *columns, "topic", "probability"
    )


def kept_rows(source: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``source`` whose ``row_id`` is in ``ids``, each once."""
    return source.join(ids.select("row_id"), "row_id", "left_semi")


def highest_probability(df: DataFrame, col: str = "probabilities") -> DataFrame:
    """Adds ``probability``: the largest entry of an array column, null for a null array."""
    return df.withColumn("probability", F.array_max(col))


def external_scores(aligned: DataFrame, gold_col: str = "VCGE_N1") -> DataFrame:
    """One row with coverage, ARI, NMI, homogeneity, completeness and V-measure."""
    covered = ag.coverage(aligned, gold_col).drop("n_scored")
    scores = ag.agreement(ag.contingency(aligned, gold_col))
    return scores.withColumns({
        "n_rows": covered.select("n_rows").scalar(),
        "coverage": covered.select("coverage").scalar(),
    })
