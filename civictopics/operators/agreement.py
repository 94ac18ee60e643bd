"""Agreement between topics and gold labels: ARI, NMI, homogeneity, completeness, V-measure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scored_rows(df: DataFrame, gold_col: str, topic_col: str = "topic") -> DataFrame:
    """Rows that count in a score: assigned to a real topic, and labelled."""
    return df.filter((F.col(topic_col) != -1) & F.col(gold_col).isNotNull())


def coverage(
    df: DataFrame, gold_col: str, topic_col: str = "topic", by: Sequence[str] = ()
) -> DataFrame:
    """``(by..., n_rows, n_scored, coverage)``: the share of rows a score is based on."""
    counts = (F.col(topic_col) != -1) & F.col(gold_col).isNotNull()
    n_scored = F.count_if(counts)
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        n_scored.alias("n_scored"),
        F.try_divide(n_scored, F.count("*")).alias("coverage"),
    )


def contingency(
    df: DataFrame, gold_col: str, topic_col: str = "topic", by: Sequence[str] = ()
) -> DataFrame:
    """``(by..., gold, topic, cnt)`` over the scored rows."""
    return (
        scored_rows(df, gold_col, topic_col)
        .groupBy(*by, F.col(gold_col).alias("gold"), F.col(topic_col).alias("topic"))
        .agg(F.count("*").alias("cnt"))
    )


def agreement(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., n_scored, ari, nmi, homogeneity, completeness, v_measure)``.

    Everything follows from sums of ``n^2`` and ``n ln n`` over the cells, the gold totals and the
    topic totals, so one set of grouping sets over the contingency table is enough, without joins.
    """
    by = list(by)
    whole = table.select(*by, "gold", "topic", F.col("cnt").cast("double").alias("cnt"))
    sums = whole.groupingSets(
        [[*by, "gold", "topic"], [*by, "gold"], [*by, "topic"]], *by, "gold", "topic"
    ).agg(F.sum("cnt").alias("cnt"), F.grouping("gold").alias("no_gold"),
          F.grouping("topic").alias("no_topic"))
    cell = (F.col("no_gold") == 0) & (F.col("no_topic") == 0)
    gold = (F.col("no_gold") == 0) & (F.col("no_topic") == 1)
    topic = (F.col("no_gold") == 1) & (F.col("no_topic") == 0)
    square, plogp = F.col("cnt") * F.col("cnt"), F.col("cnt") * F.log("cnt")
    levels = sums.groupBy(*by).agg(
        F.sum(F.when(cell, F.col("cnt"))).alias("tot"),
        F.sum(F.when(cell, square)).alias("sq"),
        F.sum(F.when(gold, square)).alias("sq_gold"),
        F.sum(F.when(topic, square)).alias("sq_topic"),
        F.sum(F.when(cell, plogp)).alias("ln_cell"),
        F.sum(F.when(gold, plogp)).alias("ln_gold"),
        F.sum(F.when(topic, plogp)).alias("ln_topic"),
    )
    c = F.col
    # Pairs of rows: together in both, only in the topics, only in the gold labels, in neither.
    pairs = levels.withColumns({
        "tp": c("sq") - c("tot"),
        "fp": c("sq_topic") - c("sq"),
        "fn": c("sq_gold") - c("sq"),
        "tn": c("tot") * c("tot") - c("sq_gold") - c("sq_topic") + c("sq"),
        # Differences below the rounding noise of the sums are no information.
        "h_gold": F.round(F.log("tot") - c("ln_gold") / c("tot"), 12),
        "h_topic": F.round(F.log("tot") - c("ln_topic") / c("tot"), 12),
        "mi": F.round(
            F.log("tot") + (c("ln_cell") - c("ln_gold") - c("ln_topic")) / c("tot"), 12
        ),
    })
    ari = F.when((c("fn") == 0) & (c("fp") == 0), 1.0).otherwise(
        F.try_divide(
            2 * (c("tp") * c("tn") - c("fn") * c("fp")),
            (c("tp") + c("fn")) * (c("fn") + c("tn")) + (c("tp") + c("fp")) * (c("fp") + c("tn")),
        )
    )
    parts = pairs.withColumns({
        "homogeneity": F.when(c("h_gold") == 0, 1.0).otherwise(c("mi") / c("h_gold")),
        "completeness": F.when(c("h_topic") == 0, 1.0).otherwise(c("mi") / c("h_topic")),
    })
    both = c("homogeneity") + c("completeness")
    return parts.select(
        *by,
        F.coalesce(c("tot"), F.lit(0)).cast("long").alias("n_scored"),
        ari.alias("ari"),
        F.when((c("h_gold") == 0) & (c("h_topic") == 0), 1.0)
        .otherwise(c("mi") / ((c("h_gold") + c("h_topic")) / 2))
        .alias("nmi"),
        "homogeneity",
        "completeness",
        F.when(both == 0, 0.0)
        .otherwise(2 * c("homogeneity") * c("completeness") / both)
        .alias("v_measure"),
    )
