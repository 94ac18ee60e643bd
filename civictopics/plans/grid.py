"""Experiment grids: every run of every configuration is a row of one DataFrame."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civictopics.functions import vectors as vx
from civictopics.operators import coherence, density, embed, topics, vocabulary
from civictopics.storage import cut, delete, new_path, settled, write

# The two tuning grids; None stands for "no reduction".
ITERATIONS = 10
PHASE_1_TOPICS = (10, 30, 50, 70, 90, 110, 130, None)
PHASE_2_TOPICS = (50, 70, 90, 110, 130, None)
PHASE_2_SIZES = (3, 5, 10, 15, 20, 25)

# Models and iterations that are fitted side by side, and cells that the tasks receive; a larger table is joined.
RUNS_AT_A_TIME, MOST_CELLS = 4, 1 << 18

# Column names of the result files, and the word for "no reduction".
RESULT_NAMES = {
    "num_topics_found": "num_topics_found", "nc": "NC", "nd": "ND", "wc": "WC", "wd": "WD",
    "ws": "Weighted Score", "valid_iters": "valid_iters",
}
NO_REDUCTION = "auto"

METRICS = ("num_topics_found", "nc", "nd", "wc", "wd", "ws")


def parameter_grid(
    spark: SparkSession,
    models: Sequence[str],
    nr_topics: Sequence[int | None],
    min_topic_sizes: Sequence[int] = (10,),
    iterations: int = 10,
    n_gram_range: tuple[int, int] = (1, 1),
) -> DataFrame:
    """``(config_id, model, nr_topics, min_topic_size, n_gram_range, iteration)``.

    One row per run; ``nr_topics`` is null for "no reduction".
    """
    schema = T.StructType([
        T.StructField("config_id", T.LongType(), False),
        T.StructField("model", T.StringType(), False),
        T.StructField("nr_topics", T.IntegerType(), True),
        T.StructField("min_topic_size", T.IntegerType(), False),
        T.StructField("n_gram_range", T.StructType([
            T.StructField("min", T.IntegerType()), T.StructField("max", T.IntegerType()),
        ])),
        T.StructField("iteration", T.LongType(), False),
    ])
    configs = enumerate(itertools.product(models, nr_topics, min_topic_sizes))
    rows = [
        (config_id, model, target, size, n_gram_range, iteration)
        for config_id, (model, target, size) in configs
        for iteration in range(iterations)
    ]
    return spark.createDataFrame(rows, schema)


def complete_runs(grid: DataFrame, scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per run of the grid; a run without result has null metrics."""
    return grid.join(scores, list(by), "left")


def _number(col: str) -> Column:
    """NaN becomes null, so that means skip it."""
    value = F.col(col).cast("double")
    return F.when(~F.isnan(value), value)


def summarise(
    runs: DataFrame, config: Sequence[str], metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Mean of each metric over the runs of a configuration, and ``valid_iters``.

    Null and NaN are left out; a configuration without any value has null means.
    """
    return runs.groupBy(*config).agg(
        *[F.avg(_number(m)).alias(m) for m in metrics],
        F.count(_number("nc")).alias("valid_iters"),
    )


def leaderboard(
    summary: DataFrame, tie_breaks: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Configurations by weighted score, best first; ``limit`` keeps the top of the list."""
    ordered = summary.orderBy(F.desc_nulls_last("ws"), *tie_breaks)
    return ordered if limit is None else ordered.limit(limit)


def append_runs(*tables: DataFrame) -> DataFrame:
    """Results of several grids in one table; columns a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def result_table(summary: DataFrame, phase: int) -> DataFrame:
    """A summary under the column names of the result file of phase 1 or 2."""
    target = F.coalesce(F.col("nr_topics").cast("string"), F.lit(NO_REDUCTION))
    if phase == 1:
        config = [F.col("model").alias("Model"), target.alias("Num_Topics")]
    else:
        grams = F.format_string("(%d, %d)", F.col("n_gram_range.min"), F.col("n_gram_range.max"))
        config = [
            grams.alias("n_gram_range"), target.alias("nr_topics"), F.col("min_topic_size")
        ]
    return summary.select(*config, *[F.col(c).alias(n) for c, n in RESULT_NAMES.items()])


def score_runs(
    docs: DataFrame,
    words: DataFrame,
    found: DataFrame,
    grid: DataFrame,
    by: Sequence[str] = ("config_id", "iteration"),
    min_words: int = 2,
) -> DataFrame:
    """Metrics of all runs in one pass over the texts, one row per run of ``grid``.

    ``words (by..., topic, rank, word, weight)`` and ``found (by..., topics_found)`` hold the runs.
    """
    by = list(by)
    scores = coherence.internal_scores(docs, words, by, min_words)
    counted = found.withColumnRenamed("topics_found", "num_topics_found")
    return complete_runs(complete_runs(grid, counted, by), scores, by)


def grid_topics(
    tokens: DataFrame,
    grid: DataFrame,
    models: Mapping[str, int],
    k: int = 5,
    width: float = 0.25,
    sim: float = 0.9,
    reducer: str = "pca",
    words_per_topic: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """Fit every run of ``grid`` on ``tokens (row_id, tokens)``.

    ``models`` gives the vector length of each model name; the iteration salts its hash.  Returns
    ``words (config_id, iteration, topic, rank, word, weight)`` and
    ``found (config_id, iteration, topics_found)``.

    Some models and iterations are fitted at a time, and their texts are written once for all of them, next to
    their cells.  Words are counted once for all texts that have the same topics in each of these fits.  The sizes
    and topic targets of a grid then only regroup these counts, never texts.
    """
    settings = [
        row.asDict() for row in
        grid.select("config_id", "model", "nr_topics", "min_topic_size").distinct().collect()
    ]
    iterations = sorted(row[0] for row in grid.select("iteration").distinct().collect())
    used = sorted({s["model"] for s in settings})
    idf = embed.inverse_frequencies(tokens)
    # A fit is a model with a size limit; its configurations differ in the topic target only.
    number = {fit: i for i, fit in enumerate(sorted({(s["model"], s["min_topic_size"]) for s in settings}))}
    runs = [(m, i) for m in used for i in iterations]
    parts = [
        _some_topics(tokens, settings, number, runs[at : at + RUNS_AT_A_TIME], models, idf, k, width, sim, reducer, words_per_topic)
        for at in range(0, len(runs), RUNS_AT_A_TIME)
    ]
    return tuple(reduce(DataFrame.unionByName, tables) for tables in zip(*parts))


def _topics_of_cells(spark: SparkSession, places: list[tuple[str, int]], cell_topic: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Adds ``group``, the topics of a row in all fits, to rows with the cells ``_c0, _c1, ...`` of ``places (column, fit)``."""
    known = cell_topic.limit(MOST_CELLS + 1).collect()
    if len(known) <= MOST_CELLS:
        found = [{} for _ in places]
        at = {fit: i for i, (_, fit) in enumerate(places)}
        for row in known:
            found[at[row["fit"]]][row["cell"]] = row["topic"]
        shared = spark.sparkContext.broadcast(found)

        def name(*cells: pa.Array) -> pa.Array:
            topics = [[of.get(c, -1) for c in column.to_pylist()] for of, column in zip(shared.value, cells)]
            return pa.array([",".join(map(str, row)) for row in zip(*topics)], pa.string())

        return lambda df: df.withColumn("group", F.arrow_udf(name, returnType="string")(*[F.col(c) for c, _ in places]))

    def joined(df: DataFrame) -> DataFrame:
        topics = []
        for i, (column, fit) in enumerate(places):
            own = cell_topic.filter(F.col("fit") == fit).select(F.col("cell").alias(column), F.col("topic").alias(f"_t{i}"))
            df = df.join(own, column, "left")
            topics.append(F.coalesce(f"_t{i}", F.lit(-1)).cast("string"))
        return df.withColumn("group", F.concat_ws(",", *topics))

    return joined


def _some_topics(
    tokens: DataFrame, settings: list[dict], number: Mapping[tuple[str, int], int], runs: Sequence[tuple[str, int]],
    models: Mapping[str, int], idf: np.ndarray, k: int, width: float, sim: float, reducer: str, words_per_topic: int,
) -> tuple[DataFrame, DataFrame]:
    """``grid_topics`` of some ``runs (model, iteration)``; only its results stay on disk."""
    spark = tokens.sparkSession
    run, fit, config = ["model", "iteration"], ["fit_id", "iteration"], ["config_id", "iteration"]
    outlier = F.lit(-1).cast("long")

    def placed_texts() -> DataFrame:
        placed = tokens.select("row_id", "tokens")
        for n, (model, iteration) in enumerate(runs):
            salt = "" if iteration == 0 else str(iteration)
            embedded = embed.embed_docs(tokens, dim=models[model], idf=idf, salt=salt)
            if reducer == "pca":
                matrix = embed.component_matrix(embedded, k, models[model])
            elif reducer == "projection":
                matrix = embed.sign_matrix(models[model], k, salt)
            else:
                raise ValueError("reducer must be 'pca' or 'projection'")
            vectors = embed.embed_docs(placed, dim=models[model], idf=idf, salt=salt)
            placed = vectors.withColumn(f"_r{n}", vx.projected(matrix)(F.col("embedding"))).drop("embedding")
        for n in range(len(runs)):
            placed = density.with_cells(placed, k, width, f"_r{n}").withColumnRenamed("cell", f"_c{n}")
        return placed

    def of_runs(placed: DataFrame) -> DataFrame:
        """``(model, iteration, row_id, reduced, cell)``."""
        each = [
            F.struct(F.lit(m).alias("model"), F.lit(i).cast("long").alias("iteration"), F.col(f"_r{n}").alias("reduced"), F.col(f"_c{n}").alias("cell"))
            for n, (m, i) in enumerate(runs)
        ]
        return placed.select("row_id", F.explode(F.array(*each)).alias("_run")).select("_run.*", "row_id")

    def words_and_found() -> tuple[DataFrame, DataFrame]:
        texts_path = new_path(spark, "placed")
        lazily = placed_texts()
        write(lazily, texts_path)
        placed = spark.read.schema(lazily.schema).parquet(texts_path)
        texts = of_runs(placed)
        cells = cut(density.cell_table(texts, k, by=run), "cells")
        links = cut(density.similar_cells(cells, k, width, sim, run), "links")
        nowhere = cut(texts.filter(F.col("cell").isNull()).groupBy(*run).agg(
            F.count("*").alias("cnt"), F.min("row_id").alias("first_row")
        ), "nowhere")
        limits = spark.createDataFrame(
            [(f, model, i, size, size) for (model, size), f in number.items() for m, i in runs if m == model],
            "fit_id long, model string, iteration long, min_pts int, min_topic_size int",
        )
        targets = spark.createDataFrame(
            [(s["config_id"], number[(s["model"], s["min_topic_size"])], i, s["nr_topics"]) for s in settings for m, i in runs if m == s["model"]],
            "config_id long, fit_id long, iteration long, nr_topics int",
        )
        keys = limits.select("fit_id", *run)
        fit_cells = cut(cells.join(keys, run), "fit-cells")
        cell_topic = cut(
            density.cell_topics(
                fit_cells, cut(links.join(keys, run).drop("model"), "fit-links"), by=fit,
                by_limits=limits,
            ),
            "cell-topics",
        )
        sizes = (
            fit_cells.select(*fit, "cell", "cnt", "first_row")
            .unionByName(
                nowhere.join(keys, run).select(*fit, outlier.alias("cell"), "cnt", "first_row")
            )
            .join(cell_topic, [*fit, "cell"], "left")
            .groupBy(*fit, F.coalesce("topic", outlier).alias("topic"))
            .agg(F.sum("cnt").alias("cnt"), F.min("first_row").alias("first_row"))
        )
        # A number for each fit of a run, and the column that has its cells.
        fits = [(f, i, f"_c{n}") for n, (m, i) in enumerate(runs) for (model, _), f in number.items() if m == model]
        numbered = spark.createDataFrame([(f, i, n) for n, (f, i, _) in enumerate(fits)], "fit_id long, iteration long, fit int")
        named = _topics_of_cells(spark, [(c, n) for n, (_, _, c) in enumerate(fits)], cell_topic.join(numbered, fit).select("fit", "cell", "topic"))
        counts = cut(vocabulary.topic_term_counts(named(placed), "group").withColumnRenamed("topic", "group"), "counts")
        delete(spark, texts_path)
        groups = cut(counts.select("group").distinct(), "groups")
        each = F.posexplode(F.split("group", ",")).alias("fit", "topic")
        fit_groups = cut(
            groups.select("group", each).join(numbered, "fit").select(*fit, "group", F.col("topic").cast("long").alias("topic")), "fit-groups"
        )
        to_config = targets.select("config_id", *fit)
        products = vocabulary.topic_products_of_groupings(counts, fit_groups, fit)
        weights = similarity = None
        if products is None:
            grouped = counts.join(fit_groups, "group").groupBy(*fit, "topic", "word").agg(F.sum("cnt").alias("cnt"))
            weights = cut(vocabulary.class_tfidf(cut(grouped, "counts"), fit), "weights").join(to_config, fit).drop("fit_id")
        else:
            similarity = topics.similarity_of_products(cut(products, "products"), fit).join(to_config, fit).drop("fit_id")
        mapping = cut(
            topics.merge_plan(
                sizes.join(to_config, fit).drop("fit_id"), weights, targets, config, similarity
            ),
            "topic-mapping",
        )
        merged = fit_groups.join(to_config, fit).join(mapping, [*config, "topic"]).select(
            *config, "group", F.col("new_topic").alias("topic")
        )
        words = vocabulary.top_words_of_groupings(counts, cut(merged, "config-groups"), words_per_topic, config)
        found = (
            mapping.filter("new_topic <> -1").select(*config, "new_topic").distinct()
            .groupBy(*config).agg(F.count("*").alias("some"))
        )
        every = mapping.select(*config).distinct().join(found, config, "left")
        return words, every.select(*config, F.coalesce("some", F.lit(0)).alias("topics_found"))

    tables: list[DataFrame] = []

    def words_only() -> DataFrame:
        words, found = words_and_found()
        tables.append(settled_rows(found))
        return words

    def settled_rows(found: DataFrame) -> DataFrame:
        # One row for a run.
        return spark.createDataFrame(found.collect(), found.schema)

    return settled(spark, "words", words_only), tables[0]


def run_grid(
    docs: DataFrame,
    grid: DataFrame,
    models: Mapping[str, int],
    min_words: int = 2,
    **settings,
) -> DataFrame:
    """Fit and score every run of ``grid`` on ``docs (row_id, tokens)``."""
    tokens = cut(docs.select("row_id", "tokens"), "tokens")
    words, found = grid_topics(tokens, grid, models, **settings)
    return score_runs(tokens, words, found, grid, min_words=min_words)
