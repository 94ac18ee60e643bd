"""Topics: centroids, assignment of texts, merging, seed guidance and description."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civictopics.functions import vectors as vx
from civictopics.operators.nearest import nearest_of_many
from civictopics.storage import cut

# Target vectors that may be sent to the tasks.
TARGETS_PER_BLOCK = 4096


def mean_vector(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """One row ``(embedding)``: the mean of all vectors."""
    mean = Summarizer.mean(array_to_vector(F.col(vector_col)))
    return df.agg(vector_to_array(mean).alias("embedding"))


def centroids(
    df: DataFrame, vector_col: str = "embedding", by: Sequence[str] = ()
) -> DataFrame:
    """``(by..., topic, embedding)``: mean vector of each real topic.

    The sums of a topic are combined in the map tasks before anything moves.
    """
    mean = Summarizer.mean(array_to_vector(F.col(vector_col)))
    return (
        df.filter(F.col("topic") != -1)
        .groupBy(*by, "topic")
        .agg(vector_to_array(mean).alias("embedding"))
    )


def assign_nearest(
    df: DataFrame,
    targets: DataFrame,
    vector_col: str = "embedding",
    min_sim: float | None = None,
    most_targets: int = TARGETS_PER_BLOCK,
    id_col: str = "row_id",
) -> DataFrame:
    """Adds ``topic`` and ``probability`` of the most similar row of ``targets (topic, embedding)``.

    ``probability`` is the cosine clipped to [0, 1]; below ``min_sim`` the topic is -1.  Ties go to
    the smallest topic.  Up to ``most_targets`` targets go to the tasks, and rows are not shuffled; beyond
    that targets stay in Spark (``nearest_of_many``) and the result is joined by ``id_col``, a key.
    """
    rest = [c for c in df.columns if c not in ("topic", "probability")]
    known = targets.select(F.col("topic").cast("long").alias("topic"), "embedding")
    few = known.limit(most_targets + 1).collect()
    if not few:
        return df.select(
            *rest, F.lit(-1).cast("long").alias("topic"), F.lit(None).cast("double").alias("probability")
        )
    if len(few) > most_targets:
        found = cut(nearest_of_many(df, known, id_col, vector_col), "nearest").select(
            F.col("id").alias(id_col), F.struct("topic", "sim").alias("_best")
        )
        scored = df.select(*rest).join(found, id_col, "left").select(*rest, "_best")
    else:
        few.sort(key=lambda row: row["topic"])
        block = (np.array([row["topic"] for row in few], dtype=np.int64), np.array([row["embedding"] for row in few], dtype=np.float64))
        scored = df.select(*rest, vx.nearest_of(df.sparkSession, block)(F.col(vector_col)).alias("_best"))
    topic = F.col("_best.topic")
    if min_sim is not None:
        topic = F.when(F.col("_best.sim") >= min_sim, topic).otherwise(F.lit(-1).cast("long"))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_best.sim")))
    return scored.select(*rest, topic.alias("topic"), clipped.alias("probability"))


def seed_guide(
    df: DataFrame, seeds: DataFrame, weight: tuple[float, float] = (3, 1), vector_col: str = "embedding"
) -> DataFrame:
    """Pull texts towards the seed topic they are most similar to.

    ``seeds (topic, embedding)`` are the vectors of the seed topics.  A text that is more similar
    to the mean of all texts than to any seed stays as it is.  Adds ``seed_topic`` (-1 for those)
    and replaces the vector by the weighted mean of itself and its seed.
    """
    mean = mean_vector(df, vector_col).select(
        F.lit(1 << 62).cast("long").alias("topic"), "embedding"
    )
    own = seeds.select(F.col("topic").cast("long").alias("topic"), "embedding")
    targets = cut(own.unionByName(mean), "seeds")
    nearest = assign_nearest(df, targets, vector_col).drop("probability")
    pulled = nearest.join(
        targets.filter(F.col("topic") != 1 << 62).withColumnRenamed("embedding", "_seed"),
        "topic", "left",
    )
    a, b = weight
    moved = F.zip_with(vector_col, "_seed", lambda x, s: (x * a + s * b) / (a + b))
    return pulled.select(
        *[c for c in df.columns if c != vector_col],
        F.coalesce(moved, F.col(vector_col)).alias(vector_col),
        F.when(F.col("_seed").isNull(), -1).otherwise(F.col("topic")).cast("long").alias("seed_topic"),
    )


def topics_found(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., topics_found)``: the number of topics without the outliers."""
    sizes = df.groupBy(*by, "topic").agg(F.count("*").alias("cnt"))
    return sizes.groupBy(*by).agg(F.count_if(F.col("topic") != -1).alias("topics_found"))


def topic_sizes(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., topic, cnt, first_row)``."""
    return df.groupBy(*by, "topic").agg(
        F.count("*").alias("cnt"), F.min("row_id").alias("first_row")
    )


def topic_similarity(
    weights: DataFrame, left: DataFrame, right: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """``(by..., topic, other, sim)``: cosine of the word weights of ``left`` and ``right`` topics.

    Topics meet on their shared words, and each word row of a ``left`` topic meets at most as many
    rows as there are ``right`` topics.
    """
    by = list(by)
    keys = [*by, "topic"]
    norms = weights.groupBy(*keys).agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    mine = weights.join(left.select(*keys), keys, "left_semi").select(*keys, "word", "weight")
    theirs = weights.join(right.select(*keys), keys, "left_semi").select(
        *by, F.col("topic").alias("other"), "word", F.col("weight").alias("other_weight")
    )
    inner = (
        mine.join(theirs, [*by, "word"])
        .groupBy(*keys, "other")
        .agg(F.sum(F.col("weight") * F.col("other_weight")).alias("inner"))
    )
    other_norms = norms.select(
        *by, F.col("topic").alias("other"), F.col("norm").alias("other_norm")
    )
    return (
        inner.join(norms, keys)
        .join(other_norms, [*by, "other"])
        .select(
            *keys, "other",
            F.round(F.try_divide("inner", F.col("norm") * F.col("other_norm")), 9).alias("sim"),
        )
    )


def similarity_of_products(products: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``topic_similarity`` of all topics from their inner products ``(by..., topic, other, inner)``, those with themselves included."""
    by = list(by)
    norms = products.filter(F.col("topic") == F.col("other")).select(*by, "topic", F.sqrt("inner").alias("norm"))
    other_norms = norms.select(*by, F.col("topic").alias("other"), F.col("norm").alias("other_norm"))
    cosine = F.try_divide("inner", F.col("norm") * F.col("other_norm"))
    joined = products.join(norms, [*by, "topic"]).join(other_norms, [*by, "other"])
    return joined.select(*by, "topic", "other", F.round(cosine, 9).alias("sim"))


def merge_plan(
    sizes: DataFrame,
    weights: DataFrame | None,
    nr_topics: int | DataFrame,
    by: Sequence[str] = (),
    similarity: DataFrame | None = None,
) -> DataFrame:
    """``(by..., topic, new_topic)`` for ``sizes (by..., topic, cnt, first_row)``.

    The largest topics stay; every other one joins the kept topic whose word weights are most
    similar (ties and topics without shared words: the larger).  Then topics are numbered by size
    again.  ``nr_topics`` counts the outlier topic; a table ``(by..., nr_topics)`` sets it per
    run, with null for the runs that merge nothing.  ``similarity (by..., topic, other, sim)`` of all topics
    stands for ``weights`` where it is known.
    """
    by = list(by)
    keys = [*by, "topic"]
    if isinstance(nr_topics, DataFrame):
        sizes = sizes.join(nr_topics.select(*by, "nr_topics"), by)
    else:
        sizes = sizes.withColumn("nr_topics", F.lit(nr_topics))
    run = Window.partitionBy(*by)
    largest = run.orderBy(F.col("topic") == -1, F.desc("cnt"), "topic")
    ranked = cut(
        sizes.withColumns({
            "place": F.row_number().over(largest),
            "outliers": F.max((F.col("topic") == -1).cast("int")).over(run),
        }).withColumn(
            "keep",
            (F.col("topic") != -1)
            & (F.col("nr_topics").isNull()
               | (F.col("place") <= F.greatest(F.col("nr_topics") - F.col("outliers"), F.lit(1)))),
        ),
        "topic-sizes",
    )
    kept = ranked.filter("keep")
    small = ranked.filter("not keep and topic <> -1")
    order = F.struct("sim", (-F.col("other_place")).alias("minus"))
    if similarity is None:
        similarity = topic_similarity(weights, small, kept, by)
    else:
        similarity = similarity.join(small.select(*keys), keys, "left_semi")
    likeness = similarity.join(
        kept.select(*by, F.col("topic").alias("other"), F.col("place").alias("other_place")),
        [*by, "other"],
    )
    chosen = likeness.groupBy(*keys).agg(F.max_by("other", order).alias("into"))
    biggest = kept.filter("place = 1").select(*by, F.col("topic").alias("biggest"))
    folded = small.join(chosen, keys, "left")
    folded = folded.join(biggest, by) if by else folded.withColumn(
        "biggest", biggest.agg(F.max("biggest")).scalar()
    )
    into = folded.select(
        *keys, "cnt", "first_row", F.coalesce("into", "biggest").alias("into")
    ).unionByName(kept.select(*keys, "cnt", "first_row", F.col("topic").alias("into")))
    into = cut(into, "merged")
    merged = into.groupBy(*by, "into").agg(
        F.sum("cnt").alias("size"), F.min("first_row").alias("first_row")
    )
    numbered = merged.select(
        *by, "into",
        (F.row_number().over(run.orderBy(F.desc("size"), "first_row")) - 1)
        .cast("long").alias("new_topic"),
    )
    outliers = ranked.filter("topic = -1").select(
        *keys, F.lit(-1).cast("long").alias("new_topic")
    )
    return into.join(numbered, [*by, "into"]).select(*keys, "new_topic").unionByName(outliers)


def reduce_topics(
    assigned: DataFrame, weights: DataFrame, nr_topics: int | None, by: Sequence[str] = ()
) -> DataFrame:
    """Merge small topics of ``assigned`` until ``nr_topics`` are left, outliers included.

    ``None`` merges nothing.  The plan of the merge is a small written table, which Spark
    broadcasts when its size allows.
    """
    if nr_topics is None:
        return assigned
    keys = [*by, "topic"]
    mapping = cut(
        merge_plan(topic_sizes(assigned, by), weights, nr_topics, by), "topic-mapping"
    )
    return (
        assigned.join(mapping, keys)
        .withColumn("topic", F.col("new_topic"))
        .select(*assigned.columns)
    )


def representative_docs(
    df: DataFrame, centers: DataFrame, n: int = 3, vector_col: str = "embedding"
) -> DataFrame:
    """``(topic, rank, row_id, sim)``: the ``n`` texts most similar to the centroid of their topic.

    Ties go to the smallest ``row_id``.  The centroids are written first, so that Spark sees their
    size and broadcasts them if it can, and it cuts each topic to ``n`` rows before the shuffle.
    """
    own = cut(centers.select("topic", F.col("embedding").alias("_center")), "centroids")
    a, b = F.col(vector_col), F.col("_center")
    sim = F.try_divide(vx.dot(a, b), vx.length_of(a) * vx.length_of(b))
    order = Window.partitionBy("topic").orderBy(F.desc("sim"), "row_id")
    return (
        df.filter(F.col("topic") != -1)
        .select("row_id", "topic", vector_col)
        .join(own, "topic")
        .select("topic", "row_id", F.round(F.coalesce(sim, F.lit(0.0)), 9).alias("sim"))
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .filter(F.col("rank") <= n)
        .select("topic", "rank", "row_id", "sim")
    )


def topic_info(
    df: DataFrame,
    words: DataFrame,
    samples: DataFrame | None = None,
    texts: DataFrame | None = None,
) -> DataFrame:
    """``(topic, cnt, name, representation[, representative_docs])``, one row per topic.

    ``name`` is the topic number and its first four words joined by ``_``.  ``samples`` comes from
    ``representative_docs``; their ``clean_text`` is looked up in ``texts``.
    """
    sizes = df.groupBy("topic").agg(F.count("*").alias("cnt"))
    listed = (
        words.groupBy("topic")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("placed"))
        .select("topic", F.col("placed.word").alias("representation"))
    )
    name = F.concat_ws("_", F.col("topic").cast("string"), F.slice("representation", 1, 4))
    info = sizes.join(listed, "topic", "left").select(
        "topic", "cnt", name.alias("name"), "representation"
    )
    if samples is None:
        return info
    shown = samples.select("topic", "rank", "row_id")
    if texts is None:
        shown = shown.withColumn("clean_text", F.col("row_id").cast("string"))
    else:
        shown = shown.join(texts.select("row_id", "clean_text"), "row_id")
    docs = (
        shown.groupBy("topic")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "clean_text"))).alias("placed"))
        .select("topic", F.col("placed.clean_text").alias("representative_docs"))
    )
    return info.join(docs, "topic", "left")
