"""Word statistics: vocabulary, counts per topic and class-based TF-IDF."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civictopics.functions import text as tx
from civictopics.storage import cut

# Rows of a table of groupings that the tasks receive; a larger one is joined.
MOST_PLACED = 1 << 18
# Products of weights in memory at once.
MOST_PRODUCTS = 1 << 20

def vocabulary(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """``(word, cf, df)``: how often a word occurs, and in how many rows.

    Each row's tokens are sorted first, so the first of equal neighbours marks a new document.
    Both counts then come out of one aggregation with map-side combining.
    """
    ordered = df.select(F.array_sort(tokens_col).alias("ordered"))
    marked = F.transform(
        "ordered",
        lambda word, i: F.struct(
            word.alias("word"),
            F.when((i > 0) & (F.get("ordered", i - 1) == word), 0).otherwise(1).alias("is_first"),
        ),
    )
    return (
        ordered.select(F.inline_outer(marked))
        .filter(F.col("word").isNotNull())
        .groupBy("word")
        .agg(F.count("*").alias("cf"), F.sum("is_first").alias("df"))
    )


def topic_term_counts(
    df: DataFrame,
    topic_col: str = "topic",
    tokens_col: str = "tokens",
    by: Sequence[str] = (),
) -> DataFrame:
    """``(by..., topic, word, cnt)``; partial counts are combined before the shuffle.

    ``explode_outer`` keeps Catalyst from pushing a "list is not empty" filter below the
    de-duplication, which would tokenise every copy of a text as well.
    """
    return (
        df.select(*by, F.col(topic_col).alias("topic"), F.explode_outer(tokens_col).alias("word"))
        .filter(tx.all_of([F.col(c).isNotNull() for c in (*by, "topic", "word")]))
        .groupBy(*by, "topic", "word")
        .agg(F.count("*").alias("cnt"))
    )


def seed_tokens(seeds: DataFrame, seed_col: str = "seed") -> DataFrame:
    """Seed phrases flattened to distinct single words ``(word)``, as the model counts words."""
    return seeds.select(F.explode(tx.model_tokens(F.col(seed_col))).alias("word")).distinct()


def unmatched_seeds(vocab: DataFrame, seed_words: DataFrame) -> DataFrame:
    """Seed words that never occur in the corpus, so boosting them has no effect."""
    return seed_words.join(vocab, "word", "left_anti").select("word")


def class_tfidf(
    counts: DataFrame,
    by: Sequence[str] = (),
    seed_words: DataFrame | None = None,
    seed_multiplier: float = 2.0,
) -> DataFrame:
    """Adds ``weight`` to ``(by..., topic, word, cnt)``.

    ``weight = cnt / words of the topic * ln(1 + floor(mean words per topic) / cnt of the word)``;
    the logarithm is multiplied by ``seed_multiplier`` for seed words.  The outlier topic counts
    as a topic here.  ``counts`` is read twice and should be a stored table.  The sizes of the
    topics are written first, so that Spark knows whether it can broadcast them.
    """
    by = list(by)
    keys = [*by, "topic"]
    per_topic = counts.groupBy(*keys).agg(F.sum("cnt").alias("topic_words"))
    run = Window.partitionBy(*by)
    mean_words = F.floor(F.sum("topic_words").over(run) / F.count("*").over(run))
    sizes = cut(per_topic.withColumn("mean_words", mean_words), "topic-sizes")
    # A word has one row per topic, so these window partitions are as small as the topic table.
    word_total = F.sum("cnt").over(Window.partitionBy(*by, "word"))
    joined = counts.withColumn("word_total", word_total).join(sizes, keys)
    idf = F.log(1 + F.col("mean_words") / F.col("word_total"))
    if seed_words is not None:
        marked = seed_words.select("word", F.lit(True).alias("is_seed"))
        joined = joined.join(marked, "word", "left")
        idf = F.when(F.col("is_seed"), idf * seed_multiplier).otherwise(idf)
    return joined.select(
        *keys, "word", "cnt", (F.col("cnt") / F.col("topic_words") * idf).alias("weight")
    )


def top_words(weights: DataFrame, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., topic, rank, word, weight)``: the ``n`` heaviest words of each topic.

    Weights are rounded before ranking and ties go to the smaller word.  Spark cuts each topic
    to ``n`` rows before the shuffle, so a topic with a huge vocabulary stays cheap.
    """
    order = Window.partitionBy(*by, "topic").orderBy(F.desc("weight"), "word")
    return (
        weights.select(*by, "topic", "word", F.round("weight", 9).alias("weight"))
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .filter(F.col("rank") <= n)
        .select(*by, "topic", "rank", "word", "weight")
    )


@dataclass(frozen=True)
class _Groupings:
    """What the tasks need to weigh a word for every grouping, from one row with its counts by group."""

    words: DataFrame
    topics: list[tuple]
    sizes: np.ndarray
    shared: Broadcast

    def weighed(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """For each grouping ``(word, topic, cnt, word_total, weight)`` of its words, by their place in the batch, and topics."""
        places, sizes, means = self.shared.value
        lengths = batch.column(1).value_lengths().to_numpy()
        group, cnt = (batch.column(1).flatten().field(k).to_numpy() for k in range(2))
        word = np.repeat(np.arange(batch.num_rows), lengths)
        for groups, at in places:
            # A group may have several places in a grouping, then it counts in each.
            first, last = np.searchsorted(groups, group, "left"), np.searchsorted(groups, group, "right")
            times = last - first
            entry = np.repeat(np.arange(len(group)), times)
            place = at[np.repeat(first - np.cumsum(times) + times, times) + np.arange(len(entry))]
            cell, index = np.unique(word[entry] * len(sizes) + place, return_inverse=True)
            total = np.bincount(word[entry], weights=cnt[entry], minlength=batch.num_rows)
            held = np.bincount(index, weights=cnt[entry], minlength=len(cell))
            w, topic = cell // max(len(sizes), 1), cell % max(len(sizes), 1)
            yield w, topic, held, total[w], held / sizes[topic] * np.log(1 + means[topic] / total[w])

    def about(self, spark: SparkSession, fields: str) -> DataFrame:
        """``(by..., topic, place, topic_words, mean_words)``."""
        means = self.shared.value[2]
        known = [(*t, i, int(self.sizes[i]), int(means[i])) for i, t in enumerate(self.topics)]
        return spark.createDataFrame(known, f"{fields}, place long, topic_words long, mean_words long")


def _groupings(counts: DataFrame, placed: DataFrame, keys: list[str]) -> _Groupings | None:
    """None if ``placed`` has more rows than the tasks get."""
    rows = placed.select(*keys, "group").limit(MOST_PLACED + 1).collect()
    if len(rows) > MOST_PLACED:
        return None
    totals = dict(counts.groupBy("group").agg(F.sum("cnt")).join(placed.select("group").distinct(), "group", "left_semi").collect())
    # One grouping after another: places of its groups, and the words of its topics.
    topics = sorted({tuple(r)[:-1] for r in rows if r["group"] in totals})
    number = {topic: i for i, topic in enumerate(topics)}
    code = {group: i for i, group in enumerate(sorted(totals))}
    sizes = np.zeros(len(topics), dtype=np.int64)
    runs: dict[tuple, list[tuple[int, int]]] = {}
    for row in rows:
        if row["group"] in totals:
            topic = number[tuple(row)[:-1]]
            sizes[topic] += totals[row["group"]]
            runs.setdefault(tuple(row)[:-2], []).append((code[row["group"]], topic))
    places, means = [], np.zeros(len(topics))
    for pairs in runs.values():
        groups, at = np.array(sorted(pairs)).T
        own = np.unique(at)
        means[own] = sizes[own].sum() // len(own)
        places.append((groups, at))
    spark = counts.sparkSession
    coded = spark.createDataFrame(list(code.items()), counts.select("group", F.lit(0).alias("code")).schema)
    words = counts.join(coded, "group").groupBy("word").agg(F.collect_list(F.struct("code", F.col("cnt").cast("long").alias("cnt"))).alias("held"))
    return _Groupings(words, topics, sizes, spark.sparkContext.broadcast((places, sizes, means)))


def _of_groups(counts: DataFrame, placed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, str]:
    """Without nulls, and the kinds of the keys."""
    counts = counts.filter(tx.all_of([F.col(c).isNotNull() for c in ("group", "word")]))
    placed = placed.filter(tx.all_of([F.col(c).isNotNull() for c in (*keys, "group")]))
    return counts, placed, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(*keys).schema)


def _joined(counts: DataFrame, placed: DataFrame, by: list[str]) -> DataFrame:
    """``class_tfidf`` of groupings that the tasks do not get."""
    joined = counts.join(placed, "group").groupBy(*by, "topic", "word").agg(F.sum("cnt").alias("cnt"))
    return class_tfidf(cut(joined, "counts"), by)


def top_words_of_groupings(counts: DataFrame, placed: DataFrame, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """``top_words`` of ``class_tfidf`` for many groupings of the same groups, without a row per grouping and word.

    ``counts (group, word, cnt)`` is read once; ``placed (by..., group, topic)`` says where each grouping puts
    each group, and groups that a grouping lacks do not count there.  All counts of a word meet in one row, from
    which a task weighs the word for every grouping; only the ``n`` heaviest words of each topic in a batch
    leave it.  Null groups, topics and words are left out.
    """
    by = list(by)
    keys = [*by, "topic"]
    counts, placed, fields = _of_groups(counts, placed, keys)
    found = _groupings(counts, placed, keys)
    if found is None:
        return top_words(_joined(counts, placed, by), n, by)
    words, weighed = found.words, replace(found, words=None).weighed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled = batch.column(0).to_pylist()
            # Words by their order, in which ties are broken.
            order = np.empty(len(spelled), dtype=np.int64)
            order[sorted(range(len(spelled)), key=spelled.__getitem__)] = np.arange(len(spelled))
            for w, topic, held, total, weight in weighed(batch):
                weight = np.round(weight, 9)
                best = np.lexsort((order[w], -weight, topic))
                start = np.searchsorted(topic[best], topic[best])
                best = best[np.arange(len(best)) - start < n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(topic[best]), batch.column(0).take(pa.array(w[best])),
                     pa.array(held[best].astype(np.int64)), pa.array(total[best].astype(np.int64))],
                    names=["place", "word", "cnt", "word_total"],
                )

    whole = words.mapInArrow(run, "place long, word string, cnt long, word_total long")
    about = found.about(counts.sparkSession, fields)
    weight = F.col("cnt") / F.col("topic_words") * F.log(1 + F.col("mean_words") / F.col("word_total"))
    return top_words(whole.join(about, "place").select(*keys, "word", weight.alias("weight")), n, by)


def topic_products_of_groupings(counts: DataFrame, placed: DataFrame, by: Sequence[str] = ()) -> DataFrame | None:
    """``(by..., topic, other, inner)``: inner products of the ``class_tfidf`` weights of any two topics of a grouping.

    ``counts`` and ``placed`` are those of ``top_words_of_groupings``.  A task weighs its words for every grouping and
    adds up the products, so that no row for a word leaves it.  None if the tasks cannot get ``placed``.
    """
    by = list(by)
    keys = [*by, "topic"]
    counts, placed, fields = _of_groups(counts, placed, keys)
    found = _groupings(counts, placed, keys)
    if found is None:
        return None
    words, weighed, n = found.words, replace(found, words=None).weighed, max(1, len(found.topics))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, topic, _, _, weight in weighed(batch):
                # Words are in order: each entry meets all entries of its word, some at a time.
                first, last = np.searchsorted(w, w, "left"), np.searchsorted(w, w, "right")
                upto, at = np.cumsum(last - first), 0
                while at < len(w):
                    to = max(at + 1, int(np.searchsorted(upto, upto[at] + MOST_PRODUCTS)))
                    times = (last - first)[at:to]
                    a = np.repeat(np.arange(at, min(to, len(w))), times)
                    b = np.repeat(first[at:to] - np.cumsum(times) + times, times) + np.arange(len(a))
                    pair, index = np.unique(topic[a] * n + topic[b], return_inverse=True)
                    inner = np.bincount(index, weights=weight[a] * weight[b])
                    yield pa.RecordBatch.from_arrays([pa.array(pair // n), pa.array(pair % n), pa.array(inner)], names=["place", "other_place", "inner"])
                    at = to

    products = words.mapInArrow(run, "place long, other_place long, inner double").groupBy("place", "other_place").agg(F.sum("inner").alias("inner"))
    about = found.about(counts.sparkSession, fields).drop("topic_words", "mean_words")
    others = about.select(F.col("place").alias("other_place"), F.col("topic").alias("other"))
    return products.join(about, "place").join(others, "other_place").select(*keys, "other", "inner")


def exclude_outliers(df: DataFrame, topic_col: str = "topic") -> DataFrame:
    """Rows of real topics, without the outlier topic -1."""
    return df.filter(F.col(topic_col) != -1)


def topics_with_words(words: DataFrame, min_words: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Keep the topics that have at least ``min_words`` words."""
    keys = [*by, "topic"]
    enough = words.groupBy(*keys).agg(F.count("*").alias("n_words"))
    return words.join(enough.filter(F.col("n_words") >= min_words).select(*keys), keys, "left_semi")
