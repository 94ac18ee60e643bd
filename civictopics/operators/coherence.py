"""Internal quality of topics: diversity, NPMI coherence and the weighted score."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civictopics.functions.vectors import ROWS_AT_A_TIME
from civictopics.operators.vocabulary import topics_with_words
from civictopics.storage import cut

# Smoothing inside the logarithms, and the weights of the two scores.
EPSILON = 1e-12
COHERENCE_SHARE = 0.8
DIVERSITY_SHARE = 0.2
# Topic words that the tasks receive; more are joined with the texts.
MOST_WORDS = 1 << 17


def topic_diversity(words: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., nd)``: distinct words over all words of the topics, 0 without topics."""
    per_word = words.groupBy(*by, "word").agg(F.count("*").alias("uses"))
    share = F.count("word") / F.sum("uses")
    return per_word.groupBy(*by).agg(F.coalesce(share, F.lit(0.0)).alias("nd"))


def _marked_tokens(docs: DataFrame, words: DataFrame) -> DataFrame:
    """``(marks)``: the tokens of each text, null where they are no topic word.

    Each topic word is looked up once per text that has it, not once per occurrence: the join runs
    over the distinct words of a text.  ``words`` has one row per word, so Spark broadcasts it
    when it is small and can split the rows of a frequent word when it is not.
    """
    distinct = docs.select("row_id", F.explode(F.array_distinct("tokens")).alias("word"))
    known = distinct.join(words, "word").groupBy("row_id").agg(F.collect_list("word").alias("known"))
    marks = F.transform("tokens", lambda word: F.when(F.array_contains("known", word), word))
    return docs.join(known, "row_id").select(marks.alias("marks"))


def _windows_of(tokens: pa.Array, words: frozenset[str] | None, window: int) -> pa.RecordBatch:
    """What ``word_windows`` counts, for the texts of one batch; ``words`` are all that are not null when not given."""
    coded = tokens.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    order = sorted((i for i, name in enumerate(names) if words is None or name in words), key=names.__getitem__)
    # Numbers in the order of the words, -1 for all others; nulls are at the end.
    number = np.full(len(names) + 1, -1, dtype=np.int64)
    number[order] = np.arange(len(order))
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    found, total = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))], 0
    for lo in range(0, len(tokens), ROWS_AT_A_TIME):
        size = lengths[lo : lo + ROWS_AT_A_TIME]
        first = ends[lo : lo + len(size)] - size
        codes = coded.indices[first[0] : first[-1] + size[-1]]
        word = number[pc.fill_null(codes, len(names)).to_numpy(zero_copy_only=False)]
        at = np.flatnonzero(word >= 0)
        row = np.searchsorted(first - first[0], at, "right") - 1
        n_windows = np.maximum(size - (window - 1), 1)
        total += int(n_windows[np.unique(row)].sum())
        # Every window that a word is in, by the place in the text at which it starts.
        place = at - (first - first[0])[row]
        low, high = np.maximum(place - (window - 1), 0), np.minimum(place, n_windows[row] - 1)
        times = high - low + 1
        start = np.repeat(at - place + low - np.cumsum(times) + times, times) + np.arange(times.sum())
        held = np.unique(start * (len(order) + 1) + np.repeat(word[at], times))
        start, inside = held // (len(order) + 1), held % (len(order) + 1)
        for step in range(min(window, len(held))):
            same = np.flatnonzero(start[: len(start) - step] == start[step:])
            found.append(np.unique(inside[same] * len(order) + inside[same + step], return_counts=True))
    pair, index = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
    cnt = np.bincount(index, weights=np.concatenate([c for _, c in found]), minlength=len(pair)).astype(np.int64)
    named = coded.dictionary.take(pa.array(order, pa.int64())).cast(pa.string())
    null = pa.nulls(1, pa.string())
    sides = [pa.concat_arrays([named.take(pa.array(side)), null]) for side in (pair // max(len(order), 1), pair % max(len(order), 1))]
    return pa.RecordBatch.from_arrays([*sides, pa.array(np.append(cnt, total))], names=["word_a", "word_b", "cnt"])


def word_windows(docs: DataFrame, words: DataFrame, window: int = 10) -> DataFrame:
    """``(word_a, word_b, cnt)`` with ``word_a <= word_b``: windows that hold both words.

    A text of L tokens has ``max(L - window + 1, 1)`` windows, and only texts with a word of
    ``words`` count.  ``(w, w)`` rows hold the windows of one word, the row with null words the
    number of all windows.  Tasks get up to ``MOST_WORDS`` words and read the texts where they lie; more
    are joined with the texts.  A task counts the pairs of a batch before they are sent, and a
    window has at most ``window`` words, so no step grows faster than the text.
    """
    rows = words.select("word").filter("word is not null").limit(MOST_WORDS + 1).collect()
    wanted = frozenset(row[0] for row in rows) if len(rows) <= MOST_WORDS else None
    marked = docs.filter("row_id is not null").select("tokens") if wanted is not None else _marked_tokens(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _windows_of(batch.column(0), wanted, window)

    counted = marked.mapInArrow(run, "word_a string, word_b string, cnt long")
    return counted.filter("cnt > 0").groupBy("word_a", "word_b").agg(F.sum("cnt").alias("cnt"))


def topic_coherence(
    docs: DataFrame, words: DataFrame, by: Sequence[str] = (), window: int = 10
) -> DataFrame:
    """``(by..., topic, npmi)``: mean NPMI over the word pairs of each topic.

    ``npmi`` is null for a topic with fewer than two words that occur in ``docs``.  All runs share
    one pass over the texts: windows are counted for the words of all runs together.
    """
    by = list(by)
    keys = [*by, "topic"]
    words = cut(words.select(*keys, "word").distinct(), "topic-words")
    # Read three times: for the number of windows, single words and pairs.
    counts = cut(word_windows(docs, words.select("word").distinct(), window), "windows")
    total = counts.filter(F.col("word_a").isNull()).agg(F.max("cnt")).scalar()
    single = counts.filter(F.col("word_a") == F.col("word_b")).select(
        F.col("word_a").alias("word"), F.col("cnt").alias("cnt_one")
    )
    placed = words.join(single, "word")
    left = placed.select(*keys, F.col("word").alias("word_a"), F.col("cnt_one").alias("cnt_a"))
    right = placed.select(*keys, F.col("word").alias("word_b"), F.col("cnt_one").alias("cnt_b"))
    pairs = left.join(right, keys).filter(F.col("word_a") < F.col("word_b"))
    joint = pairs.join(counts, ["word_a", "word_b"], "left").withColumn("n_windows", total)
    p_joint = F.coalesce(F.col("cnt"), F.lit(0)) / F.col("n_windows")
    p_a, p_b = F.col("cnt_a") / F.col("n_windows"), F.col("cnt_b") / F.col("n_windows")
    value = F.log((p_joint + EPSILON) / (p_a * p_b)) / -F.log(p_joint + EPSILON)
    scored = joint.groupBy(*keys).agg(F.avg(value).alias("npmi"))
    return words.select(*keys).distinct().join(scored, keys, "left")


def mean_coherence(per_topic: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., nc)``: mean over topics; null as soon as one topic has no value."""
    whole = F.count("npmi") == F.count("*")
    return per_topic.groupBy(*by).agg(F.when(whole, F.avg("npmi")).alias("nc"))


def weighted_scores(scores: DataFrame) -> DataFrame:
    """Adds ``wc``, ``wd`` and ``ws`` to ``nc`` and ``nd``."""
    wc, wd = F.col("nc") * COHERENCE_SHARE, F.col("nd") * DIVERSITY_SHARE
    return scores.withColumns({"wc": wc, "wd": wd, "ws": wc + wd})


def internal_scores(
    docs: DataFrame,
    words: DataFrame,
    by: Sequence[str] = (),
    min_words: int = 2,
    window: int = 10,
) -> DataFrame:
    """``(by..., nc, nd, wc, wd, ws)`` of the topics with at least ``min_words`` words."""
    by = list(by)
    kept = topics_with_words(words.filter("topic <> -1"), min_words, by)
    nc = mean_coherence(topic_coherence(docs, kept, by, window), by)
    nd = topic_diversity(kept, by)
    if by:
        both = nc.join(nd, by)
    else:
        both = nc.withColumn("nd", nd.scalar())
    return weighted_scores(both)
