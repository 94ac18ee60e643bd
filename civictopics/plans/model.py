"""Fitting a topic model and applying it to other texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civictopics.operators import embed, phrases, topics, vocabulary
from civictopics.operators.density import density_topics
from civictopics.operators.prepare import with_model_tokens
from civictopics.sources.taxonomy import seed_texts
from civictopics.storage import cut


@dataclass(frozen=True)
class Settings:
    """How topics are found.  ``nr_topics=None`` means no reduction.

    ``frequency_buckets`` is the size of the table of document frequencies.  Words that share a
    bucket share a weight, so choose it well above the number of words that matter.  With
    ``seed_phrases``, seeds of several words are counted and weighted as one word where they occur.
    """

    method: str | Callable[[Column], Column] = "hash"
    dim: int = 256
    salt: str = ""
    frequency_buckets: int = embed.FREQUENCY_BUCKETS
    reducer: str = "pca"
    k: int = 5
    width: float = 0.25
    sim: float = 0.9
    min_topic_size: int = 10
    min_pts: int | None = None
    nr_topics: int | None = None
    n_gram_range: tuple[int, int] = (1, 1)
    words_per_topic: int = 10
    docs_per_topic: int = 3
    seed_multiplier: float = 2.0
    seed_phrases: bool = True
    seed_weight: tuple[float, float] = (3, 1)
    min_sim: float | None = None


# The settings of the final model.
FINAL = Settings(nr_topics=70, min_topic_size=10)


@dataclass(frozen=True)
class TopicModel:
    """The tables of a fitted model.

    ``assigned (row_id, topic, ...)``, ``words (topic, rank, word, weight)`` and
    ``centroids (topic, embedding)``.
    """

    settings: Settings
    idf: np.ndarray | None = field(repr=False)
    assigned: DataFrame
    words: DataFrame
    centroids: DataFrame

    @cached_property
    def info(self) -> DataFrame:
        """``(topic, cnt, name, representation, representative_docs)``, worked out when asked for."""
        samples = cut(
            topics.representative_docs(
                self.assigned, self.centroids, self.settings.docs_per_topic
            ),
            "samples",
        )
        return topics.topic_info(self.assigned, self.words, samples, self.assigned)


def _embedded(
    docs: DataFrame, settings: Settings, idf: np.ndarray | None, vectors: DataFrame | None
) -> DataFrame:
    return embed.embed_docs(
        docs, settings.method, settings.dim, idf, settings.salt, vectors
    )


def fit_topics(
    docs: DataFrame,
    settings: Settings = Settings(),
    seed_words: DataFrame | None = None,
    seed_topics: DataFrame | None = None,
    vectors: DataFrame | None = None,
) -> TopicModel:
    """Find topics in ``docs (row_id, clean_text)``.

    ``seed_words`` and ``seed_topics`` are tables ``(seed_topic, pos, seed)``: the first
    strengthen words, the second pull texts.  ``vectors`` are precomputed embeddings.

    Tokens and vectors stay on the row of their text from start to end: the topic of a cell is
    looked up in a small table, so no text is shuffled by ``row_id``.
    """
    counted = with_model_tokens(docs, n_gram_range=settings.n_gram_range).select("row_id", "clean_text", "tokens")
    with_seeds = seed_words is not None and settings.seed_phrases
    if with_seeds:
        # Shorter ones are n-grams that the range counts already.
        longer = phrases.seed_phrases(seed_words).filter(F.size("words") > settings.n_gram_range[1])
        counted = phrases.find_phrases(counted, longer)
    tokens = cut(counted, "tokens")
    idf = embed.inverse_frequencies(tokens, settings.frequency_buckets) if settings.method == "hash" else None
    embedded = _embedded(tokens, settings, idf, vectors)
    if seed_topics is not None:
        # Precomputed vectors say nothing about seed texts, so guidance needs an encoder.
        if settings.method == "precomputed":
            raise ValueError("seed topics need method='hash' or a callable")
        joined = with_model_tokens(seed_texts(seed_topics))
        seeds = _embedded(joined, settings, idf, None).select(
            F.col("row_id").alias("topic"), "embedding"
        )
        embedded = topics.seed_guide(cut(embedded, "embedded"), seeds, settings.seed_weight)
    embedded = cut(embedded, "embedded")
    reduced = embed.reduce_dims(
        embedded, settings.k, settings.reducer, settings.salt,
        dim=settings.dim if settings.method == "hash" else None,
    )
    assigned = cut(
        density_topics(
            reduced, settings.k, settings.width, settings.sim,
            settings.min_pts or settings.min_topic_size, settings.min_topic_size,
        ).drop("reduced"),
        "assigned",
    )
    boosted = None
    if seed_words is not None:
        boosted = phrases.seed_terms(seed_words) if with_seeds else vocabulary.seed_tokens(seed_words)

    def weights_of(rows: DataFrame) -> DataFrame:
        if with_seeds:
            rows = rows.withColumn("tokens", F.concat("tokens", "phrases"))
        counts = cut(vocabulary.topic_term_counts(rows), "counts")
        return vocabulary.class_tfidf(counts, (), boosted, settings.seed_multiplier)

    weights = weights_of(assigned)
    if settings.nr_topics is not None:
        assigned = topics.reduce_topics(assigned, weights, settings.nr_topics)
        weights = weights_of(assigned)
    words = cut(vocabulary.top_words(weights, settings.words_per_topic), "words")
    centers = cut(topics.centroids(assigned), "centroids")
    return TopicModel(settings, idf, assigned, words, centers)


def transform(
    model: TopicModel, docs: DataFrame, vectors: DataFrame | None = None
) -> DataFrame:
    """``(row_id, ..., topic, probability)`` of other texts under a fitted model.

    Row by row, so ``docs`` may also be a streaming DataFrame.
    """
    settings = model.settings
    tokens = with_model_tokens(docs, n_gram_range=settings.n_gram_range)
    embedded = _embedded(tokens, settings, model.idf, vectors)
    return topics.assign_nearest(
        embedded, model.centroids, min_sim=settings.min_sim
    ).drop("embedding", "tokens")
