"""Corpus preparation: from a raw text column to one row of tokens per distinct text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civictopics.functions import text as tx
from civictopics.functions.stopwords import ENGLISH, PORTUGUESE
from civictopics.operators.morphology import full_lexicon
from civictopics.storage import cut


def standardise(
    df: DataFrame, text_col: str, id_col: str = "row_id", null_policy: str = "drop", keep: Sequence[str] = ()
) -> DataFrame:
    """``(row_id, original_text, keep...)`` with the text cast to string and stripped.

    ``null_policy='drop'`` removes null texts; ``'literal'`` turns them into the text ``nan``,
    as casting a frame to text before filling its gaps does.
    """
    text = F.col(text_col).cast("string")
    if null_policy == "literal":
        text = F.coalesce(text, F.lit("nan"))
    elif null_policy != "drop":
        raise ValueError("null_policy must be 'drop' or 'literal'")
    return df.select(
        F.col(id_col).cast("long").alias("row_id"), tx.strip_text(text).alias("original_text"), *keep
    )


def drop_empty(df: DataFrame, text_col: str = "original_text") -> DataFrame:
    """Remove rows whose text is null or empty."""
    return df.filter(F.col(text_col) != "")


def first_of_each_text(
    df: DataFrame, text_col: str = "original_text", keep: Sequence[str] = ()
) -> DataFrame:
    """Exact, case-sensitive de-duplication; the smallest ``row_id`` of equal texts stays.

    Only ``row_id`` is aggregated, so this is a hash aggregation: copies collapse in the map
    tasks, and a text that fills a third of the corpus reaches the reducer once per map task.
    Columns to ``keep`` come along from the row that stays, which saves a join by ``row_id`` later; numbers
    leave it a hash aggregation, strings would make Spark sort the texts.  Others are joined back where needed.
    """
    kept = [F.min_by(c, "row_id").alias(c) for c in keep]
    return df.groupBy(text_col).agg(F.min("row_id").alias("row_id"), *kept).select("row_id", text_col, *keep)


def stop_words(language: str = "portuguese") -> list[str]:
    """Spark's own stop-word list of a language."""
    known = {"english": ENGLISH, "portuguese": PORTUGUESE}
    if language in known:
        return list(known[language])
    return StopWordsRemover.loadDefaultStopWords(language)


def lemmatise(df: DataFrame, lexicon: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Replace each token that the lexicon ``(token, lemma)`` lists; others stay.

    The lexicon may have any size, so the join carries no hint.  Only words that change leave their
    text: each goes to the lexicon once for a text, and the lemmas come back as a map.  Rows of one
    ``row_id``, which should be a key, all get the tokens of all of them; those of a null one get none.
    """
    others = [c for c in df.columns if c != tokens_col]
    # Written first, so that Spark sees its size: small ones are broadcast, and for others Spark
    # can split the rows of a frequent token, as each token has one row here.
    known = cut(lexicon.groupBy("token").agg(F.min("lemma").alias("lemma")), "lexicon")
    repeated = cut(df.groupBy("row_id").agg(F.count("*").alias("n")).filter("n > 1 and row_id is not null").select("row_id"), "repeated")
    none = F.array().cast("array<string>")
    single, again = df, None
    if not repeated.isEmpty():
        single = df.join(repeated, "row_id", "left_anti")
        again = _lemmas_of_repeated(df.join(repeated, "row_id", "left_semi"), known, tokens_col)
    changed = (
        single.select("row_id", F.explode(F.array_distinct(tokens_col)).alias("token"))
        .join(known, "token")
        .groupBy("row_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("token", "lemma"))).alias("_lemmas"))
    )
    lemmas = F.transform(tokens_col, lambda token: F.coalesce(F.try_element_at("_lemmas", token), token))
    out = single.join(changed, "row_id", "left").select(
        *others, F.when(F.col("row_id").isNotNull() & F.col(tokens_col).isNotNull(), lemmas).otherwise(none).alias(tokens_col)
    )
    return out if again is None else out.unionByName(again)


def _lemmas_of_repeated(df: DataFrame, known: DataFrame, tokens_col: str) -> DataFrame:
    others = [c for c in df.columns if c != tokens_col]
    changed = (
        df.select("row_id", F.posexplode(tokens_col).alias("pos", "token"))
        .join(known, "token", "left")
        .groupBy("row_id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("pos", F.coalesce("lemma", "token").alias("word")))
            ).alias("placed")
        )
        .select("row_id", F.col("placed.word").alias("_lemmas"))
    )
    return df.join(changed, "row_id", "left").select(
        *others, F.coalesce("_lemmas", F.array().cast("array<string>")).alias(tokens_col)
    )


def clean_and_prepare(
    df: DataFrame,
    text_col: str = "proposal_text",
    id_col: str = "row_id",
    null_policy: str = "drop",
    words: Sequence[str] | None = None,
    language: str = "portuguese",
    lexicon: DataFrame | None = None,
    min_len: int = 2,
    max_len: int = 15,
    rules: DataFrame | None = None,
    exceptions: DataFrame | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(row_id, original_text, clean_text, tokens, keep...)`` of the distinct non-empty texts.

    ``original_text`` is the stripped text, ``clean_text`` its tokens joined by spaces.  A text
    that consists of stop words only stays, with no tokens.  ``words`` overrides the stop words
    of ``language``.  With detachment ``rules`` (see ``morphology``) words that the lexicon does not list
    are led back to its lemmas, and ``exceptions`` go before both.  ``keep`` names columns of ``df`` that the row
    which stays brings along.
    """
    dropped = stop_words(language) if words is None else words
    kept = first_of_each_text(drop_empty(standardise(df, text_col, id_col, null_policy, keep)), keep=keep)
    tokens = tx.without_words(
        tx.simple_tokens(F.col("original_text"), min_len, max_len), dropped
    )
    tokenised = kept.select("row_id", "original_text", tokens.alias("tokens"), *keep)
    if lexicon is not None:
        if rules is not None or exceptions is not None:
            tokenised = cut(tokenised, "tokenised")
            lexicon = full_lexicon(tokenised, lexicon, rules, exceptions)
        tokenised = lemmatise(tokenised, lexicon)
    return tokenised.select(
        "row_id", "original_text", F.array_join("tokens", " ").alias("clean_text"), "tokens", *keep
    )


def with_model_tokens(
    df: DataFrame, text_col: str = "clean_text", n_gram_range: tuple[int, int] = (1, 1)
) -> DataFrame:
    """Set ``tokens`` to the words (or n-grams) a topic model counts in ``text_col``."""
    words = tx.model_tokens(F.col(text_col))
    return df.withColumn("tokens", tx.ngrams(words, *n_gram_range))
