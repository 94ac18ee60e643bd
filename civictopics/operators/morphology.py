"""Lemmas of words by detaching endings, for the words that a lexicon does not list itself.

A rule replaces an ending; what it makes of a word must be a lemma of the lexicon.  Exceptions and the
words of the lexicon go before rules, and longer endings before shorter ones.  Rules can be given, or
induced from the lexicon's own pairs: what is left of a token and its lemma after their common beginning
is a rule, and how many pairs show it is its weight.

Everything works on the distinct words of a corpus, which meet rules, exceptions and lemmas by joins
on equal keys, so that neither the lexicon nor the rules have to be small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings of rules have at most so many characters, so that a word tries few of them.
LONGEST_ENDING = 6
# A stem that is left has at least so many.
SHORTEST_STEM = 2


def detachment_rules(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``(ending, replacement, weight)`` from pairs; earlier ones of one ending have more weight."""
    rows = [(ending, replacement, len(rules) - i) for i, (ending, replacement) in enumerate(rules)]
    return spark.createDataFrame(rows, "ending string, replacement string, weight long")


def _common_beginning(a: Column, b: Column) -> Column:
    """How many characters two words have in common at their beginning."""
    places = F.sequence(F.lit(1), F.least(F.char_length(a), F.char_length(b)))
    unequal = F.filter(places, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    shorter = F.least(F.char_length(a), F.char_length(b))
    return F.when(shorter == 0, 0).otherwise(F.coalesce(F.get(unequal, F.lit(0)) - 1, shorter))


def induced_rules(lexicon: DataFrame, min_pairs: int = 2, longest: int = LONGEST_ENDING, shortest_stem: int = SHORTEST_STEM) -> DataFrame:
    """``(ending, replacement, weight)`` that at least ``min_pairs`` pairs of ``lexicon (token, lemma)`` show.

    ``weight`` is the number of pairs.  Pairs of equal words, and endings that are empty or longer than
    ``longest``, show no rule.
    """
    pairs = lexicon.select("token", "lemma").distinct().filter("token <> lemma")
    same = pairs.withColumn("same", _common_beginning(F.col("token"), F.col("lemma"))).filter(F.col("same") >= shortest_stem)
    rules = same.select(
        F.expr("substring(token, same + 1)").alias("ending"), F.expr("substring(lemma, same + 1)").alias("replacement")
    )
    return (
        rules.filter(F.char_length("ending").between(1, longest)).groupBy("ending", "replacement")
        .agg(F.count("*").alias("weight")).filter(F.col("weight") >= min_pairs)
    )


def lemmas_of(
    words: DataFrame,
    lexicon: DataFrame,
    rules: DataFrame,
    exceptions: DataFrame | None = None,
    longest: int = LONGEST_ENDING,
    shortest_stem: int = SHORTEST_STEM,
) -> DataFrame:
    """``(word, lemma, found_by)`` for the distinct words of ``words (word)``.

    The lemma is, in this order: that of ``exceptions (token, lemma)``; that of the lexicon; what the rule
    with the longest ending makes of the word, if it is a lemma of the lexicon (of one ending, the rule
    of most weight, then the smaller lemma); the word itself, which stays.  ``found_by`` is
    ``exception``, ``lexicon``, ``rule`` or ``none``.  Null words are left out.
    """
    known = words.select("word").filter("word is not null").distinct()
    listed = lexicon.groupBy(F.col("token").alias("word")).agg(F.min("lemma").alias("listed"))
    lemmas = lexicon.select("lemma").filter("lemma is not null").distinct()
    found = known.join(listed, "word", "left")
    if exceptions is None:
        found = found.withColumn("excepted", F.lit(None).cast("string"))
    else:
        found = found.join(exceptions.groupBy(F.col("token").alias("word")).agg(F.min("lemma").alias("excepted")), "word", "left")
    # Endings of the words that nothing lists; a word tries at most ``longest`` of them.
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length("word") - shortest_stem))
    stem = F.expr("left(word, char_length(word) - size)")
    tried = (
        found.filter("listed is null and excepted is null").filter(F.char_length("word") > shortest_stem)
        .select("word", F.explode(sizes).alias("size"))
        .select("word", "size", F.expr("right(word, size)").alias("ending"), stem.alias("stem"))
        .join(rules, "ending").withColumn("lemma", F.concat("stem", "replacement"))
        .join(lemmas, "lemma", "left_semi")
        # Compared as wholes: the longest ending, then the most weight, then the smaller lemma.
        .groupBy("word").agg(F.min(F.struct(-F.col("size"), -F.col("weight"), "lemma"))["lemma"].alias("detached"))
    )
    return found.join(tried, "word", "left").select(
        "word", F.coalesce("excepted", "listed", "detached", "word").alias("lemma"),
        F.when(F.col("excepted").isNotNull(), "exception").when(F.col("listed").isNotNull(), "lexicon")
        .when(F.col("detached").isNotNull(), "rule").otherwise("none").alias("found_by"),
    )


def full_lexicon(
    tokens: DataFrame, lexicon: DataFrame, rules: DataFrame | None = None, exceptions: DataFrame | None = None,
    tokens_col: str = "tokens", min_pairs: int = 2,
) -> DataFrame:
    """``(token, lemma)`` for every word of a corpus that changes, ready for ``prepare.lemmatise``.

    Without ``rules`` they are induced from the lexicon.  The words are counted out of the texts with
    map-side combining, so texts are not moved.
    """
    rules = induced_rules(lexicon, min_pairs) if rules is None else rules
    words = tokens.select(F.explode_outer(tokens_col).alias("word"))
    changed = lemmas_of(words, lexicon, rules, exceptions).filter("lemma <> word")
    return changed.select(F.col("word").alias("token"), "lemma")
