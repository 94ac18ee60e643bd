"""Labels by similarity of spelling: an option is found when a text has its words in a like form.

Two words are alike by the cosine of their sets of character trigrams, letters without accents.  Names of
options are few and words of a corpus repeat, so the distinct words of all texts meet the distinct words of
all names once, through an inverted index of trigrams; texts then look up their words by an equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civictopics.functions import text as tx
from civictopics.operators.labelling import NO_CHILDREN, first_options, options_by_parent
from civictopics.storage import cut

# Accented letters and the plain ones that they are read as.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñý"
PLAIN = "aaaaaaeeeeiiiiooooouuuucny"

# Words below this cosine are not alike, and options below this share are not given.
ALIKE = 0.6
SHARE = 0.5


def plain_word(word: Column) -> Column:
    """Lower case, without accents."""
    return F.translate(F.lower(word), ACCENTED, PLAIN)


def trigrams(word: Column) -> Column:
    """The distinct runs of three characters of a word between marks that no word contains."""
    marked = F.concat(F.lit("^"), plain_word(word), F.lit("$"))
    # As the variable of an outer function, so that the letters are not read anew for every run.
    runs = F.transform(F.array(marked), lambda m: F.transform(F.sequence(F.lit(1), F.length(m) - 2), lambda at: F.substring(m, at, F.lit(3))))[0]
    return F.when(F.length(word) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def similar_words(words: DataFrame, names: DataFrame, alike: float = ALIKE) -> DataFrame:
    """``(word, name_word, sim)`` of all ``words (word)`` and ``names (name_word)`` with ``sim >= alike``.

    Repeats and null words count once or not at all.  A pair that is alike shares at least ``alike``
    squared of the trigrams of the name's word, so only its rarest ones, one more than it may lack, are
    posted in the index; a word with none of them cannot be alike.  Numbers of trigrams that cannot
    reach the cosine refute a pair before its trigrams are compared.
    """
    if not 0 < alike <= 1:
        raise ValueError("alike must be over 0 and at most 1")
    known = cut(
        names.select("name_word").filter(F.length("name_word") > 0).distinct()
        .withColumn("name_grams", trigrams(F.col("name_word"))), "name-words",
    )
    every = cut(
        words.select("word").filter(F.length("word") > 0).distinct().withColumn("grams", trigrams(F.col("word"))), "words"
    )
    # How many words have each trigram of the names: the rarest ones are posted.
    wanted = known.select(F.explode("name_grams").alias("gram")).distinct()
    postings = every.select(F.explode("grams").alias("gram"))
    common = cut(postings.join(wanted, "gram").groupBy("gram").agg(F.count("*").alias("n")), "trigram-counts")
    counted = known.select("name_word", "name_grams", F.explode("name_grams").alias("gram")).join(common, "gram", "left")
    ordered = counted.groupBy("name_word", "name_grams").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("ordered")
    )
    size = F.size("ordered")
    lacking = (size - F.ceil(size * alike * alike - 1e-9)).cast("int")
    index = cut(
        ordered.select("name_word", "name_grams", F.explode(F.slice("ordered", F.lit(1), lacking + 1)["gram"]).alias("gram")),
        "trigram-index",
    )
    mine, theirs = F.size("grams"), F.size("name_grams")
    met = (
        every.select("word", "grams", F.explode("grams").alias("gram")).join(index, "gram")
        .filter((mine >= theirs * (alike * alike) - 1e-9) & (theirs >= mine * (alike * alike) - 1e-9))
        .dropDuplicates(["word", "name_word"])
    )
    sim = F.round(F.size(F.array_intersect("grams", "name_grams")) / F.sqrt(mine * theirs), 9)
    return met.select("word", "name_word", sim.alias("sim")).filter(F.col("sim") >= alike)


def found_words(texts: DataFrame, names: DataFrame, alike: float = ALIKE) -> DataFrame:
    """``(row_id, found)`` of the texts ``(row_id, words)`` that have words like those of ``names (name_word)``.

    ``found`` maps each word of the names to its highest similarity with a word of the text.
    """
    # Written once, because words and texts meet twice.
    split = cut(texts.select("row_id", F.array_distinct("words").alias("words")), "split-texts")
    each = split.select("row_id", F.explode("words").alias("word"))
    pairs = cut(similar_words(each, names, alike), "similar-words")
    best = each.join(pairs, "word").groupBy("row_id", "name_word").agg(F.max("sim").alias("sim"))
    return best.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("name_word", "sim"))).alias("found"))


def best_option(options: Column, words: Column, found: Column, share: float = SHARE) -> Column:
    """The option whose words have the highest mean similarity to what was found, the first of several;
    null when none reaches ``share``.  ``words`` lists the words of each option; words not found count 0."""

    def rated(option: Column, place: Column) -> Column:
        own = F.get(words, place)
        sims = F.transform(own, lambda word: F.coalesce(F.element_at(found, word), F.lit(0.0)))
        total = F.aggregate(F.sort_array(sims), F.lit(0.0), lambda a, b: a + b)
        mean = F.round(F.coalesce(F.try_divide(total, F.size(own)), F.lit(0.0)), 9)
        return F.struct(mean.alias("share"), (-place).alias("minus"), option.alias("option"))

    best = F.array_max(F.transform(options, rated))
    return F.when(best["share"] >= share, F.struct(best["option"].alias("option"), best["share"].alias("share")))


def classify_by_spelling(
    df: DataFrame,
    tax: DataFrame,
    text_col: str = "proposal_text",
    alike: float = ALIKE,
    share: float = SHARE,
    drop_words: Sequence[str] = tx.DROP_WORDS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(row_id, keep..., n1, n2, share_1, share_2)``: labels of both levels from one reading of the texts.

    As ``classify`` with the built-in responder, but words need only be alike in spelling: "Saude publica"
    is found for the subject "Saúde".  A null or empty text, and one without a like word, has null labels;
    a subject without children gets ``NO_CHILDREN``.  ``row_id`` tells rows apart; rows that repeat one get
    the labels of all their words together, and those without one have null labels.
    """
    parents = cut(options_by_parent(tax), "subjects")
    top = cut(first_options(parents), "options")
    named = top.select(F.flatten("option_words").alias("words")).unionByName(
        parents.select(F.flatten("child_words").alias("words"))
    )
    names = named.select(F.explode("words").alias("name_word"))
    cleaned = tx.clean_text(F.col(text_col), drop_words, None)
    # A projection of its own, because the tokens name the cleaned text twice.
    shown = df.filter(F.col(text_col).isNotNull()).select("row_id", cleaned.alias("_cleaned"))
    split = shown.select("row_id", tx.model_tokens(F.col("_cleaned")).alias("words"))
    found = found_words(split, names, alike)
    asked = found.withColumns({
        "_options": top.select("options").scalar(), "_words": top.select("option_words").scalar(),
    })
    chosen = best_option(F.col("_options"), F.col("_words"), F.col("found"), share)
    first = asked.select("row_id", "found", chosen.alias("first")).filter("first is not null").select(
        "row_id", "found", F.col("first.option").alias("n1"), F.col("first.share").alias("share_1")
    )
    known = parents.select("n1", F.col("children").alias("_options"), F.col("child_words").alias("_words"))
    second = best_option(F.col("_options"), F.col("_words"), F.col("found"), share)
    labels = first.join(known, "n1").withColumn("second", second).select(
        "row_id", "n1",
        F.when(F.size("_options") == 0, NO_CHILDREN).otherwise(F.col("second.option")).alias("n2"),
        "share_1", F.col("second.share").alias("share_2"),
    )
    return df.select("row_id", *keep).join(labels, "row_id", "left")
