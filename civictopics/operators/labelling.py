"""Labelling texts against a two-level taxonomy."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civictopics.functions import text as tx
from civictopics.operators.prepare import stop_words
from civictopics.storage import cut

# Fixed value: the second-level label of a subject that has no children.
NO_CHILDREN = "Sem subcategoria"

# Fixed value: the question put to a text model; {options} and {text} are filled in.
PROMPT = """
    CLASSIFIQUE este texto usando APENAS UM destes termos oficiais do VCGE: 
    {options}.
    
    TEXTO: {text}...
    
    Responda APENAS com o termo exato. Nada além do termo.
    """

# A responder takes (row_id, text, options, prompt) and adds (response, error).
Responder = Callable[[DataFrame], DataFrame]


def build_prompt(text: Column, options: Column, max_chars: int | None = None) -> Column:
    """The question for one text and its allowed labels (an array column).

    ``max_chars`` cuts the text, ``PROMPT_LIMIT`` being the limit of the original question; by
    default the whole text is asked about.
    """
    shown = text if max_chars is None else F.substring(text, 1, max_chars)
    before, rest = PROMPT.split("{options}")
    between, after = rest.split("{text}")
    return F.concat(
        F.lit(before), F.array_join(options, ", "), F.lit(between), shown, F.lit(after)
    )


def validate_response(response: Column, options: Column) -> Column:
    """The allowed label a response stands for, or null.

    An exact label wins; otherwise the first option, in their order, whose lower-cased name
    contains the lower-cased response.  An empty response is contained in every name.
    """
    contained = F.filter(options, lambda option: F.lower(option).contains(F.lower(response)))
    return F.when(F.array_contains(options, response), response).otherwise(
        F.get(contained, F.lit(0))
    )


def label_tokens(label: Column, words: Sequence[str]) -> Column:
    return F.array_distinct(tx.without_words(tx.model_tokens(label), words))


def option_words(options: Column, language: str = "portuguese") -> Column:
    """The words of each option that count."""
    words = stop_words(language)
    return F.transform(options, lambda option: label_tokens(option, words))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, also where ``use`` puts it into a function of elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _found_words(text: Column, words: Column) -> Column:
    """Those of ``words`` that occur in the text."""
    return F.array_intersect(words, tx.model_tokens(F.coalesce(text, F.lit(""))))


def _best_option(found: Column) -> Column:
    """The option with the largest share of its words among ``found``; the first of several, null without any."""

    def share(option: Column, place: Column) -> Column:
        own = F.get("option_words", place)
        hit = F.size(F.array_intersect(own, found))
        return F.struct(
            F.round(F.coalesce(F.try_divide(hit, F.size(own)), F.lit(0.0)), 9).alias("share"),
            (-place).alias("minus"),
            option.alias("option"),
        )

    best = F.array_max(F.transform("options", share))
    return F.when(best["share"] > 0, best["option"])


def overlap_responses(asked: DataFrame, language: str = "portuguese") -> DataFrame:
    """The built-in responder: the option with the largest share of its words in the text.

    Ties go to the first option; without any shared word the response is null.  ``asked`` may bring
    the words of its options as ``option_words``, which saves splitting the names for every text, and
    those of them that occur in the text as ``found_words``, which saves splitting the text again.
    """
    if "option_words" not in asked.columns:
        asked = asked.withColumn("option_words", option_words(F.col("options"), language))
    if "found_words" in asked.columns:
        response = _best_option(F.col("found_words"))
    else:
        # The words of all options first cut the text down to what can match.
        response = _once(_found_words(F.col("text"), F.array_distinct(F.flatten("option_words"))), _best_option)
    return asked.select(
        *[c for c in asked.columns if c not in ("option_words", "found_words")],
        response.alias("response"),
        F.lit(None).cast("string").alias("error"),
    )


def model_responses(answer: Callable[[str], str]) -> Responder:
    """A responder around the user's own model, called once per prompt inside the tasks.

    A prompt that fails gives a null response and keeps the message in ``error``.
    """

    def respond(asked: DataFrame) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                responses, errors = [], []
                for prompt in batch["prompt"]:
                    response, error = None, None
                    try:
                        response = answer(prompt).strip() if prompt is not None else None
                    except Exception as failure:
                        error = str(failure)
                    responses.append(response)
                    errors.append(error)
                yield batch.assign(response=responses, error=errors)

        return asked.mapInPandas(ask, f"{fields}, response string, error string")

    return respond


def options_by_parent(tax: DataFrame) -> DataFrame:
    """``(n1_pos, n1, children)``: ordered second-level names, an empty list for a childless subject.

    One row per name: a taxonomy that lists a name twice must not double its texts.
    """
    named = F.filter(
        F.sort_array(F.collect_list(F.struct("n1_pos", "n2_pos", "n2"))),
        lambda child: child["n2"].isNotNull(),
    )
    return (
        tax.groupBy("n1")
        .agg(F.min("n1_pos").alias("n1_pos"), named.alias("placed"))
        .select("n1_pos", "n1", F.col("placed.n2").alias("children"))
        .withColumn("child_words", option_words(F.col("children")))
    )


def first_options(parents: DataFrame) -> DataFrame:
    """One row ``(options, option_words)``: all first-level names in order."""
    placed = F.sort_array(F.collect_list(F.struct("n1_pos", "n1")))
    options = parents.agg(placed.alias("placed")).select(F.col("placed.n1").alias("options"))
    return options.withColumn("option_words", option_words(F.col("options")))


def classify(
    df: DataFrame,
    tax: DataFrame,
    respond: Responder = overlap_responses,
    text_col: str = "proposal_text",
    drop_words: Sequence[str] = tx.DROP_WORDS,
    clean_chars: int | None = None,
    prompt_chars: int | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(row_id, keep..., n1, n2, response_1, response_2, error)`` of each text.

    The text is cleaned, answered and validated for the first level, then again among the children
    of the label found.  No first-level label leaves both null; a subject without children gets
    ``NO_CHILDREN``; a null text gets null labels.  The options are one small value in the plan.
    The children are written first, so that Spark sees their size and looks them up by broadcast
    instead of shuffling the texts by label.  ``keep`` carries columns along, which saves joining
    the labels back.
    """
    parents = cut(options_by_parent(tax), "subjects")
    top = cut(first_options(parents), "options")
    # The built-in responder asks for words only: each text is split once, and what it has of the words of
    # all names, of both levels, goes on in its place.
    built_in = respond is overlap_responses
    carried = ["option_words", "found_words"] if built_in else ["text"]

    def asked(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        prompt = [] if built_in else [
            F.when(F.size("options") > 0, build_prompt(F.col("text"), F.col("options"), prompt_chars)).alias("prompt")
        ]
        return respond(rows.select("row_id", *keep, *columns, "options", *carried, *prompt))

    cleaned = df.select(
        "row_id", *keep,
        tx.clean_text(F.col(text_col), drop_words, clean_chars).alias("text"),
        top.select("options").scalar().alias("options"), top.select("option_words").scalar().alias("option_words"),
    )
    if built_in:
        names = top.select(F.flatten("option_words").alias("words")).unionByName(parents.select(F.flatten("child_words").alias("words")))
        every = cut(names.agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words")), "name-words")
        cleaned = cleaned.withColumn("name_words", every.select("words").scalar())
        found = _found_words(F.col("text"), F.col("name_words"))
        both = _once(found, lambda words: F.struct(words.alias("found_words"), _best_option(words).alias("response")))
        answers = cleaned.select("row_id", *keep, "options", both.alias("both"))
        first = answers.select(
            "row_id", *keep, F.col("both.found_words").alias("found_words"), F.col("both.response").alias("response_1"),
            F.lit(None).cast("string").alias("error_1"), validate_response(F.col("both.response"), F.col("options")).alias("n1"),
        )
    else:
        first = asked(cleaned, []).select(
            "row_id", *keep, "text", F.col("response").alias("response_1"), F.col("error").alias("error_1"),
            validate_response(F.col("response"), F.col("options")).alias("n1"),
        )
    known = parents.select("n1", F.col("children").alias("options"), F.col("child_words").alias("option_words"))
    second = first.join(known, "n1", "left")
    ready = second.withColumns({
        "options": F.coalesce("options", F.array().cast("array<string>")),
        "option_words": F.coalesce("option_words", F.array().cast("array<array<string>>")),
    })
    answered = asked(ready, ["n1", "response_1", "error_1"])
    childless = F.size("options") == 0
    return answered.select(
        "row_id",
        *keep,
        "n1",
        F.when(F.col("n1").isNull(), None)
        .when(childless, NO_CHILDREN)
        .otherwise(validate_response(F.col("response"), F.col("options")))
        .alias("n2"),
        "response_1",
        F.when(F.col("n1").isNotNull() & ~childless, F.col("response")).alias("response_2"),
        F.coalesce("error_1", F.when(F.col("n1").isNotNull() & ~childless, F.col("error"))).alias("error"),
    )


def attach_labels(df: DataFrame, labels: DataFrame, n1: str = "VCGE_N1", n2: str = "VCGE_N2") -> DataFrame:
    """All rows of ``df`` with their labels in the columns ``n1`` and ``n2``."""
    named = labels.select("row_id", F.col("n1").alias(n1), F.col("n2").alias(n2))
    return df.join(named, "row_id", "left")


def label_distribution(labels: DataFrame) -> DataFrame:
    """``(n1, n2, cnt, answered, validated)``: texts per label, and how they came about."""
    return labels.groupBy("n1", "n2").agg(
        F.count("*").alias("cnt"),
        F.count("response_1").alias("answered"),
        F.count_if(F.col("response_1").isNotNull() & F.col("n1").isNotNull()).alias("validated"),
    )
