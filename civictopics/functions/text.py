"""Text expressions.  All are plain Spark columns, so they stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() and its regex class \s treat as whitespace.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())

def _ranges(characters: str) -> str:
    """A class of sorted characters for a regular expression, as ranges: far fewer tests for other characters."""
    runs: list[list[int]] = []
    for code in map(ord, characters):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + "]"


WHITESPACE_CLASS = _ranges(WHITESPACE)

# Letters, letter-like numbers and underscore, but no decimal digits.
SIMPLE_TOKEN = r"[\p{L}\p{Nl}\p{No}_]+"
# Two or more word characters, digits included.
MODEL_TOKEN = r"[\p{L}\p{N}_]{2,}"
WORD_CHARACTER = r"[\p{L}\p{N}_]"

# Fixed value: what stands for a document that has no text left.
EMPTY_DOCUMENT = "emptydoc"

# Words deleted by clean_text, and the two length limits of the labelling step.
DROP_WORDS = ("Item", "Parágrafo", "Artigo")
CLEAN_LIMIT = 2000
PROMPT_LIMIT = 1500


def strip_text(text: Column) -> Column:
    """Remove Unicode whitespace from both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def simple_tokens(text: Column, min_len: int = 2, max_len: int = 15) -> Column:
    """Lower-cased letter runs of ``min_len`` to ``max_len`` characters that do not start with ``_``."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(SIMPLE_TOKEN), F.lit(0))
    return F.filter(
        runs,
        lambda word: F.length(word).between(min_len, max_len) & ~word.startswith("_"),
    )


def without_words(tokens: Column, words: Sequence[str]) -> Column:
    """Drop stop words; repeats of the other words stay."""
    if not words:
        return tokens
    return F.filter(tokens, lambda word: ~word.isin(list(words)))


def model_text(text: Column) -> Column:
    """Line breaks and tabs to spaces; an empty text becomes a marker document."""
    spaced = F.translate(text, "\n\t", "  ")
    return F.when(spaced == "", EMPTY_DOCUMENT).otherwise(spaced)


def model_tokens(text: Column) -> Column:
    """The words a topic model counts: lower-cased runs of two or more word characters."""
    # Line breaks and tabs part words as the spaces do that model_text has in their place.
    shown = F.when(text == "", EMPTY_DOCUMENT).otherwise(text)
    return F.regexp_extract_all(F.lower(shown), F.lit(MODEL_TOKEN), F.lit(0))


def ngrams(tokens: Column, low: int = 1, high: int = 1) -> Column:
    """All n-grams of ``low`` to ``high`` consecutive tokens, shorter ones first.

    A gram is put together from single elements, so the cost grows with the text length.
    """
    if not 1 <= low <= high:
        raise ValueError("ngrams needs 1 <= low <= high")

    def of_size(n: int) -> Column:
        if n == 1:
            return tokens
        starts = F.when(
            F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts, lambda start: F.concat_ws(" ", *[F.get(tokens, start + i) for i in range(n)])
        )

    return F.concat(*[of_size(n) for n in range(low, high + 1)])


def clean_text(
    text: Column, drop_words: Sequence[str] = DROP_WORDS, max_chars: int | None = None
) -> Column:
    """Squeeze whitespace, delete ``drop_words`` (and a colon right after one), strip.

    Spaces left by a deleted word are not squeezed again.  ``max_chars`` cuts the result
    (``CLEAN_LIMIT`` is the labelling step's own limit); by default the whole text is kept.
    """
    spaced = F.regexp_replace(text, r"\n+", " ")
    squeezed = F.regexp_replace(spaced, WHITESPACE_CLASS + "{2,}", " ")
    if drop_words:
        words = "|".join(r"\Q" + word + r"\E" for word in drop_words)
        pattern = f"(?iu)(?<!{WORD_CHARACTER})(?:{words})(?!{WORD_CHARACTER}):?"
        squeezed = F.regexp_replace(squeezed, pattern, "")
    stripped = strip_text(squeezed)
    return stripped if max_chars is None else F.substring(stripped, 1, max_chars)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
