"""Quality rules on repetition inside a text, by suffix arrays over its words.

The suffixes of many texts are sorted at once by prefix doubling; only suffixes that still share their
prefix with another one are sorted again.  Words are numbered anew in each text, so suffixes of different
texts share nothing.  The longest common prefixes of neighbours follow in text order, each at most one
word shorter than the one before it.  Their intervals are the repeated runs of words; an interval whose
occurrences have different words before them is a maximal one.  A suffix belongs to its deepest
interval, so the union of the spans of all maximal repeats is the union of the deepest spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civictopics.llm.common import add_columns, pieces

# A repeat counts from so many words on.
MIN_REPEAT = 8
MIN_WORDS = 20
MAX_REPEAT_WORDS = (30, 100)
# The method's verdict: characters inside repeats, as a share of those in words, and words of a repeat.
MAX_COVERED = (25, 100)
MAX_LONGEST = 50
SYMBOLS = "#*$%&|<>"
# Words whose suffixes are sorted together.
SLICE = 1 << 18

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "longest_repeat", "n_repeats")


def suffixes(symbols: np.ndarray, ends: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, group, shared)``: sorted suffixes that share ``shared`` words or more with another one.

    ``ends`` is, for each word, where its text ends.  ``shared`` is the largest power of two up to
    ``shortest``; suffixes with the same first ``shared`` words have the same ``group``.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    active, rank = np.arange(n), np.empty(n, dtype=np.int64)
    keys, step, shared, chosen, group = symbols[order].astype(np.int64), 1, 1, active, None
    while True:
        head = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=bool)
        first = active[np.maximum.accumulate(np.where(head, np.arange(len(active)), 0))]
        rank[order[active]] = first + 1
        alone = head & np.concatenate([head[1:], [True]]) if len(head) else head
        active = active[~alone]
        if step <= shortest:
            shared, chosen = step, active
            group = rank[order[active]]
        if not len(active):
            break
        here = order[active]
        after = here + step
        inside = after < ends[here]
        keys = rank[here] * (n + 1) + np.where(inside, rank[np.where(inside, after, 0)], 0)
        moved = np.argsort(keys, kind="stable")
        order[active], keys = here[moved], keys[moved]
        step *= 2
    return order[chosen], group, shared


def _zipped(*arrays: np.ndarray) -> Iterator[tuple[int, ...]]:
    """Rows of arrays as Python numbers, of which few are held at a time."""
    for at in range(0, len(arrays[0]), 1 << 14):
        yield from zip(*(array[at : at + (1 << 14)].tolist() for array in arrays))


def common_prefixes(symbols: np.ndarray, ends: np.ndarray, order: np.ndarray, group: np.ndarray, shared: int) -> np.ndarray:
    """Words that each suffix of ``order`` shares with the one before it, 0 at the start of a group."""
    lengths = np.zeros(len(order), dtype=np.int64)
    same = np.concatenate([[False], group[1:] == group[:-1]])
    before = np.where(same, np.concatenate([[0], order[:-1]]), -1)
    word, last, have = memoryview(np.ascontiguousarray(symbols)), -2, 0
    in_text = np.argsort(order)
    for at, i, j, end in _zipped(in_text, order[in_text], before[in_text], ends[order[in_text]]):
        if j < 0:
            last = -2
            continue
        have = max(have - 1, shared) if last == i - 1 else shared
        left = end - max(i, j)
        while have < left and word[i + have] == word[j + have]:
            have += 1
        lengths[at], last = have, i
    return lengths


def intervals(symbols: np.ndarray, starts: np.ndarray, order: np.ndarray, lengths: np.ndarray, shortest: int) -> Iterator[tuple[int, int, int]]:
    """``(length, occurrences, one start)`` of every maximal repeat of ``shortest`` words or more.

    ``starts`` is, for each word, where its text begins; the start of a text differs from any word.
    """
    stack: list[list[int]] = []
    # The word before a suffix, the word's own place below 0 for the first of a text.
    lead = np.where(order > starts[order], symbols[np.maximum(order - 1, 0)], -2 - order)
    for spot, left, length in _zipped(order, lead, np.append(lengths[1:], 0)):
        count = 1
        while stack and stack[-1][0] > length:
            top = stack.pop()
            left, count = (left if left == top[1] else -1), count + top[2]
            if left == -1 or count < 2:
                yield top[0], count, spot
        if length >= shortest:
            if stack and stack[-1][0] == length:
                stack[-1][1] = left if left == stack[-1][1] else -1
                stack[-1][2] += count
            else:
                stack.append([length, left, count])


@dataclass
class Repeats:
    """What the repeats of one text come to."""

    words: int = 0
    chars: int = 0
    longest: int = 0
    maximal: int = 0


def repeats(texts: list[tuple[np.ndarray, np.ndarray]], shortest: int = MIN_REPEAT) -> list[Repeats]:
    """Repeats of each text, given as the numbers of its words and the characters of each word."""
    sizes = [len(words) for words, _ in texts]
    total = sum(sizes)
    out = [Repeats() for _ in texts]
    if not total:
        return out
    bounds = np.cumsum([0, *sizes])
    text = np.repeat(np.arange(len(texts)), sizes)
    distinct = np.cumsum([0, *(int(words.max()) + 1 if len(words) else 0 for words, _ in texts)])
    symbols = np.concatenate([words for words, _ in texts]) + distinct[text]
    starts, ends = bounds[text], bounds[text + 1]
    order, group, shared = suffixes(symbols, ends, shortest)
    if not len(order):
        return out
    lengths = common_prefixes(symbols, ends, order, group, shared)
    lengths[lengths < shortest] = 0
    deepest = np.maximum(lengths, np.concatenate([lengths[1:], [0]]))
    edges = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edges, order, deepest > 0)
    np.subtract.at(edges, order + deepest, deepest > 0)
    covered = np.cumsum(edges[:-1]) > 0
    chars = np.concatenate([c for _, c in texts])
    words_in = np.bincount(text[covered], minlength=len(texts))
    chars_in = np.bincount(text[covered], weights=chars[covered], minlength=len(texts))
    longest = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(longest, text[order], lengths)
    maximal = np.zeros(len(texts), dtype=np.int64)
    for _, _, start in intervals(symbols, starts, order, lengths, shortest):
        maximal[text[start]] += 1
    for k, found in enumerate(out):
        found.words, found.chars, found.longest, found.maximal = int(words_in[k]), int(chars_in[k]), int(longest[k]), int(maximal[k])
    return out


def numbered_words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Number and code points of each word of a whole text; equal words have equal numbers."""
    known: dict[bytes, int] = {}
    numbers = [np.zeros(0, dtype=np.int64)]
    for piece in pieces(text.encode()):
        words = piece.split()
        numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words)))
    lengths = np.array([len(w.decode()) for w in known], dtype=np.int64)
    every = np.concatenate(numbers)
    return every, lengths[every] if len(lengths) else every


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    seen: set[str] = set()
    found, at = 0, 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if line in seen:
            found += 1
        elif line.encode().strip():
            seen.add(line)
        at = end + 1
    return found


def measures(texts: list[str | None], shortest: int = MIN_REPEAT) -> list[list[int]]:
    """One list for each of ``FIELDS``."""
    out: list[list[int]] = [[] for _ in FIELDS]
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def settle() -> None:
        for found in repeats(held, shortest):
            for column, value in zip(out[4:], (found.words, found.chars, found.longest, found.maximal)):
                column.append(value)
        held.clear()

    for text in texts:
        text = text or ""
        held.append(numbered_words(text))
        size += len(held[-1][0])
        counts = (len(held[-1][0]), int(held[-1][1].sum()), sum(map(text.count, SYMBOLS)), repeated_lines(text))
        for column, value in zip(out, counts):
            column.append(value)
        if size >= SLICE:
            settle()
            size = 0
    settle()
    return out


def quality(
    df: DataFrame,
    text_col: str = "text",
    keep: list[str] | None = None,
    shortest: int = MIN_REPEAT,
    min_words: int = MIN_WORDS,
    max_repeat_words: tuple[int, int] = MAX_REPEAT_WORDS,
    max_covered: tuple[int, int] = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """``df`` with the measures of ``FIELDS``, ``base_failed`` and ``kept``, without a shuffle.

    ``covered_chars`` are the code points of the words inside repeats of ``shortest`` words or more,
    ``longest_repeat`` the words of the longest one (its two places may overlap) and ``n_repeats``
    counts the maximal ones.  A text is kept unless the base rule fails it, repeats cover more than
    ``max_covered`` of its characters, or one is longer than ``max_longest`` words.  A null or empty
    text has no words and fails.  Whole texts of any length count; repeated rows get the same result;
    an empty table gives an empty one.  ``keep`` names the columns that stay (default: all); those
    named like an added one are replaced.
    """
    fields = [(name, T.LongType()) for name in FIELDS]
    measured = add_columns(df, text_col, fields, lambda texts: measures(texts, shortest), keep)
    part, whole = max_repeat_words
    failed = (F.col("n_words") < min_words) | (whole * F.col("n_repeat_words") > part * F.col("n_words"))
    much = max_covered[1] * F.col("covered_chars") > max_covered[0] * F.col("word_chars")
    return measured.withColumns({"base_failed": failed, "kept": ~failed & ~much & (F.col("longest_repeat") <= max_longest)})
