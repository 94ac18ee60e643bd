"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are runs of two to four characters of a lower-cased word, its borders included.  They are
hashed to rows of an embedding table; a text is the average of its subwords' rows, and a softmax
over a linear layer gives the languages.  Both layers are learned by stochastic gradient descent.
Because everything behind the look-up is linear, prediction uses one table of subword by language.

Training reads a bounded sample: at most ``per_language`` whole texts of each language, chosen by
a hash of their id, each as subword counts, so what reaches the driver is bounded by that number
and the size of the table.  A fifth of the sample is left out of the descent and calibrates the
scores: a temperature makes them probabilities.  When fewer predictions than the wanted share are
right, the rejection threshold cuts off the low scores among which wrong answers outnumber right
ones; wrong labels, which have scores of any height, do not move it up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civictopics.llm.common import add_columns
from civictopics.storage import cut

BUCKETS = 1 << 16
LENGTHS = (2, 3, 4)
# Texts are read in slices of so many characters; no subword runs from one slice into the next.
SLICE = 1 << 18
PER_LANGUAGE = 300
WIDTH = 16
EPOCHS = 6
RATE = 0.5
RIGHT = 0.99
FOLDS = 5

_SPACE = np.uint32(32)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def slices(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(characters, starts, rows)`` of about ``SLICE`` characters at a time.

    Characters that are no letters are spaces; each piece of a text begins and ends with one.
    """
    pieces, rows, held = [], [], 0
    for row, text in enumerate(texts):
        lower = (text or "").lower()
        for at in range(0, max(1, len(lower)), SLICE):
            piece = lower[at : at + SLICE]
            pieces.append(piece)
            rows.append(row)
            held += len(piece)
            if held >= SLICE:
                yield _joined(pieces, rows)
                pieces, rows, held = [], [], 0
    if pieces:
        yield _joined(pieces, rows)


def _joined(pieces: list[str], rows: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer((" " + "  ".join(pieces) + " ").encode("utf-32-le"), dtype=np.uint32)
    starts = np.cumsum([0, *(len(p) + 2 for p in pieces[:-1])])
    return np.where(letters()[raw], raw, _SPACE), starts, np.array(rows)


def subwords(characters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length ``(buckets, real)``, by the place of the first character; ``real`` marks subwords."""
    letter = characters != _SPACE
    hashed, inner = characters * np.uint32(2654435761), None
    for n in range(2, max(LENGTHS) + 1):
        if len(characters) < n:
            return
        hashed = (hashed[:-1] ^ (hashed[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + characters[n - 1 :]
        if n == 2:
            real, inner = letter[:-1] | letter[1:], np.ones(len(letter) - 1, dtype=bool)
        else:
            inner = inner[:-1] & letter[n - 2 : -1]
            real = inner
        if n in LENGTHS:
            mixed = (hashed ^ (hashed >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            yield (mixed >> np.uint32(16)) % np.uint32(BUCKETS), real


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """``(buckets, counts)`` of the subwords of one text."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for characters, _, _ in slices([text]):
        for buckets, real in subwords(characters):
            total += np.bincount(buckets[real], minlength=BUCKETS)
    used = np.flatnonzero(total)
    return used, total[used]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    threshold: float

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(probabilities by language, whether there is a letter)`` for each text."""
        sums = np.zeros((len(texts), len(self.languages)))
        number, lettered = np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        for characters, starts, rows in slices(texts):
            np.logical_or.at(lettered, rows, np.logical_or.reduceat(characters != _SPACE, starts))
            for buckets, real in subwords(characters):
                inside = starts < len(buckets)
                weights = self.table[buckets]
                weights[~real] = 0
                np.add.at(sums, rows[inside], np.add.reduceat(weights, starts[inside], axis=0, dtype=np.float64))
                np.add.at(number, rows[inside], np.add.reduceat(real, starts[inside], dtype=np.int64))
        return softmax(sums / np.maximum(number, 1)[:, None] + self.bias), lettered


def softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return shifted / shifted.sum(axis=-1, keepdims=True)


def descend(examples: list, n_languages: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stochastic gradient descent over ``(language, buckets, shares)``: embeddings, layer, bias."""
    random = np.random.default_rng(seed)
    embeddings = random.uniform(-1, 1, (BUCKETS, WIDTH)) / WIDTH
    layer, bias = random.normal(0, 0.1, (WIDTH, n_languages)), np.zeros(n_languages)
    steps, done = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for place in random.permutation(len(examples)):
            language, buckets, shares = examples[place]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = shares @ embeddings[buckets]
            error = softmax(hidden @ layer + bias)
            error[language] -= 1
            back = layer @ error
            layer -= rate * np.outer(hidden, error)
            bias -= rate * error
            # Scaled up, because an average spreads its gradient thinly over its subwords.
            embeddings[buckets] -= rate * 20 * shares[:, None] * back
    return embeddings, layer, bias


def calibrate(logits: np.ndarray, truth: np.ndarray, right: float) -> tuple[float, float]:
    """``(temperature, threshold)`` from examples that the descent has not seen."""
    if not len(truth):
        return 1.0, 0.0
    rows = np.arange(len(truth))
    temperatures = np.geomspace(0.05, 20, 61)
    losses = [-np.log(softmax(logits / t)[rows, truth] + 1e-12).mean() for t in temperatures]
    temperature = float(temperatures[int(np.argmin(losses))])
    chances = softmax(logits / temperature)
    best = chances.max(axis=1)
    order = np.argsort(best, kind="stable")
    hits = (chances.argmax(axis=1) == truth)[order]
    if hits.mean() >= right:
        return temperature, 0.0
    # By how much wrong answers outnumber right ones among the lowest scores.
    excess = np.concatenate([[0], np.cumsum(np.where(hits, -1, 1))])
    rejected = int(np.argmax(excess))
    # Nothing rejected: wrong answers are no more frequent among low scores.
    return temperature, float(best[order[min(rejected, len(hits) - 1)]]) if rejected else 0.0


def held_out(id_col: Column) -> Column:
    """Rows that learning never sees: crc32 of the id as text is a multiple of five; a null id is ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % FOLDS == 0


def sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """``(lang, mark, buckets, counts)``, at most ``per_language`` texts of each language.

    Texts whose hash is above the share of their language that is needed, twice over, are left out
    before the ranking, so a language with most of the rows is not ranked as a whole.
    """
    labelled = df.select(
        df[lang_col].cast("string").alias("lang"), df[text_col].cast("string").alias("text"),
        F.xxhash64(df[id_col]).alias("mark"), held_out(df[id_col]).alias("out"),
    ).filter("not out and lang is not null and text is not null")
    # Written first, so that Spark sees how small it is and does not move the texts for it.
    sizes = cut(labelled.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    wanted = F.least(F.lit(1.0), 2.0 * (per_language + 20) / F.col("rows")) * float(1 << 31)
    few = labelled.join(sizes, "lang").filter(F.pmod("mark", F.lit(1 << 31)) < wanted)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
    chosen = few.withColumn("place", place).filter(F.col("place") <= per_language).select("lang", "mark", "text")
    fields = [("buckets", T.ArrayType(T.IntegerType())), ("counts", T.ArrayType(T.LongType()))]

    def compute(texts):
        found = [counts(t) for t in texts]
        ends = np.cumsum([0, *(len(b) for b, _ in found)], dtype="int32")
        flat = [np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in (0, 1)]
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(t)))
                for v, t in zip(flat, ("int32", "int64"))]

    return add_columns(chosen, "text", fields, compute, keep=["lang", "mark"])


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE, right: float = RIGHT, seed: int = 0) -> LanguageModel | None:
    """A model of the labelled rows that are not held out; ``None`` when they have no letters."""
    rows = [
        (r.lang, r.mark, np.array(r.buckets), np.array(r.counts, dtype=float))
        for r in sample(df, id_col, text_col, lang_col, per_language).collect() if r.buckets
    ]
    rows.sort(key=lambda r: (r[0], r[1]))
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    random, seen, unseen = np.random.default_rng(seed), [], []
    for place, (lang, _, buckets, number) in enumerate(rows):
        language = languages.index(lang)
        (unseen if place % 5 == 4 else seen).append((language, buckets, number / number.sum()))
        # A few of its subwords stand for a short text of the same language.
        short = np.unique(random.choice(buckets, size=min(len(buckets), 30), p=number / number.sum()))
        (unseen if place % 5 == 4 else seen).append((language, short, np.full(len(short), 1 / len(short))))
    embeddings, layer, bias = descend(seen, len(languages), seed)
    table = embeddings @ layer
    logits = np.array([shares @ table[buckets] + bias for _, buckets, shares in unseen]).reshape(-1, len(languages))
    temperature, threshold = calibrate(logits, np.array([u[0] for u in unseen], dtype=int), right)
    return LanguageModel(
        tuple(languages), (table / temperature).astype(np.float32), bias / temperature, threshold
    )


def identify(df: DataFrame, model: LanguageModel | None, text_col: str = "text",
             keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``rejected``, from whole texts alone.

    Null texts and those without a letter are ``und`` with score 0 and rejected.  Other texts get
    the most likely language with its probability, ties to the first by name, and are rejected
    below the model's threshold.  Without a model (no labels to learn from) they are ``und`` with
    score 0 and not rejected.  Equal texts get equal results.  Input columns with these three
    names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())]

    def compute(texts):
        known = shared.value
        if known is None:
            blank = [not any(map(str.isalpha, t or "")) for t in texts]
            return [["und"] * len(texts), [0.0] * len(texts), blank]
        chances, lettered = known.scores(texts)
        best = chances.argmax(axis=1) if len(texts) else np.zeros(0, dtype=int)
        score = np.where(lettered, chances.max(axis=1, initial=0.0), 0.0)
        names = [known.languages[b] if ok else "und" for b, ok in zip(best, lettered)]
        return [names, score, ~lettered | (score < known.threshold)]

    return add_columns(df, text_col, fields, compute, keep)
