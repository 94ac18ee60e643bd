"""Importance resampling towards a target distribution, on hashed word n-grams.

Separators are collapsed to single spaces, and one overlapped scan of a regular expression gives the
n-grams that start at each word; lookarounds keep a match from starting inside a word.  The CRC of
an n-gram goes on from the CRC of the one that is a word shorter.  A text is scanned once: its
buckets are written, counted over all texts, and weighed by the gains of the buckets.

Each document gets the sum of its features' gains plus Gumbel noise from a hash of its id, so that the
highest scores are a draw without replacement.  Ranks come from a sort by ranges: the place inside a
range plus the rows of the ranges before it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civictopics.llm.common import add_columns, parts
from civictopics.storage import cut

LONGEST = 3
BUCKETS = 10_000
MIN_WORDS = 20
SHARE = (5, 100)
SEED = 42
# Features of a long text that are held as Python numbers at a time.
HELD = 1 << 16

# Digits, letters and everything beyond ASCII stay, A-Z become a-z, all else separates words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_RUNS = re.compile(rb" {2,}")


def n_gram_pattern(longest: int) -> regex.Pattern:
    """At the start of each word: it, and up to ``longest - 1`` words after it, each in a group."""
    return regex.compile(rb"(?<![^ ])([^ ]++)" + rb"( [^ ]++)?+" * (longest - 1) + rb"(?![^ ])")


def feature_buckets(text: str | None, pattern: regex.Pattern, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words of a whole text, and the bucket of each feature, repeats included."""
    line = _RUNS.sub(b" ", (text or "").encode().translate(_WORDS)).strip(b" ")
    crc, words, held, done = zlib.crc32, 0, [], []
    for found in pattern.finditer(line, overlapped=True):
        value = 0
        for more in found.groups():
            if more is None:
                break
            value = crc(more, value)
            held.append(value)
        words += 1
        if len(held) >= HELD:
            done.append((np.array(held, dtype=np.uint32) % buckets).astype(np.uint16))
            held = []
    done.append((np.array(held, dtype=np.uint32) % buckets).astype(np.uint16))
    return words, np.concatenate(done)


def with_features(df: DataFrame, text_col: str, longest: int, buckets: int, keep: list[str]) -> DataFrame:
    """Adds ``n_words``, ``n_features`` and ``features``, the buckets as little-endian 16-bit numbers."""
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("buckets must be between 1 and 65536")

    def compute(texts):
        pattern = n_gram_pattern(longest)
        found = [feature_buckets(t, pattern, buckets) for t in texts]
        return [n for n, _ in found], [len(f) for _, f in found], [f.astype("<u2").tobytes() for _, f in found]

    fields = [("n_words", T.LongType()), ("n_features", T.LongType()), ("features", T.BinaryType())]
    return add_columns(df, text_col, fields, compute, keep)


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket; each task sends at most one row for a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in parts(batches):
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer() or b"", dtype="<u2"), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["bucket", "n"])

    rows = features.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, dtype=np.int64)
    for bucket, n in rows.collect():
        total[bucket] = n
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths: the logarithm of how much commoner it is in the target."""
    size, goal = float(raw.sum() + len(raw)), float(target.sum() + len(target))
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * size / ((s + 1.0) * goal))) for s, t in zip(raw.tolist(), target.tolist())],
        dtype=np.int64,
    )


def _weighed(features: DataFrame, table: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            values = [int(table[np.frombuffer(v.as_buffer() or b"", dtype="<u2")].sum()) for v in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(values, pa.int64())],
                                             names=["id", "n_words", "n_features", "weight"])

    kept = features.select("id", "n_words", "n_features", "features")
    schema = T.StructType([*kept.schema.fields[:3], T.StructField("weight", T.LongType())])
    return kept.mapInArrow(run, schema)


def scored(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    share: tuple[int, int] = SHARE,
    seed: int = SEED,
) -> DataFrame:
    """``(id, n_words, n_features, weight, score, rank)`` for every row of ``df``.

    ``rank`` counts the drawn rows from 1; it is null for the others.  Drawn is the share
    ``share[0] / share[1]``, rounded down, of the rows with ``min_words`` words or more.  Ties go to
    the smaller id, a null id first; equal ids with equal scores are ranked one after the other.  A
    null or empty text has no features and weight 0.  Whole texts of any length count.  Without a
    target text all gains come from the smoothing; an empty ``df`` gives an empty result.  Other
    columns are not read, so their names cannot clash.
    """
    source = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    features = cut(with_features(source, "text", longest, buckets, keep=["id"]), "importance-features")
    goal = target.select(target[target_text_col].cast("string").alias("text"))
    table = gains(
        bucket_counts(features, buckets),
        bucket_counts(with_features(goal, "text", longest, buckets, keep=[]), buckets),
    )
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    mark = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((mark + 0.5) / 4294967296.0)))
    weighed = cut(_weighed(features, table).withColumn("score", F.col("weight") + noise), "importance-weights")
    return ranked(weighed, F.col("n_words") >= min_words, share)


def ranked(weighed: DataFrame, able, share: tuple[int, int]) -> DataFrame:
    """Adds ``rank`` to the highest scores among the rows that are ``able`` to be drawn."""
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_first("id")]
    sorted_rows = weighed.withColumn("able", able).repartitionByRange(*order).sortWithinPartitions(*order)
    # The number of the range above bit 33, the place inside it below.
    placed = cut(sorted_rows.withColumn("place", F.monotonically_increasing_id()), "importance-ranks")
    part = F.shiftright("place", 33).alias("part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("rows"), F.count_if("able").alias("able_rows"))
    # As many rows as the sort has ranges.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sizes.select("part", "able_rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("begun")), "importance-ranges")
    drawn = (offsets.agg(F.sum("able_rows")).first()[0] or 0) * share[0] // share[1]
    rank = F.col("begun") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("part", part).join(offsets, "part").select(
        "id", "n_words", "n_features", "weight", "score", F.when(F.col("able") & (rank <= drawn), rank).alias("rank")
    )


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows of ``df`` that are drawn, with all their columns; ``id_col`` should be a key."""
    chosen = scored(df, target, id_col, **settings).filter("rank is not null").select(F.col("id").alias("drawn id"))
    return df.join(chosen, df[id_col].eqNullSafe(chosen["drawn id"]), "left_semi")
