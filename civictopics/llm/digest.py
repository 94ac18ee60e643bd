"""Quartile bucket digests of documents, and their likeness.

The byte triplets of a text are hashed to 256 buckets and counted.  The digest holds the length,
on a scale of eighths of a doubling, and for each bucket in which quarter of all counts its own
lies, two bits each.  The difference of two digests sums the steps between quarters and adds a
share for the lengths; likeness is 1 less this difference, as a share of what unrelated digests
have, and at least 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from civictopics.storage import cut

BUCKETS = 256
# Mean steps between the quarters of two unrelated buckets are 5/4.
UNRELATED = BUCKETS * 5 / 4
LENGTH_STEPS = 64
SLICE = 1 << 22

_SHIFTS = np.array([0, 2, 4, 6], dtype=np.uint8)


def digest(data: bytes) -> np.ndarray:
    """65 bytes: length, then the quarters of 256 buckets.  Fewer than three bytes have no triplet."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, max(0, len(data) - 2), SLICE):
        part = np.frombuffer(data, dtype=np.uint8, count=min(SLICE + 2, len(data) - at), offset=at).astype(np.uint32)
        hashed = part[:-2] * np.uint32(0x9E3779B1) + part[1:-1] * np.uint32(0x85EBCA77) + part[2:] * np.uint32(0xC2B2AE3D)
        hashed ^= hashed >> np.uint32(15)
        total += np.bincount((hashed * np.uint32(0x27D4EB2F)) >> np.uint32(24), minlength=BUCKETS)
    ordered = np.sort(total)
    quarters = sum((total > ordered[BUCKETS * k // 4 - 1]).astype(np.uint8) for k in (1, 2, 3))
    packed = (quarters.reshape(-1, 4) << _SHIFTS).sum(axis=1).astype(np.uint8)
    length = min(255, round(8 * float(np.log2(len(data) + 1))))
    return np.concatenate([np.array([length], dtype=np.uint8), packed])


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """1 for equal digests, 0 for those at least as different as unrelated ones."""
    quarters = [((d[1:, None] >> _SHIFTS) & 3).astype(np.int64) for d in (one, other)]
    steps = np.abs(quarters[0] - quarters[1]).sum() / UNRELATED
    length = abs(int(one[0]) - int(other[0])) / LENGTH_STEPS
    return max(0.0, 1.0 - float(steps) - min(1.0, length) / 4)


RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType()),
])
# What a partition passes on: finished rows, and its first and last document with their texts.
PASSED = T.StructType([*RESULT.fields, T.StructField("part", T.IntegerType()),
                       T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])


def compare(doc_id, text: str, own: np.ndarray, next_text: str, next_digest: np.ndarray) -> tuple:
    """The result row of a document and the one after it."""
    swapped = len(text) // 4
    data = (text[: len(text) - swapped] + next_text[:swapped]).encode()
    edited = digest(data)
    return (doc_id, len(text), hashlib.sha256(data).hexdigest(), own.tobytes().hex(), edited.tobytes().hex(),
            likeness(own, edited), likeness(own, next_digest))


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    fields = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of all documents of a sorted partition but the last, and its two ends."""
    part, before = TaskContext.get().partitionId(), None
    blank = (None,) * len(RESULT.fields)
    for batch in batches:
        rows = []
        for doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
            own = digest(text.encode())
            if before is None:
                rows.append((doc_id, *blank[1:], part, "first", text))
            else:
                rows.append((*compare(*before, text, own), part, "row", None))
            before = (doc_id, text, own)
        yield _batch(rows, PASSED)
    if before is not None:
        yield _batch([(before[0], *blank[1:], part, "last", before[1])], PASSED)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3)]
        yield _batch([compare(i, t, digest(t.encode()), n, digest(n.encode())) for i, t, n in zip(*columns)], RESULT)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of every whole text and of its edited text, and three likenesses.

    The edited text has its last quarter of characters (rounded down) replaced by as many of the
    next document's first, or all of them; next is by ascending id, and after the last comes the
    first.  Null texts are empty; null ids come first; rows of one id follow a hash of their texts
    (those with equal texts are alike).  A table of one document compares it with itself; an empty
    one gives nothing.  Other columns are not read.

    Texts move once, into ranges of ids.  A partition finishes all documents but its last, whose
    next one lies elsewhere; only the first and last document of each partition meet again.
    """
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    docs = df.select(df[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    ordered = docs.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark")
    passed = cut(ordered.select("doc_id", "text").mapInArrow(_within, PASSED), "digests")
    first, last = passed.filter("kind = 'first'"), passed.filter("kind = 'last'")
    order = Window.orderBy("part")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = first.select(
        "part", F.coalesce(F.lead("part").over(order), F.min("part").over(everything)).alias("next_part")
    )
    heads = first.select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    ends = last.select("part", "doc_id", "text").join(following, "part").join(heads, "next_part")
    finished = ends.select("doc_id", "text", "next_text").mapInArrow(_across, RESULT)
    return passed.filter("kind = 'row'").select(RESULT.names).unionByName(finished)
