"""Dense vector work inside tasks: Arrow batches in, Arrow batches out.

Spark partitions the rows and moves the data; these helpers only do the arithmetic of one batch
with NumPy.  Each function returns a column function.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


# Rows of a batch that are worked on at a time, so that a task's memory follows these and not its batches.
ROWS_AT_A_TIME = 512


def hash_number(word: Column) -> Column:
    """The first eight MD5 digits of a word as a number, which choose its frequency bucket."""
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long")


def hashed_vectors(
    spark: SparkSession, idf: np.ndarray, dim: int, salt: str = ""
) -> Callable[[Column], Column]:
    """Tokens -> signed hashed TF-IDF vector of ``dim`` numbers with length 1.

    A word's MD5 gives its frequency bucket (digits 1-8), its slot (9-16) and its sign (17).  A
    ``salt`` changes slots and signs only.  A text without tokens becomes the zero vector.
    """
    shared = spark.sparkContext.broadcast(idf)

    def embed(tokens: pa.Array) -> pa.Array:
        import hashlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        weights, n = shared.value, len(tokens)
        coded = tokens.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        plain = [hashlib.md5(word.encode()).hexdigest() for word in words]
        salted = plain if not salt else [
            hashlib.md5((salt + word).encode()).hexdigest() for word in words
        ]
        bucket = np.array([int(d[:8], 16) for d in plain], dtype=np.int64) % len(weights)
        slot = np.array([int(d[8:16], 16) for d in salted], dtype=np.int64) % dim
        weight = weights[bucket] * np.array([1.0 if d[16] < "8" else -1.0 for d in salted])
        del words, plain, salted, bucket
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        unit = np.empty((n, dim))
        for lo in range(0, n, ROWS_AT_A_TIME):
            size = lengths[lo : lo + ROWS_AT_A_TIME]
            first, last = ends[lo] - lengths[lo], ends[lo + len(size) - 1]
            code = coded.indices[first:last].to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            sums = np.bincount(
                row * dim + slot[code], weights=weight[code], minlength=len(size) * dim
            ).astype(np.float64).reshape(len(size), dim)
            norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            unit[lo : lo + len(size)] = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)
        return pa.ListArray.from_arrays(
            np.arange(0, n * dim + 1, dim, dtype=np.int32), unit.ravel()
        )

    return F.arrow_udf(embed, returnType="array<double>")


def projected(matrix: np.ndarray) -> Callable[[Column], Column]:
    """Vector -> vector times ``matrix`` (its size is the model's, not the data's)."""

    def project(vectors: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa

        n, (rows, columns) = len(vectors), matrix.shape
        out = vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, rows) @ matrix
        return pa.ListArray.from_arrays(
            np.arange(0, n * columns + 1, columns, dtype=np.int32), out.ravel()
        )

    return F.arrow_udf(project, returnType="array<double>")


def nearest_of(spark: SparkSession, block: tuple[np.ndarray, np.ndarray]) -> Callable[[Column], Column]:
    """Vector -> ``struct<topic, sim>`` of the most similar row of ``block (ids, vectors)``.

    Similarities are rounded before they are compared; ties go to the first row.
    """
    ids, vectors = block
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    shared = spark.sparkContext.broadcast((ids, np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)))

    def best(vectors: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa

        ids, unit = shared.value
        topic, sim = np.empty(len(vectors), dtype=np.int64), np.empty(len(vectors))
        for lo in range(0, len(vectors), ROWS_AT_A_TIME):
            part = vectors.slice(lo, ROWS_AT_A_TIME)
            x = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), unit.shape[1])
            length = np.sqrt((x * x).sum(axis=1, keepdims=True))
            x = np.divide(x, length, out=np.zeros_like(x, dtype=np.float64), where=length > 0)
            sims = np.round(x @ unit.T, 9)
            at = sims.argmax(axis=1)
            topic[lo : lo + len(part)], sim[lo : lo + len(part)] = ids[at], sims[np.arange(len(at)), at]
        return pa.StructArray.from_arrays([pa.array(topic), pa.array(sim)], ["topic", "sim"])

    return F.arrow_udf(best, returnType="struct<topic:bigint,sim:double>")


def sum_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two array columns of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def length_of(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))
